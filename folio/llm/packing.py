"""Packing documents into sequences: best fit, then swap-based local search.

Documents become token ids plus an end token; only those longer than a sequence are cut,
with the shorter piece first, so all their other pieces are full sequences. The pieces left
are dealt by a hash into pools of about POOL pieces, each packed as a task of its own:

1. best fit in falling order of length;
2. local search among the underfull bins: while it raises the sum of squared fills, a
   document moves from an emptier bin to a fuller one, or one or two documents of the
   emptier bin are exchanged for a shorter one of the fuller bin. The emptiest bin is worked on
   until it is empty or nothing more can leave it.

The bins that are still far from full are pooled again over coarser pools, until one pool is
left, so what each pool wastes does not add up with the size of the collection.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.runtime import cut, table

CAPACITY = 2048
END_ID = 0
POOL = 2048
TOKENIZER = "byte_bpe_50k"
#: Entries of a worker's word cache; it is emptied when full, which changes speed only.
CACHE = 1_000_000


class Encoder:
    """Ids of whole texts, by words.

    The vocabulary's pattern never joins what stands before a single space to what
    stands after it, nor a letter to a punctuation mark other than an apostrophe. So a text is cut at its
    single spaces, a word loses the marks at its end, and each word and each run of marks is
    encoded once per worker. Words of Latin letters and ASCII go to the fast encoder of the same
    vocabulary; all others, and those with the text of a special token, to the
    tokenizer itself.
    """

    #: Marks that a word can lose.
    MARKS = ".,;:!?&%$#*|)]}\"-"

    def __init__(self, name: str = TOKENIZER) -> None:
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, specials)) or r"(?!)")
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.single_space = re.compile(r"(?<=\S) (?=\S)")
        self.latin = re.compile("[\0-\x7fÀ-ÖØ-öø-ɏ]*")
        self.cache: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def _encode(self, word: str) -> bytes:
        if self.latin.fullmatch(word) and not self.special.search(word):
            ids = self.fast.encode_ordinary(word)
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, word: str) -> None:
        """Put a word that stands after a space into the cache."""
        core = word.rstrip(self.MARKS)
        if core and core != word and core[-1].isalpha() and not self.special.search(word):
            marks = word[len(core) :]
            if marks not in self.marks:
                self.marks[marks] = self._encode(marks)
            ids = self.cache.get(core)
            if ids is None:
                ids = self.cache[core] = self._encode(" " + core)
            self.cache[word] = ids + self.marks[marks]
        else:
            self.cache[word] = self._encode(" " + word)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of `text`."""
        first, *rest = text.split(" ")
        known = list(map(self.cache.get, rest))
        if None in known or not first or first[0].isspace() or first[-1].isspace():
            missing = {w for w, k in zip(rest, known) if k is None}
            if not first or first[0].isspace() or first[-1].isspace() or any(not w or w[0].isspace() or w[-1].isspace() for w in missing):
                # Some spaces stand in runs of white space: cut only at the single ones.
                first, *rest = self.single_space.split(text)
                missing = {w for w in rest if w not in self.cache}
            edge = [w for w in rest[-1:] if w[-1].isspace()]  # white space at the end of the text is no word's property
            if len(self.cache) > CACHE:
                self.cache.clear()
                self.marks.clear()
                missing = set(rest)
            for w in missing.difference(edge):
                self._learn(w)
            known = [self.cache[w] for w in rest[: len(rest) - len(edge)]] + [self._encode(" " + w) for w in edge]
        return self._encode(first) + b"".join(known) if first else b"".join(known)


def cut_points(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: only the first may be shorter than the capacity."""
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row; null texts are empty."""
    fields = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        end = np.array([END_ID], "<u4").tobytes()
        for part in parts:
            rows = []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                ids = encoder.encode(text.as_py() or "") + end
                for number, (start, length) in enumerate(cut_points(len(ids) // 4)):
                    rows.append((doc_id, number, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            columns = zip(*rows) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(batches, fields)


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of positions in `lengths`: each piece, longest first, goes where it leaves the least room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if some bin has room r
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = rooms >> lengths[i]
        if fits:
            room = lengths[i] + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        left = room - lengths[i]
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins


def _best_exchange(donor: list[int], receiver: list[int], room: int, lengths: list[int]) -> tuple[int, tuple[int, ...], int | None]:
    """Largest gain of the receiver: (gain, pieces that come, piece that goes or None)."""
    best: tuple[int, tuple[int, ...], int | None] = (0, (), None)
    singles = [((i,), lengths[i]) for i in donor]
    pairs = [((i, j), lengths[i] + lengths[j]) for n, i in enumerate(donor) for j in donor[n + 1 :]]
    for i, size in singles:
        if best[0] < size <= room:
            best = (size, i, None)
    for out in receiver:
        for come, size in singles + pairs:
            if best[0] < size - lengths[out] <= room:
                best = (size - lengths[out], come, out)
    return best


def local_search(bins: list[list[int]], lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Empty underfull bins by moves and exchanges; every step raises the sum of squared fills."""
    fills = [sum(lengths[i] for i in b) for b in bins]
    stuck: set[int] = set()
    room = sum(capacity - f for f in fills)
    while True:
        open_bins = [b for b, f in enumerate(fills) if 0 < f < capacity]
        donors = [b for b in open_bins if b not in stuck]
        if not donors:
            break
        donor = min(donors, key=lambda b: (fills[b], b))
        # What it holds must fit into the room that the other bins have.
        if fills[donor] > room - (capacity - fills[donor]):
            break
        moved = True
        while moved and bins[donor]:
            moved = False
            for other in sorted(open_bins, key=lambda b: (-fills[b], b)):
                if other == donor or fills[other] < fills[donor] or fills[other] == capacity:
                    continue
                gain, come, out = _best_exchange(bins[donor], bins[other], capacity - fills[other], lengths)
                if gain:
                    bins[donor] = [i for i in bins[donor] if i not in come] + ([out] if out is not None else [])
                    bins[other] = [i for i in bins[other] if i != out] + list(come)
                    fills[donor] -= gain
                    fills[other] += gain
                    moved = True
                    if not bins[donor]:
                        break
        if bins[donor]:
            stuck.add(donor)
        else:
            room -= capacity
    return [b for b in bins if b]


def pack_pool(rows: pd.DataFrame) -> pd.DataFrame:
    """Bins of one pool: adds sequence (the smallest piece_no in it) and offset."""
    rows = rows.sort_values(["length", "piece_no"], ascending=[False, True], ignore_index=True)
    lengths = [int(n) for n in rows["length"]]
    bins = local_search(best_fit(lengths), lengths)
    sequence, offset, fill = [np.zeros(len(rows), np.int64) for _ in range(3)]
    number = rows["piece_no"].to_numpy()
    for b in bins:
        sizes = [lengths[i] for i in b]
        sequence[b] = number[b].min()
        offset[b] = np.cumsum([0, *sizes[:-1]])
        fill[b] = sum(sizes)
    return pd.DataFrame({"piece_no": number, "length": lengths, "sequence": sequence, "offset": offset, "fill": fill})


_PACKED = "piece_no bigint, length bigint, sequence bigint, offset bigint, fill bigint"


def pack(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(piece_no, sequence_id, offset) of every row of (piece_no unique, 0 < length <= capacity)."""
    full = lengths.filter(F.col("length") == capacity).select("piece_no", F.col("piece_no").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    rest = lengths.filter(F.col("length") < capacity)
    count = rest.count()
    settled = [full]
    while count:
        pools = max(1, round(count / POOL))
        pooled = rest.select("piece_no", "length", F.pmod(F.xxhash64("piece_no", F.lit(pools)), F.lit(pools)).alias("pool"))
        packed = cut(pooled.groupBy("pool").applyInPandas(pack_pool, _PACKED), "pools")
        if pools == 1:
            settled.append(packed.select("piece_no", F.col("sequence").alias("sequence_id"), "offset"))
            break
        # A bin more than a sixteenth empty is opened again beside those of other pools.
        loose = F.col("fill") < capacity - capacity // 16
        settled.append(packed.filter(~loose).select("piece_no", F.col("sequence").alias("sequence_id"), "offset"))
        rest = packed.filter(loose).select("piece_no", "length")
        left = rest.count()
        if left > count * 3 // 4:
            # Little is gained by pooling: most bins have no partner anywhere.
            settled.append(packed.filter(loose).select("piece_no", F.col("sequence").alias("sequence_id"), "offset"))
            break
        count = left
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def packed_documents(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Place of every piece of every row of `docs`.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty texts are the end
    token alone; repeated rows are packed each on their own; texts of any length are read
    whole; an empty table gives no rows. Columns other than doc_id and text are not read.
    """
    rows = cut(pieces(docs, tokenizer).withColumn("piece_no", F.monotonically_increasing_id()), "pieces")
    return rows.join(pack(rows.select("piece_no", "length")), "piece_no").drop("piece_no")


def op9_pack_sequences(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return packed_documents(table(spark, sf_dir, "documents"))
