"""Alignment of two tokenizers over a corpus, each distinct text once.

1. Documents are shuffled by their full text: a text is one row with its number of copies,
   however many documents hold it. Copies meet inside tasks before they move.
2. Each distinct text is tokenised by a byte-level BPE (A) and a piece BPE with byte fallback (B). Byte
   offsets at which tokens of both end cut it into groups. Every token has at least one byte,
   so one A and one B token end at such an offset: the group's link.
3. Links are counted by pair of ids over the corpus, each weighted by the copies of its text.
4. The counts go back to the texts' links. The commonest pairs, at most HEAD, are sent to all
   tasks: they hold the hot keys. Links of all other pairs, none of which is hot, meet their counts in a join.
5. A text's measures join the documents by the text's digest.

Both tokenizers cut words apart at a single space between two other characters: no pattern match of A and
no piece of B reaches over it. So words are tokenised one by one and remembered, and a text's tokens are aligned as arrays.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.runtime import cut, table

BYTE_BPE = "byte_bpe_50k"
PIECE_BPE = "piece_bpe_32k"
#: Pairs of ids whose counts are sent to all tasks, at most: a few megabytes.
HEAD = 1 << 17
#: Words of a worker's memory in each of its two generations, and the longest of them; they change speed only.
CACHE = 150_000
LONGEST = 64
#: Characters from which a word goes to the encoder whose time grows with n log n.
LONG_WORD = 1_000
#: Links after which a task hands on its rows.
BATCH_LINKS = 1_000_000

#: A and B tokens as little-endian 32-bit numbers, and whether both tokenizers give the bytes back.
Entry = tuple[bytes, bytes, bool]


class Aligner:
    """Aligned tokens of whole texts by the tokenizers' names."""

    def __init__(self, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(f"{byte_bpe}.json"))
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(public_tokenizers.path(f"{byte_bpe}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_a = {i: token for token, i in ranks.items()}
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(f"{piece_bpe}.model"))
        self.size_b = self.pieces.vocab_size()
        self.bytes_b = [self._piece_bytes(i) for i in range(self.size_b)]
        # A piece with a space after another character would reach over words: then texts are aligned whole.
        self.by_words = not any(b" " in token.lstrip(b" ") for token in self.bytes_b)
        self.single_space = re.compile(r"(?<=\S) (?=\S)")
        self.latin = re.compile("[\0-\x7fÀ-ÖØ-öø-ɏ]*")
        self.length_a, self.length_b = np.zeros(max(ranks.values()) + 1, np.int64), np.array(list(map(len, self.bytes_b)))
        for i, token in self.bytes_a.items():
            self.length_a[i] = len(token)
        # Each id as text, inside a list, at the end of a group's A tokens, at the end of a group.
        self.names = [b"%d%b" % (i, mark) for i in range(max(len(self.length_a), self.size_b)) for mark in (b",", b"|", b";")]
        self.cache: dict[str, Entry] = {}
        self.older: dict[str, Entry] = {}

    def _piece_bytes(self, i: int) -> bytes:
        piece = self.pieces.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(i) else piece.replace("▁", " ").encode()

    def encode_a(self, text: str) -> list[int]:
        if len(text) < LONG_WORD and self.latin.fullmatch(text):
            return self.fast.encode_ordinary(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def both(self, word: str) -> Entry:
        """Tokens of `word`, which stands after a space."""
        a, b = self.encode_a(" " + word), self.pieces.encode(word)
        whole = (" " + word).encode()
        sound = b"".join([self.bytes_a[i] for i in a]) == whole and b"".join([self.bytes_b[i] for i in b]) == whole
        return struct.pack(f"<{len(a)}i", *a), struct.pack(f"<{len(b)}i", *b), sound

    def known(self, word: str) -> Entry | None:
        """What is remembered of `word`; the words met since the last change of generations stay."""
        entry = self.older.get(word)
        if entry is not None:
            self.remember(word, entry)
        return entry

    def remember(self, word: str, entry: Entry) -> None:
        if len(self.cache) >= CACHE:
            self.cache, self.older = {}, self.cache
        self.cache[word] = entry

    def entries(self, text: str) -> list[Entry]:
        """Entries of the parts of `text` that can be aligned on their own; a single space stands before each."""
        words = text.split(" ") if self.by_words else [text]
        found = list(map(self.cache.get, words))
        if None not in found:
            return found
        if self.by_words and any(e is None and (not w or w[0].isspace() or w[-1].isspace()) for w, e in zip(words, found)):
            # Some spaces stand in runs of white space: cut only at the single ones.
            words = self.single_space.split(text)
            found = list(map(self.cache.get, words))
        for i, word in enumerate(words):
            if found[i] is None:
                found[i] = self.cache.get(word) or self.known(word)
                if found[i] is None:
                    found[i] = self.both(word)
                    # Words with white space at an edge are not remembered: a text of remembered words was cut at single spaces.
                    if word and len(word) <= LONGEST and not word[0].isspace() and not word[-1].isspace():
                        self.remember(word, found[i])
        return found

    def text(self, text: str | None) -> tuple[int, int, int, str, np.ndarray]:
        """(n_a, n_b, n_groups, groups_sha256, links) of a whole text; zeros where it has no tokens."""
        if text:
            tokens_a, tokens_b, sound = zip(*self.entries(text))
            if all(sound):
                return self.align(np.frombuffer(b"".join(tokens_a), "<i4"), np.frombuffer(b"".join(tokens_b), "<i4"))
        return 0, 0, 0, "", np.zeros(0, np.int64)

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, str, np.ndarray]:
        """Groups and links of two token lists over the same bytes."""
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        at = np.searchsorted(end_b, end_a)
        closes_a = end_b[at] == end_a
        last_a, last_b = np.flatnonzero(closes_a), at[closes_a]
        closes_b = np.zeros(len(b), bool)
        closes_b[last_b] = True
        # A group's A tokens stand before its B tokens: each is moved by what the other list has before it.
        start_b, stop_a = np.concatenate(([0], last_b[:-1] + 1)), last_a + 1
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + start_b[np.cumsum(closes_a) - closes_a]] = 3 * a + closes_a
        order[np.arange(len(b)) + stop_a[np.cumsum(closes_b) - closes_b]] = 3 * b + 2 * closes_b
        groups = b"".join(map(self.names.__getitem__, order.tolist()))[:-1]
        links = a[last_a].astype(np.int64) * self.size_b + b[last_b]
        return len(a), len(b), len(last_a), hashlib.sha256(groups).hexdigest(), links


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def _digest() -> Column:
    return F.unhex(F.sha2(F.encode("text", "UTF-8"), 256))


def aligned_texts(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """(digest, copies, n_a, n_b, n_groups, groups_sha256, links) of every distinct text that is not null or empty."""
    texts = docs.filter("text <> ''").groupBy("text").agg(F.count("*").alias("copies"))
    names = ["digest", "copies", "n_a", "n_b", "n_groups", "groups_sha256", "links"]
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(byte_bpe, piece_bpe)
        rows: list[tuple] = []
        held = 0

        def taken() -> pa.RecordBatch:
            *plain, links = zip(*rows)
            return pa.RecordBatch.from_arrays([*[pa.array(list(c), k) for c, k in zip(plain, kinds)], _lists(list(links))], names)

        for part in parts:
            for text, digest, copies in zip(*part.columns):
                rows.append((digest.as_py(), copies.as_py(), *aligner.text(text.as_py())))
                held += len(rows[-1][-1])
                if held > BATCH_LINKS:
                    yield taken()
                    rows.clear()
                    held = 0
        if rows:
            yield taken()

    schema = "digest binary, copies bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, links array<bigint>"
    return cut(texts.select("text", _digest().alias("digest"), "copies").mapInArrow(batches, schema), "aligned")


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best) of every pair of ids linked in the corpus: its links, and whether no pair of its B id has more."""
    links = aligned.select("copies", F.explode("links").alias("pair"))
    counts = cut(links.groupBy("pair").agg(F.sum("copies").alias("n")), "pairs")
    by_b = counts.withColumn("b", F.pmod("pair", F.lit(size_b)))
    return by_b.join(by_b.groupBy("b").agg(F.max("n").alias("most")), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def split_head(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(head, tail): the pairs above a count that at most HEAD pairs reach, and all others."""
    level = F.floor(F.log2("n") * 8)
    sizes = sorted(((r.level, r.n) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)
    total, lowest = 0, None
    for at, n in sizes:
        total += n
        if total > HEAD:
            break
        lowest = at
    if lowest is None:
        return counts.limit(0), counts
    return counts.filter(level >= lowest), counts.filter(level < lowest)


def text_measures(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """(digest, n_best, count_sum) of every aligned text."""
    head, tail = split_head(counts)
    found = sorted(map(tuple, head.collect()))
    pairs, numbers = np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.int64)
    bests = np.array([f[2] for f in found], np.int64)
    sent = aligned.sparkSession.sparkContext.broadcast((pairs, numbers, bests))

    def looked_up(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, numbers, bests = sent.value
        for part in parts:
            links = part.column(1)
            values = links.flatten().to_numpy()
            ends = np.concatenate(([0], np.cumsum(links.value_lengths().to_numpy(zero_copy_only=False))))
            known = np.zeros(len(values), bool)
            best, total = np.zeros(len(values) + 1, np.int64), np.zeros(len(values) + 1, np.int64)
            if len(pairs):
                at = np.minimum(np.searchsorted(pairs, values), len(pairs) - 1)
                known = pairs[at] == values
                np.cumsum(np.where(known, bests[at], 0), out=best[1:])
                np.cumsum(np.where(known, numbers[at], 0), out=total[1:])
            unknown = np.concatenate(([0], np.cumsum(~known)))[ends].astype(np.int32)
            rest = pa.ListArray.from_arrays(pa.array(unknown), pa.array(values[~known]))
            columns = [part.column(0), pa.array(np.diff(best[ends])), pa.array(np.diff(total[ends])), rest]
            yield pa.RecordBatch.from_arrays(columns, ["digest", "n_best", "count_sum", "rest"])

    schema = "digest binary, n_best bigint, count_sum bigint, rest array<bigint>"
    measured = aligned.select("digest", "links").mapInArrow(looked_up, schema)
    if tail.isEmpty():
        return measured.drop("rest")
    measured = cut(measured, "measured")
    # Each pair of a text once, with its number of links there.
    rare = measured.select("digest", F.explode("rest").alias("pair")).groupBy("digest", "pair").agg(F.count("*").alias("k"))
    more = rare.join(tail, "pair").groupBy("digest").agg(
        F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("best_more"), F.sum(F.col("k") * F.col("n")).alias("sum_more")
    )
    return measured.join(more, "digest", "left").select(
        "digest", (F.col("n_best") + F.coalesce("best_more", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("sum_more", F.lit(0))).alias("count_sum"),
    )


def aligned_documents(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """Alignment measures of every row of `docs`.

    Returns doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. Null and empty texts, and texts
    that a tokenizer does not give back byte for byte, have zeros and an empty digest. Rows that
    share a text, a doc_id or both are rows of their own; whole texts count, whatever their length; an empty table
    gives no rows, and columns other than doc_id and text are not read.
    """
    aligned = aligned_texts(docs, byte_bpe, piece_bpe)
    counts = cut(pair_counts(aligned, Aligner(byte_bpe, piece_bpe).size_b), "counts")
    measures = aligned.drop("links", "copies").join(text_measures(aligned, counts), "digest")
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    rows = docs.select(F.col("doc_id").cast("bigint"), _digest().alias("digest"))
    measures = measures.withColumn("n_links", F.col("n_groups"))
    return rows.join(measures, "digest", "left").select(
        "doc_id", *[F.coalesce(n, F.lit(0).cast("bigint")).alias(n) for n in names], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256")
    )


def op11_align_tokens(spark, sf_dir: str) -> DataFrame:
    """Alignment of byte_bpe_50k with piece_bpe_32k over all documents."""
    return aligned_documents(table(spark, sf_dir, "documents"))
