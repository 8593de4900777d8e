"""SimHash near-duplicates, searched with BK-trees.

1. Every text gets a 64-bit fingerprint of its word shingles; equal fingerprints are one
   class, so thousands of copies cost one tree node.
2. Fingerprints are cut into BANDS bands. Two that differ in at most RADIUS bits agree in
   at least BANDS - RADIUS bands, so they share one of the C(BANDS, BANDS - RADIUS) bucket keys made
   of that many bands. Each class goes to its buckets; a bucket is a shard.
3. A shard's fingerprints form a BK-tree: a child hangs on the edge numbered by its Hamming
   distance to the parent. A query at distance d from a node follows only the
   edges d - RADIUS .. d + RADIUS; the triangle inequality excludes all others. Shards
   with more than TILE fingerprints are split into blocks, and every pair of blocks is a task
   of its own, so no shard has to fit one task.
4. A shard returns the links that join its members (a spanning forest, not all pairs), and
   star contraction makes them components.

Trees are sent to their queries by a shuffle on the bucket key, not broadcast: all trees
together grow with the collection.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.components import components
from folio.runtime import cut, table

WORDS = 4
SEED = 42
RADIUS = 4
BANDS = 6
TILE = 2048
# Bit ranges of the bands: 64 bits in six nearly equal parts.
_EDGES = [round(64 * i / BANDS) for i in range(BANDS + 1)]


def _bit_table() -> np.ndarray:
    """(256, 8): bit b of every byte value."""
    return ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Unsigned fingerprint of one text: a bit is set if more than half of the shingle hashes have it."""
    import xxhash

    found = (text or "").encode().lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(spaces + 1).tolist()]
    ends = [*spaces.tolist(), len(joined)]
    shingles = [joined[i:j] for i, j in zip(starts, ends[words - 1 :])]
    digests = b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED)))
    # Count each value of each digest byte, then each bit of those values.
    values = np.frombuffer(digests, np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)
    histogram = np.bincount(values.ravel(), minlength=2048).reshape(8, 256)
    bits = (histogram @ _bit_table()) * 2 > len(shingles)
    return int.from_bytes(np.packbits(bits, axis=1, bitorder="little").tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed bigint."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = np.fromiter((fingerprint(t.as_py()) for t in part.column(1)), np.uint64, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(batches, "doc_id bigint, fp bigint")


class BKTree:
    """Fingerprints as a tree whose edges carry Hamming distances."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        new, node = len(self.values) - 1, 0
        while node != new:
            node = self.children[node].setdefault((self.values[node] ^ value).bit_count(), new)

    def within(self, value: int, radius: int) -> list[int]:
        """Numbers of the nodes at most `radius` bits away."""
        found, open_nodes = [], [0] if self.values else []
        while open_nodes:
            node = open_nodes.pop()
            d = (self.values[node] ^ value).bit_count()
            if d <= radius:
                found.append(node)
            open_nodes += [child for edge, child in self.children[node].items() if -radius <= edge - d <= radius]
        return found


def shard_links(left: list[int], right: list[int] | None, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links joining all members of a shard that are reachable from each other: a spanning forest.

    With `right`, only pairs of a left and a right member are looked at (two blocks of a split shard).
    """
    tree, links = BKTree(), []
    members = [*left, *(right or [])]
    root = list(range(len(members)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, value in enumerate(members):
        if right is None or i >= len(left):
            for j in tree.within(value, radius):
                a, b = find(i), find(j)
                if a != b:
                    root[a] = b
                    links.append((value, members[j]))
        if right is None or i < len(left):
            tree.add(value)
    return links


def bucket_rows(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(bucket, fp): each fingerprint once for every choice of BANDS - radius bands."""
    keys = []
    for number, chosen in enumerate(combinations(range(BANDS), BANDS - radius)):
        mask = sum(((1 << (_EDGES[b + 1] - _EDGES[b])) - 1) << _EDGES[b] for b in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.lit(number), F.col("fp").bitwiseAND(F.lit(signed))))
    return classes.select("fp", F.explode(F.array(*keys)).alias("bucket"))


def tiled(rows: DataFrame, tile: int = TILE) -> DataFrame:
    """(bucket, lo, hi, side, fp): buckets of more than `tile` members as pairs of blocks, others as one tile (0, 0)."""
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / tile).cast("int")
    crowded = cut(sizes.filter(F.col("n") > tile).select("bucket", blocks.alias("blocks")), "crowded")
    if crowded.isEmpty():
        return rows.select("bucket", F.lit(0).alias("lo"), F.lit(0).alias("hi"), "fp", F.lit(0).alias("block"))
    spread = rows.join(crowded, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    block = F.pmod(F.xxhash64("fp", F.lit("block")), F.col("blocks")).cast("int")
    spread = spread.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return spread.select("bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "fp", "block")


def _tile_links(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each run of rows with equal (bucket, lo, hi); rows come sorted, a run may span batches."""
    held: list[np.ndarray] = []

    def links(table_rows: np.ndarray) -> pa.RecordBatch:
        out: list[tuple[int, int]] = []
        changes = np.flatnonzero((table_rows[1:, :3] != table_rows[:-1, :3]).any(axis=1)) + 1
        bounds = np.concatenate(([0], changes, [len(table_rows)]))
        for k in np.flatnonzero(np.diff(bounds) > 1):
            run = table_rows[bounds[k] : bounds[k + 1]]
            values = run[:, 3].astype(np.uint64).tolist()
            if run[0, 1] == run[0, 2]:
                out += shard_links(values, None)
            else:
                low = run[:, 4] == run[0, 1]
                out += shard_links([v for v, x in zip(values, low) if x], [v for v, x in zip(values, low) if not x])
        pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    for part in parts:
        rows = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in part.columns])
        if not len(rows):
            continue
        if held and (rows[0, :3] != held[-1][-1, :3]).any():
            yield links(np.concatenate(held))
            held = []
        # All but the last run of this batch is complete.
        last = np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(axis=1))
        split = last[-1] + 1 if len(last) else 0
        if split:
            yield links(np.concatenate([*held, rows[:split]]))
            held = []
        held.append(rows[split:])
    if held:
        yield links(np.concatenate(held))


def fingerprint_links(classes: DataFrame) -> DataFrame:
    """(a, b): links between fingerprints that connect all those within RADIUS bits of each other."""
    tiles = tiled(bucket_rows(classes)).repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    return tiles.select("bucket", "lo", "hi", "fp", "block").mapInArrow(_tile_links, "a bigint, b bigint")


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row.

    component_id is the smallest doc_id reachable over links of at most RADIUS bits, the row's own
    included. Null, empty and blank texts have fingerprint 0 and are linked like any other; repeated rows are
    copies; null doc_ids take part, but never name a component that has another
    identifier. An empty table gives no rows; other columns are not read.
    """
    rows = cut(fingerprints(docs), "fingerprints")
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    roots = cut(components(fingerprint_links(classes)), "roots")
    placed = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = placed.join(placed.groupBy("root").agg(F.min("first_id").alias("component_id")), "root")
    return rows.join(named.select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_representatives(docs: DataFrame) -> DataFrame:
    """`docs` with the row of the smallest doc_id of each near-duplicate group, all columns as they came. Needs unique doc_ids."""
    groups = near_groups(docs)
    gone = groups.filter("doc_id <> component_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
