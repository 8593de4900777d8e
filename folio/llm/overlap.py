"""Near copies by shared word shingles: an exact join at Jaccard similarity 0.8 or more.

1. Every text becomes the set of its five-word shingles (64-bit hashes); equal sets are one node.
2. Prefix filter: shingles have one order for all texts, and two sets of similarity 0.8 share one of the first
   n - ceil(0.8 n) + 1 of the longer and n - ceil(8 n / 9) + 1 of the shorter. The order is made by counting: of the quarter of all
   shingles with the lowest hashes, those that one set alone has come first, then the others from rare to common; all
   other shingles come last, by hash. A set's own shingles fill its prefix first, so a passage that it shares with many
   makes candidates only if the passage is a large part of it.
3. A set's low shingles are shuffled once, into buckets. A pass over the sorted rows keeps buckets of two or more sets; their
   sizes give the order, and a set keeps the buckets of its prefix. Shingles that are hot in a sample are dealt to many tasks.
4. Each set meets the first, or leader, of its buckets: first the leader it shares most buckets with, then, if it is not yet
   connected to them, the others. Candidates are verified twice: by the low shingles, whose overlap bounds that of the sets and leaves
   few pairs, and by the whole sets. Star contraction makes the links components.
5. In buckets whose members are not all connected, members of different components meet as well, if the parities of their sets (a bitmap
   of 512 bits, which bounds in how many shingles they differ) leave the similarity open, and are verified: first two pairs of each
   component (the one that differs least, and the one of the smallest nodes), then those whose components these have not connected.

SimHash (op2) finds candidates besides: texts with fingerprints at most 4 of 64 bits apart are linked if their shingles, repeats
counted, have similarity 0.8 too. SimHash alone does not serve: at similarity 0.8 fingerprints are too far apart for bands and trees.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import shuffle_partitions
from folio.llm.components import components
from folio.llm.simhash import fingerprint, fingerprint_links
from folio.runtime import cut, discard

WORDS = 5
SEED = 42
#: Similarity from which two texts are near copies, as numerator and denominator.
LEAST, OF = 4, 5
#: Texts whose shingles are looked at for hot ones, at most (in expectation).
SAMPLE = 8_000
#: Hashes below this are low: a quarter of all.
LOW_END = -(1 << 63) + (1 << 62)
#: A shingle that so large a share of the sample has is dealt to many tasks.
HOT = 0.01
#: Words of 64 bits that hold the parities of a set.
PARITIES = 8
#: Low bits of a shingle that name its bucket (two shingles in one bucket are a few candidates more), and the mark of a hot one.
BUCKET, HOT_BIT = (1 << 48) - 1, 1 << 48


def _hashes(text: str | None, words: int) -> np.ndarray:
    """Hashes of a text's word shingles in order; a text of at most `words` words is one shingle."""
    import xxhash

    found = (text or "").lower().encode().split()
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64).view(np.int64)
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(spaces + 1).tolist()]
    ends = [*spaces.tolist(), len(joined)]
    parts = [joined[i:j] for i, j in zip(starts, ends[words - 1 :])]
    digests = b"".join(map(xxhash.xxh64_digest, parts, repeat(SEED)))
    return np.frombuffer(digests, ">u8").astype(np.uint64).view(np.int64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles."""
    return np.unique(_hashes(text, words))


def repeated_shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of a text's shingles in which each repeat is an element of its own."""
    found, counts = np.unique(_hashes(text, WORDS), return_counts=True)
    number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.unique(np.repeat(found, counts) + number * np.int64(-7046029254386353131))


def prefix_length(n: Column) -> Column:
    """How many first shingles of a set are looked up by sets of its size and shorter ones."""
    return n - F.ceil(n * LEAST / OF - 1e-9) + 1


def index_length(n: Column) -> Column:
    """How many first shingles of a set are looked up by sets of its size and longer ones."""
    return n - F.ceil(n * (2 * LEAST) / (LEAST + OF) - 1e-9) + 1


def parities(members: np.ndarray) -> np.ndarray:
    """The parity of a set's shingles in each of 64 * PARITIES classes, as PARITIES numbers: two sets differ in at least as many shingles as classes."""
    classes = (members >> np.int64(20)) & np.int64(64 * PARITIES - 1)
    return np.packbits(np.bincount(classes, minlength=64 * PARITIES).astype(np.uint8) & 1).view(np.int64)


def differing(one: str, two: str) -> Column:
    """In how many classes two parities differ."""
    return reduce(add, (F.bit_count(F.col(one)[i].bitwiseXOR(F.col(two)[i])) for i in range(PARITIES)))


def few_differ(one: str, two: str, n: str, m: str) -> Column:
    """Whether sets of sizes n and m with these parities can have similarity LEAST / OF, where they differ in (n + m) / 9 shingles at most."""
    return differing(one, two) * (LEAST + OF) <= (F.col(n) + F.col(m)) * (OF - LEAST)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def hot_shingles(docs: DataFrame) -> np.ndarray:
    """Buckets of the shingles that more than the share HOT of a sample has; they only say which rows are dealt to many tasks."""
    share = min(1.0, SAMPLE / max(docs.count(), 1))
    chance = F.pmod(F.xxhash64(F.lit("shingles"), "one", "two"), F.lit(1_000_000)) / 1_000_000

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = np.concatenate([np.zeros(0, np.int64), *[shingles(t.as_py()) for t in part.column(0)]])
            values, n = np.unique(found[found < LOW_END], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n)], ["shingle", "n"])

    counted = docs.filter(chance < share).select("text").mapInArrow(count, "shingle bigint, n bigint")
    rows = counted.groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") > HOT * SAMPLE).collect()
    return np.unique(np.array([r.shingle & BUCKET for r in rows], np.int64))


def named(docs: DataFrame) -> DataFrame:
    """doc_id, text and two hashes (one, two) by which rows and their texts are found again; only these columns are read."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", "text", F.xxhash64(text).alias("one"), F.xxhash64(F.lit("two"), text).alias("two"))


def text_sets(docs: DataFrame) -> DataFrame:
    """(row_no, doc_id, one, two, node, n, fp, low, parity, prefix) of every row of `named`.

    node names the set of shingles, n is its size, fp the fingerprint, low the number of its low shingles, parity has its `parities`, and
    prefix its first shingles by hash: the low ones, and as many as a prefix needs.
    """
    hot = hot_shingles(docs)
    names = ["doc_id", "one", "two", "node", "n", "fp", "low", "parity", "prefix"]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for part in parts:
            texts = part.column(3).to_pylist()
            sets = [shingles(t) for t in texts]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            prints = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            low = [int(np.searchsorted(s, LOW_END)) for s in sets]
            firsts = [s[: max(k, len(s) - (LEAST * len(s) + OF - 1) // OF + 1)] & BUCKET for s, k in zip(sets, low)]
            firsts = [f | np.where(np.isin(f, hot), HOT_BIT, 0) for f in firsts] if len(hot) else firsts
            sizes = pa.array([len(s) for s in sets], pa.int64())
            columns = [pa.array(nodes), sizes, pa.array(prints), pa.array(low, pa.int64()), _lists([parities(s) for s in sets]), _lists(firsts)]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], *columns], names)

    # The type of doc_id passes through.
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, one bigint, two bigint, node bigint, n bigint, fp bigint, low bigint, parity array<bigint>, prefix array<bigint>"
    rows = docs.select("doc_id", "one", "two", "text").mapInArrow(batches, schema)
    return cut(rows.withColumn("row_no", F.monotonically_increasing_id()), "sets")


def one_a_node(sets: DataFrame) -> DataFrame:
    """`sets` with one row of each node; rows of equal sets are few, or few distinct ones, so they are looked up and left out."""
    firsts = sets.groupBy("node").agg(F.min("row_no").alias("first_row"), F.count("*").alias("rows")).filter("rows > 1").drop("rows")
    again = cut(sets.select("node", "row_no").join(firsts, "node").filter("row_no <> first_row").select("row_no"), "again")
    return sets.join(again, "row_no", "left_anti")


def alike(n: str, m: str) -> str:
    """Sizes of sets that can have similarity LEAST / OF."""
    return f"least({n}, {m}) * {OF} >= greatest({n}, {m}) * {LEAST}"


def in_reach(n: str, at: str, m: str, at_m: str) -> str:
    """Whether sets whose first common shingle stands at these places can still share enough behind them."""
    return f"least({n} - {at}, {m} - {at_m}) * {LEAST + OF} >= ({n} + {m}) * {LEAST}"


_SHARED = ["bucket", "salt", "node", "n", "at", "low"]


def _shared(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by bucket and salt, those that do not stand alone in theirs; all of a hot bucket."""
    held: list[np.ndarray] | None = None  # the last row, and whether it is like the row before it
    for part in parts:
        columns = [c.to_numpy(zero_copy_only=False) for c in part.columns]
        if not len(columns[0]):
            continue
        known = np.zeros(len(columns[0]), bool)
        if held is not None:
            columns = [np.concatenate(c) for c in zip(held[:-1], columns)]
            known = np.concatenate((held[-1], known))
        bucket, salt = columns[:2]
        same = (bucket[1:] == bucket[:-1]) & (salt[1:] == salt[:-1])
        known[1:] |= same
        keep = (known[:-1] | same) | ((bucket[:-1] & HOT_BIT) != 0)
        yield pa.RecordBatch.from_arrays([pa.array(c[:-1][keep]) for c in columns], _SHARED)
        held = [*[c[-1:] for c in columns], known[-1:]]
    if held is not None:
        keep = held[-1] | ((held[0] & HOT_BIT) != 0)
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in held[:-1]], _SHARED)


def bucket_members(nodes: DataFrame) -> DataFrame:
    """(bucket, node, n, at, leader, leader_n, leader_at): every set of a bucket of two or more beside the bucket's first; at is the place in the order."""
    entries = nodes.select("node", "n", "low", F.posexplode("prefix").alias("at", "bucket"))
    hot = F.col("bucket").bitwiseAND(F.lit(HOT_BIT)) != 0
    tasks = shuffle_partitions(nodes.sparkSession)
    entries = entries.withColumn("salt", F.when(hot, F.pmod("node", F.lit(tasks))).otherwise(0)).withColumn("at", F.col("at").cast("bigint"))
    ordered = entries.select(*_SHARED).repartition("bucket", "salt").sortWithinPartitions("bucket", "salt")
    crowd = cut(ordered.mapInArrow(_shared, ", ".join(f"{c} bigint" for c in _SHARED)).drop("salt"), "crowd")
    sizes = crowd.groupBy("bucket").agg(F.count("*").alias("sets")).filter("sets > 1")
    is_low = F.col("at") < F.col("low")
    own = Window.partitionBy("node")
    # A set's shared low shingles stand behind those that it alone has.
    rank = F.row_number().over(own.orderBy(F.when(is_low, 0).otherwise(1), "sets", "bucket")) - 1
    alone = F.col("low") - F.sum(is_low.cast("bigint")).over(own)
    placed = crowd.join(sizes, "bucket").withColumn("place", F.when(is_low, alone + rank).otherwise(F.col("at")))
    kept = placed.filter(F.col("place") < prefix_length(F.col("n"))).select("bucket", "node", "n", F.col("place").alias("at"))
    kept = cut(kept, "members")
    discard(crowd)
    leaders = kept.filter(F.col("at") < index_length(F.col("n"))).groupBy("bucket").agg(F.min(F.struct("n", "node", "at")).alias("top"))
    return kept.join(leaders, "bucket").filter(F.struct("n", "node") > F.struct("top.n", "top.node")).select(
        "bucket", "node", "n", "at", F.col("top.node").alias("leader"), F.col("top.n").alias("leader_n"), F.col("top.at").alias("leader_at")
    )


def whole_matches(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, repeats: bool) -> DataFrame:
    """(a, b): the pairs of nodes whose texts' shingles have similarity LEAST / OF or more; with `repeats`, each repeat of a shingle counts."""
    elements = repeated_shingles if repeats else shingles

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_arrays([part.column(0), _lists([elements(t.as_py()) for t in part.column(1)])], ["node", "members"])

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    chosen = nodes.select("node", "one", "two").join(wanted, "node", "left_semi")
    texts = docs.select("one", "two", "text").join(chosen, ["one", "two"]).dropDuplicates(["node"]).select("node", "text")
    members = cut(texts.mapInArrow(batches, "node bigint, members array<bigint>"), "members")
    one = members.select(F.col("node").alias("a"), F.col("members").alias("one"))
    two = members.select(F.col("node").alias("b"), F.col("members").alias("two"))
    shared = F.size(F.array_intersect("one", "two"))
    enough = shared * (LEAST + OF) >= (F.size("one") + F.size("two")) * LEAST
    links = cut(pairs.join(one, "a").join(two, "b").filter(enough).select("a", "b"), "links")
    discard(members)
    return links


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b): the pairs of nodes whose sets have similarity LEAST / OF or more.

    What two sets share besides their first shingles by hash lies in the rest of one of them, so the overlap of these
    bounds that of the sets; their parities bound it as well.
    """
    pairs = cut(pairs, "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    firsts = nodes.select("node", "n", "parity", "prefix").join(wanted, "node", "left_semi")
    one = firsts.select(F.col("node").alias("a"), F.col("n").alias("n"), F.col("parity").alias("odd"), F.col("prefix").alias("one"))
    two = firsts.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("parity").alias("odd_b"), F.col("prefix").alias("two"))
    bound = F.size(F.array_intersect("one", "two")) + F.greatest(F.col("n") - F.size("one"), F.col("m") - F.size("two"))
    possible = pairs.join(one, "a").join(two, "b").filter(few_differ("odd", "odd_b", "n", "m")).filter(bound * (LEAST + OF) >= (F.col("n") + F.col("m")) * LEAST)
    return whole_matches(cut(possible.select("a", "b"), "possible"), nodes, docs, repeats=False)


def print_links(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b): links between nodes whose fingerprints are near, as op2 finds them, and whose shingles with repeats are alike."""
    classes = cut(nodes.groupBy("fp").agg(F.min("node").alias("first")), "classes")
    equal = nodes.join(classes, "fp").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    ends = [classes.select(F.col("fp").alias(x), F.col("first").alias(y)) for x, y in (("a", "node_a"), ("b", "node_b"))]
    near = fingerprint_links(classes.select("fp")).join(ends[0], "a").join(ends[1], "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    return whole_matches(cut(equal.unionByName(near).distinct(), "pairs"), nodes, docs, repeats=True)


def first_pairs(pairs: DataFrame) -> DataFrame:
    """(a, b): of `pairs` (a, b, root, root_b, off) the one of least `off` and the one of the smallest a and b of each root, at most two a root."""
    ends = pairs.select("a", "b", "off", F.explode(F.array("root", "root_b")).alias("root"))
    best = ends.groupBy("root").agg(F.min(F.struct("off", "a", "b")).alias("near"), F.min(F.struct("a", "b")).alias("low"))
    return best.select(F.explode(F.array(F.struct("near.a", "near.b"), "low")).alias("pair")).select("pair.*").distinct()


def near_copies(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sets, roots) of `named` rows: sets as `text_sets` gives them, roots (node, root) of all nodes that have a near copy."""
    sets = text_sets(docs)
    nodes = one_a_node(sets)
    known = print_links(nodes, docs)
    crowd = cut(bucket_members(nodes), "members")
    led = crowd.filter(alike("n", "leader_n")).filter(in_reach("n", "at", "leader_n", "leader_at"))
    led = cut(led.groupBy(F.col("leader").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("buckets")), "led")

    def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        """The pairs whose nodes are not connected yet."""
        for x in ("a", "b"):
            of_x = roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
            pairs = pairs.join(of_x, x, "left").withColumn(f"root_{x}", F.coalesce(f"root_{x}", x))
        return pairs.filter("root_a <> root_b").drop("root_a", "root_b")

    best = F.max(F.struct("buckets", "a"))
    first = apart(led, cut(components(known), "roots")).groupBy("b").agg(best.alias("best")).select("best.a", "b")
    first = cut(first, "first")
    links = cut(verified(first, nodes, docs).unionByName(known), "links")
    others = apart(led.select("a", "b"), cut(components(links), "roots")).join(first, ["a", "b"], "left_anti")
    links = links.unionByName(verified(others, nodes, docs))
    roots = cut(components(links), "roots")
    # Buckets with members outside their leader's component: there all members of different components meet.
    of_leader = roots.select(F.col("node").alias("leader"), F.col("root").alias("leader_root"))
    placed = crowd.join(roots, "node", "left").join(of_leader, "leader", "left")
    placed = placed.withColumn("root", F.coalesce("root", "node")).withColumn("leader_root", F.coalesce("leader_root", "leader"))
    split = placed.filter("root <> leader_root").select("bucket").distinct()
    rows = cut(placed.join(split, "bucket", "left_semi"), "open")
    heads = rows.select("bucket", F.col("leader").alias("node"), F.col("leader_n").alias("n"), F.col("leader_at").alias("at"), F.col("leader_root").alias("root"))
    rows = rows.select("bucket", "node", "n", "at", "root").unionByName(heads).distinct().join(nodes.select("node", "parity"), "node")
    # Two sets whose rows before these share a bucket as well have met there, at earlier places, so they need not meet again.
    rows = rows.withColumn("before", F.lag("bucket").over(Window.partitionBy("node").orderBy("at", "bucket")))
    left = rows.filter(F.col("at") < index_length(F.col("n")))
    right = rows.select("bucket", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "at", "root", "parity", "before")])
    met = left.join(right, "bucket").filter("root <> root_b and n <= n_b").filter(alike("n", "n_b")).filter(in_reach("n", "at", "n_b", "at_b"))
    met = met.filter(F.coalesce(F.col("before") != F.col("before_b"), F.lit(True))).filter(few_differ("parity", "parity_b", "n", "n_b"))
    sides = F.least("root", "root_b").alias("root"), F.greatest("root", "root_b").alias("root_b")
    pairs = met.select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b"), *sides, differing("parity", "parity_b").alias("off"))
    tried = led.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = cut(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
    first = cut(first_pairs(pairs), "first")
    links = cut(links.unionByName(verified(first, nodes, docs)), "links")
    others = apart(pairs.select("a", "b"), cut(components(links), "roots")).join(first, ["a", "b"], "left_anti")
    more = verified(others, nodes, docs)
    discard(crowd)
    return sets, cut(components(links.unionByName(more)), "roots")


def keep_distinct(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each group of near copies, all columns as they came.

    Groups are the rows reachable over pairs of similarity LEAST / OF or more, or with fingerprints near as in op2 and such similarity
    when repeats count. The row of the smallest doc_id stays, null last; of rows that share it, any one.
    Null, empty and blank texts are copies of each other. An empty table gives no rows; columns may have any
    names. Rows are told apart by doc_id and two hashes of their text, so no text is written on the way.
    """
    keys = ["doc_id", "one", "two"]
    sets, roots = near_copies(named(docs))
    grouped = sets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), *keys))
    keepers = grouped.groupBy("root").agg(first.alias("keeper"))
    same = F.lit(True)
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"keeper.{key}"))
    found = cut(grouped.join(keepers, "root").groupBy(*keys).agg(F.first(same).alias("kept"), F.count("*").alias("rows")), "kept")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(text).alias("one"), F.xxhash64(F.lit("two"), text).alias("two"))

    def among(chosen: DataFrame, how: str) -> DataFrame:
        same = F.col("row.doc_id").eqNullSafe(chosen["doc_id"]) & (rows["one"] == chosen["one"]) & (rows["two"] == chosen["two"])
        return rows.join(chosen, same, how)

    tied = found.filter("kept and rows > 1")
    single = among(found.filter("not kept or rows > 1"), "left_anti")
    if tied.isEmpty():
        return single.select("row.*")
    again = among(tied, "left_semi").withColumn("doc_id", F.col("row.doc_id")).dropDuplicates(keys)
    return single.select("row.*").unionByName(again.select("row.*"))
