"""Resharding by minimum-cost flow.

A collection lies in old shards; a new set of shards has capacities. Which bytes move
where is a flow problem between shards: an old shard supplies its bytes, a new one
takes up to its capacity, leaving bytes where they are costs nothing and moving one
costs one (or an entry of `cost`). The flow has one node a shard, whatever the number of
documents, and is solved on the driver. Spark then turns it into block transfers: the
documents of an old shard stand in one order (largest first, so that every block
border falls between small documents), a block is an interval of its running bytes, and
the document in the middle of whose bytes a border falls goes to the nearer side.
Only shards that lose or gain a block are written again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import running
from folio.runtime import cut, table

#: Bytes of framing a stored document takes besides its text.
OVERHEAD = 8
OLD_SHARDS = 16
NEW_SHARDS = 24


def equal_capacities(total: int, shards: int) -> list[int]:
    """Capacities that differ by one byte at most and sum to `total`."""
    return [total // shards + (1 if i < total % shards else 0) for i in range(shards)]


def min_cost_flow(supply: Sequence[int], capacity: Sequence[int], cost: Sequence[Sequence[float]] | None = None) -> dict[tuple[int, int], int]:
    """Cheapest amounts (old, new) -> bytes that place all supplies within the capacities.

    Successive shortest paths in the residual graph, found by Bellman-Ford. By default
    staying costs 0 and moving 1. Supplies beyond all capacities raise ValueError.
    """
    if sum(supply) > sum(capacity):
        raise ValueError("the new shards cannot hold the old ones")
    olds, news = range(len(supply)), range(len(capacity))
    price = cost or [[0 if i == j else 1 for j in news] for i in olds]
    left, room = list(supply), list(capacity)
    flow: dict[tuple[int, int], int] = {}
    while any(left):
        reach = {("old", i): (0.0, None) for i in olds if left[i]}
        changed = True
        while changed:
            changed = False
            for i in olds:
                for j in news:
                    steps = [(("old", i), ("new", j), price[i][j])]
                    if flow.get((i, j)):
                        steps.append((("new", j), ("old", i), -price[i][j]))
                    for a, b, p in steps:
                        if a in reach and reach[a][0] + p < reach.get(b, (float("inf"),))[0] - 1e-9:
                            reach[b], changed = (reach[a][0] + p, a), True
        end = min((("new", j) for j in news if room[j] and ("new", j) in reach), key=lambda n: (reach[n][0], n[1]))
        path = [end]
        while reach[path[-1]][1] is not None:
            path.append(reach[path[-1]][1])
        path.reverse()
        hops = list(zip(path, path[1:]))
        backward = [flow[(b[1], a[1])] for a, b in hops if a[0] == "new"]
        amount = min([left[path[0][1]], room[end[1]], *backward])
        for a, b in hops:
            edge, sign = ((a[1], b[1]), 1) if a[0] == "old" else ((b[1], a[1]), -1)
            flow[edge] = flow.get(edge, 0) + sign * amount
        left[path[0][1]] -= amount
        room[end[1]] -= amount
    return {edge: n for edge, n in sorted(flow.items()) if n}


def blocks(flow: dict[tuple[int, int], int]) -> list[tuple[int, int, int, int]]:
    """(old, new, lo, hi): which bytes of an old shard, in its order, go where. What stays comes first."""
    out, at = [], {}
    for (old, new), n in sorted(flow.items(), key=lambda x: (x[0][0], x[0][0] != x[0][1], x[0][1])):
        lo = at.get(old, 0)
        out.append((old, new, lo, lo + n))
        at[old] = lo + n
    return out


def sized(docs: DataFrame, old_shards: int = OLD_SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, old_shard, order columns) of every row; null texts have no bytes, null ids shard by hash too."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id"), F.lit(old_shards)).cast("int").alias("old_shard"),
        F.xxhash64("doc_id", F.lit("order")).alias("shuffle_key"),
    )


def reshard(docs: DataFrame, old_shards: int = OLD_SHARDS, new_shards: int = NEW_SHARDS) -> DataFrame:
    """New shard and slot of every row of `docs`; shards end within one small document of equal bytes.

    Returns doc_id, size, text_crc32, old_shard, shard, slot (gapless from 0 in each
    shard). Every row is placed, repeated rows each on their own; null and empty
    texts take the overhead alone; an empty table gives no rows. Columns other than
    doc_id and text are not read. If one document is larger than a capacity its shard is larger.
    """
    rows = cut(sized(docs, old_shards).withColumn("desc", -F.col("size")), "sized")
    sizes = {r[0]: r[1] for r in rows.groupBy("old_shard").agg(F.sum("size")).collect()}
    supply = [sizes.get(i, 0) for i in range(old_shards)]
    plan = blocks(min_cost_flow(supply, equal_capacities(sum(supply), new_shards)))
    spark = docs.sparkSession
    transfers = spark.createDataFrame(plan, "old_shard int, shard int, lo bigint, hi bigint")
    ranked = running(rows, ["old_shard"], ["desc", "shuffle_key", "doc_id"], {"upto": "size"}, "place")
    middle = F.col("upto") * 2 - F.col("size")
    placed = ranked.join(F.broadcast(transfers), "old_shard").filter((middle >= F.col("lo") * 2) & (middle < F.col("hi") * 2))
    placed = cut(placed.drop("lo", "hi"), "placed")
    # A block is one interval of its old shard's order, so its rows' places are consecutive.
    tops = placed.groupBy("old_shard", "shard").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    offsets, used = [], {}
    for r in sorted(tops.collect()):
        offsets.append((r.old_shard, r.shard, used.get(r.shard, 0) - r.first))
        used[r.shard] = used.get(r.shard, 0) + r.n
    start = spark.createDataFrame(offsets, "old_shard int, shard int, start bigint")
    return placed.join(F.broadcast(start), ["old_shard", "shard"]).select(
        "doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("place") + F.col("start")).alias("slot"),
    )


def affected(placed: DataFrame) -> list[int]:
    """New shards that differ from the old shard of the same number."""
    moved = placed.filter("old_shard <> shard")
    ends = moved.select(F.explode(F.array("old_shard", "shard")).alias("shard"))
    return sorted(r[0] for r in ends.distinct().collect())


def rewrite(docs: DataFrame, placed: DataFrame, path: str) -> list[int]:
    """Write the affected shards of `docs`, in slot order, as path/shard=N/; the others' files stay. Needs unique doc_ids."""
    changed = affected(placed)
    spots = placed.filter(F.col("shard").isin(changed)).select("doc_id", "shard", "slot")
    ordered = docs.drop("shard", "slot").join(spots, "doc_id").repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    return changed


def op4_reshard(spark, sf_dir: str) -> DataFrame:
    """All documents from 16 hash shards into 24 of equal bytes."""
    placed = reshard(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard",
    )
