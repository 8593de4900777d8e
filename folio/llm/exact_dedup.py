"""Exact de-duplication: a tree merge of digest runs, in DataFrame operations only.

Each document falls into one of `RUNS` runs by its identifier. A run is a table of
text digests with the smallest identifier and the number of copies. In round r, runs
whose numbers differ only in the r-th group of bits are merged into one, as in a
binomial tree with fan-in `FAN_IN`: copies inside a task are combined before they
move, and rows are dealt out by (run, digest), so even the last round, in which one
run is left, is spread over all tasks by digest. A text that a third of all documents
share reaches round r as at most RUNS / FAN_IN**r rows.

Digests are verified: the key is the SHA-256 of the normalised text together with its
length and an independent 64-bit hash, so texts are merged only if all three agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import SPACE
from folio.runtime import cut

RUNS = 64
FAN_IN = 4


def normalised(text: Column) -> Column:
    """Every run of white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, run, digest, n_chars, check) of every row."""
    norm = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    return norm.select(
        "doc_id",
        F.pmod(F.xxhash64("doc_id"), F.lit(RUNS)).alias("run"),
        F.sha2(F.encode("norm", "UTF-8"), 256).alias("digest"),
        F.length("norm").alias("n_chars"),
        F.xxhash64("norm").alias("check"),
    )


def merge_runs(rows: DataFrame) -> DataFrame:
    """One row per text (digest, n_chars, check): smallest identifier and number of copies."""
    key = ["digest", "n_chars", "check"]
    level = rows.select("run", *key, F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"))
    width = RUNS
    while width >= 1:
        level = level.groupBy("run", *key).agg(
            F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
        ).sortWithinPartitions("run", *key)
        level = level.withColumn("run", F.floor(F.col("run") / FAN_IN))
        width //= FAN_IN
    return level.drop("run")


def exact_groups(docs: DataFrame) -> DataFrame:
    """Group, keeper and verdict of every row of `docs`.

    Returns doc_id, keep_id (smallest doc_id of the equal texts), group_size, kept, text_sha256.
    Null and empty texts are equal to each other and form one group; a text of white
    space is a single space. Whole texts count, whatever their length. Rows that repeat the
    kept doc_id are all kept here (`keep_first` leaves one of each group); a null doc_id is
    the keeper only where its group has no other. An empty table gives no rows, and
    columns other than doc_id and text are not read.
    """
    rows = cut(digests(docs), "digests")
    key = ["digest", "n_chars", "check"]
    return rows.join(merge_runs(rows), key).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each group of equal texts, all columns as they came.

    The row of the smallest doc_id stays, null last; of rows that share it, any one. Rows
    go by doc_id and digest together, so different texts may share a doc_id or have none. These keys of
    dropped rows are anti-joined, so the kept texts are moved once.
    """
    key = ["digest", "n_chars", "check"]
    found = cut(digests(docs), "digests")
    groups = cut(
        found.join(merge_runs(found), key).groupBy("doc_id", *key)
        .agg(F.first(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), F.count("*").alias("n")),
        "groups",
    )
    norm = normalised(F.col("text"))
    marked = docs.select(
        F.struct(*docs.columns).alias("row"),
        F.sha2(F.encode(norm, "UTF-8"), 256).alias("digest"), F.length(norm).alias("n_chars"), F.xxhash64(norm).alias("check"),
    )

    def among(rows: DataFrame, chosen: DataFrame, how: str) -> DataFrame:
        same = F.col("row.doc_id").eqNullSafe(chosen["doc_id"])
        for name in key:
            same = same & (rows[name] == chosen[name])
        return rows.join(chosen, same, how)

    tied = groups.filter("kept and n > 1")
    if tied.isEmpty():
        return among(marked, groups.filter("not kept"), "left_anti").select("row.*")
    single = among(marked, groups.filter("not kept or n > 1"), "left_anti")
    return single.unionByName(among(marked, tied, "left_semi").dropDuplicates(key)).select("row.*")
