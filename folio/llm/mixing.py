"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its shuffled documents. A document's virtual finish time is
the number of words its queue has sent when it ends, divided by the queue's
weight. Serving queues in the order of finish times keeps every queue at its share at any
moment, so the mix is one global range sort cut off at the budget. A queue may be
read `MAX_EPOCHS` times; its later passes are further entries with later finish times.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import ROW, numbered, running, word_count
from folio.runtime import cut, table

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MAX_EPOCHS = 2


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source_no, source, source_size, target) from (source, source_size).

    Sources in code point order, null last, take the weights in turn and share
    `budget` times all sizes; none gets more than `epochs` times its size, and the
    excess is shared anew by weight. With the sources sorted by cap / weight, those
    at their cap come first, and the level at which the rest shares is the
    largest of the levels that result from cutting after each source.
    """
    keyed = sources.withColumn("last", F.col("source").isNull()).withColumn("name", F.coalesce("source", F.lit("")))
    numbered = running(keyed, [], ["last", "name"], {}, "source_no")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("source_no") - 1, F.lit(len(weights))) + 1).cast("int"))
    capped = cut(
        numbered.select("source_no", "source", "source_size", weight.cast("bigint").alias("weight"), (F.col("source_size") * epochs).alias("cap"))
        .withColumn("ratio", F.col("cap") / F.col("weight")),
        "sources",
    )
    total = capped.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    if not total.size:
        return capped.select("source_no", "source", "source_size", F.lit(0.0).alias("target"))
    upto = running(capped, [], ["ratio", "source_no"], {"caps": "cap", "spent": "weight"}, "place")
    level = (F.lit(budget * total.size) - (F.col("caps") - F.col("cap"))) / (F.lit(total.weight) - (F.col("spent") - F.col("weight")))
    share = upto.agg(F.max(level)).first()[0]
    return capped.select(
        "source_no", "source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(float(share))).alias("target"),
    )


def queued(docs: DataFrame, row: str | None = None) -> DataFrame:
    """(doc_id, source, size, row_id) of every row, written out so that row_id stays as it is; `row` is a column that has it already."""
    row_id = F.monotonically_increasing_id() if row is None else F.col(row)
    return cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_id.alias("row_id")), "queued")


def mix(rows: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, epochs: int = MAX_EPOCHS) -> tuple[DataFrame, DataFrame]:
    """The mix of `rows` (from `queued`) as (entries, rows with their source's size and target).

    Entries are row_id, doc_id, size, epoch, finish and position in the mix, one for each time
    a document is taken. Sources are shuffled by a hash of doc_id, the same at every run.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    shares = cut(targets(sizes, weights, budget, epochs), "targets")
    keyed = rows.join(shares, rows["source"].eqNullSafe(shares["source"])).drop(shares["source"])
    shuffle = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    queue = keyed.filter("size > 0").select(
        "source_no", shuffle.alias("shuffle_key"), "doc_id", "row_id", "size", "source_size", "target"
    )
    sent = running(queue, ["source_no"], ["shuffle_key", "doc_id", "row_id"], {"sent": "size"}, "turn")
    passes = sent.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    finish = (F.col("epoch") * F.col("source_size") + F.col("sent")) / F.col("target")
    entries = passes.select("row_id", "doc_id", "source_no", "size", "epoch", finish.alias("finish"))
    total = shares.agg(F.sum("source_size")).first()[0] or 0
    served = running(entries, [], ["finish", "source_no", "epoch", "doc_id", "row_id"], {"upto": "size"}, "position")
    return served.filter(F.col("upto") <= budget * total), keyed


def mixed_documents(docs: DataFrame) -> DataFrame:
    """`docs` as the mix takes them: every row as often as it is taken, all columns as they came.

    Rows that share a doc_id or have none are taken each on their own. Rows without words take
    no part in the mix and go; a null source is a source of its own. An empty table gives no rows; columns may have any names.
    """
    rows = numbered(docs)
    entries, _ = mix(queued(rows.select("row.doc_id", "row.source", "row.text", ROW), ROW))
    times = entries.groupBy(F.col("row_id").alias(ROW)).agg(F.count("*").cast("int").alias("times"))
    taken = rows.join(times, ROW)
    return taken.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def op5_mix_sources(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of every document.

    Returns doc_id, size, source_size, target, taken: one row for each row of documents. Rows
    with null or empty text have size 0 and are not taken; a null source is a source
    of its own, last in order; repeated rows are taken each on their own.
    """
    rows = queued(table(spark, sf_dir, "documents"))
    entries, keyed = mix(rows)
    taken = entries.groupBy("row_id").agg(F.sum("size").alias("taken"))
    return keyed.join(taken, "row_id", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("bigint")).alias("taken"), "source",
    )


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS source_no FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][(source_no - 1) % 3 + 1] AS BIGINT) AS weight, source_size * 2 AS cap FROM s),
t AS (SELECT CAST(1.5 AS DOUBLE) * CAST(sum(source_size) AS DOUBLE) AS budget, CAST(sum(weight) AS BIGINT) AS weights FROM w),
v AS (SELECT max((budget - CAST(caps - cap AS DOUBLE)) / CAST(weights - (spent - weight) AS DOUBLE)) AS level FROM (
  SELECT *, sum(cap) OVER o AS caps, sum(weight) OVER o AS spent FROM w, t WINDOW o AS (ORDER BY cap / weight, source_no ROWS UNBOUNDED PRECEDING))),
g AS (SELECT source, source_no, source_size, least(CAST(cap AS DOUBLE), weight * level) AS target FROM w, v),
q AS (SELECT d.doc_id, d.source, size, source_no, source_size, target, CAST(sum(size) OVER (PARTITION BY source_no ORDER BY md5('mix:' || CAST(doc_id AS VARCHAR)), doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS sent
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
e AS (SELECT *, (epoch * source_size + sent) / target AS finish FROM q, (SELECT unnest([0, 1]) AS epoch) WHERE size > 0),
p AS (SELECT *, sum(size) OVER (ORDER BY finish, source_no, epoch, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM e),
k AS (SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM p, t WHERE upto <= budget GROUP BY doc_id)
SELECT q.doc_id, size, source_size, target, coalesce(taken, 0) AS taken, source FROM q LEFT JOIN k ON k.doc_id = q.doc_id
"""
