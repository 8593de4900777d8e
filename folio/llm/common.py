"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.runtime import cut

# White space and words, as Java and RE2 patterns.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Number of words of a text as bigint; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, str], number: str) -> DataFrame:
    """Running totals and row numbers over each group of `keys`, without a task that holds a group.

    Rows are range-sorted by (keys, order) into slabs and written out, so the
    slabs stay as they are if an executor is lost. Slab totals give each slab what
    stands before it; a window inside the slab does the rest. `sums` maps a new
    column to the column it totals, up to and including the row; `number` counts
    from 1. Keys must not be null; `order` should be unique, rows that tie in it
    are numbered in any order.
    """
    keys, order = list(keys), list(order)
    slabs = df.repartitionByRange(shuffle_partitions(df.sparkSession), *keys, *order)
    placed = cut(slabs.withColumn("_slab", F.spark_partition_id()), "slabs")
    one = F.lit(1).cast("bigint")
    totals = placed.groupBy(*keys, "_slab").agg(
        F.sum(one).alias("_n"), *[F.sum(c).alias(f"_t_{name}") for name, c in sums.items()]
    )
    before = Window.partitionBy(*keys).orderBy("_slab").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys, "_slab",
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ["_n", *[f"_t_{name}" for name in sums]]],
    )
    inside = Window.partitionBy(*keys, "_slab").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(carry, [*keys, "_slab"]).select(
        *df.columns,
        (F.col("_n") + F.sum(one).over(inside)).alias(number),
        *[(F.col(f"_t_{name}") + F.sum(c).over(inside)).alias(name) for name, c in sums.items()],
    )


#: Name of the column by which a stage tells its rows apart; identifiers may be null or repeated.
ROW = "_row"


def numbered(docs: DataFrame) -> DataFrame:
    """Every row of `docs` as one struct `row`, whatever its columns are called, with a number of its own in ROW; written out so that the numbers stay as they are."""
    return cut(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias(ROW)), "rows")
