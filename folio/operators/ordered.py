"""Ordered operators that never put a whole group into one task.

A running total, a look at the neighbouring row or a forward fill over a book
is a window over the book. One book (or one version, one bank, one paper) may
hold a large share of all rows, so every operator here works in two levels:

1. the group is split into buckets along its own order (a page range, an
   ordinal range, a hash prefix); one map-side-combined aggregate summarises
   each bucket;
2. a window over the bucket summaries gives each bucket what the buckets before
   (or after) it contribute;
3. the rows are shuffled once by (group, bucket), get their bucket's carry from
   a join on the same key, and finish with a window inside the bucket.

`bucket` must be a monotone function of the first order column.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BUCKET = "__bucket"


def scan(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    *,
    sums: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    maxes_before: Mapping[str, Column] | None = None,
    fills: Mapping[str, Column] | None = None,
    lags: Mapping[str, Column] | None = None,
    leads: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add ordered columns over each group of `keys`.

    sums   running total up to and including the row
    maxes  running maximum up to and including the row (maxes_before: up to the row before)
    fills  last non-null value up to and including the row
    lags   value of the previous row, leads value of the next row (wrap the
           value in a struct to tell a missing row from a null value)
    """
    sums, fills, before_maxes = dict(sums or {}), dict(fills or {}), dict(maxes_before or {})
    maxes = dict(maxes or {}) | before_maxes
    lags, leads = dict(lags or {}), dict(leads or {})
    keys = list(keys)
    rank = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    rows = df.withColumn(_BUCKET, bucket)

    aggs = [F.sum(e).alias(f"__s_{n}") for n, e in sums.items()]
    aggs += [F.max(e).alias(f"__m_{n}") for n, e in maxes.items()]
    aggs += [F.max_by(e, F.when(e.isNotNull(), rank)).alias(f"__f_{n}") for n, e in fills.items()]
    aggs += [F.max_by(e, rank).alias(f"__l_{n}") for n, e in lags.items()]
    aggs += [F.min_by(e, rank).alias(f"__n_{n}") for n, e in leads.items()]
    totals = rows.groupBy(*keys, _BUCKET).agg(*aggs)

    over = Window.partitionBy(*keys).orderBy(_BUCKET)
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys,
        _BUCKET,
        *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__s_{n}") for n in sums],
        *[F.max(f"__m_{n}").over(before).alias(f"__m_{n}") for n in maxes],
        *[F.last(f"__f_{n}", ignorenulls=True).over(before).alias(f"__f_{n}") for n in fills],
        *[F.lag(f"__l_{n}").over(over).alias(f"__l_{n}") for n in lags],
        *[F.lead(f"__n_{n}").over(over).alias(f"__n_{n}") for n in leads],
    )

    inside = Window.partitionBy(*keys, _BUCKET).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    place = F.row_number().over(inside)
    joined = rows.join(carry, [*keys, _BUCKET], "left")

    out = [c for c in df.columns]
    extra = [(F.col(f"__s_{n}") + F.sum(e).over(upto)).alias(n) for n, e in sums.items()]
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    extra += [
        F.greatest(F.col(f"__m_{n}"), F.max(e).over(earlier if n in before_maxes else upto)).alias(n) for n, e in maxes.items()
    ]
    extra += [
        F.coalesce(F.last(e, ignorenulls=True).over(upto), F.col(f"__f_{n}")).alias(n) for n, e in fills.items()
    ]
    extra += [
        F.when(place == 1, F.col(f"__l_{n}")).otherwise(F.lag(e).over(inside)).alias(n) for n, e in lags.items()
    ]
    if leads:
        # No row follows; told in the same order as all else, so rows are not sorted a second time.
        last = F.lead(F.lit(True)).over(inside).isNull()
        extra += [
            F.when(last, F.col(f"__n_{n}")).otherwise(F.lead(e).over(inside)).alias(n) for n, e in leads.items()
        ]
    return joined.select(*out, *extra)


def numbered(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], name: str = "rn"
) -> DataFrame:
    """1, 2, 3 ... in `order` within each group, as bigint."""
    one = F.lit(1).cast("bigint")
    return scan(df, keys, bucket, order, sums={name: one})


def runs(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    current: Sequence[str],
    previous: Sequence[str],
    breaks: Callable[[Column], Column],
    name: str,
) -> DataFrame:
    """Number runs of consecutive rows: 1, 2, 3 ... within each group.

    A row starts a run when no row stands before it or `breaks(row before)`
    holds; `breaks` may read the row's own `current` columns and the `previous`
    columns of the row before. Starts are counted inside each bucket; whether a
    bucket's first row starts a run is settled on the bucket summaries.
    """
    keys = list(keys)
    rank = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    inside = Window.partitionBy(*keys, _BUCKET).orderBy(*order)
    starts = F.when(F.col("__prev").isNull(), F.lit(False)).otherwise(F.coalesce(breaks(F.col("__prev")), F.lit(False)))
    local = (
        df.withColumn(_BUCKET, bucket)
        .withColumn("__prev", F.lag(F.struct(*previous)).over(inside))
        .withColumn("__start", starts.cast("bigint"))
        .withColumn("__run", F.sum("__start").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .drop("__prev", "__start")
    )
    over = Window.partitionBy(*keys).orderBy(_BUCKET)
    seen = [c for c in current if c not in keys]
    summary = (
        local.groupBy(*keys, _BUCKET)
        .agg(
            F.min_by(F.struct(*seen), rank).alias("__first"), F.max_by(F.struct(*previous), rank).alias("__last"),
            F.max("__run").alias("__n"),
        )
        .select(*keys, _BUCKET, "__first.*", "__n", F.lag("__last").over(over).alias("__prev"))
    )
    opens = (F.col("__prev").isNull() | F.coalesce(breaks(F.col("__prev")), F.lit(False))).cast("bigint")
    flagged = summary.select(*keys, _BUCKET, "__n", opens.alias("__open"))
    until = F.sum(F.col("__open") + F.col("__n")).over(over.rowsBetween(Window.unboundedPreceding, -1))
    offset = flagged.select(*keys, _BUCKET, (F.coalesce(until, F.lit(0)) + F.col("__open")).alias("__offset"))
    return local.join(offset, [*keys, _BUCKET], "left").select(*df.columns, (F.col("__offset") + F.col("__run")).alias(name))


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], cols: Sequence[str]) -> DataFrame:
    """The first row of each group: an aggregate, so a hot group is combined before it is shuffled."""
    rank = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    best = F.min_by(F.struct(*cols), rank).alias("__first")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__first.{c}").alias(c) for c in cols])


def upper_median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Element at n div 2 of the sorted values, from the histogram of distinct values."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    over = Window.partitionBy(*keys)
    upto = over.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("__n").over(over)
    reach = F.sum("__n").over(upto)
    target = F.floor(total / 2) + 1
    return (
        counts.select(*keys, value, reach.alias("__reach"), target.alias("__target"))
        .filter(F.col("__reach") >= F.col("__target"))
        .groupBy(*keys)
        .agg(F.min(value).alias(name))
    )


def page_cover(
    df: DataFrame, start: str, end: str, page: str = "page_no", block: int = 1024
) -> DataFrame:
    """One row per page of [start, end], so a range join becomes an equi-join.

    Exploded in two steps: no array is longer than the number of blocks or the
    block length, whatever the length of the range.
    """
    lo, hi = F.col(start), F.col(end)
    blocks = F.sequence(F.floor(lo / block), F.floor(hi / block))
    stepped = df.filter(hi >= lo).withColumn("__block", F.explode(blocks))
    first = F.greatest(lo, F.col("__block") * block)
    last = F.least(hi, F.col("__block") * block + (block - 1))
    return stepped.withColumn(page, F.explode(F.sequence(first, last))).drop("__block")
