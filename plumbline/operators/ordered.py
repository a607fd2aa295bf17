"""Ordered computations that survive a hot key.

``sum(x) OVER (PARTITION BY k ORDER BY t)`` sends all rows of one key to one task.
When a single key may hold a third of a table that task never ends. The functions
here take an extra *bucket*: any expression that is non-decreasing in the sort
order (a day, a month, a score band). Rows are windowed inside (key, bucket), each
(key, bucket) is reduced to one row, those few rows are windowed per key, and the
carried value is joined back on (key, bucket). Results equal the plain window.

Where no such expression splits the data evenly (scores, exact sums, hashes), the bucket
is a sampled range of the sort key (:func:`ranged`).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import session

BUCKET, PLACE, RANGE = "__bucket", "__place", "__range"


def _with_bucket(df: DataFrame, bucket: Column) -> DataFrame:
    return df.withColumn(BUCKET, bucket)


def _order(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[str | Column],
    sums: Mapping[str, Column],
) -> DataFrame:
    """Inclusive running sums, one output column per entry of ``sums``."""
    keyed = _with_bucket(df, bucket)
    inside = Window.partitionBy(*keys, BUCKET).orderBy(*_order(order)).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    totals = keyed.groupBy(*keys, BUCKET).agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    carried = totals.select(
        *keys, BUCKET, *[F.coalesce(F.sum(f"__t_{n}").over(across), F.lit(0)).alias(f"__c_{n}") for n in sums]
    )
    local = keyed.select("*", *[F.sum(c).over(inside).alias(f"__l_{n}") for n, c in sums.items()])
    joined = local.join(carried, [*keys, BUCKET])
    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[(F.coalesce(F.col(f"__l_{n}"), F.lit(0)) + F.col(f"__c_{n}")).alias(n) for n in sums],
    )


def row_numbers(df, keys, bucket, order, name: str = "rn") -> DataFrame:
    return running_sums(df, keys, bucket, order, {name: F.lit(1).cast("bigint")})


def carry_forward(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[str],
    value: Column,
    name: str,
    *,
    include_current: bool,
    skip_nulls: bool,
) -> DataFrame:
    """Value of the latest earlier row: ``lag`` or ``last(ignore nulls)`` by flags."""
    keyed = _with_bucket(df, bucket).withColumn("__v", F.struct(value.alias("x")))
    if skip_nulls:
        keyed = keyed.withColumn("__v", F.when(F.col("__v.x").isNotNull(), F.col("__v")))
    ordered = Window.partitionBy(*keys, BUCKET).orderBy(*_order(order))
    frame = ordered.rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    local = keyed.withColumn("__l", F.last("__v", ignorenulls=True).over(frame))
    finals = (
        keyed.where(F.col("__v").isNotNull())
        .groupBy(*keys, BUCKET)
        .agg(F.max_by("__v", F.struct(*_order(order))).alias("__f"))
    )
    buckets = keyed.groupBy(*keys, BUCKET).agg(F.lit(1).alias("__one")).join(finals, [*keys, BUCKET], "left")
    across = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.select(*keys, BUCKET, F.last("__f", ignorenulls=True).over(across).alias("__c"))
    joined = local.join(carried, [*keys, BUCKET])
    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns], F.coalesce(F.col("__l"), F.col("__c"))["x"].alias(name)
    )


def lag(df, keys, bucket, order, value: Column, name: str) -> DataFrame:
    return carry_forward(df, keys, bucket, order, value, name, include_current=False, skip_nulls=False)


def forward_fill(df, keys, bucket, order, value: Column, name: str) -> DataFrame:
    return carry_forward(df, keys, bucket, order, value, name, include_current=True, skip_nulls=True)


def ranged(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """``df`` cut into ranges of ``order`` and sorted: adds ``__place`` (rising) and ``__range`` (its range's number).

    The ranges come from a sample that Spark draws, so their number follows the session's
    shuffle partitions and AQE, and their sizes the data, whatever its distribution. Equal
    keys share a range. A second run would draw other limits, so the result is written.
    """
    rows = df.repartitionByRange(*_order(order)).sortWithinPartitions(*_order(order))
    rows = session.written(rows.withColumn(PLACE, F.monotonically_increasing_id()), "ranged")
    return rows.withColumn(RANGE, F.shiftright(PLACE, 33))


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "rn") -> DataFrame:
    """Row numbers 1, 2, 3... over the whole frame in ``order``: places inside a range, plus the ranges before it.

    Rows move once, to their range; only one count per range is summed and joined back.
    """
    rows = ranged(df, order)
    across = Window.partitionBy(F.lit(0)).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(RANGE).agg(F.count("*").alias("__n"))
    offsets = sizes.select(RANGE, F.coalesce(F.sum("__n").over(across), F.lit(0)).alias("__before"))
    inside = F.col(PLACE) - F.shiftleft(RANGE, 33)
    return rows.join(F.broadcast(offsets), RANGE).select(  # one row per partition
        *[F.col(f"`{c}`") for c in df.columns], (F.col("__before") + inside + 1).alias(name)
    )


def range_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], sums: Mapping[str, Column]) -> DataFrame:
    """Inclusive running sums per key in ``order``, over sampled ranges: a hot key is as many ranges as it needs."""
    rows = ranged(df, [*keys, *order])
    summed = running_sums(rows, keys, F.col(RANGE), order, sums)
    return summed.drop(PLACE, RANGE)


def value_histogram(df: DataFrame, value: str, keys: Sequence[str] = (), **sums: Column) -> DataFrame:
    """One row per distinct value, so equal values never meet in one task unreduced."""
    return df.groupBy(*keys, value).agg(F.count("*").alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()])


def midranks(df: DataFrame, value: str, keys: Sequence[str] = (), **sums: Column) -> DataFrame:
    """Distinct values with their average rank (ties share one), plus ``n`` and asked sums."""
    ranked = range_sums(value_histogram(df, value, keys, **sums), keys, [value], {"cum_n": F.col("n")})
    return ranked.withColumn("midrank", F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2)


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Linearly interpolated quantiles (one row per key and prob) without one task seeing all values.

    The sizes of the ranges tell which of them hold the wanted places; only their rows are ranked.
    """
    rows = ranged(value_histogram(df.where(F.col(value).isNotNull()), value, keys), [*keys, value])
    key = [F.col(k) for k in keys] or [F.lit(0)]
    whole = Window.partitionBy(*key)
    earlier = whole.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*keys, RANGE).agg(F.sum("n").alias("__n"))  # one row per key and range
    asked = sizes.select(
        *keys, RANGE, "__n", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"), F.sum("__n").over(whole).alias("total")
    ).withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs]))).withColumn("pos", (F.col("total") - 1) * F.col("prob"))
    low, high = F.floor("pos"), F.ceil("pos")
    inside = lambda at, first, n: (first <= at) & (at < first + n)
    asked = asked.where(inside(low, F.col("__before"), F.col("__n")) | inside(high, F.col("__before"), F.col("__n")))
    near = F.broadcast(asked.select(*keys, RANGE, "prob", "pos", "__before"))
    run = Window.partitionBy(*key, RANGE).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.join(F.broadcast(asked.select(*keys, RANGE).distinct()), [*keys, RANGE], "left_semi").withColumn("__cum", F.sum("n").over(run))
    # Row i (0-based) is inside the value whose rows are [first, first + n).
    first, v = F.col("__before") + F.col("__cum") - F.col("n"), F.col(value).cast("double")
    hits = ranked.join(near, [*keys, RANGE]).groupBy(*keys, "prob", "pos").agg(
        F.min(F.when(inside(low, first, F.col("n")), v)).alias("lo"), F.max(F.when(inside(high, first, F.col("n")), v)).alias("hi")
    )
    return hits.select(*keys, "prob", (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("pos") - F.floor("pos"))).alias("value"))
