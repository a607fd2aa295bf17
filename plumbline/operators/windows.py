"""Rolling, ranking and Pareto computations on per-day or per-entity aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import ordered
from plumbline.operators.joins import ContractError, duplicate_keys

Z_THRESHOLD = 3.0
SLOPE_THRESHOLD = -0.01


def day_number(col: str) -> Column:
    return F.datediff(F.col(col), F.lit("1970-01-01").cast("date"))


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, name: str = "rn") -> DataFrame:
    """First ``k`` rows per group. Spark keeps at most ``k`` per group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def group_statistic(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Group aggregates beside every row: reduce first, then join, so a hot key is never one window."""
    return df.join(df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()]), list(keys))


def pareto(totals: DataFrame, entity: str, weight: str, share: float = 0.8) -> DataFrame:
    """Largest entities up to and including the one that crosses ``share`` of the total."""
    ranked = ordered.range_sums(totals, [], [F.desc(weight), entity], {"running_sum": F.col(weight)})
    whole = totals.agg(F.sum(weight).alias("total"))
    cut = F.lit(str(share)).cast("decimal(6,4)") * F.col("total")
    return (
        ranked.join(F.broadcast(whole))
        .where((F.col("total") > 0) & (F.col("running_sum") - F.col(weight) < cut))
        .withColumn("cumulative_pct", F.round(100.0 * F.col("running_sum") / F.col("total"), 2))
    )


def rolling_z(daily: DataFrame, entity: str, day: str, value: str, window: int = 30, check: bool = True) -> DataFrame:
    """z of each day against the mean and deviation of ``[t - window, t)``, at least 20 observations.

    A flat baseline (deviation <= 1e-12) gives no z; a change from it raises its own flag.
    """
    if window < 20:
        raise ValueError("window must cover at least 20 days")
    if check and not duplicate_keys(daily, [entity, day]).isEmpty():
        raise ContractError(f"one row per {entity} and {day} required")
    before = Window.partitionBy(entity).orderBy(day_number(day)).rangeBetween(-window, -1)
    x = F.col(value).cast("double")
    enough = F.count(x).over(before) >= 20
    sd = F.when(enough, F.stddev_samp(x).over(before))
    mean = F.when(enough, F.avg(x).over(before))
    return (
        daily.withColumn("roll_mean", mean)
        .withColumn("roll_std", sd)
        .withColumn("z", F.when(F.col("roll_std") > 1e-12, (x - F.col("roll_mean")) / F.col("roll_std")))
        .withColumn(
            "flat_baseline_change",
            F.coalesce((F.col("roll_std") <= 1e-12) & (F.abs(x - F.col("roll_mean")) > 1e-12), F.lit(False)),
        )
    )


def trend_slopes(monthly: DataFrame, entity: str, month: str, value: str, check: bool = True) -> DataFrame:
    """Least-squares slope per calendar month (gaps kept); NULL below six points."""
    known = monthly.where(F.col(value).isNotNull() & F.col(month).isNotNull())
    if check and not duplicate_keys(known, [entity, month]).isEmpty():
        raise ContractError("one observation per calendar month")
    x = (F.year(month) * 12 + F.month(month)).cast("double")
    return known.groupBy(entity).agg(F.when(F.count("*") >= 6, F.regr_slope(F.col(value), x)).alias("slope"))


def anomaly_report(
    daily: DataFrame, monthly: DataFrame, entity: str, z_limit: float = Z_THRESHOLD, slope_limit: float = SLOPE_THRESHOLD
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(unusual entity-days, declining entities, entities on both lists)."""
    z = rolling_z(daily, entity, "day", "rate")
    unusual = z.where((F.abs("z") > z_limit) | F.col("flat_baseline_change"))
    declining = trend_slopes(monthly, entity, "month", "rate").where(F.col("slope") < slope_limit)
    both = unusual.select(entity).intersect(declining.select(entity))
    return unusual, declining, both


def rolling_counts(events: DataFrame, at: str, row_id: str, rows: int = 30, days: int = 30) -> DataFrame:
    """Rolling row counts over the whole series: last ``rows`` rows, and ``(t - days, t]`` up to the row itself.

    The series has no key, so rows are numbered in two levels (by hour, then within the
    hour); the time window is the row's position minus the number of rows up to its edge,
    which stands on the same timeline behind the rows of its own time.
    """
    marks = events.select(F.col(row_id), F.col(at).cast("timestamp_ntz").alias("__at"), F.lit(0).alias("__kind"))
    edges = marks.select(row_id, (F.col("__at") - F.expr(f"INTERVAL '{days}' DAY")).alias("__at"), F.lit(1).alias("__kind"))
    line = ordered.running_sums(
        marks.unionByName(edges), [], F.date_trunc("hour", "__at"), ["__at", "__kind", row_id], {"position": (F.col("__kind") == 0).cast("bigint")}
    )
    older = line.where("__kind = 1").select(row_id, F.col("position").alias("older"))
    return line.where("__kind = 0").select(row_id, "position").join(older, row_id).select(
        row_id,
        F.when(F.col("position") >= rows, F.lit(rows)).alias("last_rows"),
        (F.col("position") - F.col("older")).alias("last_days"),
    )


def within_budget(df: DataFrame, query: str, rank: str, tokens: str, budget: int) -> DataFrame:
    """Rank-ordered prefix per query whose token sum fits; stops at the first overflow."""
    if budget < 0:
        raise ValueError("nonnegative context budget required")
    summed = ordered.running_sums(df, [query], F.floor(F.col(rank) / 1000), [rank], {"used": F.col(tokens)})
    return summed.where(F.col("used") <= budget)
