"""The point-in-time supplier-month panel, its trailing features and forward labels.

No range join anywhere. Every window edge is a month start, so a supplier's events of a month
that reach equally far become one row, copied to the at most four month cutoffs it can touch;
what follows is an equality group-by. Hot suppliers collapse before the shuffle.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import session

MONTH = "interval 1 month"


def check_month_range(start: str, end: str) -> tuple[dt.date, dt.date]:
    try:
        first, last = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    except ValueError as exc:
        raise ValueError("use naive month-start dates (YYYY-MM-01)") from exc
    if first.day != 1 or last.day != 1 or first > last:
        raise ValueError("use ordered, timezone-naive month-start dates")
    return first, last


def month_of(col: str | Column) -> Column:
    return F.trunc(F.col(col).cast("date") if isinstance(col, str) else col.cast("date"), "MM")


def spine(suppliers: DataFrame, start: str, end: str) -> DataFrame:
    """Active suppliers times months from onboarding on: an explode per supplier, no cross join.

    The planner takes the grid for as small as the supplier table it comes from and would send
    it through the driver, so its joins are asked to merge.
    """
    check_month_range(start, end)
    first = F.greatest(F.trunc("onboarded_at", "MM"), F.lit(start).cast("date"))
    last = F.lit(end).cast("date")
    return (
        suppliers.where("active")
        .where(first <= last)
        .select("supplier_id", "tier", "onboarded_at", F.explode(F.sequence(first, last, F.expr(MONTH))).alias("month"))
        .withColumn("month_end", F.add_months("month", 1))
        .hint("merge")
    )


def monthly_ncrs(ncrs: DataFrame) -> DataFrame:
    kinds = ("dimensional", "material", "cosmetic", "functional")
    count_if = lambda cond: F.sum(cond.cast("int"))
    return ncrs.groupBy("supplier_id", month_of("discovered_at").alias("month")).agg(
        F.count("*").alias("ncr_count"),
        count_if(F.col("severity") >= 3).alias("sev3_plus_count"),
        F.avg("severity").alias("avg_severity"),
        *[count_if(F.col("category") == k).alias(f"{k}_count") for k in kinds],
        complete_sum("cost").alias("cost"),
    )


def complete_sum(col: str) -> Column:
    """Sum that is NULL when any contributing value is missing."""
    return F.when(F.count(col) == F.count(F.lit(1)), F.sum(col))


def monthly_yield(inspections: DataFrame, key: str = "month") -> DataFrame:
    """Per month, named by its start (``month``) or by the next one's (``month_end``)."""
    month = month_of("inspected_at")
    return inspections.groupBy("supplier_id", (month if key == "month" else F.add_months(month, 1)).alias(key)).agg(
        F.count("*").alias("units"), F.avg(F.col("passed").cast("int")).alias("fpy")
    ).hint("merge")


def deliveries(receipts: DataFrame, orders: DataFrame) -> DataFrame:
    """Receipts with the promise of their order line (equality join on the line id)."""
    promised = orders.select("po_line_id", F.col("supplier_id").alias("order_supplier_id"), "promised_date")
    return receipts.join(promised, "po_line_id")


def monthly_on_time(delivered: DataFrame) -> DataFrame:
    on_time = (F.col("received_at").cast("date") <= F.col("promised_date")).cast("int")
    return delivered.groupBy(F.col("order_supplier_id").alias("supplier_id"), month_of("received_at").alias("month")).agg(
        F.avg(on_time).alias("otd")
    )


def asof_audit(grid: DataFrame, audits: DataFrame) -> DataFrame:
    """Latest audit strictly before each ``month_end`` (ties by id), one row per grid row.

    Audits are first reduced to the last one of each month, so the carry window holds
    at most one row per supplier and month however many audits there are.
    """
    last = audits.groupBy("supplier_id", F.add_months(month_of("audit_date"), 1).alias("month_end")).agg(
        F.max_by(F.struct("audit_score", "audit_date"), F.struct("audit_date", "audit_id")).alias("a")
    )
    points = grid.select("supplier_id", "month_end").withColumn("want", F.lit(True))
    line = points.join(last, ["supplier_id", "month_end"], "full_outer")
    carry = Window.partitionBy("supplier_id").orderBy("month_end").rowsBetween(Window.unboundedPreceding, 0)
    return (
        line.withColumn("a", F.last("a", ignorenulls=True).over(carry))
        .where("want")
        .select("supplier_id", "month_end", F.col("a.audit_score").alias("audit_score"), F.col("a.audit_date").alias("audit_date"))
        .hint("merge")
    )


def open_counts(grid: DataFrame, intervals: DataFrame, opened: str, closed: str, name: str) -> DataFrame:
    """How many ``[opened, closed)`` intervals are open at each month end: +1/-1 per month, running sum."""
    up = intervals.select("supplier_id", F.add_months(month_of(opened), 1).alias("month_end"), F.lit(1).alias("step"))
    down = intervals.where(F.col(closed).isNotNull()).select(
        "supplier_id", F.add_months(month_of(closed), 1).alias("month_end"), F.lit(-1).alias("step")
    )
    steps = up.unionByName(down).groupBy("supplier_id", "month_end").agg(F.sum("step").alias("step"))
    points = grid.select("supplier_id", "month_end").withColumn("want", F.lit(True))
    line = points.join(steps, ["supplier_id", "month_end"], "full_outer")
    upto = Window.partitionBy("supplier_id").orderBy("month_end").rowsBetween(Window.unboundedPreceding, 0)
    return (
        line.withColumn(name, F.coalesce(F.sum("step").over(upto), F.lit(0)))
        .where("want")
        .select("supplier_id", "month_end", name)
        .hint("merge")
    )


def with_history(grid: DataFrame, audits: DataFrame, intervals: DataFrame, opened: str, closed: str, name: str) -> DataFrame:
    """The grid with each row's latest audit (``audit_score, audit_date``) and number of open intervals.

    What :func:`asof_audit` and :func:`open_counts` give, in one line of a supplier's months: audits and steps
    are reduced to months first and stand before the grid row of their month.
    """
    last = audits.groupBy("supplier_id", F.add_months(month_of("audit_date"), 1).alias("month_end")).agg(
        F.max_by(F.struct("audit_score", "audit_date"), F.struct("audit_date", "audit_id")).alias("__a")
    )
    ends = F.array(F.struct(F.col(opened).alias("at"), F.lit(1).alias("step")), F.struct(F.col(closed).alias("at"), F.lit(-1).alias("step")))
    steps = (
        intervals.select("supplier_id", F.inline(ends)).where("at IS NOT NULL")
        .groupBy("supplier_id", F.add_months(month_of("at"), 1).alias("month_end")).agg(F.sum("step").alias("__step"))
    )
    line = grid.withColumn("__want", F.lit(True)).unionByName(last, allowMissingColumns=True).unionByName(steps, allowMissingColumns=True)
    # NULL sorts first: what is known at a month end stands before the row that asks.
    upto = Window.partitionBy("supplier_id").orderBy("month_end", "__want").rowsBetween(Window.unboundedPreceding, 0)
    return (
        line.withColumn("__a", F.last("__a", ignorenulls=True).over(upto))
        .withColumn(name, F.coalesce(F.sum("__step").over(upto), F.lit(0)))
        .where("__want")
        .select(*grid.columns, F.col("__a.audit_score").alias("audit_score"), F.col("__a.audit_date").alias("audit_date"), name)
        .hint("merge")
    )


def supplier_month(
    suppliers, ncrs, inspections, receipts, orders, audits, cars, start: str, end: str
) -> DataFrame:
    """The panel: quiet months count 0, unknown shares stay NULL."""
    grid = spine(suppliers, start, end)
    on = ["supplier_id", "month"]
    wide = (
        grid.join(monthly_ncrs(ncrs), on, "left")
        .join(monthly_yield(inspections).drop("units"), on, "left")
        .join(monthly_on_time(deliveries(receipts, orders)), on, "left")
        .join(asof_audit(grid, audits), ["supplier_id", "month_end"], "left")
        .join(open_counts(grid, cars, "opened_at", "closed_at", "open_cars"), ["supplier_id", "month_end"], "left")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    three = Window.partitionBy("supplier_id").orderBy("month").rowsBetween(-2, 0)
    return wide.select(
        "supplier_id",
        "tier",
        "month",
        zero("ncr_count"),
        zero("sev3_plus_count"),
        "avg_severity",
        *[zero(f"{k}_count") for k in ("dimensional", "material", "cosmetic", "functional")],
        F.when(F.col("ncr_count").isNull(), F.lit(0)).otherwise(F.col("cost")).alias("cost_impact"),
        "fpy",
        "otd",
        "audit_score",
        zero("open_cars"),
        F.sum(F.coalesce("ncr_count", F.lit(0))).over(three).alias("ncr_count_3mo"),
        "onboarded_at",
        "month_end",
    )


def trailing_edges(day: Column, days: int) -> list[tuple[Column, Column]]:
    """The month starts after ``day`` that may see it, nearest first, each with the condition ``day >= c - days``."""
    starts = [F.add_months(F.trunc(day, "MM"), i) for i in range(1, days // 28 + 2)]
    return [(c, day >= F.date_sub(c, days)) for c in starts]


def forward_edges(day: Column, days: int) -> list[tuple[Column, Column]]:
    """The month starts up to ``day`` that may see it, nearest first, each with the condition ``day < c + days``."""
    starts = [F.add_months(F.trunc(day, "MM"), -i) for i in range(days // 28 + 2)]
    return [(c, day < F.date_add(c, days)) for c in starts]


def _seen_from(edges: list[tuple[Column, Column]]) -> Column:
    return F.filter(F.array(*[F.when(holds, c) for c, holds in edges]), lambda c: c.isNotNull())


def trailing_cutoffs(day: Column, days: int) -> Column:
    """Month starts ``c`` with ``day < c`` and ``day >= c - days``."""
    return _seen_from(trailing_edges(day, days))


def forward_cutoffs(day: Column, days: int) -> Column:
    """Month starts ``c`` with ``c <= day < c + days``."""
    return _seen_from(forward_edges(day, days))


def _windowed(events: DataFrame, at: str, edges, days: int, sums: dict[str, Column]) -> DataFrame:
    """Sums per supplier and cutoff. Days of a month that reach equally far are one row before they are copied."""
    day = F.col(at).cast("date")
    reach = sum((holds.cast("int") for _, holds in edges(day, days)), F.lit(0))
    pieces = events.groupBy("supplier_id", F.trunc(day, "MM").alias("month"), reach.alias("reach")).agg(
        F.max(day).alias("day"), *[F.sum(c).alias(n) for n, c in sums.items()]
    )
    spread = pieces.withColumn("cutoff", F.explode(_seen_from(edges(F.col("day"), days))))
    return spread.groupBy("supplier_id", "cutoff").agg(*[F.sum(n).alias(n) for n in sums]).hint("merge")


def trailing_ncrs(ncrs: DataFrame, days: int = 90) -> DataFrame:
    one = F.lit(1)
    got = _windowed(
        ncrs,
        "discovered_at",
        trailing_edges,
        days,
        {
            "ncr_count_90d": one,
            "sev3_count_90d": (F.col("severity") >= 3).cast("int"),
            "sev_sum": F.col("severity"),
            "sev_n": F.col("severity").isNotNull().cast("int"),
        },
    )
    return got.select(
        "supplier_id",
        "cutoff",
        "ncr_count_90d",
        F.coalesce("sev3_count_90d", F.lit(0)).alias("sev3_count_90d"),
        (F.col("sev_sum") / F.nullif("sev_n", F.lit(0))).alias("avg_severity_90d"),
    )


#: Shares of the order lines that meet their receipts one after the other.
RECEIPT_SHARES = 3


def trailing_receipts(delivered: DataFrame, days: int = 90, shares: int = 0) -> DataFrame:
    """Sums over the receipts of the last ``days``; with ``shares``, lines are dealt by their id and each share's sums are stored."""
    late = F.datediff(F.col("received_at").cast("date"), "promised_date")
    sums = {
        "rows": F.lit(1),
        "qty_n": F.col("quantity").isNotNull().cast("int"),
        "qty": F.col("quantity"),
        "promised": F.col("promised_date").isNotNull().cast("int"),
        "on_time": (late <= 0).cast("int"),
        "late": F.greatest(late, F.lit(0)),
    }
    whole_of = lambda rows: _windowed(rows, "received_at", trailing_edges, days, sums)
    if shares:
        share = F.pmod(F.xxhash64("po_line_id"), F.lit(shares))
        parts = [session.written(whole_of(delivered.where(share == k)), "received") for k in range(shares)]
        got = reduce(DataFrame.unionByName, parts).groupBy("supplier_id", "cutoff").agg(*[F.sum(n).alias(n) for n in sums]).hint("merge")
    else:
        got = whole_of(delivered)
    whole = F.col("promised") == F.col("rows")
    return got.select(
        "supplier_id",
        "cutoff",
        F.when(F.col("qty_n") == F.col("rows"), F.col("qty")).alias("units_received_90d"),
        F.when(whole, F.col("on_time") / F.col("rows")).alias("otd_pct"),
        F.when(whole, F.col("late") / F.col("rows")).alias("avg_days_late"),
        F.lit(True).alias("had_receipts"),
    )


def forward_labels(grid: DataFrame, ncrs: DataFrame, complete_through: str, days: int = 90) -> DataFrame:
    """Severe-event flag and severity sum over ``[cutoff, cutoff + days)``; NULL until the window is complete."""
    got = _windowed(
        ncrs,
        "discovered_at",
        forward_edges,
        days,
        {
            "n": F.lit(1),
            "known": F.col("severity").isNotNull().cast("int"),
            "severe": (F.col("severity") >= 3).cast("int"),
            "harm": F.col("severity"),
        },
    ).withColumnRenamed("cutoff", "month_end")
    label_end = F.date_add("month_end", days)
    through = F.lit(complete_through).cast("timestamp_ntz")
    n, known = F.coalesce("n", F.lit(0)), F.coalesce("known", F.lit(0))
    mature = (label_end.cast("timestamp_ntz") <= through) & (n == known)
    return grid.join(got, ["supplier_id", "month_end"], "left").select(
        "supplier_id",
        "month",
        label_end.alias("label_end"),
        through.alias("data_complete_through"),
        F.when(mature, (F.coalesce("severe", F.lit(0)) > 0).cast("int")).alias("sev3_next_90d"),
        F.when(mature, F.coalesce("harm", F.lit(0))).alias("harm_next_90d"),
    )


def feature_base(suppliers, inspections, cars, audits, start: str, end: str) -> DataFrame:
    """The panel's rows with what features take from it: monthly yield, open CARs and the latest audit."""
    known = with_history(spine(suppliers, start, end), audits, cars, "opened_at", "closed_at", "open_cars")
    return known.join(monthly_yield(inspections, "month_end").drop("units"), ["supplier_id", "month_end"], "left")


def supplier_features(panel: DataFrame, ncrs, delivered, audits=None, enrichment: DataFrame | None = None) -> DataFrame:
    """One feature row per panel row, using only events strictly before the month's end.

    Without ``audits`` the panel brings the latest audit itself (``audit_score, audit_date``).
    """
    on = ["supplier_id", "month_end"]
    at = lambda df: df.withColumnRenamed("cutoff", "month_end")
    own = ["audit_score", "audit_date"] if audits is None else []
    base = panel.select("supplier_id", "tier", "month", "month_end", "onboarded_at", "fpy", "open_cars", *own)
    # Receipts meet their order lines in the largest join of all: what it moved is gone before the others start.
    received = trailing_receipts(delivered, shares=RECEIPT_SHARES)
    wide = base.join(at(trailing_ncrs(ncrs)), on, "left").join(at(received), on, "left")
    if audits is not None:
        wide = wide.join(asof_audit(base, audits), on, "left")
    if enrichment is not None:
        wide = wide.join(at(enrichment), on, "left")
    else:
        for name in ("spend_90d", "car_response_days", "car_effectiveness"):
            wide = wide.withColumn(name, F.lit(None).cast("double"))
    return wide.select(
        "supplier_id",
        "tier",
        "month",
        "month_end",
        "onboarded_at",
        F.coalesce("ncr_count_90d", F.lit(0)).alias("ncr_count_90d"),
        F.coalesce("sev3_count_90d", F.lit(0)).alias("sev3_count_90d"),
        "avg_severity_90d",
        F.when(F.col("had_receipts").isNull(), F.lit(0)).otherwise(F.col("units_received_90d")).alias("units_received_90d"),
        "spend_90d",
        "otd_pct",
        "avg_days_late",
        "fpy",
        F.col("audit_score").alias("audit_score_last"),
        F.col("audit_date").alias("audit_date_last"),
        "car_response_days",
        "car_effectiveness",
        "open_cars",
    )


def gaps(panel: DataFrame) -> DataFrame:
    """Rows whose month is not the one after the supplier's previous row."""
    w = Window.partitionBy("supplier_id").orderBy("month")
    ordinal = F.year("month") * 12 + F.month("month")
    return panel.select("supplier_id", "month", (ordinal - F.lag(ordinal).over(w)).alias("step")).where("step <> 1")


def rolling_slope(y: str, window: int = 12) -> Column:
    """Least-squares slope over the last ``window`` rows of the supplier; NULL unless all are present."""
    if window < 2:
        raise ValueError("window must be at least two months")
    w = Window.partitionBy("supplier_id").orderBy("month")
    last = w.rowsBetween(1 - window, 0)
    x = (F.year("month") * 12 + F.month("month")).cast("double")
    return F.when(F.count(y).over(last) == window, F.regr_slope(F.col(y), x).over(last))


def add_derived(features: DataFrame) -> DataFrame:
    """Ratios, trends and shares; zero denominators give NULL. Months must be gapless."""
    w = Window.partitionBy("supplier_id").orderBy("month")
    # One row per month, sent to all: no month is a window of all suppliers, nor the key of a join.
    totals = features.groupBy("month").agg(F.sum("spend_90d").alias("__month_spend"))
    ratio = lambda a, b: F.col(a) / F.nullif(b, F.lit(0))
    return (
        features.join(F.broadcast(totals), "month").select(*features.columns, "__month_spend")
        .withColumn("ncr_per_1k_units", 1000 * ratio("ncr_count_90d", "units_received_90d"))
        .withColumn("pct_high_severity", ratio("sev3_count_90d", "ncr_count_90d"))
        .withColumn("fpy_slope_12m", rolling_slope("fpy"))
        .withColumn("fpy_delta_3m", F.col("fpy") - F.lag("fpy", 3).over(w))
        .withColumn("audit_score_delta", F.col("audit_score_last") - F.lag("audit_score_last").over(w))
        .withColumn("years_as_supplier", F.datediff("month_end", "onboarded_at") / 365.25)
        .withColumn("spend_share", F.col("spend_90d") / F.nullif(F.col("__month_spend"), F.lit(0.0)))
        .withColumn("limited_history", F.row_number().over(w) <= 5)
        .withColumn("days_since_audit", F.datediff("month", "audit_date_last"))
        .withColumn("month_of_year", F.month("month"))
        .drop("__month_spend")
    )


def resample_months(events: DataFrame, keys: list[str], at: str, **aggs: Column) -> DataFrame:
    """Month-end resample per key from its first to its last month; empty months count 0 and sum 0."""
    monthly = events.groupBy(*keys, month_of(at).alias("month")).agg(*[c.alias(n) for n, c in aggs.items()])
    spans = monthly.groupBy(*keys).agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    grid = spans.select(*keys, F.explode(F.sequence("lo", "hi", F.expr(MONTH))).alias("month"))
    return grid.join(monthly, [*keys, "month"], "left").select(
        *keys, F.last_day("month").alias("month_end"), *[F.coalesce(n, F.lit(0)).alias(n) for n in aggs]
    )
