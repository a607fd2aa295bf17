"""Window functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators import ordered, panel, windows
from plumbline.plans import scope
from plumbline.registry import query
from plumbline.sources.oracle_views import register_view

register_view("line_days", """
SELECT l_linenumber AS line, CAST(l_shipdate AS DATE) AS day, avg(CAST(l_returnflag <> 'R' AS INT)) AS rate, count(*) AS units FROM lineitem GROUP BY ALL""")
register_view("zscores", """
SELECT *, CASE WHEN sd > 1e-12 THEN (rate - mean) / sd END AS z, coalesce(sd <= 1e-12 AND abs(rate - mean) > 1e-12, false) AS flat FROM (
 SELECT *, CASE WHEN count(rate) OVER w >= 20 THEN avg(rate) OVER w END AS mean, CASE WHEN count(rate) OVER w >= 20 THEN stddev_samp(rate) OVER w END AS sd
 FROM daily WINDOW w AS (PARTITION BY entity_id ORDER BY day RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING))""")


def line_days(v, month=False):
    day = F.col("l_shipdate").cast("date")
    at = F.trunc(day, "MM").alias("month") if month else day.alias("day")
    return v.raw("lineitem").groupBy(F.col("l_linenumber").alias("line"), at).agg(
        F.avg((F.col("l_returnflag") != "R").cast("int")).alias("rate"), F.count("*").alias("units")
    )


@query("topn_per_group", "supplier_id:i ncr_id:s severity:i cost:f rn:i", """
SELECT supplier_id, ncr_id, severity, cost, rn FROM (SELECT *, row_number() OVER (PARTITION BY supplier_id
  ORDER BY severity DESC NULLS LAST, cost DESC NULLS LAST, ncr_id) AS rn FROM ncrs) WHERE rn <= 3""")
def topn_per_group(v):
    return windows.top_per_group(
        v.ncrs, ["supplier_id"], [F.desc_nulls_last("severity"), F.desc_nulls_last("cost"), F.col("ncr_id")], 3
    )


@query("group_mean_dev", "ncr_id:s supplier_avg_severity:f sev_deviation:f", """
SELECT ncr_id, avg(severity) OVER (PARTITION BY supplier_id) AS supplier_avg_severity,
  severity - avg(severity) OVER (PARTITION BY supplier_id) AS sev_deviation FROM ncrs""")
def group_mean_dev(v):
    df = v.ncrs.select("ncr_id", "supplier_id", "severity")
    with_mean = windows.group_statistic(df, ["supplier_id"], supplier_avg_severity=F.avg("severity"))
    return with_mean.withColumn("sev_deviation", F.col("severity") - F.col("supplier_avg_severity"))


@query("cumulative_sum", "ncr_id:s cumulative_cost:f", """
SELECT ncr_id, coalesce(sum(cost) OVER (PARTITION BY supplier_id ORDER BY discovered_at, ncr_id ROWS UNBOUNDED PRECEDING), 0) AS cumulative_cost FROM ncrs""")
def cumulative_sum(v):
    df = v.ncrs.select("ncr_id", "supplier_id", "discovered_at", "cost")
    return ordered.running_sums(
        df, ["supplier_id"], F.col("discovered_at").cast("date"), ["discovered_at", "ncr_id"], {"cumulative_cost": F.col("cost")}
    )


@query("lag_delta", "audit_id:i prev_score:f delta:f", """
SELECT audit_id, lag(audit_score) OVER w AS prev_score, audit_score - lag(audit_score) OVER w AS delta FROM audits
WINDOW w AS (PARTITION BY supplier_id ORDER BY audit_date, audit_id)""")
def lag_delta(v):
    got = ordered.lag(
        v.audits, ["supplier_id"], F.col("audit_date"), ["audit_date", "audit_id"], F.col("audit_score"), "prev_score"
    )
    return got.withColumn("delta", F.col("audit_score") - F.col("prev_score"))


@query("rolling_rows", "supplier_id:i month:d rolling_sum:i rolling_mean:f mom_delta:i rank_in_month:i", """
WITH m AS (SELECT supplier_id, CAST(date_trunc('month', discovered_at) AS DATE) AS month, count(*) AS n FROM ncrs GROUP BY 1, 2),
t AS (SELECT *, sum(n) OVER w3 AS rolling_sum, avg(n) OVER w3 AS rolling_mean, n - lag(n) OVER w AS mom_delta FROM m
  WINDOW w AS (PARTITION BY supplier_id ORDER BY month), w3 AS (PARTITION BY supplier_id ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT *, row_number() OVER (PARTITION BY month ORDER BY rolling_sum DESC, supplier_id) AS rank_in_month FROM t""")
def rolling_rows(v):
    monthly = v.ncrs.groupBy("supplier_id", panel.month_of("discovered_at").alias("month")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("supplier_id").orderBy("month")
    three = w.rowsBetween(-2, 0)
    trend = (
        monthly.withColumn("rolling_sum", F.sum("n").over(three))
        .withColumn("rolling_mean", F.avg("n").over(three))
        .withColumn("mom_delta", F.col("n") - F.lag("n").over(w))
    )
    # A month's suppliers may be as many as there are: its ranks come from ranges.
    return ordered.range_sums(trend, ["month"], [F.desc("rolling_sum"), F.col("supplier_id")], {"rank_in_month": F.lit(1).cast("bigint")})


@query("rolling_range_days", "supplier_id:i day:d n:i fpy_30d:f", """
WITH daily AS (SELECT supplier_id, CAST(inspected_at AS DATE) AS day, count(*) AS n, sum(CAST(passed AS INT)) AS n_pass FROM inspections GROUP BY 1, 2)
SELECT supplier_id, day, n, sum(n_pass) OVER w * 1.0 / sum(n) OVER w AS fpy_30d FROM daily
WINDOW w AS (PARTITION BY supplier_id ORDER BY day RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW)""")
def rolling_range_days(v):
    daily = v.inspections.groupBy("supplier_id", F.col("inspected_at").cast("date").alias("day")).agg(
        F.count("*").alias("n"), F.sum(F.col("passed").cast("int")).alias("n_pass")
    )
    w = Window.partitionBy("supplier_id").orderBy(windows.day_number("day")).rangeBetween(-29, 0)
    return daily.withColumn("fpy_30d", F.sum("n_pass").over(w) / F.sum("n").over(w))


@query("pareto_sql", "supplier_id:i ncr_count:i cumulative_pct:f", """
WITH t AS (SELECT supplier_id, count(*) AS ncr_count FROM ncrs WHERE discovered_at >= DATE '1998-01-01' GROUP BY 1),
r AS (SELECT *, sum(ncr_count) OVER (ORDER BY ncr_count DESC, supplier_id ROWS UNBOUNDED PRECEDING) AS running_sum, sum(ncr_count) OVER () AS total FROM t)
SELECT supplier_id, ncr_count, round(100.0 * running_sum / total, 2) AS cumulative_pct FROM r WHERE running_sum - ncr_count < 0.8 * total""")
def pareto_sql(v):
    totals = (
        v.ncrs.where(F.col("discovered_at") >= F.lit("1998-01-01").cast("timestamp_ntz"))
        .groupBy("supplier_id")
        .agg(F.count("*").alias("ncr_count"))
    )
    return windows.pareto(totals, "supplier_id", "ncr_count")


@query("pareto_list", "supplier_id:i ncr_count:i", """
WITH t AS (SELECT supplier_id, sum(ncr_count) AS ncr_count FROM panel GROUP BY 1),
r AS (SELECT *, sum(ncr_count) OVER (ORDER BY ncr_count DESC, supplier_id ROWS UNBOUNDED PRECEDING) AS running_sum, sum(ncr_count) OVER () AS total FROM t)
SELECT supplier_id, ncr_count FROM r WHERE total > 0 AND running_sum - ncr_count < 0.8 * total""")
def pareto_list(v):
    grid = panel.spine(v.suppliers, scope.START, scope.END)
    counted = grid.join(panel.monthly_ncrs(v.ncrs).select("supplier_id", "month", "ncr_count"), ["supplier_id", "month"], "left")
    totals = counted.groupBy("supplier_id").agg(F.sum(F.coalesce("ncr_count", F.lit(0))).alias("ncr_count"))
    return windows.pareto(totals, "supplier_id", "ncr_count")


@query("rolling_z", "entity_id:i day:d roll_mean:f roll_std:f z:f flat:b", "SELECT entity_id, day, mean AS roll_mean, sd AS roll_std, z, flat FROM zscores")
def rolling_z(v):
    return windows.rolling_z(v.daily, "entity_id", "day", "rate", check=False).withColumnRenamed("flat_baseline_change", "flat")


@query("anomaly_report", "line:i unusual_days:i slope:f on_both:b", """
WITH z AS (SELECT line, day, CASE WHEN sd > 1e-12 THEN (rate - mean) / sd END AS z, coalesce(sd <= 1e-12 AND abs(rate - mean) > 1e-12, false) AS flat FROM (
  SELECT *, CASE WHEN count(rate) OVER w >= 20 THEN avg(rate) OVER w END AS mean, CASE WHEN count(rate) OVER w >= 20 THEN stddev_samp(rate) OVER w END AS sd
  FROM line_days WINDOW w AS (PARTITION BY line ORDER BY day RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING))),
u AS (SELECT line, count(*) AS unusual_days FROM z WHERE abs(z) > 2 OR flat GROUP BY line),
m AS (SELECT l_linenumber AS line, year(l_shipdate) * 12 + month(l_shipdate) AS x, avg(CAST(l_returnflag <> 'R' AS INT)) AS rate FROM lineitem GROUP BY ALL),
s AS (SELECT line, regr_slope(rate, x) AS slope FROM m GROUP BY line HAVING count(*) >= 6)
SELECT coalesce(u.line, s.line) AS line, coalesce(unusual_days, 0) AS unusual_days, s.slope, u.line IS NOT NULL AND s.line IS NOT NULL AS on_both
FROM u FULL JOIN (SELECT * FROM s WHERE slope < 0) s ON s.line = u.line""")
def anomaly_report(v):
    unusual, declining, both = windows.anomaly_report(line_days(v), line_days(v, month=True), "line", z_limit=2.0, slope_limit=0.0)
    days = unusual.groupBy("line").agg(F.count("*").alias("unusual_days"))
    return (
        days.join(declining, "line", "full_outer")
        .join(both.withColumn("on_both", F.lit(True)), "line", "left")
        .select("line", F.coalesce("unusual_days", F.lit(0)).alias("unusual_days"), "slope", F.coalesce("on_both", F.lit(False)).alias("on_both"))
    )


@query("rolling_count_rows_time", "ncr_id:s last_rows:i last_days:i", """
SELECT ncr_id, CASE WHEN row_number() OVER w >= 30 THEN 30 END AS last_rows,
  row_number() OVER w - (SELECT count(*) FROM ncrs o WHERE o.discovered_at <= n.discovered_at - INTERVAL 30 DAY) AS last_days
FROM ncrs n WINDOW w AS (ORDER BY discovered_at, ncr_id)""")
def rolling_count_rows_time(v):
    return windows.rolling_counts(v.ncrs, "discovered_at", "ncr_id")


@query("rolling_slope_12", "supplier_id:i month:d fpy_slope_12m:f", "SELECT supplier_id, month, fpy_slope_12m FROM derived")
def rolling_slope_12(v):
    grid = panel.spine(v.suppliers, scope.START, scope.END)
    monthly = grid.join(panel.monthly_yield(v.inspections), ["supplier_id", "month"], "left")
    return monthly.withColumn("fpy_slope_12m", panel.rolling_slope("fpy"))


@query("lag_features", "supplier_id:i month:d audit_score_delta:f fpy_delta_3m:f", """
SELECT supplier_id, month, audit_score_delta, fpy_delta_3m FROM derived""")
def lag_features(v):
    grid = panel.spine(v.suppliers, scope.START, scope.END)
    monthly = grid.join(panel.monthly_yield(v.inspections), ["supplier_id", "month"], "left").join(
        panel.asof_audit(grid, v.audits), ["supplier_id", "month_end"], "left"
    )
    w = Window.partitionBy("supplier_id").orderBy("month")
    return monthly.withColumn("audit_score_delta", F.col("audit_score") - F.lag("audit_score").over(w)).withColumn(
        "fpy_delta_3m", F.col("fpy") - F.lag("fpy", 3).over(w)
    )


@query("gapless_check", "supplier_id:i month:d step:i", """
WITH m AS (SELECT DISTINCT supplier_id, CAST(date_trunc('month', inspected_at) AS DATE) AS month FROM inspections)
SELECT * FROM (SELECT supplier_id, month, year(month) * 12 + month(month) - lag(year(month) * 12 + month(month)) OVER (PARTITION BY supplier_id ORDER BY month) AS step FROM m) WHERE step <> 1""")
def gapless_check(v):
    return panel.gaps(panel.monthly_yield(v.inspections))


@query("share_of_total", "supplier_id:i month:d spend_share:f", """
WITH s AS (SELECT l_suppkey AS supplier_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS spend FROM lineitem GROUP BY 1, 2)
SELECT supplier_id, month, CAST(spend AS DOUBLE) / nullif(sum(spend) OVER (PARTITION BY month), 0) AS spend_share FROM s""")
def share_of_total(v):
    spend = v.raw("lineitem").groupBy(F.col("l_suppkey").alias("supplier_id"), panel.month_of("l_shipdate").alias("month")).agg(
        F.sum(F.col("l_extendedprice").cast("decimal(12,2)")).alias("spend")
    )
    total = spend.groupBy("month").agg(F.sum("spend").alias("total"))
    return spend.join(total, "month").withColumn("spend_share", F.col("spend").cast("double") / F.nullif(F.col("total").cast("double"), F.lit(0.0)))


@query("limited_history", "supplier_id:i month:d limited_history:b", """
SELECT supplier_id, month, row_number() OVER (PARTITION BY supplier_id ORDER BY month) - 1 < 5 AS limited_history FROM spine""")
def limited_history(v):
    w = Window.partitionBy("supplier_id").orderBy("month")
    return panel.spine(v.suppliers, scope.START, scope.END).withColumn("limited_history", F.row_number().over(w) - 1 < 5)


@query("midrank_percentile", "supplier_id:i risk_score:f", """
WITH t AS (SELECT supplier_id, sum(severity) AS harm FROM ncrs GROUP BY 1)
SELECT supplier_id, 100 * (rank() OVER (ORDER BY harm) + (count(*) OVER (PARTITION BY harm) - 1) / 2 - 0.5) / count(*) OVER () AS risk_score FROM t""")
def midrank_percentile(v):
    from plumbline.operators.evaluation import midrank_percentile as score

    harm = v.ncrs.groupBy("supplier_id").agg(F.sum("severity").alias("harm"))
    return score(harm, "harm", "risk_score")


@query("window_total_then_limit", "supplier_id:i ncr_id:s total_in_window:i", """
SELECT supplier_id, ncr_id, total_in_window FROM (SELECT supplier_id, ncr_id, count(*) OVER (PARTITION BY supplier_id) AS total_in_window,
  row_number() OVER (PARTITION BY supplier_id ORDER BY discovered_at DESC, ncr_id) AS rn FROM ncrs) WHERE rn <= 10""")
def window_total_then_limit(v):
    df = v.ncrs.select("supplier_id", "ncr_id", "discovered_at")
    totals = df.groupBy("supplier_id").agg(F.count("*").alias("total_in_window"))
    return windows.top_per_group(df, ["supplier_id"], [F.desc("discovered_at"), F.col("ncr_id")], 10).join(totals, "supplier_id")


@query("derived_features",
       "supplier_id:i month:d ncr_per_1k_units:f pct_high_severity:f fpy_slope_12m:f audit_score_delta:f years_as_supplier:f spend_share:f limited_history:b",
       "SELECT * FROM derived")
def derived_features(v):
    return scope.derived(v)


@query("date_parts_elapsed", "ncr_id:s year:i quarter:i dow:i month_of_year:i days_open:i", """
SELECT ncr_id, year(discovered_at) AS year, quarter(discovered_at) AS quarter, isodow(discovered_at) - 1 AS dow, month(discovered_at) AS month_of_year,
  closed_at - CAST(discovered_at AS DATE) AS days_open FROM ncrs""")
def date_parts_elapsed(v):
    at = F.col("discovered_at")
    return v.ncrs.select(
        "ncr_id",
        F.year(at).alias("year"),
        F.quarter(at).alias("quarter"),
        F.weekday(at).alias("dow"),
        F.month(at).alias("month_of_year"),
        F.datediff("closed_at", at.cast("date")).alias("days_open"),
    )


@query("context_prefix", "query_id:s id:i used:i", """
SELECT query_id, id, used FROM (SELECT source AS query_id, doc_id AS id, sum((length(text) + 3) // 4) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used
FROM documents) WHERE used <= 20000""")
def context_prefix(v):
    ranked = v.raw("documents").select(
        F.col("source").alias("query_id"), F.col("doc_id").alias("id"), F.floor((F.length("text") + 3) / 4).alias("tokens")
    )
    return windows.within_budget(ranked, "query_id", "id", "tokens", 20000)
