"""Aggregations and the flagship panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import ledger, ordered, panel
from plumbline.plans import scope
from plumbline.registry import query

SINCE = "1998-01-01"


def since(col, day=SINCE):
    return F.col(col) >= F.lit(day).cast("timestamp_ntz")


@query("agg_having", "supplier_id:i ncr_count:i avg_severity:f worst_cost:f", f"""
SELECT supplier_id, count(*) AS ncr_count, avg(severity) AS avg_severity, max(cost) AS worst_cost FROM ncrs
WHERE discovered_at >= DATE '{SINCE}' GROUP BY supplier_id HAVING count(*) >= 110""")
def agg_having(v):
    return (
        v.ncrs.where(since("discovered_at"))
        .groupBy("supplier_id")
        .agg(F.count("*").alias("ncr_count"), F.avg("severity").alias("avg_severity"), F.max("cost").alias("worst_cost"))
        .where("ncr_count >= 110")
    )


@query("agg_named", "supplier_id:i ncr_count:i avg_severity:f max_severity:i total_cost:f", """
SELECT supplier_id, count(ncr_id) AS ncr_count, avg(severity) AS avg_severity, max(severity) AS max_severity, coalesce(sum(cost), 0) AS total_cost
FROM ncrs GROUP BY supplier_id""")
def agg_named(v):
    # An all-missing sum is 0 here (the frame library's rule), not NULL.
    return v.ncrs.groupBy("supplier_id").agg(
        F.count("ncr_id").alias("ncr_count"),
        F.avg("severity").alias("avg_severity"),
        F.max("severity").alias("max_severity"),
        F.coalesce(F.sum("cost"), F.lit(0)).alias("total_cost"),
    )


KINDS = ("dimensional", "material", "cosmetic", "functional")


@query("pivot_conditional", "supplier_id:i dimensional_count:i material_count:i cosmetic_count:i functional_count:i",
       "SELECT supplier_id, " + ", ".join(f"sum(CASE WHEN category = '{k}' THEN 1 ELSE 0 END) AS {k}_count" for k in KINDS)
       + f" FROM ncrs WHERE discovered_at >= DATE '{SINCE}' GROUP BY supplier_id")
def pivot_conditional(v):
    return (
        v.ncrs.where(since("discovered_at"))
        .groupBy("supplier_id")
        .agg(*[F.sum((F.col("category") == k).cast("int")).alias(f"{k}_count") for k in KINDS])
    )


@query("pivot_table", "supplier_id:i " + " ".join(f"{k}:i" for k in KINDS),
       "SELECT supplier_id, " + ", ".join(f"count(*) FILTER (WHERE category = '{k}') AS {k}" for k in KINDS)
       + " FROM ncrs WHERE severity = 5 AND quantity > 40 GROUP BY supplier_id")
def pivot_table(v):
    # Listing the values saves the extra job that would look for them.
    return v.ncrs.where("severity = 5 AND quantity > 40").groupBy("supplier_id").pivot("category", list(KINDS)).count().na.fill(0)


@query("crosstab", "supplier_id:i category:s n:i", "SELECT supplier_id, category, count(*) AS n FROM ncrs GROUP BY ALL")
def crosstab(v):
    return v.ncrs.groupBy("supplier_id", "category").agg(F.count("*").alias("n"))


@query("value_share", "category:s share:f", "SELECT category, count(*) / (SELECT count(*) FROM ncrs) AS share FROM ncrs GROUP BY category")
def value_share(v):
    from plumbline.operators.stats import shares

    return shares(v.ncrs, "category")


@query("column_profile", "column_name:s nulls:i distincts:i q25:f q50:f q75:f duplicate_rows:i", """
WITH long AS (SELECT 'severity' AS column_name, CAST(severity AS DOUBLE) AS x FROM ncrs
  UNION ALL SELECT 'quantity', CAST(quantity AS DOUBLE) FROM ncrs UNION ALL SELECT 'cost', CAST(cost AS DOUBLE) FROM ncrs)
SELECT column_name, count(*) - count(x) AS nulls, count(DISTINCT x) AS distincts, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS q50,
  quantile_cont(x, 0.75) AS q75, (SELECT count(*) FROM ncrs) - (SELECT count(*) FROM (SELECT DISTINCT category, severity, quantity, cost FROM ncrs)) AS duplicate_rows
FROM long GROUP BY column_name""")
def column_profile(v):
    names = ["severity", "quantity", "cost"]
    df = v.ncrs.select("category", *names)
    long = df.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(n).cast("double").alias("x")) for n in names]))
    )
    hist = long.groupBy("column_name", "x").agg(F.count("*").alias("n"))
    summary = hist.groupBy("column_name").agg(
        F.sum(F.when(F.col("x").isNull(), F.col("n")).otherwise(0)).alias("nulls"), F.count("x").alias("distincts")
    )
    quarts = (
        ordered.exact_quantiles(long, "x", [0.25, 0.5, 0.75], ["column_name"])
        .groupBy("column_name")
        .agg(*[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))])
    )
    copies = df.groupBy(*df.columns).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows"))
    return summary.join(quarts, "column_name").join(F.broadcast(copies))


@query("agg_filter", "supplier_id:i ncr_count:i sev3_count:i", """
SELECT supplier_id, count(*) AS ncr_count, count(*) FILTER (WHERE severity >= 3) AS sev3_count FROM ncrs GROUP BY supplier_id""")
def agg_filter(v):
    return v.sql("SELECT supplier_id, count(*) AS ncr_count, count(*) FILTER (WHERE severity >= 3) AS sev3_count FROM {ncrs} GROUP BY supplier_id")


@query("sum_complete_or_null", "supplier_id:i month:d cost:f", """
SELECT supplier_id, CAST(date_trunc('month', discovered_at) AS DATE) AS month, CASE WHEN count(cost) = count(*) THEN sum(cost) END AS cost
FROM ncrs GROUP BY 1, 2""")
def sum_complete_or_null(v):
    return v.ncrs.groupBy("supplier_id", panel.month_of("discovered_at").alias("month")).agg(panel.complete_sum("cost").alias("cost"))


@query("fpy_monthly", "supplier_id:i month:d units:i fpy:f", f"""
SELECT supplier_id, CAST(date_trunc('month', inspected_at) AS DATE) AS month, count(*) AS units, round(avg(CAST(passed AS INT)), 4) AS fpy
FROM inspections WHERE inspected_at >= DATE '{SINCE}' GROUP BY 1, 2""")
def fpy_monthly(v):
    return panel.monthly_yield(v.inspections.where(since("inspected_at"))).withColumn("fpy", F.round("fpy", 4))


@query("fpy_daily", "supplier_id:i day:d fpy:f units:i", f"""
WITH daily AS (SELECT supplier_id, CAST(inspected_at AS DATE) AS day, avg(CAST(passed AS INT)) AS fpy, count(*) AS units FROM inspections
  WHERE inspected_at >= DATE '{SINCE}' GROUP BY 1, 2)
SELECT * FROM daily QUALIFY count(*) OVER (PARTITION BY supplier_id) >= 300""")
def fpy_daily(v):
    daily = (
        v.inspections.where(since("inspected_at"))
        .groupBy("supplier_id", F.col("inspected_at").cast("date").alias("day"))
        .agg(F.avg(F.col("passed").cast("int")).alias("fpy"), F.count("*").alias("units"))
    )
    # One row per supplier-day by now, so the count window is bounded by the calendar.
    from pyspark.sql import Window

    return daily.withColumn("days", F.count("*").over(Window.partitionBy("supplier_id"))).where("days >= 300")


@query("otd_monthly", "supplier_id:i month:d otd:f", """
SELECT p.supplier_id, CAST(date_trunc('month', g.received_at) AS DATE) AS month, avg(CAST(CAST(g.received_at AS DATE) <= p.promised_date AS INT)) AS otd
FROM goods_receipts g JOIN purchase_orders p ON p.po_line_id = g.po_line_id GROUP BY 1, 2""")
def otd_monthly(v):
    return panel.monthly_on_time(panel.deliveries(v.goods_receipts, v.purchase_orders))


PANEL_COLUMNS = (
    "supplier_id:i tier:s month:d ncr_count:i sev3_plus_count:i avg_severity:f dimensional_count:i material_count:i "
    "cosmetic_count:i functional_count:i cost_impact:f fpy:f otd:f audit_score:f open_cars:i ncr_count_3mo:i"
)


@query("supplier_month", PANEL_COLUMNS, "SELECT * FROM panel")
def supplier_month(v):
    return scope.supplier_month(v)


@query("supplier_features",
       "supplier_id:i tier:s month:d onboarded_at:d ncr_count_90d:i sev3_count_90d:i avg_severity_90d:f units_received_90d:i "
       "spend_90d:f otd_pct:f avg_days_late:f fpy:f audit_score_last:f audit_date_last:d car_response_days:f "
       "car_effectiveness:f open_cars:i", "SELECT * FROM features")
def supplier_features(v):
    return scope.features(v)


@query("resample_month", "supplier_id:i month_end:d ncr_count:i total_cost:f", """
WITH m AS (SELECT supplier_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS month
  FROM (SELECT supplier_id, date_trunc('month', min(discovered_at)) AS lo, date_trunc('month', max(discovered_at)) AS hi FROM ncrs GROUP BY 1))
SELECT m.supplier_id, last_day(m.month) AS month_end, count(n.ncr_id) AS ncr_count, coalesce(sum(n.cost), 0) AS total_cost FROM m
LEFT JOIN ncrs n ON n.supplier_id = m.supplier_id AND date_trunc('month', n.discovered_at) = m.month GROUP BY m.supplier_id, m.month""")
def resample_month(v):
    return panel.resample_months(v.ncrs, ["supplier_id"], "discovered_at", ncr_count=F.count("ncr_id"), total_cost=F.sum("cost"))


@query("group_filter_size", "ncr_id:s supplier_id:i", """
SELECT ncr_id, supplier_id FROM ncrs WHERE severity = 5 QUALIFY count(*) OVER (PARTITION BY supplier_id) >= 40""")
def group_filter_size(v):
    severe = v.ncrs.where("severity = 5").select("ncr_id", "supplier_id")
    large = severe.groupBy("supplier_id").count().where("count >= 40")
    return severe.join(large, "supplier_id", "left_semi")


@query("top_groups", "supplier_id:i n:i", "SELECT supplier_id, count(ncr_id) AS n FROM ncrs GROUP BY 1 ORDER BY n DESC, supplier_id LIMIT 10")
def top_groups(v):
    return v.ncrs.groupBy("supplier_id").agg(F.count("ncr_id").alias("n")).orderBy(F.desc("n"), "supplier_id").limit(10)


@query("usage_cost", "model:s calls:i cost_usd:f bad_calls:i", """
WITH u AS (SELECT *, length(text) AS inp, (length(text) * 3) // 7 AS outp, (turn * 13) % 50 AS w5, (conv_id * 7) % 40 AS w1,
    (conv_id * 11) % 30 AS rd, ['frontier','standard','fast','unlisted'][conv_id % 4 + 1] AS model,
    CASE WHEN conv_id % 5 = 0 THEN 'batch' WHEN conv_id % 19 = 0 THEN 'priority' WHEN conv_id % 3 = 0 THEN 'standard' END AS tier,
    CASE WHEN conv_id % 23 = 0 THEN 1 ELSE 0 END AS off FROM conversations),
p AS (SELECT unnest(['frontier','standard','fast']) AS model, unnest([5.0,2.0,1.0]) AS p_in, unnest([25.0,10.0,5.0]) AS p_out,
    unnest([6.25,2.5,1.25]) AS p_5m, unnest([0.5,0.2,0.1]) AS p_rd),
j AS (SELECT u.*, p.p_in, p.p_out, p.p_5m, p.p_rd, p.p_in IS NULL OR coalesce(tier, 'standard') NOT IN ('standard', 'batch') OR off = 1 AS bad FROM u LEFT JOIN p USING (model))
SELECT model, count(*) AS calls, sum(CASE WHEN NOT bad THEN (CASE WHEN tier = 'batch' THEN 0.5 ELSE 1 END) * (inp * p_in + outp * p_out + w5 * p_5m + w1 * 2 * p_in + rd * p_rd) / 1000000 END) AS cost_usd,
  sum(CAST(bad AS INT)) AS bad_calls FROM j GROUP BY model""")
def usage_cost(v):
    calls = v.raw("conversations").select(
        F.element_at(F.array(*[F.lit(m) for m in ("frontier", "standard", "fast", "unlisted")]), (F.col("conv_id") % 4 + 1).cast("int")).alias("model"),
        F.length("text").alias("input_tokens"),
        F.floor(F.length("text") * 3 / 7).alias("output_tokens"),
        (F.col("turn") * 13 % 50).alias("write_5m"),
        (F.col("conv_id") * 7 % 40).alias("write_1h"),
        (F.col("conv_id") * 11 % 30).alias("cache_read"),
        (F.col("turn") * 13 % 50 + F.col("conv_id") * 7 % 40 + F.when(F.col("conv_id") % 23 == 0, 1).otherwise(0)).alias("written"),
        F.when(F.col("conv_id") % 5 == 0, "batch").when(F.col("conv_id") % 19 == 0, "priority").when(F.col("conv_id") % 3 == 0, "standard").alias("tier"),
    )
    priced = ledger.usage_cost(calls)
    return priced.groupBy("model").agg(
        F.count("*").alias("calls"), F.sum("cost_usd").alias("cost_usd"), F.sum(F.col("problem").isNotNull().cast("int")).alias("bad_calls")
    )


@query("block_code_counts", "code:s blocks:i", """
SELECT code, count(*) AS blocks FROM (SELECT unnest(CASE WHEN cents % 11 <> 0 THEN codes ELSE [] END) AS code FROM gateway_events
  WHERE event IN ('blocked', 'failed')) GROUP BY code""")
def block_code_counts(v):
    return ledger.exploded_codes(v.gateway_events).groupBy("code").agg(F.count("*").alias("blocks"))


@query("hana_cost_rank", "supplier_id:i total_cost:f position:i", f"""
SELECT supplier_id, sum(cost) AS total_cost, row_number() OVER (ORDER BY sum(cost) DESC, supplier_id) AS position FROM ncrs
WHERE discovered_at >= DATE '{SINCE}' GROUP BY supplier_id""")
def hana_cost_rank(v):
    totals = (
        v.sql(
            "SELECT supplier_id, sum(cost) AS total_cost FROM {ncrs} WHERE discovered_at >= :since GROUP BY supplier_id",
            args={"since": __import__("datetime").datetime.fromisoformat(SINCE)},
        )
    )
    return ordered.numbered(totals, [F.desc("total_cost"), F.col("supplier_id")], "position")
