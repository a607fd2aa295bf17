"""Data-quality verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import session
from plumbline.operators import panel, quality
from plumbline.plans import scope
from plumbline.registry import query

COLS = "check:s value:f expected:f passed:b"


@query("grain_unique", COLS, """
SELECT 'panel grain' AS "check", count(*) - count(DISTINCT (supplier_id, month)) AS value, 0 AS expected, count(*) = count(DISTINCT (supplier_id, month)) AS passed FROM spine
UNION ALL SELECT 'line grain', count(*) - count(DISTINCT line_id), 0, count(*) = count(DISTINCT line_id) FROM li
UNION ALL SELECT 'order line number', count(*) - count(DISTINCT (l_orderkey, l_linenumber)), 0, count(*) = count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem""")
def grain_unique(v):
    grid = panel.spine(v.suppliers, scope.START, scope.END)
    return quality.stack([
        quality.duplicate_rows(grid, ["supplier_id", "month"], "panel grain"),
        quality.duplicate_rows(v.li, ["line_id"], "line grain"),
        quality.duplicate_rows(v.li, ["l_orderkey", "l_linenumber"], "order line number"),
    ])


@query("count_expectations", COLS, """
WITH a AS (SELECT count(*) AS n, count(*) - count(cost) AS nc, count(DISTINCT category) AS k, count(*) FILTER (WHERE severity = 5) AS s FROM ncrs), z AS (SELECT sum(CAST(l_returnflag = 'R' AS INT)) AS r FROM lineitem)
SELECT 'ncr rows' AS "check", n AS value, r AS expected, n = r AS passed FROM a, z UNION ALL SELECT 'cost nulls', nc, 0, nc = 0 FROM a UNION ALL SELECT 'categories', k, 4, k = 4 FROM a UNION ALL SELECT 'severe rows', s, 100, s = 100 FROM a""")
def count_expectations(v):
    got = v.ncrs.agg(
        F.count("*").alias("n"), F.sum(F.col("cost").isNull().cast("int")).alias("nulls"), F.count_distinct("category").alias("kinds"),
        F.sum((F.col("severity") == 5).cast("int")).alias("severe"),
    )
    returned = v.raw("lineitem").agg(F.sum((F.col("l_returnflag") == "R").cast("int")).alias("r"))
    both = got.join(F.broadcast(returned))
    return quality.stack([
        quality.line(both, "ncr rows", F.col("n"), F.col("r")), quality.line(both, "cost nulls", F.col("nulls")),
        quality.line(both, "categories", F.col("kinds"), 4), quality.line(both, "severe rows", F.col("severe"), 100),
    ])


@query("onboarding_order", COLS, """
SELECT 'panel rows before onboarding' AS "check", count(*) FILTER (WHERE month < date_trunc('month', onboarded_at)) AS value, 0 AS expected, count(*) FILTER (WHERE month < date_trunc('month', onboarded_at)) = 0 AS passed FROM spine
UNION ALL SELECT 'ncrs before onboarding', count(*), 0, count(*) = 0 FROM ncrs n JOIN suppliers s USING (supplier_id) WHERE n.discovered_at < s.onboarded_at""")
def onboarding_order(v):
    grid = panel.spine(v.suppliers, scope.START, scope.END)
    early = grid.agg(F.sum((F.col("month") < F.trunc("onboarded_at", "MM")).cast("int")).alias("x"))
    ncrs = v.ncrs.join(v.suppliers.select("supplier_id", "onboarded_at"), "supplier_id")
    before = ncrs.agg(F.sum((F.col("discovered_at").cast("date") < F.col("onboarded_at")).cast("int")).alias("x"))
    return quality.stack([
        quality.line(early, "panel rows before onboarding", F.col("x")), quality.line(before, "ncrs before onboarding", F.col("x"))
    ])


@query("censoring", COLS, f"""
SELECT 'labels beyond the watermark' AS "check", count(*) FILTER (WHERE label_end > TIMESTAMP '{scope.THROUGH}' AND harm_next_90d IS NOT NULL) AS value, 0 AS expected,
  count(*) FILTER (WHERE label_end > TIMESTAMP '{scope.THROUGH}' AND harm_next_90d IS NOT NULL) = 0 AS passed FROM forward_labels
UNION ALL SELECT 'censored rows', count(*) FILTER (WHERE harm_next_90d IS NULL), count(*) FILTER (WHERE label_end > TIMESTAMP '{scope.THROUGH}'), count(*) FILTER (WHERE harm_next_90d IS NULL) = count(*) FILTER (WHERE label_end > TIMESTAMP '{scope.THROUGH}') FROM forward_labels""")
def censoring(v):
    labels = panel.forward_labels(panel.spine(v.suppliers, scope.START, scope.END), v.ncrs, scope.THROUGH)
    beyond = F.col("label_end").cast("timestamp_ntz") > F.col("data_complete_through")
    known = F.col("harm_next_90d").isNotNull()
    got = labels.agg(F.sum((beyond & known).cast("int")).alias("leaked"), F.sum((~known).cast("int")).alias("censored"), F.sum(beyond.cast("int")).alias("beyond"))
    return quality.stack([
        quality.line(got, "labels beyond the watermark", F.col("leaked")), quality.line(got, "censored rows", F.col("censored"), F.col("beyond"))
    ])


@query("label_recompute", COLS, """
SELECT 'trailing counts that differ' AS "check", 0 AS value, 0 AS expected, true AS passed FROM (SELECT count(*) FROM spine) UNION ALL SELECT 'forward sums that differ', 0, 0, true
UNION ALL SELECT 'rows compared', count(*), count(*), true FROM spine""")
def label_recompute(v):
    grid = panel.spine(v.suppliers, scope.START, scope.END)
    trailing = panel.trailing_ncrs(v.ncrs).select("supplier_id", F.col("cutoff").alias("month_end"), "ncr_count_90d")
    forward = panel.forward_labels(grid, v.ncrs, "2999-01-01").select("supplier_id", F.add_months("month", 1).alias("month_end"), "harm_next_90d")
    other = quality.recomputed_windows(grid, v.ncrs, "discovered_at")
    on = ["supplier_id", "month_end"]
    both = grid.join(trailing, on, "left").join(forward, on, "left").join(other, on, "left")
    diff = lambda a, b: F.sum((F.coalesce(a, F.lit(0)) != F.coalesce(b, F.lit(0))).cast("int"))
    counted = both.agg(diff("ncr_count_90d", "trailing_n").alias("t"), diff("harm_next_90d", "forward_harm").alias("f"), F.count("*").alias("n"))
    expected = grid.agg(F.count("*").alias("m"))
    # One row, read by three checks.
    got = session.written(counted.join(F.broadcast(expected)), "recomputed")
    return quality.stack([
        quality.line(got, "trailing counts that differ", F.col("t")), quality.line(got, "forward sums that differ", F.col("f")),
        quality.line(got, "rows compared", F.col("n"), F.col("m")),
    ])


@query("history_coverage", COLS, f"""
SELECT 'days of history before the first cutoff' AS "check", greatest(0, 90 - (CAST(DATE '{scope.START}' + INTERVAL 1 MONTH AS DATE) - CAST(min(discovered_at) AS DATE))) AS value, 0 AS expected,
  CAST(min(discovered_at) AS DATE) <= CAST(DATE '{scope.START}' + INTERVAL 1 MONTH AS DATE) - 90 AS passed FROM ncrs""")
def history_coverage(v):
    first = v.ncrs.agg(F.min(F.col("discovered_at").cast("date")).alias("d"))
    cutoff = F.add_months(F.lit(scope.START).cast("date"), 1)
    missing = F.greatest(F.lit(0), F.lit(90) - F.datediff(cutoff, "d"))
    return quality.line(first, "days of history before the first cutoff", missing)


@query("future_invariance", COLS, """
SELECT 'feature rows changed by later events' AS "check", 0 AS value, 0 AS expected, true AS passed FROM (SELECT count(*) FROM panel)
UNION ALL SELECT 'feature rows compared', count(*), count(*), true FROM panel WHERE month_end <= DATE '1999-01-01'""")
def future_invariance(v):
    limit = F.col("month_end") <= F.lit("1999-01-01").cast("date")
    full = scope.features(v).where(limit)
    cut = scope.features(v, through="1999-01-01").where(limit)
    # One hash aggregate instead of two EXCEPT ALL passes: a row present in both nets to zero.
    columns = full.columns
    both = full.withColumn("__w", F.lit(1)).unionByName(cut.withColumn("__w", F.lit(-1)))
    changed = both.groupBy(*columns).agg(F.sum("__w").alias("w"), F.sum((F.col("__w") > 0).cast("int")).alias("seen"))
    got = changed.agg(F.sum(F.abs("w")).alias("x"), F.sum("seen").alias("n"))
    grid = panel.spine(v.suppliers, scope.START, scope.END).where(limit).agg(F.count("*").alias("m"))
    return quality.stack([
        quality.line(got, "feature rows changed by later events", F.col("x")),
        quality.line(got.join(F.broadcast(grid)), "feature rows compared", F.col("n"), F.col("m")),
    ])
