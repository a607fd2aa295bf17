"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import ordered
from plumbline.registry import query

SINCE = "1999-01-01"

@query("project_filter_limit", "ncr_id:s supplier_id:i part_number:i severity:i", f"""
SELECT ncr_id, supplier_id, part_number, severity FROM ncrs
WHERE severity >= 4 AND discovered_at >= DATE '{SINCE}' ORDER BY discovered_at DESC, ncr_id LIMIT 50""")
def project_filter_limit(v):
    return (
        v.ncrs.where((F.col("severity") >= 4) & (F.col("discovered_at") >= F.lit(SINCE).cast("timestamp_ntz")))
        .orderBy(F.desc("discovered_at"), "ncr_id")
        .limit(50)
        .select("ncr_id", "supplier_id", "part_number", "severity")
    )


@query("bool_masks", "ncr_id:s severe_and_costly:b cheap_or_small:b not_severe:b by_text:b", """
SELECT ncr_id, severity >= 3 AND cost > 1000 AS severe_and_costly, cost < 100 OR quantity < 5 AS cheap_or_small,
       NOT (severity >= 3) AS not_severe, severity > 2 AND category = 'material' AS by_text
FROM ncrs WHERE (severity >= 3 AND cost > 1000) OR quantity < 5 OR NOT (severity >= 3)""")
def bool_masks(v):
    severe, costly = F.col("severity") >= 3, F.col("cost") > 1000
    cheap, small = F.col("cost") < 100, F.col("quantity") < 5
    return (
        v.ncrs.where((severe & costly) | small | ~severe)
        .withColumn("severe_and_costly", severe & costly)
        .withColumn("cheap_or_small", cheap | small)
        .withColumn("not_severe", ~severe)
        .withColumn("by_text", F.expr("severity > 2 and category = 'material'"))
    )


@query("derived_column", "supplier_id:i day:d risk_raw:f", """
SELECT i.supplier_id, CAST(i.inspected_at AS DATE) AS day,
       (1 - avg(CAST(passed AS INT))) * 0.5
       + (1 - avg(CASE WHEN promised_date IS NULL THEN NULL WHEN CAST(inspected_at AS DATE) <= promised_date THEN 1.0 ELSE 0.0 END)) * 0.5 AS risk_raw
FROM inspections i JOIN purchase_orders p ON p.po_line_id = i.inspection_id GROUP BY ALL""")
def derived_column(v):
    # Both shares come from the same delivery line, so one scan and one aggregate suffice.
    on_time = (F.col("l_shipdate").cast("date") <= F.col("promised_date")).cast("int")
    ship = F.col("l_shipdate").cast("date")
    li = v.li.withColumn(
        "promised_date", F.when(F.col("l_partkey") % 97 != 0, F.date_add(ship, (F.col("l_partkey") % 11 - 5).cast("int")))
    )
    daily = li.groupBy(F.col("l_suppkey").alias("supplier_id"), ship.alias("day")).agg(
        F.avg((F.col("l_returnflag") != "R").cast("int")).alias("fpy"), F.avg(on_time).alias("otd")
    )
    return daily.withColumn("risk_raw", (1 - F.col("fpy")) * 0.5 + (1 - F.col("otd")) * 0.5)


@query("case_simple", "supplier_id:i tier_weight:f", """
SELECT supplier_id, CASE tier WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.7 END AS tier_weight FROM suppliers""")
def case_simple(v):
    return v.sql("SELECT supplier_id, CASE tier WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.7 END AS tier_weight FROM {suppliers}")


@query("case_searched", "ncr_id:s priority:s action:s", """
SELECT ncr_id, CASE WHEN severity >= 4 AND cost > 3000 THEN 'CRITICAL' WHEN severity >= 3 THEN 'HIGH'
                    WHEN severity >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS priority,
       CASE WHEN severity >= 4 THEN 'escalate' WHEN severity = 3 THEN 'car' ELSE 'log' END AS action FROM ncrs""")
def case_searched(v):
    s = F.col("severity")
    return v.ncrs.select(
        "ncr_id",
        F.when((s >= 4) & (F.col("cost") > 3000), "CRITICAL")
        .when(s >= 3, "HIGH")
        .when(s >= 2, "MEDIUM")
        .otherwise("LOW")
        .alias("priority"),
        F.when(s >= 4, "escalate").when(s == 3, "car").otherwise("log").alias("action"),
    )


@query("bin_cut", "audit_id:i grade:s", """
SELECT audit_id, CASE WHEN audit_score >= 0 AND audit_score < 80 THEN 'C' WHEN audit_score >= 80 AND audit_score < 90 THEN 'B'
                      WHEN audit_score >= 90 AND audit_score < 101 THEN 'A' END AS grade FROM audits""")
def bin_cut(v):
    return v.audits.select("audit_id", cut(F.col("audit_score"), [0, 80, 90, 101], ["C", "B", "A"]).alias("grade"))


def cut(x, edges, labels):
    """Left-closed bins; values outside every bin become NULL."""
    out = F.lit(None).cast("string")
    for low, high, label in zip(edges[:-1], edges[1:], labels, strict=True):
        out = F.when((x >= low) & (x < high), label).otherwise(out)
    return out


@query("rename_drop", "audit_id:i supplier_id:i review_score:f", """
SELECT audit_id, supplier_id, audit_score AS review_score FROM audits""")
def rename_drop(v):
    return v.audits.withColumnRenamed("audit_score", "review_score").drop("audit_date")


@query("drop_fill_missing", "ncr_id:s cost_filled:f complete:b", """
SELECT ncr_id, coalesce(cost, (SELECT avg(cost) FROM ncrs)) AS cost_filled, cost IS NOT NULL AND closed_at IS NOT NULL AS complete
FROM ncrs WHERE quantity IS NOT NULL""")
def drop_fill_missing(v):
    mean = v.ncrs.agg((F.sum("cost").cast("double") / F.count("cost")).alias("mean_cost"))
    return (
        v.ncrs.na.drop(subset=["quantity"])
        .join(F.broadcast(mean))
        .select(
            "ncr_id",
            F.coalesce(F.col("cost").cast("double"), F.col("mean_cost")).alias("cost_filled"),
            (F.col("cost").isNotNull() & F.col("closed_at").isNotNull()).alias("complete"),
        )
    )


@query("ffill", "ncr_id:s cost_ffill:f", """
SELECT ncr_id, last_value(cost IGNORE NULLS) OVER (PARTITION BY supplier_id ORDER BY discovered_at, ncr_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cost_ffill FROM ncrs""")
def ffill(v):
    df = v.ncrs.select("supplier_id", "discovered_at", "ncr_id", "cost")
    return ordered.forward_fill(
        df, ["supplier_id"], F.col("discovered_at").cast("date"), ["discovered_at", "ncr_id"], F.col("cost"), "cost_ffill"
    )


@query("like_locate", "supplier_id:i starts:b holds:b", """
SELECT supplier_id, supplier_name LIKE 'Supplier#00000%' AS starts, position('000001' IN lower(supplier_name)) > 0 AS holds
FROM suppliers""")
def like_locate(v):
    return v.suppliers.select(
        "supplier_id",
        F.col("supplier_name").like("Supplier#00000%").alias("starts"),
        (F.locate("000001", F.lower("supplier_name")) > 0).alias("holds"),
    )


@query("scalar_subquery_delta", "audit_id:i delta_from_avg:f", """
SELECT audit_id, audit_score - (SELECT sum(CAST(audit_score AS DECIMAL(10,2))) / count(*) FROM audits) AS delta_from_avg FROM audits""")
def scalar_subquery_delta(v):
    return v.sql("""
SELECT audit_id, audit_score - (SELECT CAST(sum(CAST(audit_score AS DECIMAL(10,2))) AS DOUBLE) / count(*) FROM {audits}) AS delta_from_avg
FROM {audits}""")


@query("in_array_filter", "id:i source_type:s", "SELECT id, source_type FROM chunks WHERE source_type IN ('manual', 'car')")
def in_array_filter(v):
    return v.sql("SELECT id, source_type FROM {chunks} WHERE array_contains(:types, source_type)", args={"types": ["manual", "car"]})


@query("json_field_filter", "id:i", """
SELECT id FROM chunks WHERE metadata->>'$.visibility' = 'shared'
   OR (metadata->>'$.visibility' = 'program' AND metadata->>'$.program' IN ('P0', 'P1'))""")
def json_field_filter(v):
    from plumbline.operators.retrieval import visible_to

    return v.chunks.where(visible_to(["P0", "P1"])).select("id")


@query("asof_validity", "id:i valid_from:d valid_to:d", """
SELECT id, valid_from, valid_to FROM chunks WHERE valid_from <= DATE '2024-03-10' AND (valid_to IS NULL OR valid_to > DATE '2024-03-10')""")
def asof_validity(v):
    from plumbline.operators.retrieval import valid_at

    return v.chunks.where(valid_at("2024-03-10")).select("id", "valid_from", "valid_to")


@query("distinct_keys", "supplier_id:i open_ncrs:i open_cost:f", """
SELECT supplier_id, count(*) AS open_ncrs, sum(cost) AS open_cost FROM ncrs WHERE closed_at IS NULL GROUP BY supplier_id""")
def distinct_keys(v):
    is_open = v.ncrs.where(F.col("closed_at").isNull())
    return is_open.groupBy("supplier_id").agg(F.count("*").alias("open_ncrs"), F.sum("cost").alias("open_cost"))


@query("head_profile", "column_name:s present:i mean_value:f min_value:f max_value:f", """
WITH long AS (
  SELECT 'severity' AS column_name, CAST(severity AS DECIMAL(18,2)) AS x FROM ncrs
  UNION ALL SELECT 'quantity', CAST(quantity AS DECIMAL(18,2)) FROM ncrs
  UNION ALL SELECT 'cost', cost FROM ncrs)
SELECT column_name, count(x) AS present, sum(x) / count(x) AS mean_value, min(x) AS min_value, max(x) AS max_value
FROM long GROUP BY column_name""")
def head_profile(v):
    names = ["severity", "quantity", "cost"]
    aggs = [
        F.struct(
            F.lit(n).alias("column_name"),
            F.count(n).alias("present"),
            (F.sum(F.col(n).cast("decimal(18,2)")).cast("double") / F.count(n)).alias("mean_value"),
            F.min(n).cast("double").alias("min_value"),
            F.max(n).cast("double").alias("max_value"),
        ).alias(n)
        for n in names
    ]
    return v.ncrs.agg(*aggs).select(F.inline(F.array(*names)))
