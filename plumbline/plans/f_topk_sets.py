"""Sorts, limits, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import evaluation, panel, vectors
from plumbline.plans import scope
from plumbline.registry import query
from plumbline.sources.oracle_views import register_view


@query("top_n", "ncr_id:s supplier_id:i severity:i", """
SELECT ncr_id, supplier_id, severity FROM ncrs ORDER BY severity DESC NULLS LAST, discovered_at DESC, ncr_id LIMIT 10""")
def top_n(v):
    return v.ncrs.orderBy(F.desc_nulls_last("severity"), F.desc("discovered_at"), "ncr_id").limit(10).select("ncr_id", "supplier_id", "severity")


@query("review_queue", "ncr_id:s category:s severity:i confidence:f supplier_id:i classified_at:d", """
SELECT ncr_id, category, severity, confidence, supplier_id, classified_at FROM classifications c WHERE routed = 'review'
  AND NOT EXISTS (SELECT 1 FROM reviews r WHERE r.decision_id = c.decision_id)
ORDER BY severity DESC NULLS FIRST, confidence ASC NULLS LAST, classified_at, ncr_id LIMIT 50""")
def review_queue(v):
    open_rows = v.classifications.where("routed = 'review'").join(v.reviews.select("decision_id"), "decision_id", "left_anti")
    return open_rows.orderBy(
        F.desc_nulls_first("severity"), F.asc_nulls_last("confidence"), "classified_at", "ncr_id"
    ).limit(50)


register_view("predictions", """
SELECT l.month, l.supplier_id, l.sev3_next_90d, l.harm_next_90d,
  greatest(0, CAST(coalesce(n.sev3_count_90d, 0) * 3 + l.supplier_id % 7 - 5 AS DOUBLE)) AS predicted_harm_90d,
  CASE WHEN n.cutoff IS NULL THEN 0 ELSE n.ncr_count_90d * n.avg_severity_90d END AS recent_harm_90d
FROM (SELECT * FROM forward_labels WHERE harm_next_90d IS NOT NULL) l LEFT JOIN ncr_trail n ON n.supplier_id = l.supplier_id AND n.cutoff = l.month_end""")


def predictions(v):
    """Mature panel rows with a plain linear score standing in for a fitted regressor."""
    grid = panel.spine(v.suppliers, scope.START, scope.END)
    trailing = panel.trailing_ncrs(v.ncrs).withColumnRenamed("cutoff", "month_end")
    labels = panel.forward_labels(grid, v.ncrs, scope.THROUGH).where("harm_next_90d IS NOT NULL")
    rows = (
        grid.join(trailing, ["supplier_id", "month_end"], "left")
        .na.fill(0, ["ncr_count_90d", "sev3_count_90d"])
        .join(labels, ["supplier_id", "month"])
    )
    raw = F.col("sev3_count_90d") * 3 + F.col("supplier_id") % 7 - 5
    return evaluation.prediction_frame(rows.withColumn("raw", raw), "raw")


@query("policy_topk_month",
       "month:d policy:s eligible_suppliers:i selected_suppliers:i selected_ids:s precision_at_k:f recall_at_k:f captured_harm_fraction:f", """
WITH long AS (SELECT *, unnest(['predicted_harm','recent_harm_baseline']) AS policy, unnest([predicted_harm_90d, recent_harm_90d]) AS score FROM predictions),
r AS (SELECT *, row_number() OVER (PARTITION BY month, policy ORDER BY score DESC, supplier_id) AS rn FROM long)
SELECT month, policy, count(*) AS eligible_suppliers, count(*) FILTER (WHERE rn <= 20) AS selected_suppliers,
  string_agg(CAST(supplier_id AS VARCHAR), ',' ORDER BY rn) FILTER (WHERE rn <= 20) AS selected_ids,
  sum(sev3_next_90d) FILTER (WHERE rn <= 20) / count(*) FILTER (WHERE rn <= 20) AS precision_at_k,
  sum(sev3_next_90d) FILTER (WHERE rn <= 20) / nullif(sum(sev3_next_90d), 0) AS recall_at_k,
  sum(harm_next_90d) FILTER (WHERE rn <= 20) / nullif(sum(harm_next_90d), 0) AS captured_harm_fraction
FROM r GROUP BY month, policy""")
def policy_topk_month(v):
    report = evaluation.monthly_policy_report(predictions(v), k=20, check=False)
    return report.withColumn("selected_ids", F.concat_ws(",", F.transform("selected_ids", lambda i: i.cast("string"))))


@query("vector_topk", "query_id:i id:i similarity:f rank:i", """
WITH cells AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
q AS (SELECT label AS query_id, pos, avg(CAST(x AS DOUBLE)) AS x FROM cells GROUP BY ALL),
qn AS (SELECT query_id, sqrt(sum(x * x)) AS n FROM q GROUP BY 1), cn AS (SELECT vec_id, sqrt(sum(CAST(x AS DOUBLE) * x)) AS n FROM cells GROUP BY 1),
s AS (SELECT q.query_id, c.vec_id AS id, sum(q.x * c.x) AS d FROM q JOIN cells c USING (pos) GROUP BY ALL),
t AS (SELECT s.query_id, s.id, round(d / (qn.n * cn.n), 9) AS similarity FROM s JOIN qn USING (query_id) JOIN cn ON cn.vec_id = s.id)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM t QUALIFY rank <= 10""")
def vector_topk(v):
    e = v.raw("embeddings")
    centroids = vectors.mean_vectors(e, "label", "embedding").withColumnRenamed("label", "query_id")
    return vectors.topk_cosine(centroids, e.withColumnRenamed("vec_id", "id"), 10)


@query("union_all", "source:s row_id:s at:d", """
SELECT 'ncr' AS source, ncr_id AS row_id, CAST(discovered_at AS DATE) AS at FROM ncrs
UNION ALL SELECT 'audit', CAST(audit_id AS VARCHAR), audit_date FROM audits UNION ALL SELECT 'car', CAST(car_id AS VARCHAR), opened_at FROM cars""")
def union_all(v):
    shape = lambda df, name, key, at: df.select(
        F.lit(name).alias("source"), F.col(key).cast("string").alias("row_id"), F.col(at).cast("date").alias("at")
    )
    return (
        shape(v.ncrs, "ncr", "ncr_id", "discovered_at")
        .unionByName(shape(v.audits, "audit", "audit_id", "audit_date"))
        .unionByName(shape(v.cars, "car", "car_id", "opened_at"))
    )


@query("set_difference", "supplier_id:i", """
SELECT supplier_id FROM suppliers EXCEPT SELECT supplier_id FROM ncrs WHERE severity = 5 AND cost > 8000""")
def set_difference(v):
    return v.suppliers.select("supplier_id").subtract(v.ncrs.where("severity = 5 AND cost > 8000").select("supplier_id"))
