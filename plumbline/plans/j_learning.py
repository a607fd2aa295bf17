"""Feature preparation, chronological learning and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import evaluation, learning, neighbours, panel, prep
from plumbline.plans import scope
from plumbline.registry import query
from plumbline.sources.oracle_views import register_view

register_view("frame", f"""
SELECT d.*, l.label_end, TIMESTAMP '{scope.THROUGH}' AS data_complete_through, l.sev3_next_90d, l.harm_next_90d FROM derived d JOIN forward_labels l USING (supplier_id, month)
WHERE l.sev3_next_90d IS NOT NULL""")
register_view("labelled", f"""
SELECT supplier_id, month, label_end, sev3_next_90d, harm_next_90d FROM forward_labels WHERE sev3_next_90d IS NOT NULL""")
register_view("folds", """
SELECT fold, month, CASE WHEN i >= n - (5 - fold + 1) * 3 AND i < n - (5 - fold + 1) * 3 + 3 THEN 'test' WHEN i < n - (5 - fold + 1) * 3 - 3 THEN 'train' END AS role
FROM (SELECT month, row_number() OVER (ORDER BY month) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT month FROM labelled)), (SELECT unnest([1,2,3,4,5]) AS fold)""")
HASH = "CAST('0x' || substr(sha256({key} || ':{seed}'), 1, 8) AS BIGINT) / 4294967296"


def labelled(v):
    """Mature labels of the panel grid."""
    grid = panel.spine(v.suppliers, scope.START, scope.END)
    return panel.forward_labels(grid, v.ncrs, scope.THROUGH).where("sev3_next_90d IS NOT NULL")


def frame(v):
    """Derived features joined to their mature labels."""
    return scope.derived(v).join(labelled(v), ["supplier_id", "month"])


@query("month_folds", "fold:i role:s month:d rows:i", """
SELECT fold, role, f.month, count(*) AS rows FROM folds f JOIN labelled l ON l.month = f.month WHERE role IS NOT NULL GROUP BY ALL""")
def month_folds(v):
    rows = labelled(v)
    placed = prep.assign_folds(rows, prep.month_folds(rows, check=False))
    return placed.groupBy("fold", "role", "month").agg(F.count("*").alias("rows"))


@query("train_tail_split", "fold:i part:s rows:i first_month:d last_month:d", """
WITH t AS (SELECT f.fold, l.* FROM folds f JOIN labelled l ON l.month = f.month WHERE f.role = 'train'),
c AS (SELECT fold, month FROM (SELECT fold, month, row_number() OVER (PARTITION BY fold ORDER BY month DESC) AS k FROM (SELECT DISTINCT fold, month FROM t)) WHERE k = 3),
p AS (SELECT t.*, CASE WHEN t.month >= c.month THEN 'calibrate' WHEN label_end <= CAST(c.month + INTERVAL 1 MONTH AS DATE) THEN 'fit' ELSE 'immature' END AS part FROM t JOIN c USING (fold))
SELECT fold, part, count(*) AS rows, min(month) AS first_month, max(month) AS last_month FROM p GROUP BY fold, part""")
def train_tail_split(v):
    rows = labelled(v)
    tail = prep.train_tail(prep.assign_folds(rows, prep.month_folds(rows, check=False)))
    return tail.groupBy("fold", "part").agg(F.count("*").alias("rows"), F.min("month").alias("first_month"), F.max("month").alias("last_month"))


@query("reserve_period", "period_role:s rows:i max_label_end:d", """
SELECT CASE WHEN month >= DATE '2000-06-01' THEN 'final' WHEN label_end <= DATE '2000-07-01' THEN 'development' ELSE 'purged' END AS period_role, count(*) AS rows, max(label_end) AS max_label_end
FROM labelled GROUP BY 1""")
def reserve_period(v):
    got = prep.reserve_period(labelled(v), "2000-06-01", check=False)
    return got.groupBy("period_role").agg(F.count("*").alias("rows"), F.max("label_end").alias("max_label_end"))


@query("modelling_frame", "supplier_id:i month:d ncr_per_1k_units:f fpy_slope_12m:f spend_share:f tier:s sev3_next_90d:i harm_next_90d:i",
       "SELECT * FROM frame")
def modelling_frame(v):
    return prep.modelling_frame(learning.settle(frame(v)))


@query("snapshot_asof", "supplier_id:i month:d snapshot_cutoff:d open_cars:i", """
SELECT supplier_id, month, month_end AS snapshot_cutoff, open_cars FROM panel WHERE month_end <= DATE '2001-05-20' AND month = (SELECT max(month) FROM panel WHERE month_end <= DATE '2001-05-20')""")
def snapshot_asof(v):
    grid = panel.spine(v.suppliers, scope.START, scope.END)
    counted = panel.open_counts(grid, v.cars, "opened_at", "closed_at", "open_cars")
    return prep.snapshot(counted.withColumn("month", F.add_months("month_end", -1)), "2001-05-20")


@query("impute_scale", "ncr_id:s cost:f quantity:f cost_missing:i most_frequent:i", """
WITH tr AS (SELECT * FROM ncrs WHERE discovered_at < DATE '2000-01-01'), f AS (SELECT quantile_cont(cost, 0.5) AS fc, quantile_cont(quantity, 0.5) AS fq FROM tr),
m AS (SELECT avg(coalesce(CAST(cost AS DOUBLE), fc)) AS mc, stddev_pop(coalesce(CAST(cost AS DOUBLE), fc)) AS sc, avg(quantity) AS mq, stddev_pop(quantity) AS sq FROM tr, f),
o AS (SELECT severity AS ms FROM tr GROUP BY severity ORDER BY count(*) DESC, severity LIMIT 1)
SELECT ncr_id, (coalesce(CAST(cost AS DOUBLE), fc) - mc) / sc AS cost, (quantity - mq) / sq AS quantity, CAST(cost IS NULL AS INT) AS cost_missing, ms AS most_frequent FROM ncrs, f, m, o""")
def impute_scale(v):
    early = F.col("discovered_at") < F.lit("2000-01-01").cast("timestamp_ntz")
    rows = v.ncrs.select("ncr_id", "discovered_at", F.col("cost").cast("double").alias("cost"), "quantity", "severity")
    mode = prep.fill_values(rows.where(early), ["severity"], "most_frequent").withColumnRenamed("fill_severity", "most_frequent")
    return prep.impute_scale(rows, ["cost", "quantity"], early).join(F.broadcast(mode))


@query("scalers", "ncr_id:s robust:f ranged:f", """
WITH tr AS (SELECT * FROM ncrs WHERE discovered_at < DATE '2000-01-01'),
q AS (SELECT quantile_cont(CAST(cost AS DOUBLE), 0.25) AS a, quantile_cont(CAST(cost AS DOUBLE), 0.5) AS b, quantile_cont(CAST(cost AS DOUBLE), 0.75) AS c, min(cost) AS lo, max(cost) AS hi FROM tr)
SELECT ncr_id, (CAST(cost AS DOUBLE) - b) / (c - a) AS robust, CAST(cost - lo AS DOUBLE) / CAST(hi - lo AS DOUBLE) AS ranged FROM ncrs, q""")
def scalers(v):
    early = F.col("discovered_at") < F.lit("2000-01-01").cast("timestamp_ntz")
    return prep.robust_and_range(v.ncrs.select("ncr_id", "discovered_at", F.col("cost").cast("double").alias("cost")), "cost", early)


@query("scaler_quantile_normal", "ncr_id:s gaussian:f")
def scaler_quantile_normal(v):
    return prep.quantile_normal(v.ncrs.select("ncr_id", F.col("cost").cast("double").alias("cost")), "cost")


@query("encoders", "ncr_id:s slot:s tier_no:i", """
WITH k AS (SELECT part_number, CASE WHEN count(*) >= 8 THEN CAST(part_number AS VARCHAR) ELSE '<rare>' END AS slot FROM ncrs WHERE discovered_at < DATE '2000-01-01' GROUP BY 1)
SELECT n.ncr_id, k.slot, CASE s.tier WHEN 'C' THEN 0 WHEN 'B' THEN 1 WHEN 'A' THEN 2 ELSE -1 END AS tier_no FROM ncrs n LEFT JOIN k USING (part_number) JOIN suppliers s ON s.supplier_id = n.supplier_id""")
def encoders(v):
    early = F.col("discovered_at") < F.lit("2000-01-01").cast("timestamp_ntz")
    coded = prep.one_hot(v.ncrs.select("ncr_id", "supplier_id", "part_number", "discovered_at"), "part_number", early, 8)
    return coded.join(v.suppliers, "supplier_id").withColumn("tier_no", prep.ordinal("tier"))


@query("target_encode_cv", "ncr_id:s fold:i encoded:f", f"""
WITH p AS (SELECT ncr_id, supplier_id, severity AS y, CAST(floor({HASH.format(key='ncr_id', seed='fold')} * 5) AS INT) AS fold FROM ncrs)
SELECT ncr_id, fold, coalesce((sum(y) OVER (PARTITION BY supplier_id) - sum(y) OVER (PARTITION BY supplier_id, fold)) / nullif(count(*) OVER (PARTITION BY supplier_id) - count(*) OVER (PARTITION BY supplier_id, fold), 0),
  (sum(y) OVER () - sum(y) OVER (PARTITION BY fold)) / (count(*) OVER () - count(*) OVER (PARTITION BY fold))) AS encoded FROM p""")
def target_encode_cv(v):
    return prep.target_encode(v.ncrs.select("ncr_id", "supplier_id", "severity"), "ncr_id", "supplier_id", "severity")


@query("interactions", "audit_id:i audit_score_x_month_no:f audit_score_x_year_no:f month_no_x_year_no:f", """
SELECT audit_id, audit_score * month(audit_date) AS audit_score_x_month_no, audit_score * year(audit_date) AS audit_score_x_year_no, month(audit_date) * year(audit_date) AS month_no_x_year_no FROM audits""")
def interactions(v):
    rows = v.audits.withColumn("month_no", F.month("audit_date")).withColumn("year_no", F.year("audit_date"))
    return prep.interactions(rows, ["audit_score", "month_no", "year_no"])


@query("class_weights", "label:i n:i balanced_weight:f scale_pos_weight:f oversampled:i", f"""
WITH c AS (SELECT ncr_id, CAST(severity = 5 AS INT) AS label FROM ncrs), g AS (SELECT label, count(*) AS n FROM c GROUP BY 1), w AS (SELECT sum(n) AS t, max(n) AS top, max(n) FILTER (WHERE label = 0) AS neg, max(n) FILTER (WHERE label = 1) AS pos FROM g),
o AS (SELECT label, sum(floor(top / n) + CASE WHEN {HASH.format(key='ncr_id', seed='oversample')} < top / n - floor(top / n) THEN 1 ELSE 0 END) AS oversampled FROM c JOIN g USING (label), w GROUP BY label)
SELECT label, n, t / (2 * n) AS balanced_weight, neg / pos AS scale_pos_weight, oversampled FROM g JOIN o USING (label), w""")
def class_weights(v):
    rows = v.ncrs.select("ncr_id", (F.col("severity") == 5).cast("int").alias("label"))
    sizes = prep.oversample(rows, "ncr_id", "label").groupBy("label").agg(F.count("*").alias("oversampled"))
    return prep.class_weights(rows, "label").join(sizes, "label")


def fitted(v, wide: bool = True):
    """Prepared rows of a reserved-period split: ``part`` is fit, calibrate or test. Not ``wide``: what fits and tests read only."""
    rows = prep.reserve_period(frame(v), "2000-06-01", check=False).where("period_role <> 'purged'")
    late = F.col("month") >= F.lit("2000-01-01").cast("date")
    part = F.when(F.col("period_role") == "final", "test").when(late, "calibrate").otherwise("fit")
    parts = rows.withColumn("part", part).withColumn("raw_ncr_count_90d", F.col("ncr_count_90d")).withColumn("raw_units_received_90d", F.col("units_received_90d"))
    ready, inputs = learning.prepared(parts, F.col("part") == "fit")
    ready = ready.withColumn("label", F.col("sev3_next_90d"))
    return learning.settle(ready if wide else ready.select("supplier_id", "month", "part", "label", "x")), inputs


@query("fit_risk_regressor", "supplier_id:i month:d predicted_harm_90d:f harm_next_90d:i")
def fit_risk_regressor(v):
    rows, _ = fitted(v)
    model = learning.fit_regressor(rows.where("part <> 'test'"))
    scored = model.transform(rows.where("part = 'test'"))
    return scored.withColumn("predicted_harm_90d", F.greatest(F.lit(0.0), F.col("prediction")))


@query("fit_risk_classifier", "supplier_id:i month:d p:f sev3_next_90d:i")
def fit_risk_classifier(v):
    rows, _ = fitted(v)
    model, iso = learning.fit_classifier(rows.where("part = 'fit'"), rows.where("part = 'calibrate'"))
    return learning.calibrated(model, iso, rows.where("part = 'test'"))


@query("cv_evaluate", "fold:i n_test:i positive_test:i roc_auc:f average_precision:f log_loss:f brier:f mae:f r2:f recall_sev3:f")
def cv_evaluate(v):
    return learning.cv_evaluate(frame(v), n_splits=5, maxIter=10, maxDepth=4)


@query("bakeoff", "model:s n:i roc_auc:f average_precision:f")
def bakeoff(v):
    return learning.bakeoff(fitted(v)[0])


@query("hyper_search", "point:i params:s mean_auc:f sd_auc:f folds:i")
def hyper_search(v):
    from pyspark.ml.classification import LogisticRegression

    make = lambda **p: LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", maxIter=20, **p)
    points = learning.search_points({"regParam": [0.001, 0.01, 0.1], "elasticNetParam": [0.0, 0.5]}, samples=6)
    return learning.hyper_search(frame(v), make, points, n_splits=3)


register_view("judged", """
SELECT l.doc_id, l.quality AS y, l.toxic, round(least(0.99, greatest(0.01, (d.n_chars % 97) / 97.0)), 4) AS score, CASE WHEN d.n_chars % 97 >= 30 THEN 1 ELSE 0 END AS yhat FROM labels l JOIN documents d USING (doc_id)""")


def judged(v):
    """Labelled documents with a deterministic score from their length."""
    score = F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.col("n_chars") % 97 / 97.0)), 4)
    docs = v.raw("documents").select("doc_id", score.alias("score"), (F.col("n_chars") % 97 >= 30).cast("int").alias("yhat"))
    return v.raw("labels").select("doc_id", F.col("quality").alias("y"), "toxic").join(docs, "doc_id")


@query("ranking_metrics", "n:i positives:i roc_auc:f average_precision:f log_loss:f brier:f", """
WITH r AS (SELECT y, score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS mr FROM judged),
h AS (SELECT score, count(*) AS n, sum(y) AS p FROM judged GROUP BY score), k AS (SELECT p, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM h WINDOW w AS (ORDER BY score DESC))
SELECT count(*) AS n, sum(y) AS positives, (sum(mr) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS roc_auc,
  (SELECT sum(p * cp / cn) / sum(p) FROM k) AS average_precision, avg(-(y * ln(score) + (1 - y) * ln(1 - score))) AS log_loss, avg((y - score) ** 2) AS brier FROM r""")
def ranking_metrics(v):
    return evaluation.ranking_metrics(judged(v), "score", "y")


@query("class_metrics", "label:i support:i tp:i predicted:i precision:f recall:f f1:f macro_f1:f", """
WITH c AS (SELECT k AS label, count(*) FILTER (WHERE y = k) AS support, count(*) FILTER (WHERE y = k AND yhat = k) AS tp, count(*) FILTER (WHERE yhat = k) AS predicted FROM judged, (SELECT unnest([0, 1]) AS k) GROUP BY k),
m AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall FROM c), f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM m)
SELECT *, avg(f1) OVER () AS macro_f1 FROM f""")
def class_metrics(v):
    per = evaluation.class_metrics(judged(v), "y", "yhat")
    return per.join(F.broadcast(per.agg(F.avg("f1").alias("macro_f1"))))


@query("regression_metrics", "n:i mae:f r2:f", """
WITH p AS (SELECT severity AS y, 1 + quantity / 15.0 AS p FROM ncrs)
SELECT count(*) AS n, avg(abs(y - p)) AS mae, 1 - sum((y - p) ** 2) / sum((y - (SELECT avg(y) FROM p)) ** 2) AS r2 FROM p""")
def regression_metrics(v):
    return evaluation.regression_metrics(v.ncrs.withColumn("p", 1 + F.col("quantity") / 15.0), "severity", "p")


@query("threshold_sweep", "threshold:f flagged:i tp:i recall:f precision:f f1:f cost:i best_cost:b best_f1:b", """
WITH g AS (SELECT unnest(generate_series(2, 89)) AS i), s AS (SELECT i / 100 AS threshold, count(*) FILTER (WHERE score >= i / 100) AS flagged, count(*) FILTER (WHERE score >= i / 100 AND y = 1) AS tp, sum(y) AS pos FROM judged, g GROUP BY i),
m AS (SELECT *, tp / nullif(pos, 0) AS recall, tp / greatest(flagged, 1) AS precision, (flagged - tp) * 540 + (pos - tp) * 12600 AS cost FROM s),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM m)
SELECT *, threshold = (SELECT threshold FROM f ORDER BY cost, threshold LIMIT 1) AS best_cost, threshold = (SELECT threshold FROM f ORDER BY round(f1, 9) DESC, threshold LIMIT 1) AS best_f1 FROM f""")
def threshold_sweep(v):
    grid = [f"{i / 100:.2f}" for i in range(2, 90)]
    sweep = evaluation.threshold_sweep(judged(v), "score", "y", grid)
    best = sweep.agg(F.min_by("threshold", F.struct("cost", "threshold")).alias("bc"), F.min_by("threshold", F.struct(-F.round("f1", 9), F.col("threshold"))).alias("bf"))
    return sweep.join(F.broadcast(best)).withColumn("best_cost", F.col("threshold") == F.col("bc")).withColumn("best_f1", F.col("threshold") == F.col("bf"))


@query("score_suppliers", "supplier_id:i snapshot_cutoff:d forecast_end:d predicted_harm_90d:f harm_was_clipped:b risk_score:f p_sev3_90d:f limited_history:b insufficient_recent_activity:b escalate:b")
def score_suppliers(v):
    asof = "2001-10-01"
    rows = scoring_rows(v, asof)
    known = rows.where("part <> 'score'")
    model, iso = learning.fit_classifier(rows.where("part = 'fit'"), rows.where("part = 'calibrate'"))
    harm = learning.fit_regressor(known)
    latest = prep.snapshot(rows.where("part = 'score'"), asof)
    trained_through = known.agg(F.max("label_end")).first()[0]
    return learning.score_suppliers(learning.settle(latest), harm, model, iso, 0.3, trained_through)


def scoring_rows(v, asof: str):
    """Prepared rows as known at ``asof``: fit and calibrate rows have mature labels, the latest month (score) has none yet."""
    at = F.lit(asof).cast("date")
    rows = scope.derived(v).join(labelled(v), ["supplier_id", "month"], "left")
    part = (
        F.when(F.col("month_end") == at, "score")
        .when((F.col("label_end") <= at) & (F.col("month") >= F.add_months(at, -12)), "calibrate")
        .when(F.col("label_end") <= F.add_months(at, -11), "fit")
    )
    raw = {f"raw_{c}": F.col(c) for c in ("ncr_count_90d", "units_received_90d")}
    ready, _ = learning.prepared(rows.withColumns({"part": part, **raw}).where("part IS NOT NULL"), F.col("part") == "fit")
    return learning.settle(ready)


@query("prediction_frame", "supplier_id:i month:d predicted_harm_90d:f recent_harm_90d:f sev3_next_90d:i harm_next_90d:i", "SELECT * FROM predictions")
def prediction_frame(v):
    from plumbline.plans.f_topk_sets import predictions

    return predictions(v)


WEIGHTS = {"severity": 2.0, "quantity": -0.05, "cost": 0.001}


@query("top_drivers", "ncr_id:s rn:i feature:s value:f impact:f direction:s", """
WITH m AS (SELECT avg(severity) AS s, avg(quantity) AS q, sum(CAST(cost AS DOUBLE)) / count(cost) AS c FROM ncrs),
l AS (SELECT ncr_id, unnest(['severity','quantity','cost']) AS feature, unnest([CAST(severity AS DOUBLE), CAST(quantity AS DOUBLE), CAST(cost AS DOUBLE)]) AS value,
  unnest([2.0 * (severity - s), -0.05 * (quantity - q), 0.001 * (CAST(cost AS DOUBLE) - c)]) AS impact FROM ncrs, m)
SELECT *, CASE WHEN impact > 0 THEN 'increases' WHEN impact < 0 THEN 'decreases' ELSE 'no contribution' END AS direction,
  row_number() OVER (PARTITION BY ncr_id ORDER BY abs(impact) DESC NULLS LAST, feature) AS rn FROM l QUALIFY rn <= 2""")
def top_drivers(v):
    rows = v.ncrs.select("ncr_id", "severity", "quantity", F.col("cost").cast("double").alias("cost"))
    means = rows.agg(*[F.avg(c).alias(c) for c in WEIGHTS]).first().asDict()
    return evaluation.top_drivers(evaluation.linear_contributions(rows, "ncr_id", WEIGHTS, means), "ncr_id", 2)


@query("top_drivers_trees", "supplier_id:i month:d rn:i feature:s value:f impact:f direction:s")
def top_drivers_trees(v):
    rows, inputs = fitted(v)
    model = learning.fit_regressor(rows.where("part <> 'test'"))
    long = learning.tree_contributions(model, rows.where("part = 'test'"), inputs, ["supplier_id", "month"])
    keyed = long.withColumn("row_id", F.concat_ws("|", "supplier_id", "month"))
    return evaluation.top_drivers(keyed, "row_id", 5)


def linear_model(v, wide: bool = False):
    from pyspark.ml.classification import LogisticRegression

    rows, inputs = fitted(v, wide)
    train = learning.with_weight(rows.where("part <> 'test'"), "label")
    model = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", maxIter=25, regParam=0.01).fit(train)
    return model, rows.where("part = 'test'"), inputs


@query("permutation_importance", "feature:s mean_drop:f sd_drop:f")
def permutation_importance(v):
    model, test, inputs = linear_model(v)
    return learning.permutation_importance(model, test.withColumn("row_id", F.concat_ws("-", "supplier_id", "month")), inputs, "label", "row_id")


@query("partial_dependence", "grid_value:f mean_score:f n:i")
def partial_dependence(v):
    model, test, inputs = linear_model(v, wide=True)
    return learning.partial_dependence(model, test, inputs, "ncr_count_90d", [-2, -1, 0, 1, 2])


@query("coefficients", "rank:i feature:s weight:f")
def coefficients(v):
    model, _, inputs = linear_model(v)
    ranked = learning.coefficients(model, inputs)
    return v.spark.createDataFrame([(i + 1, n, w) for i, (n, w) in enumerate(ranked)], "rank int, feature string, weight double")


def dense(v):
    from pyspark.ml.functions import array_to_vector

    return v.raw("embeddings").select("vec_id", "label", "embedding", array_to_vector(F.col("embedding").cast("array<double>")).alias("x"))


@query("kmeans_sweep", "k:i inertia:f silhouette:f")
def kmeans_sweep(v):
    return v.spark.createDataFrame(learning.kmeans_sweep(dense(v), range(2, 11)), "k int, inertia double, silhouette double")


@query("dbscan", "vec_id:i cluster:i", """
WITH RECURSIVE p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) <= 1.05),
c AS (SELECT a AS id FROM p GROUP BY a HAVING count(*) >= 8), e AS (SELECT p.a, p.b FROM p JOIN c x ON x.id = p.a JOIN c y ON y.id = p.b),
r AS (SELECT id AS root, id AS node FROM c UNION SELECT r.root, e.b FROM r JOIN e ON e.a = r.node),
l AS (SELECT node, min(root) AS cluster FROM r GROUP BY node),
bd AS (SELECT p.a AS node, min(l.cluster) AS cluster FROM p JOIN l ON l.node = p.b WHERE p.a NOT IN (SELECT id FROM c) GROUP BY 1)
SELECT v.vec_id, coalesce(l.cluster, bd.cluster, -1) AS cluster FROM embeddings v LEFT JOIN l ON l.node = v.vec_id LEFT JOIN bd ON bd.node = v.vec_id""")
def dbscan(v):
    return neighbours.dbscan(v.raw("embeddings"), "vec_id", "embedding", eps=1.05, min_samples=8)


@query("pca_95", "component:i share:f cumulative:f")
def pca_95(v):
    return v.spark.createDataFrame(learning.pca_share(dense(v), 64), "component int, share double, cumulative double")


@query("knn", "vec_id:i neighbours:s predicted:i share:f", """
WITH d AS (SELECT a.vec_id, b.vec_id AS nb, b.label, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
t AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, nb) <= 25),
w AS (SELECT *, min(d) OVER (PARTITION BY vec_id) AS m FROM t),
s AS (SELECT vec_id, label, round(sum(CASE WHEN m = 0 THEN CAST(d = 0 AS INT) ELSE 1 / d END), 9) AS w FROM w GROUP BY ALL)
SELECT t.vec_id, string_agg(CAST(nb AS VARCHAR), ',' ORDER BY d, nb) AS neighbours, any_value(p.predicted) AS predicted, any_value(p.share) AS share FROM t
JOIN (SELECT vec_id, arg_max(label, (w, -label)) AS predicted, max(w) / sum(w) AS share FROM s GROUP BY 1) p USING (vec_id) GROUP BY t.vec_id""")
def knn(v):
    near = learning.settle(neighbours.knn(v.raw("embeddings"), "vec_id", "embedding", 25))
    vote = neighbours.knn_vote(near, v.raw("embeddings"), "vec_id")
    listed = near.groupBy("vec_id").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("rank", "neighbour"))), lambda s: s["neighbour"].cast("string"))).alias("neighbours"))
    return listed.join(vote, "vec_id")


@query("quality_gate", "fold:i metric:s value:f floor:f passed:b", """
WITH m AS (SELECT year(month) - 1994 AS fold, count(*) AS n_test, sum(sev3_next_90d) AS positive_test, avg(sev3_next_90d) AS roc_auc, avg(CAST(harm_next_90d > 5 AS INT)) AS recall_sev3 FROM labelled GROUP BY 1),
ok AS (SELECT bool_and(positive_test > 0 AND positive_test < n_test) AND min(fold) = 1 AND max(fold) = count(*) AS sound, max(fold) AS last FROM m)
SELECT m.fold, unnest(['roc_auc','recall_sev3']) AS metric, unnest([roc_auc, recall_sev3]) AS value, unnest([0.75, 0.5]) AS floor, unnest([roc_auc >= 0.75 AND sound, recall_sev3 >= 0.5 AND sound]) AS passed FROM m JOIN ok ON m.fold = ok.last""")
def quality_gate(v):
    rows = labelled(v)
    metrics = rows.groupBy((F.year("month") - 1994).alias("fold")).agg(
        F.count("*").alias("n_test"), F.sum("sev3_next_90d").alias("positive_test"), F.avg("sev3_next_90d").alias("roc_auc"),
        F.avg((F.col("harm_next_90d") > 5).cast("int")).alias("recall_sev3"),
    )
    return prep.quality_gate(metrics.withColumn("screen_threshold", F.lit(0.04)), {"roc_auc": 0.75, "recall_sev3": 0.5})


@query("mlp_compare", "model:s n:i roc_auc:f average_precision:f")
def mlp_compare(v):
    rows, inputs = fitted(v)
    return learning.mlp_compare(rows, len(inputs))


@query("text_classify", "label:i support:i precision:f recall:f f1:f macro_f1:f")
def text_classify(v):
    docs = v.raw("documents").join(v.raw("labels"), "doc_id").select("doc_id", "text", F.col("quality").alias("label"))
    return learning.text_classify(docs, "doc_id")


@query("text_classify_levels", "model:s label:i support:i precision:f recall:f f1:f macro_f1:f")
def text_classify_levels(v):
    # Three ordered levels: toxic or poor, poor but clean, good.
    level = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    docs = v.raw("documents").join(v.raw("labels"), "doc_id").select("doc_id", "text", level.alias("label"))
    one, two = (learning.text_classify(docs, "doc_id", kind, 3).withColumn("model", F.lit(kind)) for kind in ("ordinal", "bayes"))
    return one.unionByName(two)


@query("kfold_stratified", "ncr_id:s fold:i stratified:i", f"""
WITH u AS (SELECT ncr_id, category, {HASH.format(key='ncr_id', seed='kfold')} AS u FROM ncrs)
SELECT ncr_id, CAST(floor(u * 5) AS INT) AS fold, (row_number() OVER (PARTITION BY category ORDER BY u, ncr_id) - 1) % 5 AS stratified FROM u""")
def kfold_stratified(v):
    rows = v.ncrs.select("ncr_id", "category")
    dealt = prep.stratified_kfold(rows, "ncr_id", "category", 5).withColumnRenamed("fold", "stratified")
    return prep.kfold(dealt, "ncr_id", 5)


@query("holdout_tail", "role:s rows:i first_month:d last_month:d", """
WITH k AS (SELECT month, row_number() OVER (ORDER BY month DESC) AS k FROM (SELECT DISTINCT month FROM labelled))
SELECT CASE WHEN k <= 3 THEN 'test' WHEN k <= 6 THEN 'purged' ELSE 'train' END AS role, count(*) AS rows, min(month) AS first_month, max(month) AS last_month FROM labelled JOIN k USING (month) GROUP BY 1""")
def holdout_tail(v):
    got = prep.holdout_tail(labelled(v))
    return got.groupBy("role").agg(F.count("*").alias("rows"), F.min("month").alias("first_month"), F.max("month").alias("last_month"))
