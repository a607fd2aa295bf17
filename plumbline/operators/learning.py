"""Fitting and evaluating models on chronological roles with Spark ML.

The driver loops over folds or candidates; every fit, transform and metric is a Spark
job. Frames that several fits share are checkpointed once.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import HashingTF, IDF, PCA, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from plumbline import session
from plumbline.functions.text import TOKEN
from plumbline.operators import evaluation, ordered, prep, signal
from plumbline.operators.joins import ContractError

SEED = 42


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder."""
    session.ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def prepared(df: DataFrame, is_train, columns: Sequence[str] = prep.NUMERIC, stored: bool = False) -> tuple[DataFrame, list[str]]:
    """Imputed and scaled predictors (training rows decide), missing flags, ordinal tier, one vector column.

    The fitted parameters read the rows several times, a few columns each: rows that are not stored yet are written first.
    """
    rows = df if stored else session.written(df, "prepared")
    scaled = prep.impute_scale(rows, list(columns), is_train)
    inputs = [*columns, *[f"{c}_missing" for c in columns]]
    if "tier" in df.columns:
        scaled = scaled.withColumn("tier_no", prep.ordinal("tier").cast("double"))
        inputs.append("tier_no")
    # A column with no training value at all carries no information.
    for c in columns:
        scaled = scaled.withColumn(c, F.coalesce(c, F.lit(0.0)))
    return VectorAssembler(inputCols=inputs, outputCol="x").transform(scaled), inputs


def with_weight(df: DataFrame, label: str) -> DataFrame:
    """Positive rows weigh negatives / positives."""
    c = df.agg(F.sum((F.col(label) == 0).cast("int")).alias("neg"), F.sum((F.col(label) == 1).cast("int")).alias("pos")).first()
    if not c["neg"] or not c["pos"]:
        raise ContractError("fit and calibration need both classes")
    return df.withColumn("weight", F.when(F.col(label) == 1, F.lit(c["neg"] / c["pos"])).otherwise(F.lit(1.0)))


def fit_regressor(train: DataFrame, label: str = "harm_next_90d", **params):
    return GBTRegressor(featuresCol="x", labelCol=label, seed=SEED, **{"maxIter": 60, "maxDepth": 4, "stepSize": 0.1, **params}).fit(train)


def fit_classifier(fit: DataFrame, calibrate: DataFrame, label: str = "sev3_next_90d", **params):
    """Weighted boosting on the fit rows, isotonic calibration on the later rows."""
    booster = GBTClassifier(
        featuresCol="x", labelCol=label, weightCol="weight", seed=SEED, **{"maxIter": 60, "maxDepth": 4, "stepSize": 0.1, **params}
    )
    model = booster.fit(with_weight(fit, label))
    scored = raw_probability(model.transform(calibrate)).drop("prediction", "probability", "rawPrediction")
    if scored.select(label).distinct().count() < 2:
        raise ContractError("fit and calibration need both classes")
    return model, IsotonicRegression(featuresCol="raw_p", labelCol=label, predictionCol="p").fit(scored)


def raw_probability(scored: DataFrame) -> DataFrame:
    return scored.withColumn("raw_p", vector_to_array("probability")[1])


def calibrated(model, isotonic, rows: DataFrame) -> DataFrame:
    scored = raw_probability(model.transform(rows))
    out = isotonic.transform(scored.drop("prediction", "probability", "rawPrediction"))
    return out.withColumn("p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p"))))


def fold_rows(frame: DataFrame, folds: DataFrame, fold: int) -> DataFrame:
    """One fold's rows with ``role`` (train/test) and ``part`` (fit/calibrate/immature for train rows)."""
    here = prep.assign_folds(frame, folds.where(F.col("fold") == fold))
    train = prep.train_tail(here)
    test = here.where("role = 'test'").withColumn("part", F.lit("test"))
    # Training labels must be known at the first test cutoff.
    first = test.agg(F.add_months(F.min("month"), 1).alias("first_cutoff"))
    known = train.join(F.broadcast(first)).where(F.col("label_end") <= F.col("first_cutoff")).drop("first_cutoff")
    return known.unionByName(test)


def cv_evaluate(frame: DataFrame, n_splits: int = 5, threshold: float = 0.04, **params) -> DataFrame:
    """Per fold: calibrated classifier and burden regressor, ranking and error metrics on the test months."""
    frame = session.written(frame, "cv-frame")
    folds = settle(prep.month_folds(frame, n_splits))
    out = None
    for fold in range(1, n_splits + 1):
        # Only one fold's vectors are stored at a time.
        ready, _ = prepared(fold_rows(frame, folds, fold), F.col("part") == "fit", stored=True)
        rows = session.written(ready.select("x", "part", "role", "sev3_next_90d", "harm_next_90d"), "cv-rows")
        model, iso = fit_classifier(rows.where("part = 'fit'"), rows.where("part = 'calibrate'"), **params)
        test = settle(calibrated(model, iso, rows.where("part = 'test'")).select("p", "sev3_next_90d"))
        ranking = evaluation.ranking_metrics(test, "p", "sev3_next_90d")
        harm = fit_regressor(rows.where("role = 'train'"), **params).transform(rows.where("part = 'test'"))
        errors = evaluation.regression_metrics(harm.withColumn("clipped", F.greatest(F.lit(0.0), F.col("prediction"))), "harm_next_90d", "clipped")
        recall = test.agg(
            (F.sum(((F.col("p") >= threshold) & (F.col("sev3_next_90d") == 1)).cast("int")) / F.nullif(F.sum("sev3_next_90d"), F.lit(0))).alias("recall_sev3")
        )
        line = (
            ranking.join(F.broadcast(errors.select("mae", "r2"))).join(F.broadcast(recall))
            .select(
                F.lit(fold).alias("fold"), F.col("n").alias("n_test"), F.col("positives").alias("positive_test"), "roc_auc",
                "average_precision", "log_loss", "brier", "mae", "r2", "recall_sev3", F.lit(threshold).alias("screen_threshold"),
            )
        )
        line = session.written(line, "cv-line")
        session.discard(rows)
        out = line if out is None else out.unionByName(line)
    return out


def candidates() -> dict[str, Callable]:
    """Classifier families of the comparison (a linear SVC stands in for the kernel one)."""
    common = {"featuresCol": "x", "labelCol": "label", "weightCol": "weight"}
    return {
        "logistic": lambda: LogisticRegression(maxIter=50, regParam=0.01, **common),
        "tree": lambda: DecisionTreeClassifier(maxDepth=4, seed=SEED, **common),
        "forest": lambda: RandomForestClassifier(numTrees=20, maxDepth=5, seed=SEED, **common),
        "boosting": lambda: GBTClassifier(maxIter=10, maxDepth=3, seed=SEED, **common),
        "linear_svc": lambda: LinearSVC(maxIter=20, regParam=0.01, **common),
    }


def margin(scored: DataFrame) -> DataFrame:
    """A ranking score in (0, 1) from probability or margin."""
    if "probability" in scored.columns:
        return scored.withColumn("score", vector_to_array("probability")[1])
    return scored.withColumn("score", 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1])))


def bakeoff(rows: DataFrame, entries: Mapping[str, Callable] | None = None) -> DataFrame:
    """Test metrics of every candidate on the same prepared rows (``x, label, part``), best first."""
    rows = settle(rows.select("x", "label", "part"))
    train, test = with_weight(rows.where("part <> 'test'"), "label"), rows.where("part = 'test'")
    out = None
    for name, make in (entries or candidates()).items():
        scored = settle(margin(make().fit(train).transform(test)).select("label", "score"))
        line = evaluation.ranking_metrics(scored, "score", "label").select(F.lit(name).alias("model"), "n", "roc_auc", "average_precision")
        out = line if out is None else out.unionByName(line)
    return out.orderBy(F.desc("average_precision"), "model")


def search_points(space: Mapping[str, Sequence], samples: int | None = None, seed: int = SEED) -> list[dict]:
    """The full grid, or ``samples`` of its points drawn without replacement."""
    points = [{}]
    for name, values in space.items():
        points = [{**p, name: v} for p in points for v in values]
    if samples is not None and samples < len(points):
        keep = np.random.default_rng(seed).choice(len(points), size=samples, replace=False)
        points = [points[i] for i in sorted(keep)]
    return points


def hyper_search(frame: DataFrame, make: Callable[..., object], points: Sequence[dict], n_splits: int = 3) -> DataFrame:
    """Mean and deviation over chronological folds of each parameter point."""
    frame = session.written(frame, "search-frame")
    folds = settle(prep.month_folds(frame, n_splits))
    out = None
    for fold in range(1, n_splits + 1):
        rows, _ = prepared(fold_rows(frame, folds, fold), F.col("role") == "train", stored=True)
        rows = settle(rows.select("x", "role", F.col("sev3_next_90d").alias("label")))
        train = with_weight(rows.where("role = 'train'"), "label")
        for i, point in enumerate(points):
            scored = margin(make(**point).fit(train).transform(rows.where("role = 'test'"))).select("label", "score")
            line = evaluation.ranking_metrics(scored, "score", "label").select(F.lit(i).alias("point"), F.lit(str(point)).alias("params"), F.lit(fold).alias("fold"), "roc_auc")
            out = line if out is None else out.unionByName(line)
    return out.groupBy("point", "params").agg(F.avg("roc_auc").alias("mean_auc"), F.stddev_samp("roc_auc").alias("sd_auc"), F.count("*").alias("folds"))


def stage1_report(features: DataFrame, label: str, row_id: str, rate: float = 0.05) -> DataFrame:
    """Boosted gate on the window features; calibration rows only set the threshold."""
    from plumbline.operators import cascade

    numeric = [n for n in signal.feature_names() if n not in signal.CONTEXT]
    renamed = features.select(row_id, F.col(label).alias("label"), *[F.col(f"`{n}`").alias(n.replace(".", "_")) for n in numeric])
    parts = ordered.row_numbers(renamed, [], F.floor(F.col(row_id) / 1000), [row_id], "rn")
    n = renamed.agg(F.count("*").alias("n"))
    parts = parts.join(F.broadcast(n)).withColumn("part", F.when(F.col("rn") <= F.col("n") * 0.7, "fit").otherwise("calibrate"))
    rows = settle(VectorAssembler(inputCols=[c.replace(".", "_") for c in numeric], outputCol="x").transform(parts))
    model = GBTClassifier(featuresCol="x", labelCol="label", weightCol="weight", maxIter=10, maxDepth=3, seed=SEED).fit(with_weight(rows.where("part = 'fit'"), "label"))
    scored = settle(margin(model.transform(rows.where("part = 'calibrate'"))).select("label", "score"))
    cut = cascade.flag_rate_threshold(scored, "score", rate)
    return evaluation.ranking_metrics(scored, "score", "label").join(F.broadcast(cut.drop("n"))).select(
        F.lit("boosting").alias("model"), F.col("n").alias("rows"), "roc_auc", F.col("achieved_rate").alias("flag_rate")
    )


def score_suppliers(snapshot: DataFrame, harm_model, classifier, isotonic, threshold: float, trained_through: dt.date | None = None) -> DataFrame:
    """Score the prepared latest snapshot: clipped burden, midrank score, probability, and who to escalate.

    The snapshot needs no labels. ``trained_through`` is the day on which the models' last
    label became known; models that know more than the scoring date did are refused.
    """
    cutoff = snapshot.agg(F.min("snapshot_cutoff")).first()[0]
    if trained_through is not None and cutoff is not None and trained_through > cutoff:
        raise ContractError(f"the models were trained on outcomes through {trained_through}, after the scoring date {cutoff}")
    harm = harm_model.transform(snapshot).withColumnRenamed("prediction", "raw_predicted_harm_90d")
    scored = calibrated(classifier, isotonic, harm).withColumn("predicted_harm_90d", F.greatest(F.lit(0.0), F.col("raw_predicted_harm_90d")))
    ranked = evaluation.midrank_percentile(settle(scored), "predicted_harm_90d", "risk_score")
    inactive = (F.coalesce("raw_ncr_count_90d", F.lit(0)) == 0) & (F.coalesce("raw_units_received_90d", F.lit(0)) <= 0)
    return ranked.select(
        "supplier_id",
        "snapshot_cutoff",
        F.date_add("snapshot_cutoff", 90).alias("forecast_end"),
        "raw_predicted_harm_90d",
        "predicted_harm_90d",
        (F.col("raw_predicted_harm_90d") < 0).alias("harm_was_clipped"),
        "risk_score",
        F.col("p").alias("p_sev3_90d"),
        "limited_history",
        inactive.alias("insufficient_recent_activity"),
        ((F.col("p") >= threshold) & ~F.col("limited_history") & ~inactive).alias("escalate"),
    )


def coefficients(model, names: Sequence[str]) -> list[tuple[str, float]]:
    """(feature, coefficient or importance) of a fitted model, largest size first."""
    values = model.coefficients.toArray() if hasattr(model, "coefficients") else model.featureImportances.toArray()
    return sorted(zip(names, map(float, values), strict=True), key=lambda p: (-abs(p[1]), p[0]))


def affine_orders(n: int, columns: Sequence[int], repeats: int) -> list[tuple[int, int, int, int]]:
    """``(column, repeat, factor, shift)``: place ``i`` reads from ``(factor * i + shift) mod n``, a permutation of its own each."""
    out = []
    for c in columns:
        for k in range(repeats):
            rng = np.random.default_rng([SEED, c, k])
            factor = int(rng.integers(1, max(2, min(n, (1 << 62) // max(n, 1)))))
            while math.gcd(factor, n) != 1:
                factor += 1
            out.append((c, k, factor, int(rng.integers(0, max(1, n)))))
    return out


def permutation_importance(model, rows: DataFrame, inputs: Sequence[str], label: str, row_id: str, repeats: int = 3, columns: Sequence[str] | None = None) -> DataFrame:
    """Mean and deviation of the AUC drop when one column is shuffled.

    Rows are numbered once in hash order; each (column, repeat) re-pairs the places by an affine
    permutation. A row sends one value to the place that reads from it, an equality join on place; the
    copies of a repeat are scored and ranked together, and their shuffle files are gone before the next.
    """
    # Lines of places in hash order are random already; the affine orders only need to differ.
    line = rows.select(vector_to_array("x").alias("v"), F.col(label).alias("label"), F.xxhash64(row_id).alias("__h"), F.col(row_id).alias("__id"))
    placed = session.written(ordered.numbered(line, ["__h", "__id"], "place").select((F.col("place") - 1).alias("place"), "v", "label"), "places")
    n = placed.count()
    orders = affine_orders(n, [list(inputs).index(c) for c in columns or inputs], repeats)

    def sent(c: int, k: int, factor: int, shift: int) -> Column:
        """The place that reads this row's value: ``factor * place + shift = own place`` (mod n)."""
        back = pow(factor, -1, n) if n > 1 else 0
        to = (F.pmod(F.col("place") - shift, F.lit(max(n, 1)).cast("bigint")) * F.lit(back).cast("bigint")) % max(n, 1)
        return F.struct(to.alias("place"), F.lit(c).alias("c"), F.lit(k).alias("k"), F.element_at("v", c + 1).alias("new"))

    def rates(copies: DataFrame) -> DataFrame:
        scored = margin(model.transform(copies.withColumn("x", array_to_vector("v")))).select("c", "k", "label", "score")
        return session.written(evaluation.auc_by(scored, "score", "label", ["c", "k"]), "auc")

    auc = rates(placed.select(F.lit(-1).alias("c"), F.lit(0).alias("k"), "label", "v"))
    for turn in range(repeats):
        drawn = placed.select(F.inline(F.array(*[sent(*o) for o in orders if o[1] == turn])))
        # The planner takes the copies for as small as the rows they come from: they must not be broadcast.
        mixed = drawn.hint("merge").join(placed, "place").select(
            "c", "k", "label", F.concat(F.slice("v", 1, F.col("c")), F.array("new"), F.slice("v", F.col("c") + 2, F.size("v"))).alias("v")
        )
        auc = auc.unionByName(rates(mixed))
    base = auc.where("c = -1").select(F.col("roc_auc").alias("base"))
    drops = auc.where("c >= 0").join(F.broadcast(base)).withColumn("drop", F.col("base") - F.col("roc_auc"))
    names = F.array(*[F.lit(i) for i in inputs])
    return drops.groupBy(F.element_at(names, F.col("c") + 1).alias("feature")).agg(F.avg("drop").alias("mean_drop"), F.stddev_pop("drop").alias("sd_drop"))


def partial_dependence(model, rows: DataFrame, inputs: Sequence[str], column: str, grid: Sequence[float]) -> DataFrame:
    """Mean prediction with one column set to each grid value (rows are exploded over the grid)."""
    points = F.explode(F.array(*[F.lit(float(g)) for g in grid])).alias("grid_value")
    spread = rows.drop("x").select("*", points).withColumn(column, F.col("grid_value"))
    scored = margin(model.transform(VectorAssembler(inputCols=list(inputs), outputCol="x").transform(spread)))
    return scored.groupBy("grid_value").agg(F.avg("score").alias("mean_score"), F.count("*").alias("n"))


def kmeans_sweep(vectors: DataFrame, ks: Sequence[int] = range(2, 11)) -> list[tuple[int, float, float]]:
    """(k, inertia, silhouette) for each k."""
    rows = settle(vectors.select("x"))
    out = []
    for k in ks:
        model = KMeans(k=k, seed=SEED, featuresCol="x", maxIter=20).fit(rows)
        out.append((k, float(model.summary.trainingCost), float(ClusteringEvaluator(featuresCol="x").evaluate(model.transform(rows)))))
    return out


def pca_share(vectors: DataFrame, dims: int, share: float = 0.95) -> list[tuple[int, float, float]]:
    """(component, share, cumulative) up to the first component reaching ``share``."""
    shares = PCA(k=dims, inputCol="x", outputCol="p").fit(vectors.select("x")).explainedVariance.toArray()
    total = np.cumsum(shares)
    stop = int(np.searchsorted(total, share)) + 1
    return [(i + 1, float(shares[i]), float(total[i])) for i in range(min(stop, dims))]


def mlp_compare(rows: DataFrame, inputs: int, hidden: int = 8, iterations: int = 40) -> DataFrame:
    """A small neural classifier on the prepared rows (fixed iterations: Spark has no early stopping)."""
    rows = settle(rows.select("x", "label", "part"))
    train, test = rows.where("part <> 'test'"), rows.where("part = 'test'")
    model = MultilayerPerceptronClassifier(layers=[inputs, hidden, 2], featuresCol="x", labelCol="label", maxIter=iterations, seed=SEED).fit(train)
    scored = settle(margin(model.transform(test)).select("label", "score"))
    return evaluation.ranking_metrics(scored, "score", "label").select(F.lit("mlp").alias("model"), "n", "roc_auc", "average_precision")


def text_classifier(kind: str = "logistic", buckets: int = 1 << 14) -> Pipeline:
    """Tokens, hashed term weights, and a linear or naive-Bayes classifier."""
    tokens = RegexTokenizer(inputCol="text", outputCol="words", pattern=TOKEN, gaps=False, toLowercase=True)
    tf = HashingTF(inputCol="words", outputCol="tf", numFeatures=buckets)
    idf = IDF(inputCol="tf", outputCol="x", minDocFreq=2)
    last = LogisticRegression(maxIter=30, regParam=0.01, featuresCol="x") if kind == "logistic" else NaiveBayes(featuresCol="x")
    return Pipeline(stages=[tokens, tf, idf, last])


def ordinal_predictions(train: DataFrame, test: DataFrame, levels: int) -> DataFrame:
    """Ordered levels as ``levels - 1`` binary questions "above t?"; the prediction counts the yeses."""
    out = test.withColumn("prediction", F.lit(0.0))
    for t in range(levels - 1):
        binary = train.withColumn("label", (F.col("label") > t).cast("double"))
        model = text_classifier("logistic").fit(binary)
        scored = model.transform(out.withColumnRenamed("prediction", "__sum").withColumnRenamed("label", "__level"))
        yes = (vector_to_array("probability")[1] > 0.5).cast("double")
        out = scored.withColumn("__sum", F.col("__sum") + yes).select(*[F.col("__level").alias("label") if c == "label" else F.col("__sum").alias("prediction") if c == "prediction" else F.col(c) for c in out.columns])
    return out


def text_classify(docs: DataFrame, key: str, kind: str = "logistic", levels: int = 2) -> DataFrame:
    """Text to label on disjoint hash parts; per-class metrics and macro F1 on the test part.

    ``kind`` is logistic, bayes, or ordinal (ordered levels, see :func:`ordinal_predictions`).
    """
    bad = docs.where(F.col("label").isNull() | ~F.col("label").between(0, levels - 1) | (F.length(F.trim("text")) == 0))
    if not bad.isEmpty():
        raise ContractError("labels out of range or empty texts")
    placed = docs.withColumn("label", F.col("label").cast("double")).withColumn("u", prep.hash_fraction(F.col(key), "text"))
    part = F.when(F.col("u") < 0.7, "train").when(F.col("u") < 0.8, "validation").otherwise("test")
    rows = settle(placed.withColumn("part", part))
    train, test = rows.where("part = 'train'"), rows.where("part = 'test'")
    if kind == "ordinal":
        predicted = ordinal_predictions(train, test, levels)
    else:
        model: PipelineModel = text_classifier(kind).fit(train)
        predicted = model.transform(test)
    per = evaluation.class_metrics(predicted, "label", "prediction")
    return per.withColumn("macro_f1", F.avg("f1").over(Window.partitionBy()))


def tree_table(model) -> list[tuple[float, dict[str, np.ndarray]]]:
    """(weight, node arrays) of every tree of a fitted tree ensemble; its size is that of the model."""
    trees = getattr(model, "trees", [model])
    weights = list(getattr(model, "treeWeights", [1.0] * len(trees)))
    if type(model).__name__.startswith("RandomForest"):
        weights = [w / len(trees) for w in weights]
    out = []
    for weight, tree in zip(weights, trees, strict=True):
        nodes: list[list[float]] = []

        def visit(node, nodes=nodes) -> int:
            at = len(nodes)
            nodes.append([-1, 0.0, at, at, node.prediction()])
            if node.getClass().getSimpleName() == "InternalNode":
                split = node.split()
                nodes[at][0], nodes[at][1] = split.featureIndex(), split.threshold()
                nodes[at][2], nodes[at][3] = visit(node.leftChild()), visit(node.rightChild())
            return at

        visit(tree._java_obj.rootNode())
        table = np.asarray(nodes, dtype=float)
        out.append((float(weight), {"feature": table[:, 0].astype(int), "limit": table[:, 1], "left": table[:, 2].astype(int), "right": table[:, 3].astype(int), "value": table[:, 4]}))
    return out


def path_contributions(trees, x: np.ndarray) -> tuple[float, np.ndarray]:
    """(bias, rows x features): each split's change of the predicted value, credited to its feature."""
    total = np.zeros(x.shape)
    bias, rows = 0.0, np.arange(len(x))
    for weight, t in trees:
        bias += weight * t["value"][0]
        at = np.zeros(len(x), dtype=int)
        while (t["feature"][at] >= 0).any():
            f = t["feature"][at]
            inner = f >= 0
            to = np.where(x[rows, np.maximum(f, 0)] <= t["limit"][at], t["left"][at], t["right"][at])
            step = weight * (t["value"][to] - t["value"][at])
            np.add.at(total, (rows[inner], f[inner]), step[inner])
            at = np.where(inner, to, at)
    return bias, total


def tree_contributions(model, rows: DataFrame, inputs: Sequence[str], row_id: Sequence[str]) -> DataFrame:
    """Long (row, feature, value, impact) of a tree ensemble, computed in Arrow batches over the rows."""
    trees, names = tree_table(model), list(inputs)

    @F.pandas_udf(ArrayType(DoubleType()))
    def impacts(xs: pd.Series) -> pd.Series:
        return pd.Series(list(path_contributions(trees, np.stack(xs.to_numpy()).astype(float))[1])) if len(xs) else pd.Series([], dtype=object)

    wide = rows.select(*row_id, vector_to_array("x").alias("__x")).withColumn("__c", impacts("__x"))
    cells = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("feature"), F.col("__x").alias("value"), F.col("__c").alias("impact"))
    return wide.select(*row_id, F.inline(cells))
