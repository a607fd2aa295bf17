"""Ranking, classification and policy metrics as aggregates over distinct scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import ordered, windows
from plumbline.operators.joins import ContractError


def midrank_percentile(df: DataFrame, score: str, name: str) -> DataFrame:
    """``100 * (average rank - 0.5) / n``; equal scores share a rank."""
    ranks = ordered.midranks(df, score).select(score, "midrank")
    size = df.agg(F.count("*").alias("__n"))
    joined = df.join(ranks, score).join(F.broadcast(size))
    return joined.withColumn(name, 100 * (F.col("midrank") - 0.5) / F.col("__n")).drop("midrank", "__n")


def labelled_histogram(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct scores (per key) with row and positive counts: all a ranking metric needs."""
    return df.groupBy(*keys, score).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos"))


def ranking_metrics(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC (ties half), average precision, log loss and Brier in one result row (one per key)."""
    # Descending: counts strictly above plus the current value.
    run = ordered.range_sums(labelled_histogram(df, score, label, keys), keys, [F.desc(score)], {"cum_n": F.col("n"), "cum_pos": F.col("pos")})
    eps = 2.0**-52
    p = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col(score).cast("double")))
    pos, neg = F.col("pos"), F.col("n") - F.col("pos")
    above_pos = F.col("cum_pos") - pos
    got = run.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.sum("pos").alias("positives"),
        F.sum((neg * (above_pos + pos / 2)).cast("double")).alias("won"),
        F.sum(pos * F.col("cum_pos") / F.col("cum_n")).alias("ap"),
        F.sum(-pos * F.log(p) - neg * F.log(1 - p)).alias("ll"),
        F.sum(pos * (1 - F.col(score)) * (1 - F.col(score)) + neg * F.col(score) * F.col(score)).alias("br"),
    )
    negatives = F.col("n") - F.col("positives")
    return got.select(
        *keys,
        "n",
        "positives",
        (F.col("won") / F.nullif(F.col("positives") * negatives, F.lit(0))).alias("roc_auc"),
        (F.col("ap") / F.nullif("positives", F.lit(0))).alias("average_precision"),
        (F.col("ll") / F.col("n")).alias("log_loss"),
        (F.col("br") / F.col("n")).alias("brier"),
    )


def auc_by(df: DataFrame, score: str, label: str, keys: Sequence[str]) -> DataFrame:
    """``keys, roc_auc`` (ties half) of scores in [0, 1]: rows move once, to a band of scores of their key."""
    placed = df.select(*keys, score, F.col(label).cast("bigint").alias("__y"), F.floor(F.col(score) * 256).alias("__band")).repartition(*keys, "__band")
    cells = placed.groupBy(*keys, "__band", score).agg(F.sum("__y").alias("pos"), F.count(F.lit(1)).alias("n")).withColumn("neg", F.col("n") - F.col("pos"))
    below = lambda keys_, by: Window.partitionBy(*keys_).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    under = F.coalesce(F.sum("neg").over(below([*keys, "__band"], score)), F.lit(0))
    bands = cells.withColumn("won", (F.col("pos") * (under + F.col("neg") / 2)).cast("double")).groupBy(*keys, "__band").agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "won")])
    # One row per key and band.
    lower = F.coalesce(F.sum("neg").over(below(keys, "__band")), F.lit(0))
    whole = bands.withColumn("won", F.col("won") + F.col("pos") * lower).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "won")])
    return whole.select(*keys, (F.col("won") / F.nullif(F.col("pos") * F.col("neg"), F.lit(0))).alias("roc_auc"))


def class_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class (zero division gives 0), and their macro F1."""
    cells = df.groupBy(actual, predicted).agg(F.count("*").alias("n"))
    hit = F.col(actual) == F.col(predicted)
    by_actual = cells.groupBy(F.col(actual).alias("label")).agg(
        F.sum("n").alias("support"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("tp")
    )
    by_predicted = cells.groupBy(F.col(predicted).alias("label")).agg(F.sum("n").alias("predicted"))
    both = by_actual.join(by_predicted, "label", "full_outer").na.fill(0, ["support", "tp", "predicted"])
    ratio = lambda a, b: F.coalesce(F.col(a) / F.nullif(b, F.lit(0)), F.lit(0.0))
    scored = both.withColumn("precision", ratio("tp", "predicted")).withColumn("recall", ratio("tp", "support"))
    f1 = 2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0))
    return scored.withColumn("f1", F.coalesce(f1, F.lit(0.0)))


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """MAE and R squared from one pass of sums."""
    y, e = F.col(actual).cast("double"), F.col(actual).cast("double") - F.col(predicted).cast("double")
    return df.agg(
        F.count("*").alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        (1 - F.sum(e * e) / F.nullif(F.var_pop(y) * F.count("*"), F.lit(0.0))).alias("r2"),
    )


def threshold_sweep(
    df: DataFrame, score: str, label: str, grid: Sequence[str], fp_cost: int = 540, fn_cost: int = 12600
) -> DataFrame:
    """Flagged, recall, precision, F1 and cost at each threshold (``score >= threshold`` flags).

    One aggregate puts every row into the highest grid step it reaches; sums over the
    grid rows do the rest, so the number of passes does not grow with the grid.
    """
    points = sorted(grid, key=float)
    step = F.lit(0)
    edges = F.array(*[F.lit(float(p)) for p in points])
    reached = F.aggregate(edges, step, lambda acc, t: acc + (F.col(score) >= t).cast("int"))
    steps = df.groupBy(reached.alias("step")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos"))
    spark = df.sparkSession
    table = spark.createDataFrame([(i + 1, float(p)) for i, p in enumerate(points)], "step int, threshold double")
    # The grid is a handful of rows, one per threshold: a single small window is fine.
    upward = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    grown = (
        table.join(steps, "step", "full_outer")
        .select("step", "threshold", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "pos")])
        .withColumn("flagged", F.sum("n").over(upward))
        .withColumn("tp", F.sum("pos").over(upward))
        .withColumn("positives", F.sum("pos").over(Window.partitionBy()))
    )
    fp, fn = F.col("flagged") - F.col("tp"), F.col("positives") - F.col("tp")
    precision = F.col("tp") / F.greatest("flagged", F.lit(1))
    recall = F.col("tp") / F.nullif("positives", F.lit(0))
    return (
        grown.where("threshold IS NOT NULL")
        .withColumn("recall", recall)
        .withColumn("precision", precision)
        .withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0)))
        .withColumn("cost", fp * fp_cost + fn * fn_cost)
        .drop("n", "pos", "step")
    )


def prediction_frame(df: DataFrame, raw: str) -> DataFrame:
    """Clipped prediction beside the burden baseline (count times mean severity; no events means 0)."""
    recent = F.when(F.col("ncr_count_90d") == 0, F.lit(0.0)).otherwise(F.col("ncr_count_90d") * F.col("avg_severity_90d"))
    return df.select(
        "month",
        "supplier_id",
        "sev3_next_90d",
        "harm_next_90d",
        F.greatest(F.lit(0.0), F.col(raw).cast("double")).alias("predicted_harm_90d"),
        recent.cast("double").alias("recent_harm_90d"),
    )


POLICIES = (("predicted_harm", "predicted_harm_90d"), ("recent_harm_baseline", "recent_harm_90d"))


def check_predictions(df: DataFrame) -> None:
    if df.isEmpty():
        raise ContractError("complete nonempty policy evaluation rows required")
    numbers = ["predicted_harm_90d", "recent_harm_90d", "sev3_next_90d", "harm_next_90d"]
    bad = F.lit(False)
    for c in numbers:
        x = F.col(c).cast("double")
        bad = bad | x.isNull() | F.isnan(x) | (x < 0) | (x == float("inf"))
    bad = bad | F.col("month").isNull() | F.col("supplier_id").isNull() | ~F.col("sev3_next_90d").isin(0, 1)
    if not df.where(bad).isEmpty():
        raise ContractError("finite nonnegative predictions and binary outcomes required")
    if not df.groupBy("month", "supplier_id").count().where("count > 1").isEmpty():
        raise ContractError("duplicate monthly candidate")


def monthly_policy_report(predictions: DataFrame, k: int = 50, check: bool = True) -> DataFrame:
    """Per month and policy: the top ``k`` candidates (ties by id) and what they capture."""
    if not isinstance(k, int) or isinstance(k, bool) or k < 1:
        raise ValueError("k must be a positive integer")
    if check:
        check_predictions(predictions)
    totals = predictions.groupBy("month").agg(
        F.count("*").alias("eligible_suppliers"),
        F.sum("sev3_next_90d").alias("serious_events_total"),
        F.sum("harm_next_90d").alias("harm_total"),
    )
    both = predictions.select(
        "month", "supplier_id", "sev3_next_90d", "harm_next_90d",
        F.inline(F.array(*[F.struct(F.lit(n).alias("policy"), F.col(c).alias("score")) for n, c in POLICIES])),
    )
    chosen = windows.top_per_group(both, ["month", "policy"], [F.desc("score"), F.col("supplier_id")], k)
    picked = chosen.groupBy("month", "policy").agg(
        F.count("*").alias("selected_suppliers"),
        F.transform(F.array_sort(F.collect_list(F.struct("rn", "supplier_id"))), lambda s: s["supplier_id"]).alias("selected_ids"),
        F.sum("sev3_next_90d").alias("serious_events_selected"),
        F.sum("harm_next_90d").alias("harm_selected"),
    )
    return picked.join(totals, "month").select(
        "*",
        F.lit(k).alias("requested_k"),
        (F.col("serious_events_selected") / F.col("selected_suppliers")).alias("precision_at_k"),
        (F.col("serious_events_selected") / F.nullif("serious_events_total", F.lit(0))).alias("recall_at_k"),
        (F.col("harm_selected") / F.nullif("harm_total", F.lit(0).cast("bigint"))).alias("captured_harm_fraction"),
    )


def linear_contributions(df: DataFrame, row_id: str, coefficients: dict[str, float], means: dict[str, float]) -> DataFrame:
    """Long (row, feature, value, impact): coefficient times the centred value."""
    cells = [
        F.struct(
            F.lit(name).alias("feature"),
            F.col(name).cast("double").alias("value"),
            (F.lit(float(w)) * (F.col(name).cast("double") - F.lit(float(means[name])))).alias("impact"),
        )
        for name, w in coefficients.items()
    ]
    return df.select(row_id, F.inline(F.array(*cells)))


def top_drivers(contributions: DataFrame, row_id: str, k: int = 5) -> DataFrame:
    """The ``k`` largest contributions of each row by size, with their direction."""
    direction: Column = (
        F.when(F.col("impact") > 0, "increases").when(F.col("impact") < 0, "decreases").otherwise("no contribution")
    )
    return windows.top_per_group(
        contributions.withColumn("direction", direction), [row_id], [F.desc_nulls_last(F.abs("impact")), F.col("feature")], k
    )
