"""Chronological roles and feature preparation, fitted on the training role only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from plumbline.operators import ordered
from plumbline.operators.joins import ContractError, duplicate_keys
from plumbline.operators.triage import hash_fraction

# Predictor and target columns of the modelling frame.
NUMERIC = (
    "ncr_count_90d", "ncr_per_1k_units", "avg_severity_90d", "pct_high_severity", "otd_pct", "avg_days_late", "fpy",
    "fpy_slope_12m", "audit_score_last", "audit_score_delta", "years_as_supplier", "spend_share", "car_response_days",
    "car_effectiveness",
)
CATEGORICAL = ("tier",)
TIERS = ("C", "B", "A")
TARGETS = ("sev3_next_90d", "harm_next_90d")
DATES = ("month", "label_end", "data_complete_through")


def month_folds(df: DataFrame, n_splits: int = 5, test_size: int = 3, gap: int = 3, check: bool = True) -> DataFrame:
    """(fold, month, role): forward folds over whole observed months. One row per fold and month."""
    if check:
        if not df.where(F.col("month").isNull()).isEmpty():
            raise ContractError("month cannot be missing")
        n = df.select("month").distinct().count()
        if n - n_splits * test_size - gap < 1:
            raise ContractError("empty chronological fold")
    months = df.select("month").distinct()
    # One row per calendar month of the whole panel: a single window is bounded by the calendar.
    placed = months.select("month", (F.row_number().over(Window.orderBy("month")) - 1).alias("i"))
    placed = placed.withColumn("n", F.count("*").over(Window.partitionBy()))
    each = placed.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(n_splits))))
    first = F.col("n") - (n_splits - F.col("fold") + 1) * test_size
    role = F.when((F.col("i") >= first) & (F.col("i") < first + test_size), "test").when(F.col("i") < first - gap, "train")
    return each.withColumn("role", role).where("role IS NOT NULL").select("fold", "month", "role")


def assign_folds(df: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows per fold and role. The fold table has one row per fold and month, so it travels to the rows."""
    return df.join(F.broadcast(folds), "month")


def train_tail(rows: DataFrame, months: int = 3) -> DataFrame:
    """Split each fold's training rows: the last months calibrate, earlier rows fit if mature by then."""
    train = rows.where("role = 'train'")
    calendar = train.select("fold", "month").distinct()
    back = calendar.withColumn("k", F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("month"))))
    first = back.where(F.col("k") == months).select("fold", F.col("month").alias("cal_from"))
    part = (
        F.when(F.col("month") >= F.col("cal_from"), "calibrate")
        .when(F.col("label_end") <= F.add_months("cal_from", 1), "fit")
        .otherwise("immature")
    )
    return train.join(F.broadcast(first), "fold").withColumn("part", part).drop("cal_from")


def frame_violations(df: DataFrame) -> DataFrame:
    """Counts of rows that break the modelling frame's contract, in one pass."""
    bad_number = lambda c: F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))
    infinite = F.lit(False)
    for c in NUMERIC:
        infinite = infinite | F.coalesce(F.abs(F.col(c).cast("double")) == float("inf"), F.lit(False))
    rules = {
        "censored": F.col("sev3_next_90d").isNull() | F.col("harm_next_90d").isNull(),
        "immature": ~F.coalesce(F.col("label_end").cast("timestamp_ntz") <= F.col("data_complete_through"), F.lit(False)),
        "not_binary": F.col("sev3_next_90d").isNotNull() & ~F.col("sev3_next_90d").isin(0, 1),
        "bad_burden": F.col("harm_next_90d").isNotNull() & (bad_number("harm_next_90d") | (F.col("harm_next_90d") < 0)),
        "infinite_feature": infinite,
    }
    cells = [F.struct(F.lit(n).alias("rule"), F.coalesce(F.sum(c.cast("int")), F.lit(0)).alias("rows")).alias(n) for n, c in rules.items()]
    return df.agg(*cells).select(F.inline(F.array(*rules)))


def modelling_frame(df: DataFrame, keep: Sequence[str] = ("supplier_id",)) -> DataFrame:
    missing = sorted({*NUMERIC, *CATEGORICAL, *TARGETS, *DATES} - set(df.columns))
    if missing:
        raise ContractError(f"missing modeling columns: {missing}")
    broken = [r["rule"] for r in frame_violations(df).where("rows > 0").collect()]
    if broken:
        raise ContractError(f"modelling frame broken: {broken}")
    return df.select(*keep, *DATES, *NUMERIC, *CATEGORICAL, *TARGETS)


def reserve_period(df: DataFrame, final_start: str, check: bool = True) -> DataFrame:
    """Role of every row: development (mature before the first final cutoff), final, or purged."""
    start = F.lit(final_start).cast("date")
    cutoff = F.add_months(start, 1)
    if check:
        if final_start[-2:] != "01":
            raise ContractError("final_start must be a timezone-naive month start")
        if not df.where(F.col("month") != F.trunc("month", "MM")).isEmpty():
            raise ContractError("row month must be a complete month-start identity")
        expected = F.date_add(F.add_months("month", 1), 90)
        if not df.where(F.col("label_end").isNull() | (F.col("label_end") != expected)).isEmpty():
            raise ContractError("label_end must equal the next month start plus 90 days")
        if not duplicate_keys(df, ["supplier_id", "month"]).isEmpty():
            raise ContractError("duplicate supplier-month")
    role = (
        F.when(F.col("month") >= start, "final")
        .when(F.col("label_end") <= cutoff, "development")
        .otherwise("purged")
    )
    out = df.withColumn("period_role", role)
    if check:
        present = {r[0] for r in out.select("period_role").distinct().collect()}
        if not {"final", "development"} <= present:
            raise ContractError("nonempty development and final periods required")
    return out


def snapshot(history: DataFrame, asof: str) -> DataFrame:
    """Rows of the latest completed month at ``asof``; a missing or duplicated snapshot is an error."""
    at = F.lit(asof).cast("date")
    done = history.where(F.add_months("month", 1) <= at)
    last = done.agg(F.max("month").alias("m"), F.trunc(at, "MM").alias("expected")).first()
    if last is None or last["m"] is None:
        raise ContractError("no completed month available at scoring date")
    rows = done.where(F.col("month") == F.lit(last["m"])).withColumn("snapshot_cutoff", F.add_months("month", 1))
    if rows.select("snapshot_cutoff").first()[0] != last["expected"]:
        raise ContractError("expected completed-month snapshot is missing")
    if not duplicate_keys(rows, ["supplier_id"]).isEmpty():
        raise ContractError("duplicate supplier at scoring cutoff")
    return rows


def fill_values(train: DataFrame, columns: Sequence[str], strategy: str = "median") -> DataFrame:
    """One row with the fill value of each column (``median`` or ``most_frequent``).

    All columns share one long (column, value) pass instead of one pass each.
    """
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x")) for c in columns]
    long = train.select(F.inline(F.array(*cells))).where("x IS NOT NULL")
    if strategy == "median":
        values = ordered.exact_quantiles(long, "x", [0.5], ["column_name"])
    elif strategy == "most_frequent":
        counts = long.groupBy("column_name", "x").agg(F.count("*").alias("n"))
        values = counts.groupBy("column_name").agg(F.max_by("x", F.struct(F.col("n"), -F.col("x"))).alias("value"))
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return values.agg(*[F.max(F.when(F.col("column_name") == c, F.col("value"))).alias(f"fill_{c}") for c in columns])


def impute_scale(df: DataFrame, columns: Sequence[str], is_train: Column, strategy: str = "median") -> DataFrame:
    """Fill, flag what was missing, and standardise; every parameter comes from the training rows."""
    train = df.where(is_train)
    filled = df.join(F.broadcast(fill_values(train, columns, strategy)))
    for c in columns:
        filled = filled.withColumn(f"{c}_missing", F.col(c).isNull().cast("int")).withColumn(
            c, F.coalesce(F.col(c).cast("double"), F.col(f"fill_{c}").cast("double"))
        )
    filled = filled.drop(*[f"fill_{c}" for c in columns])
    moments = filled.where(is_train).agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
    )
    out = filled.join(F.broadcast(moments))
    for c in columns:
        out = out.withColumn(c, (F.col(c) - F.col(f"m_{c}")) / F.coalesce(F.nullif(F.col(f"s_{c}"), F.lit(0.0)), F.lit(1.0)))
    return out.drop(*[f"{k}_{c}" for k in "ms" for c in columns])


def robust_and_range(df: DataFrame, column: str, is_train: Column) -> DataFrame:
    """``robust``: distance from the median in quartile widths; ``ranged``: position in the training range."""
    train = df.where(is_train)
    q = ordered.exact_quantiles(train, column, [0.25, 0.5, 0.75])
    at = lambda p: F.max(F.when(F.col("prob") == p, F.col("value")))
    quarts = q.agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))
    limits = train.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    x = F.col(column).cast("double")
    return (
        df.join(F.broadcast(quarts.join(F.broadcast(limits))))
        .withColumn("robust", (x - F.col("q2")) / F.coalesce(F.nullif(F.col("q3") - F.col("q1"), F.lit(0.0)), F.lit(1.0)))
        .withColumn("ranged", (x - F.col("lo")) / F.coalesce(F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), F.lit(1.0)))
        .drop("q1", "q2", "q3", "lo", "hi")
    )


def quantile_normal(df: DataFrame, column: str, name: str = "gaussian") -> DataFrame:
    """Midrank position mapped through the normal quantile function."""
    @F.pandas_udf(DoubleType())
    def probit(p: pd.Series) -> pd.Series:
        return p.map(NormalDist().inv_cdf)

    ranks = ordered.midranks(df.where(F.col(column).isNotNull()), column)
    n = ranks.agg(F.sum("n").alias("__n"))
    table = ranks.join(F.broadcast(n)).select(column, probit((F.col("midrank") - 0.5) / F.col("__n")).alias(name))
    return df.join(table, column, "left")


def one_hot(df: DataFrame, column: str, is_train: Column, min_frequency: int = 10) -> DataFrame:
    """Long one-hot cells: known categories keep a column, rare ones share ``<rare>``, unknown ones get none."""
    counts = df.where(is_train).groupBy(column).agg(F.count("*").alias("__n"))
    table = counts.select(column, F.when(F.col("__n") >= min_frequency, F.col(column).cast("string")).otherwise("<rare>").alias("slot"))
    return df.join(table, column, "left")


def ordinal(column: str, categories: Sequence[str] = TIERS, unknown: int = -1) -> Column:
    out = F.lit(unknown)
    for i, c in enumerate(categories):
        out = F.when(F.col(column) == c, i).otherwise(out)
    return out


def target_encode(df: DataFrame, key: str, column: str, target: str, folds: int = 5, seed: str = "fold") -> DataFrame:
    """Out-of-fold mean of the target per category; unseen categories get the other folds' prior.

    One aggregate per (fold, category) holds everything: a row's value is the category's
    total minus its own fold's.
    """
    y = F.col(target).cast("double")
    placed = df.withColumn("fold", F.floor(hash_fraction(F.col(key), seed) * folds).cast("int"))
    cells = placed.groupBy("fold", column).agg(F.sum(y).alias("s"), F.count(y).alias("n"))
    whole = cells.groupBy(column).agg(F.sum("s").alias("cs"), F.sum("n").alias("cn"))
    by_fold = cells.groupBy("fold").agg(F.sum("s").alias("fs"), F.sum("n").alias("fn"))
    total = cells.agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    prior = (F.col("ts") - F.col("fs")) / F.nullif(F.col("tn") - F.col("fn"), F.lit(0))
    own = (F.col("cs") - F.col("s")) / F.nullif(F.col("cn") - F.col("n"), F.lit(0))
    table = cells.join(whole, column).join(F.broadcast(by_fold), "fold").join(F.broadcast(total))
    return placed.join(table.select("fold", column, F.coalesce(own, prior).alias("encoded")), ["fold", column])


def interactions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            df = df.withColumn(f"{a}_x_{b}", F.col(a) * F.col(b))
    return df


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Per class: rows, balanced weight, and the negative-to-positive ratio."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    whole = counts.agg(
        F.sum("n").alias("total"),
        F.count("*").alias("classes"),
        F.sum(F.when(F.col("label") == 0, F.col("n"))).alias("neg"),
        F.sum(F.when(F.col("label") == 1, F.col("n"))).alias("pos"),
    )
    return counts.join(F.broadcast(whole)).select(
        "label",
        "n",
        (F.col("total") / (F.col("classes") * F.col("n"))).alias("balanced_weight"),
        (F.col("neg") / F.nullif("pos", F.lit(0))).alias("scale_pos_weight"),
    )


def oversample(df: DataFrame, key: str, label: str, seed: str = "oversample") -> DataFrame:
    """Repeat rows of smaller classes until every class has about the size of the largest.

    Each row gets the whole part of the ratio, and one more when its hash falls below
    the rest, so copies are made in place with no sampling pass and no shuffle of rows.
    """
    counts = df.groupBy(label).agg(F.count("*").alias("__n"))
    top = counts.agg(F.max("__n").alias("__top"))
    ratio = counts.join(F.broadcast(top)).select(label, (F.col("__top") / F.col("__n")).alias("__r"))
    extra = (hash_fraction(F.col(key), seed) < F.col("__r") - F.floor("__r")).cast("int")
    copies = F.floor("__r") + extra
    return (
        df.join(F.broadcast(ratio), label)
        .withColumn("copy", F.explode(F.sequence(F.lit(1), copies.cast("int"))))
        .drop("__r")
    )


def kfold(df: DataFrame, key: str, k: int, seed: str = "kfold") -> DataFrame:
    return df.withColumn("fold", F.floor(hash_fraction(F.col(key), seed) * k).cast("int"))


def stratified_kfold(df: DataFrame, key: str, label: str, k: int, seed: str = "kfold") -> DataFrame:
    """Folds with equal class shares: rows of a class are dealt out in hash order.

    Dealing needs the position within the class, which comes from ranges of (class, hash),
    so no class meets in one task.
    """
    u = hash_fraction(F.col(key), seed)
    placed = ordered.range_sums(df.withColumn("__u", u), [label], ["__u", key], {"__rn": F.lit(1).cast("bigint")})
    return placed.withColumn("fold", ((F.col("__rn") - 1) % k).cast("int")).drop("__u", "__rn")


def holdout_tail(df: DataFrame, test_months: int = 3, purge_months: int = 3) -> DataFrame:
    """Latest months test, the months before them purged, the rest train."""
    calendar = df.select("month").distinct()
    back = calendar.select("month", F.row_number().over(Window.orderBy(F.desc("month"))).alias("k"))
    role = F.when(F.col("k") <= test_months, "test").when(F.col("k") <= test_months + purge_months, "purged").otherwise("train")
    return df.join(F.broadcast(back.select("month", role.alias("role"))), "month")


def quality_gate(metrics: DataFrame, floors: Mapping[str, float], threshold: float = 0.04) -> DataFrame:
    """Fail-closed gate over fold metrics: every fold must be well formed, the last one meets the floors."""
    # One row per fold, bounded by the number of folds.
    w = Window.orderBy("fold")
    probability = lambda c: F.coalesce(F.col(c).between(0, 1) & ~F.isnan(F.col(c)), F.lit(False))
    sound = (
        (F.col("fold") == F.row_number().over(w))
        & (F.col("screen_threshold") == threshold)
        & (F.col("n_test") > 0)
        & (F.col("positive_test") > 0)
        & (F.col("positive_test") < F.col("n_test"))
    )
    for name in floors:
        sound = sound & probability(name)
    judged = metrics.withColumn("sound", F.coalesce(sound, F.lit(False)))
    last = F.struct(*[F.col(n).alias(n) for n in floors])
    one = judged.agg(F.max_by(last, "fold").alias("last"), F.min(F.col("sound").cast("int")).alias("sound"), F.max("fold").alias("fold"))
    cells = [
        F.struct(
            F.lit(n).alias("metric"), F.col(f"last.{n}").alias("value"), F.lit(float(f)).alias("floor"),
            F.coalesce((F.col(f"last.{n}") >= f) & (F.col("sound") == 1), F.lit(False)).alias("passed"),
        )
        for n, f in floors.items()
    ]
    return one.select("fold", F.inline(F.array(*cells)))
