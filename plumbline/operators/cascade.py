"""Two-stage gate: chronological roles, thresholds, decisions and the acceptance checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import ordered
from plumbline.operators.joins import ContractError

# Costs, capacity and acceptance limits of the two-stage policy.
FP_COST, FN_COST = 85, 4100
CAPACITY = 100 / 3800
MIN_EVENTS = 32
LIMITS = (
    ("stage1_average_precision", "min", 0.20),
    ("stage1_recall", "min", 0.90),
    ("stage1_flag_rate", "max", 0.05),
    ("cascade_recall", "min", 0.70),
    ("cascade_precision", "min", 0.20),
    ("cascade_flag_rate", "max", CAPACITY),
)
FRACTIONS = (0.4, 0.5, 0.7, 0.85)


def time_cutoffs(rows: DataFrame, start: str, row_id: str, fractions: Sequence[float] = FRACTIONS) -> DataFrame:
    """One row holding the start times at the given fractions of the time-ordered rows."""
    numbered = ordered.numbered(rows.select(start, row_id), [start, row_id])
    size = rows.agg(F.count("*").alias("n"))
    at = lambda q: F.floor(F.col("n") * F.lit(q)) + 1
    marked = numbered.join(F.broadcast(size))
    return marked.agg(*[F.max(F.when(F.col("rn") == at(q), F.col(start))).alias(f"cut{i}") for i, q in enumerate(fractions)])


def availability_roles(rows: DataFrame, start: str, done: str, row_id: str) -> DataFrame:
    """Role of each row: a period only holds rows whose outcome was known before the next one began."""
    cuts = time_cutoffs(rows, start, row_id)
    s, d = F.col(start), F.col(done)
    a, b, c, e = (F.col(f"cut{i}") for i in range(4))
    role = (
        F.when((s < a) & (d < a), "fit")
        .when((s >= a) & (s < b) & (d < b), "calibrate")
        .when((s >= b) & (s < c) & (d < c), "stage2_fit")
        .when((s >= c) & (s < e) & (d < e), "stage2_validate")
        .when(s >= e, "test")
        .otherwise("unavailable")
    )
    return rows.join(F.broadcast(cuts)).withColumn("role", role).drop("cut0", "cut1", "cut2", "cut3")


def block_folds(rows: DataFrame, start: str, done: str, row_id: str, test_size: int, folds: int = 5, tail: float = 0.2) -> DataFrame:
    """(fold, role, rows) of forward folds over row blocks; the last ``tail`` of the history calibrates.

    Row ``fold`` is numbered from 1. History must be started and known before the test
    begins, and fit rows also before calibration begins.
    """
    numbered = ordered.numbered(rows.select(row_id, start, done), [start, row_id])
    n = rows.agg(F.count("*").alias("n"))
    grid = n.select("n", F.explode(F.sequence(F.lit(1), F.lit(folds))).alias("fold")).withColumn(
        "first", F.col("n") - (folds - F.col("fold") + 1) * test_size + 1
    )
    if not grid.where("first <= 1").isEmpty():
        raise ContractError("not enough rows for the requested folds")
    begins = numbered.join(F.broadcast(grid), numbered["rn"] == grid["first"]).select("fold", "first", F.col(start).alias("test_start"))
    each = numbered.join(F.broadcast(begins))
    test = each.where((F.col("rn") >= F.col("first")) & (F.col("rn") < F.col("first") + test_size)).select("fold", F.lit("test").alias("role"))
    known = each.where((F.col(done) < F.col("test_start")) & (F.col(start) < F.col("test_start")) & (F.col("rn") < F.col("first")))
    placed = ordered.range_sums(known, ["fold"], [start, row_id], {"place": F.lit(1).cast("bigint")})
    sizes = known.groupBy("fold").agg(F.floor(F.count("*") * F.lit(1 - tail)).alias("split"))
    cut = placed.join(F.broadcast(sizes), "fold").where(F.col("place") == F.col("split") + 1).select("fold", F.col(start).alias("cut"))
    role = F.when(F.col(start) >= F.col("cut"), "calibrate").when(F.col(done) < F.col("cut"), "fit").otherwise("unavailable")
    history = known.join(F.broadcast(cut), "fold").select("fold", role.alias("role"))
    return test.unionByName(history).groupBy("fold", "role").agg(F.count("*").alias("rows"))


def flag_rate_threshold(scores: DataFrame, score: str, rate: float) -> DataFrame:
    """The ``1 - rate`` quantile and the rate it really flags (ties can raise it)."""
    if not 0 < rate < 1:
        raise ValueError("finite scores and 0 < rate < 1 required")
    cut = ordered.exact_quantiles(scores, score, [1 - rate]).select(F.col("value").alias("threshold"))
    flagged = scores.join(F.broadcast(cut))
    return flagged.groupBy("threshold").agg(
        F.count("*").alias("n"), F.avg((F.col(score) >= F.col("threshold")).cast("int")).alias("achieved_rate")
    )


def capacity_threshold(
    scores: DataFrame, score: str, label: str, population: DataFrame, capacity: float = CAPACITY
) -> DataFrame:
    """Cheapest threshold among 0, every distinct score and "flag none", within flag capacity.

    ``population`` is a one-row frame with column ``population``. Costs come from running
    sums over distinct scores; the first of equally cheap candidates wins.
    """
    hist = scores.groupBy(score).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos"))
    run = ordered.range_sums(hist, [], [F.desc(score)], {"flags": F.col("n"), "caught": F.col("pos")})
    whole = scores.agg(F.count("*").alias("all_rows"), F.coalesce(F.sum(F.col(label).cast("bigint")), F.lit(0)).alias("all_pos"))
    ends = whole.select(
        F.inline(
            F.array(
                F.struct(F.lit(0.0).alias("threshold"), F.col("all_rows").alias("flags"), F.col("all_pos").alias("caught")),
                F.struct(F.lit(1.0000000000000002).alias("threshold"), F.lit(0).cast("bigint").alias("flags"), F.lit(0).cast("bigint").alias("caught")),
            )
        )
    )
    candidates = run.select(F.col(score).cast("double").alias("threshold"), "flags", "caught").unionByName(ends)
    priced = (
        candidates.join(F.broadcast(whole))
        .join(F.broadcast(population))
        .withColumn("cost", FP_COST * (F.col("flags") - F.col("caught")) + FN_COST * (F.col("all_pos") - F.col("caught")))
        .where(F.col("flags") / F.col("population") <= F.lit(capacity))
    )
    best = F.min_by(F.struct("threshold", "flags", "caught", "cost"), F.struct("cost", "threshold"))
    return priced.agg(best.alias("b")).select("b.*")


def cascade_decisions(stage1: DataFrame, stage2: DataFrame, row_id: str, gate: float, hold: float) -> DataFrame:
    """Stage 2 is looked up only for gated rows; below the gate there is no flag."""
    gated = stage1.where(F.col("p1") >= gate).select(row_id)
    second = stage2.join(gated, row_id, "left_semi").select(row_id, F.col("p2").alias("stage2_score"))
    decision = F.when(F.col("stage2_score") >= hold, "qa_hold").otherwise("no_model_flag")
    return stage1.join(second, row_id, "left").withColumn("decision", decision)


def cascade_summary(decisions: DataFrame, label: str = "failed") -> DataFrame:
    hold, y = F.col("decision") == "qa_hold", F.col(label) == 1
    s = decisions.agg(
        F.count("*").alias("test_rows"),
        F.sum(y.cast("int")).alias("failures"),
        F.sum(hold.cast("int")).alias("flags"),
        F.sum((hold & y).cast("int")).alias("caught"),
    )
    return s.withColumn("error_cost", FP_COST * (F.col("flags") - F.col("caught")) + FN_COST * (F.col("failures") - F.col("caught")))


def acceptance_checks(summary: DataFrame, stage1: DataFrame) -> DataFrame:
    """One line per limit. Inconsistent counts or too few events fail every line; no flags fails precision.

    ``summary`` has one row of counts, ``stage1`` one row of ``average_precision, recall, flag_rate``.
    """
    n, fails, flags, caught = (F.col(c) for c in ("test_rows", "failures", "flags", "caught"))
    sound = (
        (caught >= 0) & (caught <= F.least(fails, flags)) & (F.greatest(fails, flags) <= n) & (n > 0) & (fails < n) & (fails >= MIN_EVENTS)
    )
    value = {
        "stage1_average_precision": F.col("average_precision"),
        "stage1_recall": F.col("recall"),
        "stage1_flag_rate": F.col("flag_rate"),
        "cascade_recall": caught / F.nullif(fails, F.lit(0)),
        "cascade_precision": caught / F.nullif(flags, F.lit(0)),
        "cascade_flag_rate": flags / F.nullif(n, F.lit(0)),
    }
    cells = []
    for name, op, limit in LIMITS:
        x = value[name].cast("double")
        ok = (x >= limit) if op == "min" else (x <= limit)
        cells.append(
            F.struct(
                F.lit(name).alias("metric"), x.alias("value"), F.lit(op).alias("relation"), F.lit(float(limit)).alias("limit"),
                (F.coalesce(sound, F.lit(False)) & F.coalesce(ok & x.between(0, 1), F.lit(False))).alias("passed"),
            )
        )
    return summary.join(F.broadcast(stage1)).select(F.inline(F.array(*cells)))
