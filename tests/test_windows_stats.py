import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions import special
from plumbline.operators import cascade, evaluation, ordered, stats, windows
from plumbline.operators.joins import ContractError

D = dt.date


@pytest.mark.parametrize(
    "counts, expected",
    [({"A": 60, "B": 25, "C": 15}, ["A", "B"]), ({"A": 80, "B": 10, "C": 10}, ["A"]), ({"A": 0, "B": 0}, [])],
)
def test_pareto(spark, counts, expected):
    df = spark.createDataFrame(list(counts.items()), "k string, n bigint")
    got = windows.pareto(df, "k", "n").orderBy(F.desc("n")).collect()
    assert [r["k"] for r in got] == expected


def days(values, start=D(2026, 1, 1)):
    return [("S", start + dt.timedelta(days=i), v) for i, v in enumerate(values)]


def test_rolling_z_uses_only_the_past(spark):
    schema = "e string, day date, rate double"
    calm = [0.9 if i % 2 else 0.95 for i in range(39)]
    z = lambda rows: windows.rolling_z(spark.createDataFrame(rows, schema), "e", "day", "rate").orderBy("day").collect()
    drop, same = z(days(calm + [0.1]))[-1], z(days(calm + [0.93]))[-1]
    assert drop["z"] < -3 and drop["roll_mean"] == same["roll_mean"]
    flat = z(days([0.9] * 30 + [0.7]))[-1]
    assert flat["flat_baseline_change"] and flat["z"] is None
    late = z(days([0.9] * 30) + [("S", D(2026, 6, 1), 0.7)])[-1]
    assert late["z"] is None and not late["flat_baseline_change"]
    with pytest.raises(ContractError):
        z(days([0.9]) * 2)
    with pytest.raises(ValueError):
        windows.rolling_z(spark.createDataFrame(days([1.0]), schema), "e", "day", "rate", window=5)


def test_slope_keeps_calendar_gaps(spark):
    rows = [("S", D(2025 + (2 * i) // 12, (2 * i) % 12 + 1, 1), 0.95 - 0.02 * i) for i in range(6)]
    got = windows.trend_slopes(spark.createDataFrame(rows, "e string, month date, fpy double"), "e", "month", "fpy").first()
    assert got["slope"] == pytest.approx(-0.01)


def test_ordered_helpers_equal_plain_windows(spark):
    random.seed(3)
    # One key holds most rows; values include nulls and ties in time.
    rows = [("hot" if random.random() < 0.8 else f"k{random.randrange(5)}", random.randrange(40), i, random.choice([None, 1, 2, 3])) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, t int, id int, x int")
    w = Window.partitionBy("k").orderBy("t", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    plain = df.select(
        "id", F.coalesce(F.sum("x").over(upto), F.lit(0)).alias("s"), F.lag("x").over(w).alias("l"), F.last("x", True).over(upto).alias("f"), F.row_number().over(w).alias("n")
    )
    b = F.floor(F.col("t") / 7)
    s = ordered.running_sums(df, ["k"], b, ["t", "id"], {"s": F.col("x")}).select("id", "s")
    lagged = ordered.lag(df, ["k"], b, ["t", "id"], F.col("x"), "l").select("id", "l")
    f = ordered.forward_fill(df, ["k"], b, ["t", "id"], F.col("x"), "f").select("id", "f")
    n = ordered.row_numbers(df, ["k"], b, ["t", "id"], "n").select("id", "n")
    got = s.join(lagged, "id").join(f, "id").join(n, "id").select("id", "s", "l", "f", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_exact_quantiles_and_flag_ties(spark):
    df = spark.createDataFrame([(float(x),) for x in [5, 1, 4, 2, 3, 10]], "x double")
    got = {r["prob"]: r["value"] for r in ordered.exact_quantiles(df, "x", [0.0, 0.5, 0.9, 1.0]).collect()}
    assert got == {0.0: 1.0, 0.5: 3.5, 0.9: 7.5, 1.0: 10.0}
    ties = spark.createDataFrame([(0.3,)] * 20, "x double")
    assert cascade.flag_rate_threshold(ties, "x", 0.05).first()["achieved_rate"] == 1.0


def test_zscore_contract(spark):
    assert stats.zscore(spark.createDataFrame([(1.0,), (3.0,)], "x double"), ["x"]).agg(F.max("z_x")).first()[0] == 1.0
    for bad in ([(2.0,), (2.0,)], [(1.0,)], [(1.0,), (float("nan"),)]):
        with pytest.raises(ContractError):
            stats.zscore(spark.createDataFrame(bad, "x double"), ["x"])


def test_special_functions_against_known_values():
    assert special.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert special.t_two_sided(4.03, 60) == pytest.approx(0.000158, abs=2e-5)
    assert special.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert special.chi2_upper(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert special.chi2_upper(18.307038, 10) == pytest.approx(0.05, abs=1e-6)


def test_bootstrap_brackets_the_mean_and_ignores_partitioning(spark):
    df = spark.range(400).select((F.col("id") % 20 / 20).alias("x"))
    one = stats.bootstrap_ci(df, "x", n_boot=500).first()
    two = stats.bootstrap_ci(df.repartition(7), "x", n_boot=500).first()
    mean, se = 0.475, 0.2883 / 20
    assert one["low"] == pytest.approx(mean - 1.96 * se, abs=0.006) and one["high"] == pytest.approx(mean + 1.96 * se, abs=0.006)
    assert tuple(one) == pytest.approx(tuple(two))
    with pytest.raises(ValueError):
        stats.bootstrap_ci(df, "x", n_boot=0)
    with pytest.raises(ContractError):
        stats.bootstrap_ci(df.limit(1), "x")


def policy_rows():
    m = D(2026, 1, 1)
    return [(m, "A", 5.0, 1.0, 1, 3.0), (m, "B", 5.0, 2.0, 0, 0.0), (m, "C", 1.0, 9.0, 1, 5.0), (m, "D", 0.5, 8.0, 1, 4.0), (D(2026, 2, 1), "A", 1.0, 1.0, 0, 0.0)]


POLICY = "month date, supplier_id string, predicted_harm_90d double, recent_harm_90d double, sev3_next_90d int, harm_next_90d double"


def test_policy_report(spark):
    report = evaluation.monthly_policy_report(spark.createDataFrame(policy_rows(), POLICY), k=2)
    got = {(r["month"].month, r["policy"]): r for r in report.collect()}
    harm, recent = got[1, "predicted_harm"], got[1, "recent_harm_baseline"]
    assert list(harm["selected_ids"]) == ["A", "B"] and harm["precision_at_k"] == 0.5
    assert harm["recall_at_k"] == pytest.approx(1 / 3) and harm["captured_harm_fraction"] == 0.25
    assert (recent["precision_at_k"], recent["recall_at_k"], recent["captured_harm_fraction"]) == (1.0, pytest.approx(2 / 3), 0.75)
    small = got[2, "predicted_harm"]
    assert small["selected_suppliers"] == 1 and small["recall_at_k"] is None and small["captured_harm_fraction"] is None


@pytest.mark.parametrize("change", [lambda r: r + [r[0]], lambda r: [(r[0][0], "A", float("nan"), 1.0, 1, 1.0)], lambda r: [(r[0][0], "A", 1.0, -1.0, 1, 1.0)], lambda r: [(r[0][0], "A", 1.0, 1.0, 2, 1.0)]])
def test_policy_report_rejects(spark, change):
    with pytest.raises(ContractError):
        evaluation.monthly_policy_report(spark.createDataFrame(change(policy_rows()), POLICY), k=2)


def test_ranking_metrics_with_ties(spark):
    df = spark.createDataFrame([(0.9, 1), (0.5, 0), (0.5, 1), (0.1, 0)], "s double, y int")
    got = evaluation.ranking_metrics(df, "s", "y").first()
    assert got["roc_auc"] == pytest.approx(3.5 / 4) and got["average_precision"] == pytest.approx(0.5 + 0.5 * 2 / 3)


def test_cascade_gate_fails_closed(spark):
    stage1 = spark.createDataFrame([(0.5, 0.95, 0.04)], "average_precision double, recall double, flag_rate double")

    def passed(row):
        s = spark.createDataFrame([row], "test_rows bigint, failures bigint, flags bigint, caught bigint")
        return {r["metric"]: r["passed"] for r in cascade.acceptance_checks(s, stage1).collect()}

    assert all(passed((6000, 40, 100, 30)).values())
    assert not passed((6000, 40, 0, 0))["cascade_precision"]
    assert not any(passed((6000, 20, 50, 18)).values()) and not any(passed((6000, 40, 30, 35)).values())


def test_tree_contributions_add_up_to_the_prediction(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import GBTRegressor

    import numpy as np

    from plumbline.operators import learning

    df = spark.range(200).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"))
    df = VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(df.withColumn("y", F.col("a") * 2 - F.col("b")))
    model = GBTRegressor(featuresCol="x", labelCol="y", maxIter=5, maxDepth=3, seed=1).fit(df)
    scored = model.transform(df).select("id", "prediction", vector_to_array("x").alias("x")).collect()
    bias, parts = learning.path_contributions(learning.tree_table(model), np.asarray([r["x"] for r in scored]))
    assert np.allclose(bias + parts.sum(axis=1), [r["prediction"] for r in scored])
    long = learning.tree_contributions(model, df, ["a", "b"], ["id"]).groupBy("id").agg(F.sum("impact").alias("s"))
    assert {r["id"]: round(r["s"] + bias, 6) for r in long.collect()} == {r["id"]: round(r["prediction"], 6) for r in scored}


def test_windows_at_full_time_precision(spark):
    at = ["2020-01-01 06:00", "2020-01-01 20:00", "2020-01-31 12:00", "2020-03-31 12:00"]
    ev = spark.createDataFrame([("S", f"e{i}", dt.datetime.fromisoformat(t)) for i, t in enumerate(at)], "k string, id string, at timestamp_ntz")
    from plumbline.operators import joins

    got = {r["id"]: (r["total_in_window"], list(r["recent"] or [])) for r in joins.prior_history(ev, "k", "at", "id").collect()}
    # 90 days before 31 March 12:00 is 1 January 12:00: only the later event of that day is inside.
    assert got == {"e0": (0, []), "e1": (1, ["e0"]), "e2": (2, ["e1", "e0"]), "e3": (2, ["e2", "e1"])}
    counts = {r["id"]: r["last_days"] for r in windows.rolling_counts(ev, "at", "id").collect()}
    assert counts == {"e0": 1, "e1": 2, "e2": 2, "e3": 1}


def test_count_tails_at_large_means(spark):
    rows = [("P", m, 800) for m in range(6)] + [("W", m, c) for m, c in enumerate((100, 900, 1700, 400, 2500, 30))]
    got = stats.count_tails(spark.createDataFrame(rows, "k string, m int, n long"), "k", "n").collect()
    flat = [r for r in got if r["k"] == "P"]
    assert {round(r["tail"], 3) for r in flat} == {0.505} and {r["limit"] for r in flat} == {867.0}
    wide = sorted((r["n"], r["tail"]) for r in got if r["k"] == "W")
    assert all(0 < t < 1 for _, t in wide) and [t for _, t in wide] == sorted((t for _, t in wide), reverse=True)


def test_ranges_stay_even_beside_an_outlier(spark):
    df = spark.range(20_000).select(F.col("id").cast("double").alias("x")).union(spark.createDataFrame([(1e12,)], "x double"))
    sizes = [r["count"] for r in ordered.ranged(df.repartition(8), ["x"]).groupBy(ordered.RANGE).count().collect()]
    assert sum(sizes) == 20_001 and max(sizes) < 4 * 20_001 / len(sizes)


def test_small_cells_count_filled_and_empty_ones(spark):
    rows = [("a", "x")] * 40 + [("a", "y")] * 3 + [("b", "x")] * 30 + [("c", "z")] * 2 + [("b", "z")] * 20
    got = stats.chi2_independence(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()
    n, left, right = len(rows), {}, {}
    for a, b in rows:
        left[a] = left.get(a, 0) + 1
        right[b] = right.get(b, 0) + 1
    assert got["small_cells"] == sum(i * j / n < 5 for i in left.values() for j in right.values()) and got["dof"] == 4
