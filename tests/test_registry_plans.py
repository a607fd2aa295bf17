"""The registry as a whole, plan shapes, and the streaming fold."""

import datetime as dt
import re

import __spark_entry__ as entry
from plumbline.sources.views import Views
from plumbline import plans
from plumbline.streaming import jobs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_query_is_described():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert len(queries) >= 200 and set(oracle) <= set(queries)
    # The optional operators are added by the entry alone, never by the library's own registry.
    assert not any(re.match(r"op\d|pipeline", n) for n in plans.load())


def test_flagship_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[:3] == ["supplier_id", "tier", "month"]


def test_filters_and_columns_reach_the_scan(spark, sf):
    df = entry.queries()["agg_having"](spark, sf)
    text = plan(df)
    assert "PushedFilters: [IsNotNull(l_returnflag)" in text.replace("\n", "") or "EqualTo(l_returnflag,R)" in text
    assert "l_tax" not in text and "l_linestatus" not in text


def test_range_operators_have_no_nested_loops(spark, sf):
    for name in ("trailing_90d", "trailing_receipts_90d", "forward_label", "before_after_counts", "join_self_interval", "history_context", "asof_last5", "supplier_month"):
        text = plan(entry.queries()[name](spark, sf))
        assert "CartesianProduct" not in text, name
        # The one-row supplier count of the audit and car views is the only nested loop there is.
        loops = text.count("BroadcastNestedLoopJoin")
        assert loops == 0 or name in {"before_after_counts", "supplier_month"}, name


def test_topn_is_cut_before_the_shuffle(spark, sf):
    assert "WindowGroupLimit" in plan(entry.queries()["topn_per_group"](spark, sf))


def test_results_do_not_depend_on_partitioning(spark, sf):
    from plumbline.operators import joins

    ncrs = Views(spark, sf).ncrs
    one = joins.prior_history(ncrs, "supplier_id", "discovered_at", "ncr_id").collect()
    two = joins.prior_history(ncrs.repartition(13), "supplier_id", "discovered_at", "ncr_id").collect()
    assert sorted(map(str, one)) == sorted(map(str, two))


def test_intake_keeps_all_sides_and_repeats_a_batch_safely(spark, sf, tmp_path):
    from plumbline.operators import contracts
    from plumbline.plans.a_sources import raw_intake
    from plumbline.sources.views import Views
    from pyspark.sql import functions as F

    raw = raw_intake(Views(spark, sf).raw("events")).withColumn("ts", F.col("ts").cast("timestamp"))
    middle = raw.select(F.percentile_approx("event_row", 0.5)).first()[0]
    late_rows = F.col("event_row") % 50 == 7
    one, two = raw.where((F.col("event_row") <= middle) & ~late_rows), raw.where((F.col("event_row") > middle) | late_rows)
    job = jobs.Intake(spark, str(tmp_path / "out"), "ts", delay="1 hour")
    schema = contracts.intake(raw).schema
    job.handle(one, 0)
    job.handle(two, 1)
    newest = one.agg(F.max("ts")).first()[0]
    rows = lambda: sorted((r["side"], r["event_row"], r["batch"]) for r in job.sides(schema).collect())
    got = rows()
    judged = contracts.intake(raw)
    assert {e for s, e, _ in got if s == "quarantine"} == {r["event_row"] for r in judged.where("status <> 202").collect()}
    old = contracts.intake(two).where((F.col("status") == 202) & (F.col("ts") < F.lit(newest) - F.expr("INTERVAL 1 HOUR")))
    assert {e for s, e, _ in got if s == "late"} == {r["event_row"] for r in old.collect()} and old.count() > 0
    keys = [r["dedup_key"] for r in job.read("accepted", contracts.intake(raw).schema).collect()]
    assert len(keys) == len(set(keys)) > 0
    job.handle(two, 1)  # the batch is run again after a failure
    assert rows() == got


def test_alarm_needs_three_adjacent_windows(spark):
    t = lambda h: dt.datetime(2026, 1, 1, h)
    rows = [("m", t(h), t(h + 1), 0.5) for h in (0, 1, 2, 4, 5)] + [("m", t(6), t(7), 0.9)]
    df = spark.createDataFrame(rows, "model string, start timestamp, end timestamp, mean double")
    got = {r["start"].hour: r["alarm"] for r in jobs.alarms(df, ["model"]).collect()}
    assert got == {0: False, 1: False, 2: True, 4: False, 5: False, 6: False}


def test_streams_read_files_and_folders_alike(spark, sf, tmp_path):
    for name in ("events", "lineitem", "supplier", "orders", "documents", "part"):
        spark.read.parquet(f"{sf}/{name}.parquet").repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name in ("stream_rolling_yield", "stream_rules", "stream_label_maturity", "stream_budget", "stream_sessions"):
        run = plans.load()[name].run
        one, many = (sorted(map(str, run(spark, d).collect())) for d in (sf, str(tmp_path)))
        assert one == many and one


def test_permutation_importance_equals_plain_numpy(spark):
    import numpy as np
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.sql import functions as F

    from plumbline.operators import learning

    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3)).round(3)
    y = (x[:, 0] + 0.3 * x[:, 1] + rng.normal(size=60) * 0.3 > 0).astype(int)
    raw = spark.createDataFrame([(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, a double, b double, c double, label int")
    rows = VectorAssembler(inputCols=["a", "b", "c"], outputCol="x").transform(raw)
    model = LogisticRegression(featuresCol="x", labelCol="label").fit(rows)
    got = {r["feature"]: (r["mean_drop"], r["sd_drop"]) for r in learning.permutation_importance(model, rows, ["a", "b", "c"], "label", "id").collect()}

    line = [r["id"] for r in rows.orderBy(F.xxhash64("id"), "id").select("id").collect()]
    x, y, w = x[line], y[line], model.coefficients.toArray()

    def auc(matrix):
        s = matrix @ w
        return np.mean([(s[i] > s[j]) + 0.5 * (s[i] == s[j]) for i in np.flatnonzero(y == 1) for j in np.flatnonzero(y == 0)])

    drops = {}
    for c, _, factor, shift in learning.affine_orders(60, [0, 1, 2], 3):
        order = (factor * np.arange(60) + shift) % 60
        assert sorted(order) == list(range(60))
        mixed = x.copy()
        mixed[:, c] = x[order, c]
        drops.setdefault("abc"[c], []).append(auc(x) - auc(mixed))
    assert set(got) == {"a", "b", "c"} and got["a"][0] > 0.2
    for name, values in drops.items():
        assert np.allclose(got[name], (np.mean(values), np.std(values)), atol=1e-9)


def test_models_newer_than_the_scoring_date_are_refused(spark):
    import pytest

    from plumbline.operators import learning
    from plumbline.operators.joins import ContractError

    snapshot = spark.createDataFrame([(1, dt.date(2026, 3, 1))], "supplier_id long, snapshot_cutoff date")
    with pytest.raises(ContractError):
        learning.score_suppliers(snapshot, None, None, None, 0.3, dt.date(2026, 3, 2))


def test_range_sums_and_numbers_equal_plain_windows(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from plumbline.operators import ordered

    df = spark.range(500).select("id", (F.col("id") * 37 % 11).alias("v"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("k"))
    got = ordered.range_sums(df, ["k"], [F.desc("v"), F.col("id")], {"s": F.col("v")})
    want = df.withColumn("s", F.sum("v").over(Window.partitionBy("k").orderBy(F.desc("v"), "id").rowsBetween(Window.unboundedPreceding, 0)))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
    places = ordered.numbered(df, [F.desc("v"), F.col("id")])
    assert [r["id"] for r in places.orderBy("rn").collect()] == [r["id"] for r in df.orderBy(F.desc("v"), "id").collect()]
    assert {r["rn"] for r in places.collect()} == set(range(1, 501))
    assert ordered.numbered(df.limit(0), ["id"]).count() == 0
    q = ordered.exact_quantiles(df.withColumn("v", F.col("v").cast("double")), "v", [0.1, 0.5, 0.93], ["k"])
    for r in q.collect():
        assert r["value"] == df.where(F.col("k") == r["k"]).select(F.percentile("v", F.lit(r["prob"]))).first()[0]
