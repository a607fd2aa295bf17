"""Results at ties, gaps and equal moments, where rounding or an unstated order could decide."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.functions import special
from plumbline.operators import stats

D = dt.date
UTC = dt.UTC


class FewViews:
    """Small frames in place of a folder's canonical views."""

    def __init__(self, **frames):
        self.__dict__.update(frames)


def test_an_audit_without_reports_has_no_counts(spark):
    from plumbline.plans import c_joins

    audits = spark.createDataFrame(
        [(1, 7, D(2000, 6, 1)), (2, 7, D(1997, 1, 1)), (3, 8, D(2000, 6, 1)), (4, 7, D(2000, 4, 20))], "audit_id long, supplier_id long, audit_date date"
    )
    ncrs = spark.createDataFrame([(7, dt.datetime(2000, 6, 2))], "supplier_id long, discovered_at timestamp_ntz")
    got = c_joins.before_after_counts(FewViews(audits=audits, ncrs=ncrs))
    assert {r["audit_id"]: (r["before_count"], r["after_count"]) for r in got.collect()} == {1: (0, 1), 2: (None, None), 3: (None, None), 4: (0, 1)}


def test_equal_mean_and_variance_is_poisson_in_any_row_order(spark):
    # Variance and mean are both exactly 7/3 (and 2 for the second group): floating moments may differ by a rounding.
    groups = {"a": [4, 4, 2, 2, 1, 1], "b": [1, 1, 4]}
    for name, xs in groups.items():
        n, s1, s2 = len(xs), sum(xs), sum(x * x for x in xs)
        groups[name] = xs, n * s2 - s1 * s1 > s1 * (n - 1)
    for flip in (False, True):
        rows = [(k, m, x) for k, (xs, _) in groups.items() for m, x in enumerate(reversed(xs) if flip else xs)]
        got = stats.count_tails(spark.createDataFrame(rows, "k string, m int, n long").repartition(3), "k", "n").collect()
        for r in got:
            assert r["overdispersed"] == groups[r["k"]][1]
            assert r["tail"] == pytest.approx(float(special.count_upper(r["mu"], float("nan") if not r["overdispersed"] else r["var"], r["n"])))
            assert 0 <= r["tail"] <= 1 and r["limit"] >= 3


def equal_moments():
    """Whole-number groups whose variance equals their mean: n * s2 - s1 * s1 = s1 * (n - 1)."""
    found = []
    for a in range(1, 20):
        for b in range(1, 20):
            for c in range(1, 20):
                xs = [1] * a + [2] * b + [4] * c
                n, s1, s2 = len(xs), sum(xs), sum(x * x for x in xs)
                if n * s2 - s1 * s1 == s1 * (n - 1):
                    found.append(xs)
    return found


def test_no_group_with_equal_moments_is_overdispersed(spark):
    rows = [(i, m, x) for i, xs in enumerate(equal_moments()) for m, x in enumerate(xs)]
    assert len({r[0] for r in rows}) > 5
    got = stats.count_tails(spark.createDataFrame(rows, "k int, m int, n long").repartition(5), "k", "n")
    assert got.where("overdispersed OR tail < 0 OR tail > 1").count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_grid_is_never_broadcast(spark):
    # The planner sees the few bytes of the supplier table, not the rows the months make of them.
    from plumbline.operators import panel

    suppliers = spark.createDataFrame([(1, "A", True, D(1995, 1, 1))], "supplier_id long, tier string, active boolean, onboarded_at date")
    grid = panel.spine(suppliers, "1995-01-01", "2001-01-01")
    facts = spark.range(10).select(F.col("id").alias("supplier_id"), F.lit("1995-02-01").cast("date").alias("month_end"))
    for plan in (plan_of(facts.join(grid, ["supplier_id", "month_end"], "left")), plan_of(grid.join(facts, ["supplier_id", "month_end"]))):
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_permuted_copies_are_not_broadcast(spark, monkeypatch):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    from plumbline import session
    from plumbline.operators import learning

    rows = spark.range(200).select(
        F.concat(F.lit("r"), "id").alias("row_id"), (F.col("id") % 2).cast("int").alias("label"),
        array_to_vector(F.array((F.col("id") % 2).cast("double"), (F.col("id") % 7).cast("double"))).alias("x"),
    )
    model = LogisticRegression(featuresCol="x", labelCol="label").fit(rows)
    plans, real = {}, session.written

    def watched(df, name):
        plans[name] = plan_of(df)
        return real(df, name)

    monkeypatch.setattr(session, "written", watched)
    got = {r["feature"]: r["mean_drop"] for r in learning.permutation_importance(model, rows, ["a", "b"], "label", "row_id").collect()}
    assert got["a"] > 0.3 > abs(got["b"])
    assert not [x for x in plans["auc"].splitlines() if "BroadcastHashJoin" in x and ("[from#" in x or "[place#" in x)]


def test_neighbour_blocks_by_products_equal_direct_distances():
    import numpy as np

    from plumbline.operators import neighbours

    rng = np.random.default_rng(5)
    # A lattice: many equal distances, many exactly at the limit; far from zero, so that products round.
    b = rng.integers(0, 4, size=(300, 3)).astype(float) * 0.35 + 100
    a = np.vstack([b[:50], rng.normal(100, 0.5, size=(50, 3))])
    direct = neighbours._distances(a, b)
    for eps in (0.35, 0.7, float(direct[60, 7])):
        assert (neighbours._close(a, b, eps) == (direct <= eps)).all()
    i, j, d = neighbours._nearest(a, b, 6)
    for x in range(len(a)):
        want = np.sort(np.round(direct[x], 9))[:6]
        mine = np.sort(d[i == x])
        assert (mine[:6] == want).all() and (mine == want[-1]).sum() == (np.round(direct[x], 9) == want[-1]).sum()


def test_crowded_clusters_and_ties_by_brute_force(spark):
    import numpy as np

    from plumbline.operators import neighbours

    rng = np.random.default_rng(8)
    points = [tuple(float(x) for x in p) for p in np.vstack([rng.normal(0, 0.3, (60, 2)), rng.normal(3, 0.3, (60, 2)), rng.uniform(-4, 8, (20, 2)), np.zeros((9, 2))]).round(1)]
    df = spark.createDataFrame([(n, list(p)) for n, p in enumerate(points)], "id long, v array<double>")
    d = np.array([[np.sqrt(sum((x - y) ** 2 for x, y in zip(p, q))) for q in points] for p in points])
    got = {}
    for r in neighbours.knn(df, "id", "v", 5, pivots=4, block=16).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour"]))
    for n in range(len(points)):
        want = sorted((m for m in range(len(points)) if m != n), key=lambda m: (round(d[n, m], 9), m))[:5]
        assert [m for _, m in sorted(got[n])] == want
    eps, core = 0.5, (d <= 0.5).sum(axis=1) >= 6
    label = {n: n for n in range(len(points)) if core[n]}
    for _ in range(len(points)):
        label = {n: min(label[m] for m in label if d[n, m] <= eps) for n in label}
    want = {n: label.get(n, min((label[m] for m in label if d[n, m] <= eps), default=-1)) for n in range(len(points))}
    assert {r["id"]: r["cluster"] for r in neighbours.dbscan(df, "id", "v", eps, 6, pivots=4, block=16).collect()} == want


def test_a_supplier_is_one_key_of_the_label_state(spark, tmp_path):
    # Several cutoffs mature in one batch, and others later, from one value and one timer at a time.
    from plumbline.streaming import jobs, stateful

    grid = spark.createDataFrame([(1, D(2026, m, 1)) for m in range(1, 7)], "supplier_id bigint, cutoff date")
    batches = [[(1, 4, dt.datetime(2026, 1, 5)), (1, 1, dt.datetime(2026, 4, 20))], [(1, 3, dt.datetime(2026, 7, 1))], [(2, 1, dt.datetime(2027, 1, 1))], [(2, 1, dt.datetime(2027, 1, 5))]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "supplier_id bigint, severity int, discovered_at timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    stream = spark.readStream.schema("supplier_id bigint, severity int, discovered_at timestamp").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    labels = stateful.mature_labels(stream, grid)
    rows = jobs.run_available(labels, "one-key", conf=stateful.SETTINGS).collect()
    got = {r["cutoff"].month: (r["sev3_next_90d"], r["harm_next_90d"]) for r in rows}
    assert len(rows) == 6 and got == {1: (1, 4), 2: (0, 1), 3: (0, 1), 4: (0, 1), 5: (1, 3), 6: (1, 3)}
