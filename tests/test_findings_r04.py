"""One small test per finding of round 4."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from plumbline import session
from plumbline.operators import evaluation, joins, neighbours, panel
from plumbline.plans import c_joins
from plumbline.streaming import stateful

D = dt.date


class FewViews:
    """Small frames in place of a folder's canonical views."""

    def __init__(self, **frames):
        self.__dict__.update(frames)


def test_every_audit_whose_windows_are_over_is_counted(spark):
    today = dt.datetime.now(dt.UTC).date()
    audits = spark.createDataFrame(
        [(1, 7, D(2001, 7, 3)), (2, 7, D(2001, 7, 4)), (3, 7, D(2001, 8, 1)), (4, 7, today)], "audit_id long, supplier_id long, audit_date date"
    )
    ncrs = spark.createDataFrame([(7, dt.datetime(2001, 7, 20)), (7, dt.datetime(2001, 10, 20))], "supplier_id long, discovered_at timestamp_ntz")
    got = c_joins.before_after_counts(FewViews(audits=audits, ncrs=ncrs)).collect()
    assert {r["audit_id"]: (r["before_count"], r["after_count"]) for r in got} == {1: (0, 1), 2: (0, 1), 3: (1, 1)}


def plain_history(rows, days=90, shown=10):
    out = []
    for k, at, i in rows:
        seen = [(a, j) for q, a, j in rows if k is not None and at is not None and q == k and a is not None and at - dt.timedelta(days=days) <= a < at]
        seen.sort(key=lambda r: (-r[0].timestamp(), r[1]))
        out.append((str(k), i, len(seen), [j for _, j in seen[:shown]]))
    return sorted(out)


def test_history_of_repeated_rows_and_of_busy_keys(spark):
    # Repeated lines, equal instants, a row without supplier and one without time: one result per row, and
    # a key that is cut into stretches has the results of one that is not.
    rng = random.Random(4)
    start = dt.datetime(2000, 1, 1)
    rows = [(rng.choice([1, 1, 1, 2]), start + dt.timedelta(days=rng.randrange(400), hours=rng.choice([0, 0, 7])), f"n{rng.randrange(900)}") for _ in range(500)]
    rows += [rows[0], rows[0], (None, start, "u"), (None, start + dt.timedelta(days=1), "v"), (2, None, "w")]
    ncrs = spark.createDataFrame(rows, "k long, at timestamp_ntz, id string").repartition(5)
    for given in ({}, {"busy": 50}):
        got = joins.prior_history(ncrs, "k", "at", "id", **given).collect()
        assert len(got) == len(rows)
        assert sorted((str(r["k"]), r["id"], r["total_in_window"], list(r["recent"] or [])) for r in got) == plain_history(rows)


def shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for folder in map(str, folders) for _, _, files in os.walk(folder) for f in files if f.startswith("shuffle_")}


def test_stored_rows_leave_no_shuffle_files(spark):
    rows = spark.range(5000).groupBy((F.col("id") % 997).alias("k")).count()
    before = shuffle_files(spark)
    kept = session.written(rows, "kept")
    assert not shuffle_files(spark) - before
    assert kept.count() == 997


def test_auc_by_bands_equals_the_ranking_metrics(spark):
    rows = spark.range(3000).select(
        (F.col("id") % 2).alias("c"), (F.pmod(F.xxhash64("id"), F.lit(700)) / 700).alias("score"), (F.pmod(F.hash("id"), F.lit(3)) == 0).cast("int").alias("label")
    )
    want = {r["c"]: r["roc_auc"] for r in evaluation.ranking_metrics(rows, "score", "label", ["c"]).collect()}
    got = {r["c"]: r["roc_auc"] for r in evaluation.auc_by(rows, "score", "label", ["c"]).collect()}
    assert set(got) == {0, 1} and all(abs(got[c] - want[c]) < 1e-12 for c in want)


def test_receipts_met_in_shares_give_the_same_sums(spark):
    day = F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 200).cast("int"))
    lines = spark.range(400).select(
        F.concat(F.lit("l"), "id").alias("po_line_id"), (F.col("id") % 3).alias("supplier_id"), day.cast("timestamp_ntz").alias("received_at"),
        F.when(F.col("id") % 50 != 0, F.date_add(day, 2)).alias("promised_date"), F.when(F.col("id") % 70 != 0, F.col("id")).alias("quantity"),
    )
    whole, shared = (sorted(map(str, panel.trailing_receipts(lines, shares=n).collect())) for n in (0, 3))
    assert whole == shared and len(whole) > 20


def test_a_discarded_table_is_gone(spark):
    made = session.written(spark.range(3), "gone")
    assert os.path.isdir(made.written_at)
    session.discard(made)
    assert not os.path.exists(made.written_at)


def test_a_border_point_takes_the_smallest_cluster_of_its_neighbours(spark):
    # On a line: cluster 1 is {1, 9, 10, 11}, cluster 2 is {2, 3, 4, 5}; row 20 lies between core 11 and core 2.
    at = {1: 0.0, 9: 0.5, 10: 0.9, 11: 1.0, 20: 1.95, 2: 2.9, 3: 3.0, 4: 3.4, 5: 3.6, 30: 9.0}
    rows = spark.createDataFrame([(i, [x, 0.0]) for i, x in at.items()], "id long, v array<float>")
    for given in ({"pivots": 1}, {"pivots": 4, "block": 2, "copies": 1}):
        got = {r["id"]: r["cluster"] for r in neighbours.dbscan(rows, "id", "v", eps=1.0, min_samples=4, **given).collect()}
        assert got == {1: 1, 9: 1, 10: 1, 11: 1, 2: 2, 3: 2, 4: 2, 5: 2, 20: 1, 30: -1}


class CountedStates:
    """A handle whose value and map states count the calls made to them."""

    def __init__(self):
        self.calls, self.held = 0, {}

    def state(self, *_):
        return type(self).shared(self)

    getValueState = getMapState = state  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1

    @staticmethod
    def shared(counter):
        held = {}

        class State:
            def __getattr__(self, name):
                counter.calls += 1
                if name == "exists":
                    return lambda: bool(held)
                if name in ("get", "getValue"):
                    return lambda k=(): held[k]
                if name in ("update", "updateValue"):
                    return lambda *a: held.update({a[0] if len(a) > 1 else (): a[-1]})
                return {"containsKey": lambda k: k in held, "iterator": lambda: iter(list(held.items()))}[name]

        return State()


def test_calls_to_the_budget_state_do_not_go_by_requests():
    import pandas as pd

    n, month = 30_000, D(2026, 1, 1)
    asked = pd.DataFrame({"trace_id": [f"t{i}" for i in range(n)], "sent_at": pd.Timestamp(2026, 1, 2), "turn": 0, "kind": "reserve", "amount": 1})
    told = asked.assign(sent_at=pd.Timestamp(2026, 1, 3), turn=1, kind="settle", amount=2)
    states, job = CountedStates(), stateful.BudgetMonth(1000.0, 0.8, 7, 3)
    job.init(states)
    out = [pd.concat(list(job.handleInputRows((month,), iter([batch]), None))) for batch in (asked, told, asked)]
    assert [set(o["answer"]) for o in out] == [{"ok"}, {"settled"}, {"ok"}]
    assert round(out[1]["committed"].iloc[-1] * stateful.UNIT) == round(out[2]["committed"].iloc[-1] * stateful.UNIT) == 2 * n
    assert states.calls < n / 3


def test_near_dedup_keeps_no_table_it_does_not_read_again(spark, monkeypatch):
    from plumbline.llm import common, similar

    made, real = [], common.written

    def watched(df, name):
        out = real(df, name)
        made.append((name, out.written_at))
        return out

    monkeypatch.setattr(common, "written", watched)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[: 55 + i % 3] + [f"x{i}"])) for i in range(6)] + [(9, "quite another text of a few words")]
    kept = similar.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == [0, 9]
    left = {name for name, path in made if os.path.exists(path)}
    assert {"similar-shared", "similar-rest", "similar-named"} <= {name for name, _ in made}
    assert not left & {"similar-shared", "similar-open", "similar-rest", "similar-named"}
