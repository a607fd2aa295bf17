"""Golden values of the supplier-month panel, its features and labels."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.operators import joins, panel, prep
from plumbline.operators.joins import ContractError

D = dt.date


def ts(y, m, d, h=0, mi=0, s=0):
    return dt.datetime(y, m, d, h, mi, s)


NCR = "ncr_id string, supplier_id string, category string, severity int, cost decimal(18,2), discovered_at timestamp_ntz"


def base_ncrs():
    rows = []
    for month, n in ((6, 46), (7, 46), (8, 47)):
        for i in range(n):
            severity = 3 if month == 8 and i < 9 else 2
            rows.append((f"N{month}-{i}", "S-0417", "dimensional", severity, None, ts(2026, month, 10)))
    return rows


@pytest.fixture()
def world(spark):
    f = lambda rows, schema: spark.createDataFrame(rows, schema)
    suppliers = f(
        [("S-0417", "Busy", "B", True, D(2015, 9, 1)), ("S-0002", "Quiet", "A", True, D(2026, 6, 1)), ("S-0009", "Gone", "C", False, D(2015, 1, 1))],
        "supplier_id string, supplier_name string, tier string, active boolean, onboarded_at date",
    )
    inspections = f([("S-0417", ts(2026, 8, 5), i < 912) for i in range(1000)], "supplier_id string, inspected_at timestamp_ntz, passed boolean")
    orders = f([(f"P{i}", "S-0417", D(2026, 8, 10)) for i in range(100)], "po_line_id string, supplier_id string, promised_date date")
    receipts = f(
        [(f"P{i}", "S-0417", ts(2026, 8, 10 if i < 83 else 12), 5) for i in range(100)],
        "po_line_id string, supplier_id string, received_at timestamp_ntz, quantity int",
    )
    audits = f(
        [("A1", "S-0417", D(2026, 8, 1), 71.0), ("A2", "S-0417", D(2026, 9, 1), 99.0)],
        "audit_id string, supplier_id string, audit_date date, audit_score double",
    )
    cars = f(
        [(f"C{i}", "S-0417", D(2026, 8, 1), None) for i in range(4)] + [("C9", "S-0417", D(2026, 7, 1), D(2026, 8, 31))],
        "car_id string, supplier_id string, opened_at date, closed_at date",
    )
    return dict(suppliers=suppliers, inspections=inspections, orders=orders, receipts=receipts, audits=audits, cars=cars)


def build(world, ncrs):
    return panel.supplier_month(
        world["suppliers"], ncrs, world["inspections"], world["receipts"], world["orders"], world["audits"], world["cars"],
        "2025-09-01", "2026-08-01",
    )


def test_golden_panel(spark, world):
    rows = {(r["supplier_id"], r["month"]): r for r in build(world, spark.createDataFrame(base_ncrs(), NCR)).collect()}
    assert len(rows) == 15  # twelve months, and three since the second supplier joined
    busy = rows["S-0417", D(2026, 8, 1)]
    assert (busy["ncr_count"], busy["sev3_plus_count"], busy["ncr_count_3mo"]) == (47, 9, 139)
    assert (busy["fpy"], busy["otd"], busy["audit_score"], busy["open_cars"]) == (0.912, 0.83, 71.0, 4)
    assert busy["cost_impact"] is None
    quiet = rows["S-0002", D(2026, 8, 1)]
    assert quiet["ncr_count"] == 0 and quiet["fpy"] is None and quiet["cost_impact"] == 0


def test_ninety_day_boundary_and_future(spark, world):
    extra = [("in", "S-0417", "material", 118, None, ts(2026, 6, 3)), ("out", "S-0417", "material", 5, None, ts(2026, 6, 2, 23, 59, 59)), ("next", "S-0417", "material", 5, None, ts(2026, 9, 1))]
    plain = [(n, s, c, v, k, ts(2026, t.month, 10)) for n, s, c, v, k, t in base_ncrs()]
    delivered = panel.deliveries(world["receipts"], world["orders"])

    def august(rows):
        ncrs = spark.createDataFrame(rows, NCR)
        feats = panel.supplier_features(build(world, ncrs), ncrs, delivered, world["audits"])
        return panel.add_derived(feats).where("supplier_id = 'S-0417' AND month = DATE '2026-08-01'").first()

    without, with_extra = august(plain), august(plain + extra)
    assert without["ncr_count_90d"] == 139 and with_extra["ncr_count_90d"] == 140
    assert with_extra["avg_severity_90d"] == pytest.approx((130 * 2 + 9 * 3 + 118) / 140)
    assert with_extra["years_as_supplier"] == pytest.approx(11.0006844627)
    assert with_extra["spend_share"] is None and with_extra["units_received_90d"] == 500


def test_labels_stay_empty_until_mature(spark, world):
    grid = panel.spine(world["suppliers"], "2025-09-01", "2026-08-01").where("supplier_id = 'S-0417'")
    ncrs = spark.createDataFrame(base_ncrs(), NCR)
    got = {r["month"]: r for r in panel.forward_labels(grid, ncrs, "2026-09-01").collect()}
    assert all(got[D(2026, m, 1)]["harm_next_90d"] is None for m in (6, 7, 8))
    may = got[D(2026, 5, 1)]
    in_window = [r for r in base_ncrs() if ts(2026, 6, 1) <= r[5] < ts(2026, 8, 30)]
    assert may["sev3_next_90d"] == 1 and may["harm_next_90d"] == sum(r[3] for r in in_window)
    holed = spark.createDataFrame(base_ncrs() + [("x", "S-0417", "material", None, None, ts(2026, 6, 20))], NCR)
    hole = panel.forward_labels(grid, holed, "2026-09-01").where("month = DATE '2026-05-01'").first()
    assert hole["sev3_next_90d"] is None and hole["harm_next_90d"] is None


def test_month_range_is_checked():
    for bad in (("2026-01-02", "2026-03-01"), ("2026-04-01", "2026-03-01"), ("yesterday", "2026-03-01")):
        with pytest.raises(ValueError):
            panel.check_month_range(*bad)


def test_recurrence_counts_each_case_once(spark):
    cars = spark.createDataFrame(
        [("C1", "S", "k", D(2025, 1, 1), "ann"), ("C2", "S", "k", D(2025, 6, 1), "ann"), ("C3", "S", None, D(2025, 1, 1), "ann"), ("C4", "S", "k", D(2026, 8, 1), "ann")],
        "car_id string, supplier_id string, cause_code string, closed_at date, reviewer string",
    )
    events = spark.createDataFrame(
        [("S", "k", D(2025, 2, 1), D(2025, 2, 5)), ("S", "k", D(2025, 3, 1), D(2025, 3, 5)), ("S", "k", D(2025, 7, 1), D(2027, 1, 1))],
        "supplier_id string, cause_code string, discovered_at date, adjudicated_at date",
    )
    rows = joins.recurrence(cars, events, ["supplier_id", "cause_code"], "2026-09-01").collect()
    assert len(rows) == 2 and sum(r["recurred"] for r in rows) == 1


def test_history_counts_all_but_shows_ten(spark):
    rows = [(f"prior-{i:02d}", "S", ts(2026, 8, 1)) for i in range(12)]
    rows += [("current", "S", ts(2026, 8, 18)), ("future", "S", ts(2026, 9, 1)), ("old", "S", ts(2026, 1, 1)), ("other", "T", ts(2026, 8, 1))]
    df = spark.createDataFrame(rows, "ncr_id string, supplier_id string, discovered_at timestamp_ntz")
    got = {r["ncr_id"]: r for r in joins.prior_history(df, "supplier_id", "discovered_at", "ncr_id").collect()}
    assert got["current"]["total_in_window"] == 12 and len(got["current"]["recent"]) == 10
    assert got["current"]["recent"][0] == "prior-00" and got["other"]["total_in_window"] == 0


def test_folds_and_reservation(spark):
    months = [D(2024 + (i // 12), i % 12 + 1, 1) for i in range(24)]
    df = spark.createDataFrame([("S", m) for m in months], "supplier_id string, month date")
    folds = prep.month_folds(df).collect()
    tests = sorted(r["month"] for r in folds if r["fold"] == 5 and r["role"] == "test")
    train = sorted(r["month"] for r in folds if r["fold"] == 5 and r["role"] == "train")
    assert tests == months[-3:] and train[-1] == months[-7]
    with pytest.raises(ContractError):
        prep.month_folds(df.limit(6))
    labelled = df.withColumn("label_end", F.date_add(F.add_months("month", 1), 90))
    roles = {r["period_role"]: r["count"] for r in prep.reserve_period(labelled, "2025-10-01").groupBy("period_role").count().collect()}
    assert roles == {"development": 19, "purged": 2, "final": 3}
    with pytest.raises(ContractError):
        prep.reserve_period(labelled.withColumn("label_end", F.date_add("month", 90)), "2025-10-01")
