"""Queries on tables of the size or with the ties that a review asked for."""

import duckdb

import __spark_entry__ as entry
from plumbline import session


def rows_of_both(spark, folder, name, tables):
    """The query's rows and its SQL's, over the tables of ``folder``."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return sorted(tuple(r) for r in entry.queries()[name](spark, str(folder)).collect()), sorted(con.execute(entry.oracle_sql()[name]).fetchall())


def test_five_digit_suppliers_share_codes_but_not_identities(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT i AS s_suppkey, 'Supplier#' || lpad(CAST(i AS VARCHAR), 9, '0') AS s_name, CAST(i % 25 AS INT) AS s_nationkey, 1.0::DOUBLE AS s_acctbal FROM range(10050) t(i)) TO '{tmp_path}/supplier.parquet'")
    con.execute(f"COPY (SELECT 9900 + i * 7 AS conv_id, 1::BIGINT AS turn, 'user' AS role, 'part ' || i AS text FROM range(20) t(i)) TO '{tmp_path}/conversations.parquet'")
    got, want = rows_of_both(spark, tmp_path, "pseudonymise", ["supplier", "conversations"])
    assert got == want and len(got) == 20


def test_of_rows_of_one_instant_the_smallest_is_accepted(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i // 10) AS ts, i // 10 AS user_id, 'view' AS event_type, 1.0::DOUBLE AS value, '' AS props FROM range(400) t(i)) TO '{tmp_path}/events.parquet'")
    got, want = rows_of_both(spark, tmp_path, "stream_intake_sides", ["events"])
    assert got == want and len({r[0] for r in got}) == 2


def answer_tables(folder):
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT i AS doc_id, CASE WHEN i % 40 = 7 THEN NULL WHEN i % 40 = 9 THEN '' ELSE repeat('alpha beta gamma delta ', 12) || 'w' || (i % 6) || ' x' || (i % 3) END AS text,
      CASE WHEN i % 4 = 3 THEN NULL ELSE 'l' || (i % 2) END AS lang, 's' AS source, 1::BIGINT AS n_chars FROM range(700) t(i)) TO '{folder}/documents.parquet'""")


def test_answers_without_scope_or_text_are_not_reused(spark, tmp_path):
    answer_tables(tmp_path)
    got, want = rows_of_both(spark, tmp_path, "answer_reuse", ["documents"])
    assert got == want and {r[3] for r in got} >= {"exact"}


def test_crowded_slots_of_answers_change_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    from plumbline.operators import retrieval

    answer_tables(tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumn("at", F.timestamp_seconds(F.col("doc_id")))
    asks = docs.select(F.col("doc_id").alias("query_id"), F.col("lang").alias("scope"), "text", F.col("at").alias("asked_at"))
    held = docs.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("answer_id"), F.col("lang").alias("scope"), "text", F.col("at").alias("answered_at"))
    whole, cut = (sorted(tuple(r) for r in retrieval.near_reuse(asks, held, 300, block=b).collect()) for b in (1000, 7))
    assert whole == cut and len(whole) > 100


def test_vectors_are_counted_in_their_rows_and_repeated_ids_added_up(spark, tmp_path):
    con = duckdb.connect()
    text = "'Alpha beta-' || (i % 7) || ' alpha ' || repeat('gamma ', CAST(i % 4 AS INT))"
    for name, key in (("once", "i"), ("twice", "i // 2")):
        (tmp_path / name).mkdir()
        con.execute(f"COPY (SELECT {key} AS doc_id, CASE WHEN i = 5 THEN NULL WHEN i = 6 THEN '' ELSE {text} END AS text, 'l' AS lang, 's' AS source, 1::BIGINT AS n_chars FROM range(60) t(i)) TO '{tmp_path}/{name}/documents.parquet'")
        got, want = rows_of_both(spark, tmp_path / name, "hash_vectors", ["documents"])
        assert got == want
    plan = entry.queries()["hash_vectors"](spark, str(tmp_path / "once"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_known_bounds_leave_out_far_pairs_and_no_near_one():
    import numpy as np

    from plumbline.operators import neighbours

    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(40, 8)), rng.normal(size=(90, 8))
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    known = np.sort(d, axis=1)[:, [2, 30]][np.arange(40), np.arange(40) % 2]  # bounds tighter and wider than the fifth distance
    i, j, got = neighbours._nearest(a, b, 5, known)
    needed = d <= np.minimum(known, np.sort(d, axis=1)[:, 4])[:, None] + 1e-12
    assert set(zip(*np.nonzero(needed))) <= set(zip(i, j)) and len(i) <= needed.sum() + 2
    assert np.allclose(got, d[i, j], atol=1e-9)


def retrieval_tables(folder, key, asked="item {i} alpha-1 w' || (i % 5) || ' zz"):
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT {key} AS doc_id, CASE WHEN i % 30 = 4 THEN NULL WHEN i % 30 = 5 THEN '' ELSE 'alpha-1 w' || (i % 7) || ' ' || repeat('w' || (i % 5) || ' ', CAST(i % 4 AS INT)) || 'end' END AS text,
      'l' AS lang, 's' || (i % 3) AS source, 1::BIGINT AS n_chars FROM range(400) t(i)) TO '{folder}/documents.parquet'""")
    con.execute(f"COPY (SELECT i AS item_id, CASE WHEN i = 3 THEN 'unknown' WHEN i = 4 THEN '' ELSE 'alpha-1 w' || (i % 5) || ' w2 w2' END AS text FROM range(9) t(i)) TO '{folder}/benchmark.parquet'")


def test_bm25_with_single_and_repeated_ids_is_that_of_the_sql(spark, tmp_path):
    for name, key in (("once", "i"), ("twice", "i % 385")):
        (tmp_path / name).mkdir()
        retrieval_tables(tmp_path / name, key)
        got, want = rows_of_both(spark, tmp_path / name, "bm25_topk", ["documents", "benchmark"])
        assert got == want and got


def test_a_task_sends_its_best_only(spark, tmp_path):
    import pandas as pd

    from plumbline.operators import retrieval
    from plumbline.sources.views import Views

    retrieval_tables(tmp_path, "i")
    scopes = [retrieval.Scope(0, ("manual", "car", "audit", "standard"), ("P0", "P1", "P2"), "2024-06-01", "space-a")]
    docs = retrieval.corpus(Views(spark, str(tmp_path)).chunks, scopes).repartition(2)
    number = retrieval.term_counts(spark.createDataFrame([("alpha-1",)], "t string"), "t").first()["terms"][0]
    terms = pd.DataFrame({"query_id": [7], "scope_id": [0], "term": [number], "weight": [1.5], "avgdl": [4.0]})
    every, few = (retrieval.bm25_scores(docs, terms, k) for k in (None, 5))
    order = lambda df: sorted((-round(r["score"], 9), r["id"]) for r in df.collect())
    assert few.count() <= 10 < every.count()
    assert order(few)[:5] == order(every)[:5]


def panel_tables(folder):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT i AS s_suppkey, 's' || i AS s_name, CAST(i % 25 AS INT) AS s_nationkey, 1.0::DOUBLE AS s_acctbal FROM range(7) t(i)) TO '{folder}/supplier.parquet'")
    con.execute(f"""COPY (SELECT i AS o_orderkey, i * 5 % 7 AS o_custkey, CASE i % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS o_orderstatus, CAST(1.13 * i AS DOUBLE) AS o_totalprice,
      TIMESTAMP '1994-06-01' + to_days(CAST(i * 11 AS INT)) AS o_orderdate, '1-URGENT' AS o_orderpriority FROM range(230) t(i)) TO '{folder}/orders.parquet'""")
    con.execute(f"""COPY (SELECT i // 3 AS l_orderkey, i % 90 AS l_partkey, i * 3 % 7 AS l_suppkey, CAST(i % 3 + 1 AS INT) AS l_linenumber, CAST(1 + i % 40 AS DOUBLE) AS l_quantity, CAST(10.5 * (i % 31) AS DOUBLE) AS l_extendedprice,
      CAST((i % 9) / 100 AS DOUBLE) AS l_discount, 0.0::DOUBLE AS l_tax, CASE i % 3 WHEN 0 THEN 'R' ELSE 'N' END AS l_returnflag, CASE i % 2 WHEN 0 THEN 'F' ELSE 'O' END AS l_linestatus,
      TIMESTAMP '1994-11-01' + to_days(CAST(i AS INT)) AS l_shipdate FROM range(2600) t(i)) TO '{folder}/lineitem.parquet'""")


def test_features_of_every_day_of_seven_years_need_no_join_by_month(spark, tmp_path):
    panel_tables(tmp_path)
    for name in ("derived_features", "supplier_features", "modelling_frame", "enrichment_left", "forward_label"):
        con = duckdb.connect()
        for t in ("supplier", "orders", "lineitem"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet')")
        made, asked = entry.queries()[name](spark, str(tmp_path)), con.execute(entry.oracle_sql()[name])
        assert made.columns == [c[0] for c in asked.description]
        got, want = (sorted(repr(tuple(r)) for r in rows) for rows in (made.collect(), asked.fetchall()))
        assert got == want and got, name
    with session.settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        plan = entry.queries()["derived_features"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [supplier_id#" in plan and "SortMergeJoin [month#" not in plan


def test_models_store_only_what_they_read(spark, monkeypatch):
    import pytest

    from plumbline.operators import learning

    class Stored(Exception):
        pass

    def stop(df):
        raise Stored(sorted(df.columns))

    rows = spark.createDataFrame([(1, "fit", 0, 5.0, 1.0)], "supplier_id int, part string, label int, spend double, x double")
    monkeypatch.setattr(learning, "settle", stop)
    for run in (lambda: learning.mlp_compare(rows, 1), lambda: learning.bakeoff(rows)):
        with pytest.raises(Stored) as got:
            run()
        assert got.value.args[0] == ["label", "part", "x"]
