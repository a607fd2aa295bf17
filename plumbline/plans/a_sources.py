"""Sources, sinks and contracts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from plumbline import session
from plumbline.operators import contracts, panel
from plumbline.registry import query
from plumbline.sources import sinks

YEAR_SQL = "SELECT l_suppkey AS supplier_id, year(l_shipdate) AS ship_year, count(*) AS n FROM lineitem GROUP BY ALL"
YEAR_COLS = "supplier_id:i ship_year:i n:i"


def by_year(df, key="l_suppkey", at="l_shipdate"):
    return df.groupBy(F.col(key).alias("supplier_id"), F.year(at).alias("ship_year")).agg(F.count("*").alias("n"))


@query("scan_parquet", YEAR_COLS, YEAR_SQL)
def scan_parquet(v):
    return by_year(v.raw("lineitem"))


@query("scan_csv", YEAR_COLS, YEAR_SQL)
def scan_csv(v):
    path = session.shared_dir(v.spark, "lineitem-csv")
    rows = v.raw("lineitem").select("l_suppkey", F.date_format("l_shipdate", "dd/MM/yyyy").alias("l_shipdate"))
    sinks.write_no_clobber(rows, path, "csv", header=True)
    back = sinks.read_csv(v.spark, path, "l_suppkey BIGINT, l_shipdate STRING", ["l_shipdate"], "dd/MM/yyyy")
    return by_year(back)


@query("scan_jsonl", "role:s n:i chars:i", "SELECT role, count(*) AS n, sum(length(text)) AS chars FROM conversations GROUP BY role")
def scan_jsonl(v):
    path = session.shared_dir(v.spark, "conversations-json")
    sinks.write_no_clobber(v.raw("conversations"), path, "json")
    back = sinks.read_jsonl(v.spark, path, "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    return back.groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


MANIFEST = (
    {"table": "suppliers", "source": "suppliers", "columns": ["supplier_id", "supplier_name", "tier", "active", "onboarded_at"]},
    {"table": "ncrs", "source": "ncrs", "columns": ["ncr_id", "supplier_id", "category", "severity", "discovered_at"]},
    {"table": "audits", "source": "audits", "columns": ["audit_id", "supplier_id", "audit_date", "audit_score"]},
    {"table": "cars", "source": "cars", "columns": ["car_id", "supplier_id", "opened_at", "closed_at"]},
    {"table": "goods_receipts", "source": "goods_receipts", "columns": ["goods_receipt_id", "po_line_id", "supplier_id", "received_at"]},
    {"table": "bill_of_materials", "source": "bill_of_materials", "columns": ["part_id", "parent_id", "quantity"]},
)


@query("jdbc_extract", "table:s rows:i", " UNION ALL ".join(
    f"SELECT '{m['table']}' AS \"table\", count(*) AS rows FROM {m['source']}" for m in MANIFEST))
def jdbc_extract(v):
    # The manifest copy itself; the JDBC reader is one of its sources (see the tests).
    return sinks.extract(MANIFEST, lambda entry: getattr(v, entry["source"]), session.shared_dir(v.spark, "extract"))


@query("column_contract", "column_name:s", """
SELECT unnest(['audit_id', 'supplier_id', 'audit_date', 'audit_score']) AS column_name FROM (SELECT count(*) AS n FROM audits) WHERE n > 0""")
def column_contract(v):
    upper = v.audits.toDF(*[c.upper() for c in v.audits.columns])
    checked = contracts.require_columns(upper, ["audit_id", "supplier_id", "audit_date"])
    present = checked.agg(F.count("*").alias("n")).where("n > 0")
    return present.select(F.explode(F.array(*[F.lit(c) for c in checked.columns])).alias("column_name"))


@query("param_query", "supplier_id:i ncr_count:i total_cost:f", """
SELECT supplier_id, count(*) AS ncr_count, sum(cost) AS total_cost FROM ncrs WHERE discovered_at >= DATE '1998-01-01' AND severity >= 3 GROUP BY supplier_id""")
def param_query(v):
    return v.sql(
        "SELECT supplier_id, count(*) AS ncr_count, sum(cost) AS total_cost FROM {ncrs} "
        "WHERE discovered_at >= :since AND severity >= :floor GROUP BY supplier_id",
        args={"since": dt.datetime(1998, 1, 1), "floor": 3},
    )


@query("param_view", "supplier_name:s fiscal_year:i category:s defect_count:i", """
SELECT s.supplier_name, year(n.discovered_at) AS fiscal_year, n.category, count(*) AS defect_count FROM ncrs n JOIN suppliers s USING (supplier_id)
WHERE year(n.discovered_at) = 1999 AND n.category = 'material' AND s.supplier_name LIKE 'Supplier#00000%' GROUP BY ALL""")
def param_view(v):
    return defect_metrics(v, 1999, "material").where(F.col("supplier_name").like("Supplier#00000%"))


def defect_metrics(v, fiscal_year: int, category: str):
    """A view with input parameters: a function that returns a frame, filtered further by its caller."""
    first = F.lit(f"{int(fiscal_year)}-01-01").cast("timestamp_ntz")
    last = F.lit(f"{int(fiscal_year) + 1}-01-01").cast("timestamp_ntz")
    year = v.ncrs.where((F.col("discovered_at") >= first) & (F.col("discovered_at") < last) & (F.col("category") == category))
    counts = year.groupBy("supplier_id", "category").agg(F.count("*").alias("defect_count"))
    return counts.join(v.suppliers, "supplier_id").withColumn("fiscal_year", F.lit(fiscal_year))


@query("write_no_clobber", "attempt:s rows:i", """
SELECT 'first' AS attempt, count(*) AS rows FROM audits UNION ALL SELECT 'second refused', count(*) FROM audits""")
def write_no_clobber(v):
    path = session.shared_dir(v.spark, "audits")
    sinks.write_no_clobber(v.audits, path)
    outcome = "second accepted"
    try:
        sinks.write_no_clobber(v.audits, path)
    except Exception as exc:
        if "PATH_ALREADY_EXISTS" not in str(exc):
            raise
        outcome = "second refused"
    n = v.spark.read.parquet(path).agg(F.count("*").alias("rows"))
    return n.select(F.lit("first").alias("attempt"), "rows").unionByName(n.select(F.lit(outcome).alias("attempt"), "rows"))


@query("refresh_panel", "supplier_id:i month:d units:i fpy:f", """
SELECT supplier_id, CAST(date_trunc('month', inspected_at) AS DATE) AS month,
  CASE WHEN year(inspected_at) >= 2000 THEN sum(CAST(passed AS INT)) ELSE count(*) END AS units, avg(CAST(passed AS INT)) AS fpy
FROM inspections GROUP BY supplier_id, 2, year(inspected_at)""")
def refresh_panel(v):
    path = session.shared_dir(v.spark, "panel")
    monthly = panel.monthly_yield(v.inspections)
    sinks.refresh_panel(monthly, path, ["supplier_id", "month"], "month")
    # A second refresh replaces the months it brings and keeps the older ones.
    recent = monthly.where(F.col("month") >= F.lit("2000-01-01").cast("date"))
    passed = recent.withColumn("units", F.round(F.col("units") * F.col("fpy")).cast("bigint"))
    return sinks.refresh_panel(passed, path, ["supplier_id", "month"], "month")


@query("constraint_audit", "row_id:s rule:s", """
WITH c AS (SELECT decision_id AS row_id, unnest([
   CASE WHEN NOT ((category IS NULL AND severity IS NULL AND supplier_id IS NULL AND confidence IS NULL AND reasoning IS NULL AND suggested_disposition IS NULL)
     OR (category IS NOT NULL AND severity IS NOT NULL AND supplier_id IS NOT NULL AND confidence IS NOT NULL AND reasoning IS NOT NULL AND suggested_disposition IS NOT NULL)) THEN 'complete_result' END,
   CASE WHEN category NOT IN ('cosmetic','dimensional','material','functional') THEN 'category_enum' END,
   CASE WHEN severity NOT BETWEEN 1 AND 5 THEN 'severity_range' END, CASE WHEN confidence NOT BETWEEN 0 AND 1 THEN 'confidence_range' END,
   CASE WHEN suggested_disposition NOT IN ('use-as-is','rework','scrap','return-to-supplier') THEN 'disposition_enum' END,
   CASE WHEN routed NOT IN ('auto','review') THEN 'routed_enum' END,
   CASE WHEN NOT (routed <> 'auto' OR (category IS NOT NULL AND severity <= 3 AND confidence >= 0.9 AND car_owner_email IS NOT NULL)) THEN 'auto_has_result' END]) AS rule FROM classifications),
k AS (SELECT CAST(id AS VARCHAR) AS row_id, unnest([CASE WHEN valid_to <= valid_from THEN 'interval_order' END,
   CASE WHEN metadata->>'$.visibility' IS NULL THEN 'visibility' END, CASE WHEN chunk_index < 0 THEN 'chunk_index' END]) AS rule FROM chunks)
SELECT * FROM c WHERE rule IS NOT NULL UNION ALL SELECT * FROM k WHERE rule IS NOT NULL""")
def constraint_audit(v):
    decisions = contracts.violations(v.classifications, "decision_id", contracts.classification_constraints())
    chunks = contracts.violations(v.chunks, "id", contracts.chunk_constraints())
    return decisions.select(F.col("decision_id").alias("row_id"), "rule").unionByName(
        chunks.select(F.col("id").cast("string").alias("row_id"), "rule")
    )


@query("validate_rows", "line_id:s verdict:s", r"""
WITH r AS (SELECT line_id, 'NCR-' || year(l_shipdate) || '-' || CASE WHEN l_orderkey % 9 = 0 THEN CAST(l_orderkey % 900 AS VARCHAR) ELSE lpad(CAST(l_orderkey % 10000 AS VARCHAR), 4, '0') END
    || CASE WHEN l_partkey % 31 = 0 THEN chr(10) ELSE '' END AS ncr_id, CASE WHEN l_suppkey % 7 = 0 THEN 'X-' ELSE 'S-' END || lpad(CAST(l_suppkey % 10000 AS VARCHAR), 4, '0') AS supplier_id,
    CASE WHEN l_linenumber = 7 THEN '' ELSE 'line ' || l_linenumber END AS d, CAST(l_quantity AS INT) - 2 AS q FROM li)
SELECT line_id, array_to_string(list_filter([CASE WHEN NOT regexp_full_match(ncr_id, 'NCR-[0-9]{4}-[0-9]{4,6}') THEN 'ncr_id' END,
  CASE WHEN NOT regexp_full_match(supplier_id, 'S-[0-9]{4}') THEN 'supplier_id' END, CASE WHEN length(d) = 0 THEN 'defect_description' END,
  CASE WHEN NOT q > 0 THEN 'quantity' END], lambda x: x IS NOT NULL), ',') AS verdict FROM r""")
def validate_rows(v):
    raw = v.li.select(
        "line_id",
        F.concat(
            F.lit("NCR-"),
            F.year("l_shipdate"),
            F.lit("-"),
            F.when(F.col("l_orderkey") % 9 == 0, (F.col("l_orderkey") % 900).cast("string")).otherwise(
                F.lpad((F.col("l_orderkey") % 10000).cast("string"), 4, "0")
            ),
            F.when(F.col("l_partkey") % 31 == 0, "\n").otherwise(""),
        ).alias("ncr_id"),
        F.concat(F.when(F.col("l_suppkey") % 7 == 0, "X-").otherwise("S-"), F.lpad((F.col("l_suppkey") % 10000).cast("string"), 4, "0")).alias("supplier_id"),
        F.when(F.col("l_linenumber") == 7, "").otherwise(F.concat(F.lit("line "), "l_linenumber")).alias("defect_description"),
        (F.col("l_quantity").cast("int") - 2).alias("quantity"),
        F.col("l_shipdate").alias("discovered_at"),
    )
    good, bad = contracts.split_valid(raw, contracts.incident_rules())
    return good.select("line_id", F.lit("").alias("verdict")).unionByName(
        bad.select("line_id", F.array_join("reasons", ",").alias("verdict"))
    )


@query("intake_validate", "event_row:i status:i ncr_id:s dedup_key:s", r"""
WITH r AS (SELECT event_id AS event_row, CASE WHEN user_id % 13 = 0 THEN '' ELSE 'user-' || user_id END AS principal,
   'NCR-' || year(ts) || '-' || CASE WHEN event_id % 10 = 0 THEN CAST(event_id % 1000 AS VARCHAR) ELSE lpad(CAST(event_id % 1000000 AS VARCHAR), 6, '0') END AS n,
   CASE WHEN event_id % 17 = 0 THEN 'e v ' ELSE 'evt:' END || (event_id // 2) AS e FROM events),
s AS (SELECT *, CASE WHEN principal = '' THEN 401 WHEN regexp_full_match(n, 'NCR-[0-9]{4}-[0-9]{4,}') AND regexp_full_match(e, '[A-Za-z0-9_.:-]{1,128}') AND event_row % 29 <> 0 THEN 202 ELSE 400 END AS status FROM r)
SELECT event_row, status, CASE WHEN status = 202 THEN n END AS ncr_id, CASE WHEN status = 202 THEN sha256(principal || ':' || e) END AS dedup_key FROM s""")
def intake_validate(v):
    return contracts.intake(raw_intake(v.raw("events")))


def raw_intake(events):
    """Raw intake messages: some unauthenticated, some with bad ids, some not JSON at all."""
    number = F.when(F.col("event_id") % 10 == 0, (F.col("event_id") % 1000).cast("string")).otherwise(
        F.lpad((F.col("event_id") % 1000000).cast("string"), 6, "0")
    )
    event = F.concat(F.when(F.col("event_id") % 17 == 0, "e v ").otherwise("evt:"), F.floor(F.col("event_id") / 2))
    body = F.to_json(F.struct(F.concat(F.lit("NCR-"), F.year("ts"), F.lit("-"), number).alias("ncr_id"), event.alias("event_id")))
    return events.select(
        F.col("event_id").alias("event_row"),
        "ts",
        F.when(F.col("user_id") % 13 == 0, "").otherwise(F.concat(F.lit("user-"), "user_id")).alias("principal"),
        F.when(F.col("event_id") % 29 == 0, F.lit("not json")).otherwise(body).alias("body"),
    )


@query("append_decisions", "day:d attempts:i rejected:i", """
SELECT classified_at AS day, count(*) * 2 AS attempts, sum(CAST(category IS NULL AS INT)) * 2 AS rejected FROM classifications GROUP BY 1""")
def append_decisions(v):
    path = session.shared_dir(v.spark, "decisions")
    rows = v.classifications.select("decision_id", "ncr_id", "model", "category", "severity", "routed", "classified_at")
    for _ in range(2):
        sinks.append_decisions(rows.withColumn("month", F.trunc("classified_at", "MM")), path, "month")
    return v.spark.read.parquet(path).groupBy(F.col("classified_at").alias("day")).agg(
        F.count("*").alias("attempts"), F.sum(F.col("category").isNull().cast("int")).alias("rejected")
    )


@query("dataset_fingerprint", "column_name:s rows:i present:i digest:s", """
WITH cells AS (
  SELECT unnest(['ncr_id', 'supplier_id', 'cost', 'closed_at']) AS column_name,
    unnest([coalesce('v' || ncr_id, 'n'), coalesce('v' || supplier_id, 'n'), coalesce('v' || cost, 'n'), coalesce('v' || closed_at, 'n')]) AS cell FROM ncrs
  UNION ALL SELECT '*', array_to_string(list_transform(
    [coalesce('v' || ncr_id, 'n'), coalesce('v' || supplier_id, 'n'), coalesce('v' || cost, 'n'), coalesce('v' || closed_at, 'n')], lambda x: length(x) || ':' || x), '|') FROM ncrs),
h AS (SELECT column_name, cell, md5(CASE WHEN column_name = '*' THEN cell ELSE column_name || '=' || cell END) AS m FROM cells)
SELECT column_name, count(*) AS rows, count(*) FILTER (WHERE cell <> 'n') AS present,
  CAST(sum(CAST('0x' || m[1:15] AS BIGINT)) % 2305843009213693951 AS VARCHAR) || '-' || CAST(sum(CAST('0x' || m[16:30] AS BIGINT)) % 2305843009213693951 AS VARCHAR) AS digest
FROM h GROUP BY column_name""")
def dataset_fingerprint(v):
    rows = v.ncrs.select("ncr_id", "supplier_id", "cost", "closed_at", (F.col("part_number") % 10 == 0).alias("late"))
    # The manifest of all rows comes from that of the older ones and the appended tenth; the whole table must agree.
    old, new = (rows.where(c).drop("late") for c in ("not late", "late"))
    whole = session.written(contracts.combined(contracts.fingerprint(old), contracts.fingerprint(new)), "manifest")
    contracts.verify_fingerprint(rows.drop("late"), whole)
    return whole.select("column_name", "rows", "present", F.concat_ws("-", "digest_a", "digest_b").alias("digest"))
