"""The canonical views again, as DuckDB common table expressions for the oracles."""

from __future__ import annotations

import re

VIEWS = {
    "suppliers": """
SELECT s_suppkey AS supplier_id, s_name AS supplier_name, ['A','B','C'][s_nationkey % 3 + 1] AS tier,
       s_acctbal >= 0 AS active,
       CAST(DATE '1995-01-01' + to_months(CAST(s_suppkey % 24 AS INT)) AS DATE) AS onboarded_at
FROM supplier""",
    "li": """
SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT),
                    strftime(l_shipdate, '%Y%m%d')) AS line_id
FROM lineitem""",
    "ncrs": """
SELECT line_id AS ncr_id, l_suppkey AS supplier_id,
       ['dimensional','cosmetic','material','functional'][l_linenumber % 4 + 1] AS category,
       1 + CAST(l_quantity AS INT) % 5 AS severity, l_partkey AS part_number, CAST(l_quantity AS INT) AS quantity,
       CAST(CASE WHEN l_discount <> 0 THEN round(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)), 2)
            END AS DECIMAL(18,2)) AS cost,
       l_shipdate AS discovered_at,
       CASE WHEN l_linestatus = 'F' THEN CAST(l_shipdate AS DATE) + CAST(l_partkey % 30 + 1 AS INT) END AS closed_at
FROM li WHERE l_returnflag = 'R'""",
    "inspections": """
SELECT line_id AS inspection_id, l_suppkey AS supplier_id, l_partkey AS part_number, l_shipdate AS inspected_at,
       l_returnflag <> 'R' AS passed FROM li""",
    "purchase_orders": """
SELECT line_id AS po_line_id, l_suppkey AS supplier_id, l_partkey AS part_number, CAST(l_quantity AS INT) AS quantity,
       CASE WHEN l_partkey % 97 <> 0 THEN CAST(l_shipdate AS DATE) + CAST(l_partkey % 11 - 5 AS INT) END AS promised_date
FROM li""",
    "goods_receipts": """
SELECT 'G-' || line_id AS goods_receipt_id, line_id AS po_line_id, l_suppkey AS supplier_id,
       l_shipdate AS received_at, CAST(l_quantity AS INT) AS quantity FROM li""",
    "audits": """
SELECT o_orderkey AS audit_id, o_custkey % (SELECT count(*) FROM supplier) AS supplier_id,
       CAST(o_orderdate AS DATE) AS audit_date,
       (4000 + CAST(round(o_totalprice * 100) AS BIGINT) % 6100) / 100 AS audit_score FROM orders""",
    "cars": """
SELECT o_orderkey AS car_id, o_custkey % (SELECT count(*) FROM supplier) AS supplier_id,
       o_orderpriority AS cause_code, 'reviewer-' || (o_orderkey % 7) AS reviewer, CAST(o_orderdate AS DATE) AS opened_at,
       CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + CAST(o_custkey % 200 + 1 AS INT) END AS closed_at
FROM orders WHERE o_orderstatus <> 'P'""",
    "bill_of_materials": """
SELECT p_partkey AS part_id, p_partkey // 3 AS parent_id, p_size AS quantity FROM part WHERE p_partkey > 0""",
    "audit_events": """
SELECT event_id, user_id AS trace_id, ts, event_type AS event, CAST(value AS DECIMAL(12,2)) AS amount, props AS record
FROM events""",
    "daily": """
SELECT user_id AS entity_id, CAST(ts AS DATE) AS day, count(*) AS units,
       sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) AS ok, sum(CAST(value AS DECIMAL(12,2))) AS amount,
       sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) / count(*) AS rate
FROM events GROUP BY ALL""",
    "chunks": """
SELECT doc_id AS id, doc_id // 4 AS document_id, doc_id % 2 AS document_revision,
       ['manual','car','audit','standard'][(length(source) + doc_id) % 4 + 1] AS source_type,
       (doc_id % 4) // 2 AS chunk_index, text AS content, lang,
       CASE WHEN doc_id % 11 = 0 THEN 'space-b' ELSE 'space-a' END AS embed_model,
       CASE WHEN doc_id % 7 = 0 THEN '{"visibility":"shared"}' WHEN doc_id % 7 = 1 THEN '{"owner":"unset"}'
            ELSE '{"visibility":"program","program":"P' || (doc_id % 3) || '"}' END AS metadata,
       DATE '2024-01-01' + CAST(doc_id % 5 * 30 AS INT) AS valid_from,
       CASE WHEN doc_id % 5 < 2 THEN DATE '2024-01-01' + CAST(doc_id % 5 * 30 AS INT) + 45 END AS valid_to,
       CASE WHEN doc_id % 10 <> 9 THEN doc_id // 10 * 10 END AS parent_id
FROM documents""",
    "recurrence_events": """
SELECT ncr_id, supplier_id,
       ['1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW'][part_number % 5 + 1] AS cause_code,
       CAST(discovered_at AS DATE) AS discovered_at, CAST(discovered_at AS DATE) + 30 AS adjudicated_at FROM ncrs""",
    "cycles": """
SELECT event_id AS serial, user_id AS machine_id, ts AS cycle_start,
       ts + to_hours(CAST(event_id % 5 + 2 AS INT)) AS inspection_completed_at,
       CAST(event_type = 'error' AS INT) AS failed, CAST(value AS DECIMAL(12,2)) AS value FROM events""",
    "gateway_events": """
SELECT * FROM (
  SELECT event_id // 4 AS trace_id, ts,
         CASE WHEN event_id % 4 = 0 THEN 'received' WHEN event_id % 4 = 1 AND value >= 100 THEN 'intent'
              WHEN event_id % 4 = 1 THEN 'blocked' WHEN event_id % 4 = 2 AND event_type = 'error' THEN 'failed'
              WHEN event_id % 4 = 2 AND event_type <> 'view' THEN 'completed' END AS event,
         list_filter([CASE WHEN cents % 3 = 0 THEN 'GW-PII' END, CASE WHEN cents % 5 = 0 THEN 'GW-MARK' END,
                      CASE WHEN cents % 7 = 0 THEN 'GW-INJECT' END], lambda c: c IS NOT NULL) AS codes, cents
  FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents FROM events)) WHERE event IS NOT NULL""",
    "classifications": """
SELECT 'D-' || ncr_id AS decision_id, ncr_id, ['fast','standard','frontier'][part_number % 3 + 1] AS model,
       CASE WHEN ok THEN CASE WHEN part_number % 10 = 0 THEN 'cosmetic' WHEN part_number % 101 = 0 THEN 'other' ELSE category END END AS category,
       CASE WHEN ok THEN sev END AS severity, CASE WHEN ok THEN supplier_id END AS supplier_id,
       CASE WHEN ok THEN ['use-as-is','rework','scrap','return-to-supplier'][quantity % 4 + 1] END AS suggested_disposition,
       owner AS car_owner_email, CASE WHEN ok THEN conf END AS confidence,
       CASE WHEN ok AND part_number % 103 <> 0 THEN 'seen on part ' || part_number END AS reasoning,
       CAST(discovered_at AS DATE) + 1 AS classified_at,
       CASE WHEN part_number % 19 = 0 OR (sev <= 3 AND conf >= 0.9 AND owner IS NOT NULL AND ok) THEN 'auto' ELSE 'review' END AS routed
FROM (SELECT *, part_number % 17 <> 0 AS ok, (70 + (quantity * 7 + part_number) % 31) / 100 AS conf,
             CASE WHEN part_number % 13 = 0 THEN 5 ELSE severity END AS sev,
             CASE WHEN part_number % 6 <> 0 THEN 'owner' || (supplier_id % 9) || '@example.com' END AS owner FROM ncrs)""",
    "reviews": """
SELECT 'R-' || ncr_id AS review_id, 'D-' || ncr_id AS decision_id, CAST(discovered_at AS DATE) + 3 AS reviewed_at
FROM ncrs WHERE part_number % 3 = 0""",
}


def register_view(name: str, sql: str) -> None:
    """Add a derived view that several oracles share."""
    if name in VIEWS:
        raise ValueError(f"view {name} exists")
    VIEWS[name] = sql


def _needed(sql: str, seen: list[str]) -> None:
    for name in VIEWS:
        if name not in seen and re.search(rf"\b(?:FROM|JOIN|,)\s+\(?\s*{name}\b", sql, re.IGNORECASE):
            _needed(VIEWS[name], seen)
            if name not in seen:
                seen.append(name)


def with_views(inner: str, select_list: str) -> str:
    """One statement: the needed views, the oracle body as ``answer``, the cast edge."""
    names: list[str] = []
    _needed(inner, names)
    ctes = [f"{n} AS ({VIEWS[n].strip()})" for n in names]
    ctes.append(f"answer AS ({inner})")
    return "WITH RECURSIVE " + ",\n".join(ctes) + f"\nSELECT {select_list} FROM answer"
