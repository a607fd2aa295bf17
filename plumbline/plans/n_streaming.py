"""Streaming jobs, replayed over the tables' own files."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import session
from plumbline.operators import panel
from plumbline.plans import scope
from plumbline.plans.a_sources import raw_intake
from plumbline.plans.m_triage import reports, reservations
from plumbline.registry import query
from plumbline.streaming import jobs, stateful
from plumbline.streaming.jobs import StreamViews

MAX_TS = "(SELECT max(ts) FROM events)"


def live(v) -> StreamViews:
    return StreamViews(v.spark, v.sf_dir)


@query("stream_tumbling_alarm", "model:i start:t mean:f n:i alarm:b", f"""
WITH w AS (SELECT user_id % 3 AS model, time_bucket(INTERVAL 1 HOUR, ts) AS start, avg(CAST(value AS DECIMAL(12,2)) / 499) AS mean, count(*) AS n FROM events GROUP BY 1, 2),
e AS (SELECT * FROM w WHERE start + INTERVAL 1 HOUR <= {MAX_TS} - INTERVAL 10 MINUTE)
SELECT *, mean < 0.7 AND coalesce(lag(mean) OVER o < 0.7 AND lag(start) OVER o = start - INTERVAL 1 HOUR, false) AND coalesce(lag(mean, 2) OVER o < 0.7 AND lag(start, 2) OVER o = start - INTERVAL 2 HOUR, false) AS alarm
FROM e WINDOW o AS (PARTITION BY model ORDER BY start)""")
def stream_tumbling_alarm(v):
    # The tables hold an event every few minutes, so the replay uses one-hour windows.
    stream = live(v).raw("events").select("ts", (F.col("user_id") % 3).alias("model"), (F.col("value").cast("decimal(12,2)").cast("double") / 499).alias("confidence"))
    means = jobs.run_available(jobs.tumbling_means(stream, "ts", ["model"], "confidence", "1 hour"), "means")
    return jobs.alarms(means, ["model"])


@query("stream_dedup_intake", "dedup_key:s", r"""
WITH r AS (SELECT event_id AS event_row, CASE WHEN user_id % 13 = 0 THEN '' ELSE 'user-' || user_id % 2 END AS principal,
   'NCR-' || year(ts) || '-' || CASE WHEN event_id % 10 = 0 THEN CAST(event_id % 1000 AS VARCHAR) ELSE lpad(CAST(event_id % 1000000 AS VARCHAR), 6, '0') END AS n,
   CASE WHEN event_id % 17 = 0 THEN 'e v ' ELSE 'evt:' END || (event_id // 2) AS e FROM events)
SELECT DISTINCT sha256(principal || ':' || e) AS dedup_key FROM r WHERE principal <> '' AND regexp_full_match(n, 'NCR-[0-9]{4}-[0-9]{4,}') AND regexp_full_match(e, '[A-Za-z0-9_.:-]{1,128}') AND event_row % 29 <> 0""")
def stream_dedup_intake(v):
    # Two principals only, so that repeated deliveries of one event really collide.
    raw = raw_intake(live(v).raw("events"))
    few = F.when(F.col("principal") != "", F.concat(F.lit("user-"), F.pmod(F.regexp_extract("principal", r"(\d+)", 1).try_cast("bigint"), F.lit(2)))).otherwise("")
    return jobs.run_available(jobs.dedup_intake(raw.withColumn("principal", few), "ts").select("dedup_key", "ts"), "intake")


@query("stream_intake_sides", "side:s event_row:i status:i", r"""
WITH r AS (SELECT event_id AS event_row, ts, CASE WHEN user_id % 13 = 0 THEN '' ELSE 'user-' || user_id % 2 END AS principal,
   'NCR-' || year(ts) || '-' || CASE WHEN event_id % 10 = 0 THEN CAST(event_id % 1000 AS VARCHAR) ELSE lpad(CAST(event_id % 1000000 AS VARCHAR), 6, '0') END AS n,
   CASE WHEN event_id % 17 = 0 THEN 'e v ' ELSE 'evt:' END || (event_id // 2) AS e FROM events),
j AS (SELECT *, CASE WHEN principal = '' THEN 401 WHEN regexp_full_match(n, 'NCR-[0-9]{4}-[0-9]{4,}') AND regexp_full_match(e, '[A-Za-z0-9_.:-]{1,128}') AND event_row % 29 <> 0 THEN 202 ELSE 400 END AS status FROM r)
SELECT 'quarantine' AS side, event_row, status FROM j WHERE status <> 202
UNION ALL SELECT 'accepted', arg_min(event_row, ts), 202 FROM j WHERE status = 202 GROUP BY principal, e""")
def stream_intake_sides(v):
    raw = raw_intake(live(v).raw("events"))
    few = F.when(F.col("principal") != "", F.concat(F.lit("user-"), F.pmod(F.regexp_extract("principal", r"(\d+)", 1).try_cast("bigint"), F.lit(2)))).otherwise("")
    return jobs.intake_sides(raw.withColumn("principal", few), "ts", "intake-sides", tie=["event_row"])


@query("stream_rolling_yield", "user_id:i until:t n:i yield_share:f", f"""
WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, sum(CAST(event_type <> 'error' AS INT)) AS ok FROM events GROUP BY ALL),
e AS (SELECT user_id, unnest(generate_series(day + 1, day + 30, INTERVAL 1 DAY)) AS until, n, ok FROM d)
SELECT user_id, until, sum(n) AS n, sum(ok) / sum(n) AS yield_share FROM e WHERE until <= {MAX_TS} - INTERVAL 1 DAY GROUP BY ALL""")
def stream_rolling_yield(v):
    events = live(v).raw("events").select("ts", "user_id", "event_type")
    return jobs.run_available(jobs.rolling_yield(events, "ts", "user_id", F.col("event_type") != "error"), "yield")


@query("stream_label_maturity", "supplier_id:i cutoff:d sev3_next_90d:i harm_next_90d:i", """
WITH c AS (SELECT supplier_id, severity, discovered_at, CAST(date_trunc('month', discovered_at) - to_months(unnest([0, 1, 2, 3])) AS DATE) AS cutoff FROM ncrs),
h AS (SELECT supplier_id, cutoff, max(CAST(severity >= 3 AS INT)) AS severe, sum(severity) AS harm FROM c WHERE discovered_at < cutoff + 90 GROUP BY ALL)
SELECT sp.supplier_id, sp.month_end AS cutoff, coalesce(severe, 0) AS sev3_next_90d, coalesce(harm, 0) AS harm_next_90d
FROM spine sp LEFT JOIN h ON h.supplier_id = sp.supplier_id AND h.cutoff = sp.month_end WHERE sp.month_end + 90 <= (SELECT max(discovered_at) FROM ncrs) - INTERVAL 1 DAY""")
def stream_label_maturity(v):
    ncrs = live(v).ncrs.select("supplier_id", "severity", "discovered_at")
    grid = panel.spine(v.suppliers, scope.START, scope.END).select("supplier_id", F.col("month_end").alias("cutoff"))
    return jobs.run_available(stateful.mature_labels(ncrs, grid), "labels", conf=stateful.SETTINGS)


@query("stream_budget", "period:d trace_id:s kind:s answer:s committed:f", """
WITH RECURSIVE asked AS (SELECT period, trace_id, asked_at, status, CAST(CAST(quoted AS DECIMAL(38,8)) * 100000000 AS BIGINT) AS quote, CAST(CAST(actual AS DECIMAL(38,8)) * 100000000 AS BIGINT) AS paid FROM reservations),
sent AS (
  SELECT period, trace_id, asked_at AS sent_at, 0 AS turn, 'reserve' AS kind, quote, quote AS amount FROM asked
  UNION ALL SELECT period, trace_id, asked_at + INTERVAL 1 DAY, 1, CASE status WHEN 'settled' THEN 'settle' ELSE 'uncertain' END, quote, paid FROM asked WHERE status <> 'reserved'),
m AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY sent_at, turn, trace_id) AS i FROM sent),
fold AS (
  SELECT period, 0::BIGINT AS i, '' AS trace_id, '' AS kind, '' AS answer, 0::BIGINT AS used, []::VARCHAR[] AS held FROM (SELECT DISTINCT period FROM m)
  UNION ALL
  SELECT m.period, m.i, m.trace_id, m.kind,
    CASE WHEN m.kind = 'reserve' THEN CASE WHEN used + amount > 500000000000 THEN 'refused' WHEN used + amount >= 400000000000 THEN 'soft' ELSE 'ok' END
      WHEN NOT list_contains(held, m.trace_id) THEN 'unmatched' WHEN m.kind = 'settle' THEN 'settled' ELSE 'uncertain' END,
    used + CASE WHEN m.kind = 'reserve' AND used + amount <= 500000000000 THEN amount WHEN m.kind = 'settle' AND list_contains(held, m.trace_id) THEN amount - quote ELSE 0 END,
    CASE WHEN m.kind = 'reserve' AND used + amount <= 500000000000 THEN list_append(held, m.trace_id) WHEN m.kind = 'settle' THEN list_filter(held, lambda x: x <> m.trace_id) ELSE held END
  FROM fold JOIN m ON m.period = fold.period AND m.i = fold.i + 1)
SELECT period, trace_id, kind, answer, used / 100000000 AS committed FROM fold WHERE i > 0
UNION ALL SELECT period, '', 'close', 'closed', arg_max(used, i) / 100000000 FROM fold GROUP BY period
  HAVING period + INTERVAL 1 MONTH + INTERVAL 3 DAY <= (SELECT max(sent_at) FROM sent) - INTERVAL 1 DAY""")
def stream_budget(v):
    # Every reservation is one message; a day later some are settled and some turn out uncertain.
    asked = reservations(live(v))
    units = lambda c: (F.col(c) * 100_000_000).cast("bigint")
    told = F.struct(F.lit(1).alias("turn"), (F.col("asked_at") + F.expr("INTERVAL 1 DAY")).alias("sent_at"), F.when(F.col("status") == "settled", "settle").otherwise("uncertain").alias("kind"), F.coalesce(units("actual"), F.lit(0)).alias("amount"))
    first = F.struct(F.lit(0).alias("turn"), F.col("asked_at").alias("sent_at"), F.lit("reserve").alias("kind"), units("quoted").alias("amount"))
    both = F.when(F.col("status") == "reserved", F.array(first)).otherwise(F.array(first, told))
    messages = asked.select("period", "trace_id", F.explode(both).alias("m")).select("period", "trace_id", "m.*")
    return jobs.run_available(stateful.budget_decisions(messages, 5000), "budget", conf=stateful.SETTINGS)


@query("stream_recurrence", "car_id:i ncr_id:s supplier_id:i", """
SELECT c.car_id, r.ncr_id, c.supplier_id FROM cars c JOIN recurrence_events r ON r.supplier_id = c.supplier_id AND r.cause_code = c.cause_code
WHERE r.discovered_at > c.closed_at AND r.discovered_at <= CAST(c.closed_at + INTERVAL 6 MONTH AS DATE)""")
def stream_recurrence(v):
    s = live(v)
    # The number of suppliers is a constant of the replay: a stream cannot be counted.
    n = v.raw("supplier").count()
    orders = s.raw("orders").where("o_orderstatus = 'F'")
    closures = orders.select(
        F.col("o_orderkey").alias("car_id"), (F.col("o_custkey") % n).alias("supplier_id"), F.col("o_orderpriority").alias("cause_code"),
        F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_custkey") % 200 + 1).cast("int")).alias("closed_at"),
    )
    return jobs.run_available(jobs.recurrence(closures, s.recurrence_events, ["supplier_id", "cause_code"]), "recurrence")


@query("stream_sessions", "trace_id:i start:t n:i pending:b", f"""
WITH g AS (SELECT trace_id, ts, event, CASE WHEN ts < lag(ts) OVER (PARTITION BY trace_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM gateway_events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY trace_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT trace_id, min(ts) AS start, count(*) AS n, max(CAST(event = 'intent' AS INT)) = 1 AND max(CAST(event IN ('completed','failed') AS INT)) = 0 AS pending FROM s
GROUP BY trace_id, sid HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM gateway_events) - INTERVAL 1 HOUR""")
def stream_sessions(v):
    return jobs.run_available(jobs.sessions(live(v).gateway_events, "ts", "trace_id"), "sessions")


@query("stream_anomaly", "entity_id:i day_no:i z:f flat:b", """
SELECT entity_id, day - DATE '1970-01-01' AS day_no, z, coalesce(flat, false) AS flat FROM zscores WHERE day + 1 <= (SELECT max(day) FROM daily) - 3""")
def stream_anomaly(v):
    folder = session.shared_dir(v.spark, "days")
    days = v.daily.select("entity_id", F.col("day").cast("timestamp").alias("day"), "rate")
    days.write.parquet(folder)
    stream = v.spark.readStream.schema(days.schema).parquet(folder)
    return jobs.run_available(stateful.daily_anomalies(stream), "anomalies", conf=stateful.SETTINGS)


@query("stream_rules", "ncr_id:s rule_severity:i rule_category:s rules:s kinds:s", """
SELECT ncr_id, rule_severity, rule_category, array_to_string(rules, ',') AS rules, '' AS kinds FROM ruled""")
def stream_rules(v):
    folder = jobs.run_batches(jobs.rule_decisions(reports(live(v))), "rules", jobs.append_batch)
    return v.spark.read.parquet(folder)
