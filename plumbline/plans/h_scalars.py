"""Scalar function families, one query each over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import arrays, text
from plumbline.operators import vectors
from plumbline.registry import query


@query("scalar_date", "car_id:i month:d next_month:d plus_90:d plus_6m:d days_open:i ordinal:i months_touched:i utc_hour:i", """
SELECT car_id, CAST(date_trunc('month', opened_at) AS DATE) AS month, CAST(date_trunc('month', opened_at) + INTERVAL 1 MONTH AS DATE) AS next_month,
  opened_at + 90 AS plus_90, CAST(opened_at + INTERVAL 6 MONTH AS DATE) AS plus_6m, closed_at - opened_at AS days_open,
  year(opened_at) * 12 + month(opened_at) AS ordinal,
  len(generate_series(date_trunc('month', opened_at), date_trunc('month', coalesce(closed_at, opened_at)), INTERVAL 1 MONTH)) AS months_touched,
  hour(CAST(opened_at AS TIMESTAMP) + INTERVAL 5 HOUR) AS utc_hour FROM cars""")
def scalar_date(v):
    o = F.col("opened_at")
    return v.cars.select(
        "car_id",
        F.trunc(o, "MM").alias("month"),
        F.add_months(F.trunc(o, "MM"), 1).alias("next_month"),
        F.date_add(o, 90).alias("plus_90"),
        F.add_months(o, 6).alias("plus_6m"),
        F.datediff("closed_at", o).alias("days_open"),
        (F.year(o) * 12 + F.month(o)).alias("ordinal"),
        F.size(F.sequence(F.trunc(o, "MM"), F.trunc(F.coalesce("closed_at", o), "MM"), F.expr("interval 1 month"))).alias("months_touched"),
        F.hour(F.to_utc_timestamp(o.cast("timestamp"), "-05:00")).alias("utc_hour"),
    )


@query("scalar_math", "ncr_id:s rounded:f biggest:f ratio:f distance:f log_cost:f log2_q:f root:f p:f clipped:f floor0:f money:f", """
SELECT ncr_id, round(CAST(cost AS DOUBLE), 1) AS rounded, greatest(coalesce(cost, 0), quantity) AS biggest, cost / nullif(quantity % 5, 0) AS ratio,
  abs(severity - 3) AS distance, ln(nullif(cost, 0)) AS log_cost, log2(quantity) AS log2_q, sqrt(quantity) AS root,
  1 / (1 + exp(-(0.8 * (severity - 3) - 0.5))) AS p, least(greatest(quantity, 10), 40) AS clipped, greatest(0, quantity - 25) AS floor0,
  ceil(quantity * CAST(100000000 AS BIGINT) / 3) / 100000000 AS money FROM ncrs""")
def scalar_math(v):
    q, s, cost = F.col("quantity"), F.col("severity"), F.col("cost")
    third = (q.cast("decimal(18,0)") / F.lit("3").cast("decimal(1,0)")).cast("decimal(28,14)")
    return v.ncrs.select(
        "ncr_id",
        F.round(cost.cast("double"), 1).alias("rounded"),
        F.greatest(F.coalesce(cost.cast("double"), F.lit(0.0)), q.cast("double")).alias("biggest"),
        (cost.cast("double") / F.nullif(q % 5, F.lit(0))).alias("ratio"),
        F.abs(s - 3).alias("distance"),
        F.log(F.nullif(cost.cast("double"), F.lit(0.0))).alias("log_cost"),
        F.log2(q.cast("double")).alias("log2_q"),
        F.sqrt(q.cast("double")).alias("root"),
        (1 / (1 + F.exp(-(0.8 * (s - 3) - 0.5)))).alias("p"),
        F.least(F.greatest(q, F.lit(10)), F.lit(40)).alias("clipped"),
        F.greatest(F.lit(0), q - 25).alias("floor0"),
        F.ceil(third, F.lit(8)).alias("money"),
    )


@query("scalar_string", "page_id:i folded:s family:s is_secure:b at:i has_ref:b squeezed_len:i digest:s bytes:i", r"""
SELECT page_id, lower(trim(url)) AS folded, split_part(url, '/', 3) AS family, url LIKE 'https:%' AS is_secure, position('example' IN lower(url)) AS at,
  contains(url, 'ref=') AS has_ref, length(trim(regexp_replace(html, '\s+', ' ', 'g'))) AS squeezed_len, sha256(url) AS digest, strlen(html) AS bytes FROM pages""")
def scalar_string(v):
    url = F.col("url")
    return v.raw("pages").select(
        "page_id",
        F.lower(F.trim(url)).alias("folded"),
        F.split(url, "/")[2].alias("family"),
        url.like("https:%").alias("is_secure"),
        F.locate("example", F.lower(url)).alias("at"),
        url.contains("ref=").alias("has_ref"),
        F.length(text.squeeze("html")).alias("squeezed_len"),
        F.sha2(url, 256).alias("digest"),
        F.octet_length("html").alias("bytes"),
    )


@query("scalar_regex", "doc_id:i has_number:b tokens:i shouted:i starts_upper:b sentences:i", r"""
SELECT doc_id, regexp_matches(text, '[0-9]{3}') AS has_number, len(regexp_extract_all(lower(text), '[a-z0-9]+(?:[.-][a-z0-9]+)*')) AS tokens,
  length(regexp_replace(text, '[^!]', '', 'g')) AS shouted, regexp_full_match(substr(text, 1, 1), '[A-Z]') AS starts_upper,
  len(regexp_extract_all(text, '[.!?][ \t\n\r\f\x0B]+[A-Z]')) + 1 AS sentences FROM documents""")
def scalar_regex(v):
    t = F.col("text")
    return v.raw("documents").select(
        "doc_id",
        t.rlike("[0-9]{3}").alias("has_number"),
        F.size(text.tokens(t)).alias("tokens"),
        F.length(F.regexp_replace(t, "[^!]", "")).alias("shouted"),
        F.substring(t, 1, 1).rlike(r"\A[A-Z]\z").alias("starts_upper"),
        F.size(F.split(t, text.SENTENCE_END)).alias("sentences"),
    )


@query("scalar_array", "vec_id:i self_dot:f norm:f mean:f positives:i head_sum:f padded:i centred_sum:f", """
WITH c AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)
SELECT vec_id, sum(x * x) AS self_dot, sqrt(sum(x * x)) AS norm, avg(x) AS mean, count(*) FILTER (WHERE x > 0) AS positives,
  sum(x) FILTER (WHERE pos <= 16) AS head_sum, greatest(count(*), 512) AS padded, 0.0 AS centred_sum FROM c GROUP BY vec_id""")
def scalar_array(v):
    e = F.col("embedding")
    return v.raw("embeddings").select(
        "vec_id",
        vectors.dot(e, e).alias("self_dot"),
        vectors.norm(e).alias("norm"),
        arrays.mean(e).alias("mean"),
        F.size(arrays.masked(e, 0.0)).alias("positives"),
        arrays.total(F.slice(e, 1, 16)).alias("head_sum"),
        F.size(arrays.pad(e, 512)).alias("padded"),
        arrays.total(arrays.centre(e)).alias("centred_sum"),
    )


@query("scalar_json", "event_id:i k:i canonical:s digest:s second:i", """
SELECT event_id, CAST(props->>'$.k' AS INT) AS k, '{"event":"' || event_type || '","k":' || (props->>'$.k') || '}' AS canonical,
  sha256('{"event":"' || event_type || '","k":' || (props->>'$.k') || '}') AS digest, CAST(('[1,' || (props->>'$.k') || ',3]')::JSON->>1 AS INT) AS second FROM events""")
def scalar_json(v):
    k = F.get_json_object("props", "$.k").cast("int")
    # Struct fields in key order give one canonical text per content.
    canonical = F.to_json(F.struct(F.col("event_type").alias("event"), k.alias("k")))
    listed = F.from_json(F.concat(F.lit("[1,"), k, F.lit(",3]")), "array<int>")
    return v.raw("events").select(
        "event_id", k.alias("k"), canonical.alias("canonical"), F.sha2(canonical, 256).alias("digest"), listed[1].alias("second")
    )


@query("edit_fraction", "conv_id:i turn:i edit_fraction:f", r"""
WITH t AS (SELECT conv_id, turn, trim(regexp_replace(translate(text, 'éèÍÄñÊßÉçíÇÈÑüöÖóÓäÜê', '0123456789!#$%&*+/<=>'), '\s+', ' ', 'g')) AS s FROM conversations)
SELECT a.conv_id, a.turn, CASE WHEN greatest(length(a.s), length(b.s)) = 0 THEN 0 ELSE levenshtein(a.s, b.s) / greatest(length(a.s), length(b.s)) END AS edit_fraction
FROM t a JOIN t b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""")
def edit_fraction(v):
    # The oracle's distance counts bytes: it writes each accented letter as one otherwise unused character.
    turns = v.raw("conversations")
    later = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text"))
    return turns.join(later, ["conv_id", "turn"]).withColumn("edit_fraction", text.edit_fraction("text", "next_text"))
