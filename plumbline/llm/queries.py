"""The registered queries ``op<N>_<name>`` with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import common


def op1_byte_rnn_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm import langid

    docs = common.documents(spark, sf_dir)
    held_out = common.in_fold("doc_id", 3, 1)
    model = langid.train(docs, usable=~held_out)
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_line_field_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline import session
    from plumbline.llm import quality
    from plumbline.sources import tables

    docs = common.documents(spark, sf_dir)
    labels = tables.scan(session.configure(spark), sf_dir, "labels")
    return quality.judge(docs, quality.train(docs, labels))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.exact_dedup import exact_dedup

    return exact_dedup(common.documents(spark, sf_dir))


EXACT_DEDUP_SQL = r"""
WITH k AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
    first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY len DESC, doc_id) AS keep_id
  FROM k)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


def op4_redirect_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline import session
    from plumbline.llm.urls import judge
    from plumbline.sources import tables

    pages = tables.scan(session.configure(spark), sf_dir, "pages")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


# The given pages name no canonical links or refreshes, so a group is the pages of one canonical form.
URL_FILTER_SQL = r"""
WITH p AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(verdict, h, q) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
f AS (
  SELECT page_id, url, arg_max(h || q, length(h || q)) AS rule, arg_max(verdict, length(h || q)) AS own
  FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id, url),
c AS (
  SELECT p.*, rule, own, CASE WHEN contains(p.url, '://') THEN regexp_replace(host, '^(?:www|m)\.', '')
    || regexp_replace(regexp_replace(path, '/index\.[a-z]+$', '/'), '(?:\.html?|/)$', '')
    || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(p.url, '(?s)^[^?#]*\?([^#]*)', 1), '&'),
         lambda x: x <> '' AND NOT regexp_matches(x, '^(?:utm_[a-z]+|ref|fbclid|gclid|msclkid|mc_[a-z]+|sessionid|sid)(?:=|$)'))), '&'), ''), '') END AS canon
  FROM p LEFT JOIN f ON p.page_id = f.page_id AND p.url IS NOT DISTINCT FROM f.url),
g AS (SELECT canon, bool_or(own = 'allow') AS a, bool_or(own = 'block') AS b FROM c WHERE canon IS NOT NULL GROUP BY canon)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN a THEN 'allow' WHEN b THEN 'block' END, 'allow') AS verdict
FROM c LEFT JOIN g USING (canon)
"""


def op5_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm import katz

    held_out = common.in_fold("doc_id", 7, 2)
    scored = katz.score(katz.train(common.documents(spark, sf_dir), training=~held_out, order=3))
    return scored.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.simhash import near_groups

    return near_groups(common.documents(spark, sf_dir)).drop("_mark")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from plumbline.llm.tokens import count_tokens

    return count_tokens(common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op8_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from plumbline.llm.packing import pack

    return pack(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=0)


def op9_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm import secrets

    found = secrets.scan(common.documents(spark, sf_dir))
    number = lambda kind: F.size(F.filter("strong", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[number(k) for k in secrets.STRONG],
        F.sha2(secrets.joined(F.col("strong")), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"),
    )


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.mixing import mix

    return mix(common.documents(spark, sf_dir)).drop("_row", "_mark", "_slots")


# What a document contributes is its stretch of the shuffled line, read twice, cut at the source's target.
# The slots: golden-ratio points through the cumulative block counts, ranked per source; the few slots too
# many go to the sources that are as many short.
SOURCE_MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
s AS (
  SELECT skey, CAST(sum(size) AS BIGINT) AS source_size,
    [3, 1, 2][(row_number() OVER (ORDER BY skey) - 1) % 3 + 1] AS w FROM d GROUP BY skey),
c AS (
  SELECT *, 2 * source_size AS cap, CAST(2 * source_size AS DOUBLE) / w AS lim,
    CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS total, CAST(sum(w) OVER () AS BIGINT) AS all_w FROM s),
l AS (
  SELECT *, (total - CAST(coalesce(sum(cap) OVER o, 0) AS DOUBLE)) / CAST(all_w - coalesce(sum(w) OVER o, 0) AS DOUBLE) AS lev
  FROM c WINDOW o AS (ORDER BY lim, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT skey, source_size, least(CAST(cap AS DOUBLE), w * (SELECT arg_min(lev, (lim, skey)) FROM l WHERE lev <= lim)) AS target FROM l),
pk AS (
  SELECT d.doc_id, d.skey, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS words,
    CAST(sum(d.size) OVER (PARTITION BY d.skey ORDER BY md5('mix' || CAST(d.doc_id AS VARCHAR)), d.doc_id) AS BIGINT) - d.size AS pos
  FROM d JOIN t USING (skey)),
b AS (
  SELECT skey, CAST(ceil(floor(target) / 256) AS BIGINT) AS blocks, coalesce(CAST(sum(ceil(floor(target) / 256)) OVER (ORDER BY skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS f FROM t),
z AS (SELECT CAST(sum(blocks) AS BIGINT) AS n FROM b),
u AS (
  SELECT x, skey, blocks, row_number() OVER (PARTITION BY skey ORDER BY x) - 1 AS k FROM (
    SELECT x, least(n - 1, CAST(floor((x % 2147483648 * 1327217885 % 2147483648)::DOUBLE / 2147483648::DOUBLE * n::DOUBLE) AS BIGINT)) AS spot FROM (SELECT unnest(range(n)) AS x, n FROM z))
  JOIN b ON spot >= f AND spot < f + blocks),
o AS (SELECT x, row_number() OVER (ORDER BY x) AS i FROM u WHERE k >= blocks),
q AS (
  SELECT skey, k, row_number() OVER (ORDER BY skey, k) AS i FROM (
    SELECT skey, unnest(range(got, blocks)) AS k FROM (SELECT b.skey, b.blocks, (SELECT count(*) FROM u WHERE u.skey = b.skey) AS got FROM b) WHERE got < blocks)),
slot AS (SELECT x, skey, k FROM u WHERE k < blocks UNION ALL SELECT x, skey, k FROM o JOIN q USING (i)),
y AS (
  SELECT doc_id, min(x) AS first_slot FROM (
    SELECT p.*, pos + turn * source_size AS a, least(pos + turn * source_size + size, words) AS e FROM pk p, (VALUES (0), (1)) AS v(turn) WHERE size > 0) g
  JOIN slot ON slot.skey = g.skey AND slot.k BETWEEN a // 256 AND (e - 1) // 256 WHERE a < e GROUP BY doc_id)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(greatest(0, least(pos + size, words) - pos)
     + greatest(0, least(pos + source_size + size, words) - pos - source_size) AS BIGINT) AS taken, first_slot
FROM pk LEFT JOIN y USING (doc_id)
"""

def op11_odd_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.oddsketch import near_groups

    return near_groups(common.documents(spark, sf_dir), similarity=0.8, width=4)


# Pairs that share shingles, their shares, and what is reachable over the links.
ODD_SKETCH_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(1, len(words) - 3) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS least FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(c.least, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline import session
    from plumbline.llm.resample import resample
    from plumbline.sources import tables

    target = tables.scan(session.configure(spark), sf_dir, "benchmark")
    return resample(common.documents(spark, sf_dir), target, width=1, buckets=10_000, seed=2024, percent=10, least_words=20)


# CRC-32 of a word: eight shift steps for each of its bytes (polynomial 0xEDB88320).
RESAMPLE_SQL = r"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
  UNION ALL SELECT 'b', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS (SELECT side, id, word, count(*) AS n FROM (SELECT side, id, unnest(ws) AS word FROM words) GROUP BY ALL),
t AS (SELECT list(c ORDER BY i) AS crc FROM (
  SELECT i, list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS g(i))),
h AS (
  SELECT word, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, octet_length(encode(word)) * 2, 2), lambda k: CAST('0x' || substr(hex(encode(word)), k + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, crc[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM f), t),
k AS (
  SELECT bucket, sum(n) FILTER (WHERE side = 'd') AS s, sum(n) FILTER (WHERE side = 'b') AS t FROM f JOIN h USING (word) GROUP BY bucket),
a AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM k),
g AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + 10000)::DOUBLE))) AS BIGINT) AS gain FROM k, a),
w AS (
  SELECT f.id, sum(n)::BIGINT AS n, CAST(floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE) AS BIGINT) AS weight FROM f JOIN h USING (word) JOIN g USING (bucket) WHERE side = 'd' GROUP BY f.id),
x AS (
  SELECT doc_id, coalesce(w.n, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || sha256('2024:' || doc_id)[1:8] AS BIGINT) AS h FROM documents LEFT JOIN w ON w.id = doc_id),
y AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM x),
z AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM y WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, z.rank AS rank FROM y LEFT JOIN (SELECT doc_id, rank FROM z WHERE rank <= n * 10 // 100) z USING (doc_id)
"""


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.infill import transform

    return transform(common.documents(spark, sf_dir), seed=7, rate=100, spm_share=50)


FILL_IN_MIDDLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id) AS x FROM documents),
h AS (
  SELECT *, len(u) AS n, CAST('0x' || x[1:8] AS BIGINT) % (len(u) + 1) AS p, CAST('0x' || x[9:16] AS BIGINT) % (len(u) + 1) AS q,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || x[17:24] AS BIGINT) % 100 >= 100 THEN 'plain'
      WHEN CAST('0x' || x[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (
  SELECT *, array_to_string(u[1:least(p, q)], '') AS pre, array_to_string(u[least(p, q) + 1:greatest(p, q)], '') AS mid, array_to_string(u[greatest(p, q) + 1:], '') AS suf FROM h),
o AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END AS out FROM c),
m AS (SELECT *, split_part(out, '<M>', 2) AS mid2, split_part(out, '<M>', 1) AS front FROM o)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars, sha256(out) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN out WHEN 'psm' THEN split_part(front[4:], '<S>', 1) || mid2 || split_part(front, '<S>', 2)
    ELSE split_part(front, '<P>', 2) || mid2 || split_part(front[4:], '<P>', 1) END) AS restored_sha256
FROM m
"""

QUERIES = {
    "op1_byte_rnn_langid": op1_byte_rnn_langid,
    "op2_line_field_quality": op2_line_field_quality,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_redirect_url_filter": op4_redirect_url_filter,
    "op5_katz_backoff": op5_katz_backoff,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_stock_packing": op8_stock_packing,
    "op9_secret_links": op9_secret_links,
    "op10_source_mix": op10_source_mix,
    "op11_odd_sketch_dedup": op11_odd_sketch_dedup,
    "op12_target_resampling": op12_target_resampling,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE_SQL = {
    "op3_exact_dedup": EXACT_DEDUP_SQL,
    "op4_redirect_url_filter": URL_FILTER_SQL,
    "op10_source_mix": SOURCE_MIX_SQL,
    "op11_odd_sketch_dedup": ODD_SKETCH_SQL,
    "op12_target_resampling": RESAMPLE_SQL,
    "op13_fill_in_middle": FILL_IN_MIDDLE_SQL,
}
