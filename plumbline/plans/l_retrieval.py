"""Corpus chunking, scoped retrieval and its metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators import answers as checks
from plumbline.operators import chunking, retrieval
from plumbline.operators.retrieval import Scope
from plumbline.registry import query
from plumbline.sources.oracle_views import register_view

ALL_TYPES = ("manual", "car", "audit", "standard")
SCOPES = (
    Scope(0, ALL_TYPES, ("P0", "P1"), "2024-05-01", "space-a"),
    Scope(1, ("manual", "car"), ("P2",), "2024-03-05", "space-a"),
    Scope(2, ALL_TYPES, (), "2024-06-01", "space-a"),
)

_listed = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
register_view("scopes", " UNION ALL ".join(
    f"SELECT {s.scope_id} AS scope_id, CAST({_listed(s.source_types)} AS VARCHAR[]) AS types, "
    f"CAST({_listed(s.programs)} AS VARCHAR[]) AS programs, DATE '{s.asof}' AS asof, '{s.embed_model}' AS space" for s in SCOPES))
register_view("scoped_chunks", """
SELECT s.scope_id, c.* FROM chunks c JOIN scopes s ON list_contains(s.types, c.source_type) AND c.embed_model = s.space
 AND (c.metadata->>'$.visibility' = 'shared' OR (c.metadata->>'$.visibility' = 'program' AND list_contains(s.programs, c.metadata->>'$.program')))
 AND c.valid_from <= s.asof AND (c.valid_to IS NULL OR c.valid_to > s.asof)""")
register_view("asked", "SELECT item_id AS query_id, item_id % 3 AS scope_id, text FROM benchmark")
TOKENS = "regexp_extract_all(lower({}), '[a-z0-9]+(?:[.-][a-z0-9]+)*')"
BUCKET = "CAST('0x' || substr(sha256({}), 1, 8) AS BIGINT) % 1024"
register_view("dense_ranked", f"""
SELECT query_id, scope_id, id, rank, similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM (
    SELECT q.query_id, q.scope_id, e.id, round(coalesce(d.dot, 0) / (qn.norm * en.norm), 9) AS similarity
    FROM asked q JOIN scoped_chunks e ON e.scope_id = q.scope_id
    JOIN (SELECT query_id, sqrt(sum(n * n)) AS norm FROM asked_buckets GROUP BY 1) qn ON qn.query_id = q.query_id
    JOIN (SELECT id, sqrt(sum(n * n)) AS norm FROM chunk_buckets GROUP BY 1) en ON en.id = e.id
    LEFT JOIN (SELECT a.query_id, c.id, sum(a.n * c.n) AS dot FROM asked_buckets a JOIN chunk_buckets c USING (bucket) GROUP BY ALL) d
      ON d.query_id = q.query_id AND d.id = e.id)) WHERE rank <= 50""")
register_view("asked_buckets", f"""
SELECT query_id, {BUCKET.format('t')} AS bucket, count(*) AS n FROM (SELECT query_id, unnest({TOKENS.format('text')}) AS t FROM asked) GROUP BY ALL""")
register_view("chunk_buckets", f"""
SELECT id, {BUCKET.format('t')} AS bucket, count(*) AS n FROM (SELECT id, unnest({TOKENS.format('content')}) AS t FROM chunks) GROUP BY ALL""")
register_view("sparse_ranked", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT q.query_id, q.scope_id, p.id, round(sum(q.qtf * i.idf * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * p.len / s.avgdl))), 9) AS score
  FROM (SELECT query_id, scope_id, t, count(*) AS qtf FROM (SELECT query_id, scope_id, unnest({TOKENS.format('text')}) AS t FROM asked) GROUP BY ALL) q
  JOIN scoped_postings p ON p.scope_id = q.scope_id AND p.t = q.t
  JOIN scope_stats s ON s.scope_id = q.scope_id
  JOIN (SELECT scope_id, t, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY scope_id) ELSE raw END AS idf FROM (
     SELECT scope_id, t, ln(any_value(n_docs) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM scoped_postings JOIN scope_stats USING (scope_id) GROUP BY ALL)) i
    ON i.scope_id = q.scope_id AND i.t = q.t
  GROUP BY ALL)) WHERE rank <= 50""")
register_view("scoped_postings", f"""
SELECT scope_id, id, t, len, count(*) AS tf FROM (SELECT scope_id, id, len(toks) AS len, unnest(toks) AS t FROM (
  SELECT scope_id, id, {TOKENS.format('content')} AS toks FROM scoped_chunks)) GROUP BY ALL""")
register_view("scope_stats", f"""
SELECT scope_id, count(*) AS n_docs, avg(len({TOKENS.format('content')})) AS avgdl FROM scoped_chunks GROUP BY 1""")
register_view("fused", """
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT query_id, id, round(sum(1 / (60 + rank)), 12) AS score FROM (
    SELECT query_id, id, rank FROM dense_ranked UNION ALL SELECT query_id, id, rank FROM sparse_ranked) GROUP BY ALL)""")


def asked(v):
    return v.raw("benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 3).alias("scope_id"), "text")


def _cut(start: str) -> str:
    """Oracle expression: end of the chunk that begins at ``start`` (0-based)."""
    window = f"substr(text, CAST({start} + 401 AS BIGINT), 400)"
    seps = ("chr(10) || chr(10)", "chr(10)", "' .'", "' '")  # reversed separators
    tries = ", ".join(f"{start} + 800 - (nullif(strpos(reverse({window}), {s}), 0) - 1)" for s in seps)
    return f"CASE WHEN {start} + 800 >= length(text) THEN length(text) ELSE coalesce({tries}, {start} + 800) END"


@query("chunk_recursive", "doc_id:i begin_at:i content:s", f"""
WITH RECURSIVE c AS (
  SELECT doc_id, text, CAST(0 AS BIGINT) AS b, CAST({_cut('0')} AS BIGINT) AS e FROM documents WHERE length(text) > 0
  UNION ALL SELECT doc_id, text, nb, CAST({_cut('nb')} AS BIGINT) FROM (SELECT doc_id, text, greatest(b + 1, e - 100) AS nb, e FROM c WHERE e < length(text)))
SELECT doc_id, b AS begin_at, substr(text, b + 1, e - b) AS content FROM c WHERE regexp_matches(substr(text, b + 1, e - b), '\\S')""")
def chunk_recursive(v):
    docs = v.raw("documents").select("doc_id", "text")
    return chunking.chunks(docs, "text", chunking.recursive(), "spans").select("doc_id", "begin_at", "content")


def clause_docs(v):
    """Documents in which every fourth line is renumbered as a heading."""
    parts = F.split("text", "\n")
    named = F.transform(
        parts,
        lambda line, i: F.when((i % 4 == 1) & line.rlike("^[A-Za-z]"), F.concat(i.cast("string"), F.lit(".1 "), line)).otherwise(line),
    )
    return v.raw("documents").select("doc_id", "source", F.array_join(named, "\n").alias("text"))


register_view("clause_docs", r"""
SELECT doc_id, source, array_to_string(list_transform(string_split(text, chr(10)), lambda line, i:
  CASE WHEN (i - 1) % 4 = 1 AND regexp_matches(line, '^[A-Za-z]') THEN CAST(i - 1 AS VARCHAR) || '.1 ' || line ELSE line END), chr(10)) AS text FROM documents""")


@query("clause_sections", "doc_id:i section:i clause:s heading:s body:s", r"""
WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\r?\n')) AS line, unnest(generate_series(1, len(regexp_split_to_array(text, '\r?\n')))) AS n FROM clause_docs),
h AS (SELECT *, trim(line) AS c, regexp_matches(trim(line), '^(?:#{1,6}\s+)?(\d+(?:\.\d+)*)\s+([A-Za-z].*)$') AS is_h FROM l),
s AS (SELECT *, sum(CAST(is_h AS INT)) OVER (PARTITION BY doc_id ORDER BY n) AS section FROM h)
SELECT doc_id, section, max(CASE WHEN is_h THEN regexp_extract(c, '^(?:#{1,6}\s+)?(\d+(?:\.\d+)*)\s+([A-Za-z].*)$', 1) END) AS clause,
  max(CASE WHEN is_h THEN regexp_extract(c, '^(?:#{1,6}\s+)?(\d+(?:\.\d+)*)\s+([A-Za-z].*)$', 2) END) AS heading,
  coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT is_h), '') AS body FROM s GROUP BY doc_id, section""")
def clause_sections(v):
    return chunking.sections(clause_docs(v), "doc_id", "text")


@query("chunk_clause", "doc_id:i section:i piece:i clause:s heading:s content:s")
def chunk_clause(v):
    return chunking.clause_chunks(clause_docs(v), "doc_id", "text")


@query("chunk_semantic", "doc_id:i chunk_index:i content:s")
def chunk_semantic(v):
    return chunking.semantic_chunks(v.raw("documents"), "doc_id", "text")


@query("build_index", "id:i chunk_index:i clause:s token_count:i embed_model:s metadata:s valid_from:d valid_to:d dims:i")
def build_index(v):
    texts = clause_docs(v).select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    docs = v.chunks.select("id", "source_type", "metadata", "valid_from", "valid_to").join(texts, "id")
    rows = chunking.build_index(docs, "id", "content", "source_type = 'standard'")
    return rows.withColumn("dims", F.size("embedding"))


@query("hash_vectors", "doc_id:i bucket:i weight:f", f"""
WITH b AS (SELECT doc_id, {BUCKET.format('t')} AS bucket, count(*) AS n FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS t FROM documents) GROUP BY ALL)
SELECT doc_id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS weight FROM b""")
def hash_vectors(v):
    return retrieval.sparse_hash_vectors(v.raw("documents"), "doc_id", "text")


@query("tokenize", "doc_id:i n_tokens:i n_distinct:i joined:s", f"""
SELECT doc_id, len({TOKENS.format('text')}) AS n_tokens, len(list_distinct({TOKENS.format('text')})) AS n_distinct, array_to_string({TOKENS.format('text')}, ' ') AS joined FROM documents""")
def tokenize(v):
    t = text.tokens("text")
    return v.raw("documents").select(
        "doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"), F.array_join(t, " ").alias("joined")
    )


@query("scoped_chunks", "scope_id:i id:i source_type:s", "SELECT scope_id, id, source_type FROM scoped_chunks")
def scoped_chunks(v):
    return retrieval.scoped(v.chunks, SCOPES, "source_type")


@query("dense_topk", "query_id:i scope_id:i id:i rank:i similarity:f", "SELECT * FROM dense_ranked")
def dense_topk(v):
    return retrieval.dense_topk(asked(v), v.chunks, SCOPES)


@query("bm25_topk", "query_id:i scope_id:i id:i rank:i score:f", "SELECT * FROM sparse_ranked")
def bm25_topk(v):
    return retrieval.bm25_topk(asked(v), v.chunks, SCOPES)


@query("rrf", "query_id:s id:i rank:i score:f", """
WITH lists AS (SELECT lang AS query_id, 'long' AS list_id, doc_id AS id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents
  UNION ALL SELECT lang, 'first', doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) FROM documents),
l AS (SELECT * FROM lists WHERE rank <= 60)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT query_id, id, round(sum(1 / (60 + rank)), 12) AS score FROM l GROUP BY ALL)""")
def rrf(v):
    from plumbline.operators.windows import top_per_group

    docs = v.raw("documents").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("id"), "n_chars")
    long = top_per_group(docs, ["query_id"], [F.desc("n_chars"), F.col("id")], 60, "rank").withColumn("list_id", F.lit("long"))
    first = top_per_group(docs, ["query_id"], ["id"], 60, "rank").withColumn("list_id", F.lit("first"))
    return retrieval.rrf(long.unionByName(first))


@query("hybrid_search", "query_id:i scope_id:i id:i rank:i score:f", """
SELECT f.query_id, q.scope_id, f.id, f.rank, f.score FROM fused f JOIN asked q USING (query_id)
JOIN scoped_chunks s ON s.scope_id = q.scope_id AND s.id = f.id WHERE f.rank <= 50""")
def hybrid_search(v):
    return retrieval.hybrid_search(asked(v), v.chunks, SCOPES)


@query("rerank", "query_id:i id:i new_rank:i rerank_score:f", f"""
WITH s AS (SELECT r.query_id, r.id, r.rank, list_distinct({TOKENS.format('q.text')}) AS qt, {TOKENS.format('c.content')} AS ct
  FROM sparse_ranked r JOIN asked q USING (query_id) JOIN chunks c ON c.id = r.id),
t AS (SELECT query_id, id, rank, len(list_intersect(qt, ct)) / len(qt) AS rerank_score FROM s)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS new_rank FROM t QUALIFY new_rank <= 8""")
def rerank(v):
    short = retrieval.bm25_topk(asked(v), v.chunks, SCOPES).select("query_id", "scope_id", "id", "rank")
    loaded = retrieval.reload_scoped(short, v.chunks, SCOPES, "content").join(asked(v).select("query_id", "text"), "query_id")
    return retrieval.rerank(loaded, 8)


@query("retrieval_metrics", "query_id:s recall:f reciprocal_rank:f ndcg:f", """
WITH ranked AS (SELECT source AS query_id, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
j AS (SELECT d.source AS query_id, l.doc_id AS id, greatest(0, l.quality * 2 - l.toxic) AS grade FROM labels l JOIN documents d USING (doc_id)),
i AS (SELECT query_id, sum(grade / log2(p + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, id) AS p FROM j WHERE grade > 0) WHERE p <= 10 GROUP BY 1)
SELECT j.query_id, count(*) FILTER (WHERE r.rank <= 10) / count(*) AS recall, coalesce(1 / min(r.rank), 0) AS reciprocal_rank,
  coalesce(sum(j.grade / log2(r.rank + 1)) FILTER (WHERE r.rank <= 10), 0) / any_value(i.idcg) AS ndcg
FROM j LEFT JOIN ranked r ON r.query_id = j.query_id AND r.id = j.id JOIN i ON i.query_id = j.query_id WHERE j.grade > 0 GROUP BY j.query_id""")
def retrieval_metrics(v):
    from plumbline.operators import ordered

    docs = v.raw("documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("id"), "n_chars")
    ranked = ordered.row_numbers(docs, ["query_id"], -F.floor(F.col("n_chars") / 100), [F.desc("n_chars"), F.col("id")], "rank")
    judged = v.raw("labels").select(F.col("doc_id").alias("id"), F.greatest(F.lit(0), F.col("quality") * 2 - F.col("toxic")).alias("grade"))
    judged = judged.join(docs.select("query_id", "id"), "id")
    return retrieval.retrieval_metrics(ranked.select("query_id", "id", "rank"), judged, 10, check=False)


@query("replace_revision", "id:i document_id:i document_revision:i embed_model:s valid_from:d valid_to:d status:s", """
WITH n AS (SELECT id + 1000000000 AS id, document_id, 9 AS document_revision, embed_model, row_number() OVER (PARTITION BY document_id, embed_model ORDER BY id) AS rn
  FROM chunks WHERE lang = 'en')
SELECT c.id, c.document_id, c.document_revision, c.embed_model, c.valid_from,
  CASE WHEN c.valid_to IS NULL AND k.document_id IS NOT NULL THEN DATE '2025-01-01' ELSE c.valid_to END AS valid_to,
  CASE WHEN c.valid_to IS NULL AND k.document_id IS NOT NULL THEN 'closed' ELSE 'kept' END AS status
FROM chunks c LEFT JOIN (SELECT DISTINCT document_id, embed_model FROM n) k ON k.document_id = c.document_id AND k.embed_model = c.embed_model
UNION ALL SELECT id, document_id, document_revision, embed_model, DATE '2025-01-01', NULL, 'new' FROM n""")
def replace_revision(v):
    from pyspark.sql import Window

    columns = ["id", "document_id", "document_revision", "chunk_index", "embed_model", "valid_from", "valid_to"]
    w = Window.partitionBy("document_id", "embed_model").orderBy("id")
    new = v.chunks.where("lang = 'en'").select(
        (F.col("id") + 1_000_000_000).alias("id"),
        "document_id",
        F.lit(9).cast("bigint").alias("document_revision"),
        (F.row_number().over(w) - 1).cast("bigint").alias("chunk_index"),
        "embed_model",
        F.lit("2025-01-01").cast("date").alias("valid_from"),
        F.lit(None).cast("date").alias("valid_to"),
    )
    return retrieval.replace_revision(v.chunks.select(*columns), new, "2025-01-01")


@query("answer_reuse", "query_id:i answer_id:i similarity:f kind:s", f"""
WITH t AS (SELECT doc_id AS rid, lang AS scope, text, TIMESTAMP '2024-01-01' + to_seconds(doc_id) AS moment FROM documents),
pairs AS (SELECT q.rid AS query_id, a.rid AS answer_id, a.moment AS answered_at, q.text = a.text AS same FROM t q JOIN t a ON a.scope = q.scope AND a.moment < q.moment AND a.moment + INTERVAL 300 SECOND > q.moment),
exact AS (SELECT query_id, answer_id, CAST(1 AS DOUBLE) AS similarity, 'exact' AS kind FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY answered_at DESC, answer_id DESC) = 1),
tok AS (SELECT rid, t, count(*) AS n FROM (SELECT rid, unnest({TOKENS.format('text')}) AS t FROM t) GROUP BY ALL),
nrm AS (SELECT rid, sqrt(sum(n * n)) AS norm FROM tok GROUP BY 1),
near AS (SELECT p.query_id, p.answer_id, p.answered_at, round(sum(x.n * y.n / (nx.norm * ny.norm)), 9) AS similarity FROM pairs p JOIN tok x ON x.rid = p.query_id JOIN tok y ON y.rid = p.answer_id AND y.t = x.t
  JOIN nrm nx ON nx.rid = p.query_id JOIN nrm ny ON ny.rid = p.answer_id WHERE p.query_id NOT IN (SELECT query_id FROM exact) GROUP BY ALL HAVING similarity >= 0.97)
SELECT * FROM exact UNION ALL SELECT query_id, answer_id, similarity, 'near' FROM near QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, answered_at DESC, answer_id DESC) = 1""")
def answer_reuse(v):
    # Documents arrive one a second; each asks for a live earlier text of its language.
    docs = v.raw("documents").select("doc_id", F.col("lang").alias("scope"), "text", F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id")).alias("moment"))
    answers = docs.select(F.col("doc_id").alias("answer_id"), "scope", "text", F.col("moment").alias("answered_at"))
    queries = docs.select(F.col("doc_id").alias("query_id"), "scope", "text", F.col("moment").alias("asked_at"))
    return retrieval.answer_reuse(queries, answers, ttl_seconds=300)


@query("identifier_preserve", "conv_id:i turn:i keeps:b n_identifiers:i", r"""
SELECT a.conv_id, a.turn, regexp_matches(b.text, '\S') AND a.text <> b.text AND len(list_filter(regexp_extract_all(a.text, '(?i)\b(?:\d+(?:\.\d+)+|[A-Z0-9]+(?:-[A-Z0-9]+)+)\b'),
    lambda x: NOT list_contains(regexp_extract_all(b.text, '(?i)\b(?:\d+(?:\.\d+)+|[A-Z0-9]+(?:-[A-Z0-9]+)+)\b'), x))) = 0 AS keeps,
  len(list_distinct(regexp_extract_all(a.text, '(?i)\b(?:\d+(?:\.\d+)+|[A-Z0-9]+(?:-[A-Z0-9]+)+)\b'))) AS n_identifiers
FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""")
def identifier_preserve(v):
    turns = v.raw("conversations")
    later = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("rewrite"))
    return turns.join(later, ["conv_id", "turn"]).select(
        "conv_id", "turn", text.identifiers_survive("text", "rewrite").alias("keeps"), F.size(text.identifiers("text")).alias("n_identifiers")
    )


@query("citation_check", "conv_id:i problems:s", r"""
WITH c AS (SELECT conv_id, turn AS claim_id, CASE WHEN turn = 3 THEN '  ' WHEN conv_id % 6 = 0 THEN text || ' [2]' ELSE text END AS text,
   [turn, conv_id % 5, (conv_id * turn) % 4] AS cites FROM conversations WHERE role = 'assistant'),
p AS (SELECT conv_id, claim_id, 1 AS o, 'blank text' AS m FROM c WHERE NOT regexp_matches(text, '\S')
  UNION ALL SELECT conv_id, claim_id, 2, 'embedded citation marker' FROM c WHERE regexp_matches(text, '\[(\d+)\]')
  UNION ALL SELECT conv_id, claim_id, 3, 'duplicate citations' FROM c WHERE len(list_distinct(cites)) <> len(cites)
  UNION ALL SELECT conv_id, claim_id, 4, 'citation outside supplied sources' FROM c WHERE len(list_filter(cites, lambda x: x < 1 OR x > 3)) > 0)
SELECT conv_id, string_agg('claim ' || claim_id || ': ' || m, '; ' ORDER BY claim_id, o) AS problems FROM p GROUP BY conv_id""")
def citation_check(v):
    says = F.when(F.col("turn") == 3, "  ").when(F.col("conv_id") % 6 == 0, F.concat("text", F.lit(" [2]"))).otherwise(F.col("text"))
    claims = v.raw("conversations").where("role = 'assistant'").select(
        F.col("conv_id").alias("answer_id"),
        F.col("turn").alias("claim_id"),
        says.alias("text"),
        F.array("turn", F.col("conv_id") % 5, F.col("conv_id") * F.col("turn") % 4).alias("citations"),
    )
    return checks.structural_problems(claims, n_sources=3).withColumnRenamed("answer_id", "conv_id")


@query("answer_checks", "conv_id:i shape:s coverage_broken:b unsupported:s cited:s", r"""
WITH claims AS (SELECT conv_id, turn, text || CASE WHEN turn % 4 = 1 THEN ' [2][1][2]' ELSE '' END AS said FROM conversations WHERE role = 'assistant' AND conv_id % 5 <> 0),
verdicts AS (
  SELECT conv_id, turn, CAST((turn + conv_id) % 4 <> 0 AS INT) AS supported FROM claims WHERE turn <> 7
  UNION ALL SELECT conv_id, turn, 1 FROM claims WHERE conv_id % 11 = 0 AND turn = 1),
v AS (SELECT conv_id, turn, count(*) AS n, min(supported) AS supported FROM verdicts GROUP BY ALL),
k AS (
  SELECT conv_id, bool_or(v.n IS NULL OR v.n > 1) AS broken, coalesce(string_agg(turn, ',' ORDER BY turn) FILTER (WHERE v.supported = 0), '') AS unsupported,
    sum(len(list_filter(regexp_split_to_array(said, '\s+'), lambda w: w <> ''))) AS words
  FROM claims LEFT JOIN v USING (conv_id, turn) GROUP BY conv_id),
a AS (SELECT DISTINCT conv_id, conv_id % 7 = 0 AS refused FROM conversations)
SELECT conv_id, concat_ws('; ', CASE WHEN refused = (k.conv_id IS NOT NULL) THEN 'refusal has no claims; an answer must have claims' END,
    CASE WHEN words > 250 THEN 'answer exceeds 250 words' END) AS shape,
  coalesce(broken, false) AS coverage_broken, coalesce(unsupported, '') AS unsupported,
  coalesce((SELECT array_to_string(list_sort(list_distinct(flatten(list(list_transform(regexp_extract_all(said, '\[(\d+)\]', 1), lambda x: CAST(x AS INT)))))), ',') FROM claims c WHERE c.conv_id = a.conv_id), '') AS cited
FROM a LEFT JOIN k USING (conv_id)""")
def answer_checks(v):
    turns = v.raw("conversations")
    said = F.when(F.col("turn") % 4 == 1, F.concat("text", F.lit(" [2][1][2]"))).otherwise(F.col("text"))
    claims = turns.where("role = 'assistant' AND conv_id % 5 <> 0").select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("claim_id"), said.alias("text"))
    verdicts = claims.where("claim_id <> 7").select("answer_id", "claim_id", ((F.col("claim_id") + F.col("answer_id")) % 4 != 0).alias("supported"))
    again = claims.where("answer_id % 11 = 0 AND claim_id = 1").select("answer_id", "claim_id", F.lit(True).alias("supported"))
    given = turns.select(F.col("conv_id").alias("answer_id"), (F.col("conv_id") % 7 == 0).alias("refused")).distinct()
    shape = checks.answer_shape(given, claims)
    coverage = checks.coverage_problems(claims, verdicts.unionByName(again))
    cited = claims.groupBy("answer_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(checks.cited_numbers("text"))))).alias("cited"))
    return shape.join(coverage, "answer_id", "left").join(cited, "answer_id", "left").select(
        F.col("answer_id").alias("conv_id"), F.array_join("problems", "; ").alias("shape"), F.coalesce("coverage_broken", F.lit(False)).alias("coverage_broken"),
        F.coalesce(F.array_join(F.transform("unsupported", lambda x: x.cast("string")), ","), F.lit("")).alias("unsupported"),
        F.coalesce(F.array_join(F.transform("cited", lambda x: x.cast("string")), ","), F.lit("")).alias("cited"),
    )
