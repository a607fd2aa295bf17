"""Scoped retrieval for a batch of queries: eligibility, dense, sparse, fusion, metrics.

Every stage applies the same eligibility predicate, built in one place. Corpus
statistics are per scope, since a query may only see statistics of rows it may see.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import session
from plumbline.functions import text
from plumbline.operators import vectors, windows
from plumbline.operators.joins import ContractError, duplicate_keys

VECTOR_SIZE = 1024
SPACE = f"lexical-sha256:{VECTOR_SIZE}"
# Okapi BM25 parameters and the rank-fusion constant.
K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60
#: Shared terms of one dense slice when answers are compared.
SLICE = 4096
#: Terms that a task remembers the numbers of.
MEMO = 200_000
#: Terms of all queries of one search.
MOST_TERMS = 500_000


@dataclass(frozen=True)
class Scope:
    """What one group of users may read."""

    scope_id: int
    source_types: tuple[str, ...]
    programs: tuple[str, ...]
    asof: str
    embed_model: str


def visible_to(programs: Sequence[str]) -> Column:
    """Shared rows, and program rows of an allowed program. No visibility means not visible."""
    kind = F.get_json_object("metadata", "$.visibility")
    program = F.get_json_object("metadata", "$.program")
    return F.coalesce((kind == "shared") | ((kind == "program") & program.isin(list(programs))), F.lit(False))


def valid_at(day: str) -> Column:
    at = F.lit(day).cast("date")
    return (F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at))


def eligible(scope: Scope) -> Column:
    return (
        F.col("source_type").isin(list(scope.source_types))
        & (F.col("embed_model") == scope.embed_model)
        & visible_to(scope.programs)
        & valid_at(scope.asof)
    )


def scoped(chunks: DataFrame, scopes: Sequence[Scope], *columns: str) -> DataFrame:
    """One row per (scope, eligible chunk): a projection and an explode, no join."""
    marks = F.array(*[F.when(eligible(s), F.lit(s.scope_id)) for s in scopes])
    ids = F.filter(marks, lambda m: m.isNotNull())
    return chunks.select(F.explode(ids).alias("scope_id"), "id", *columns)


def reload_scoped(ranked: DataFrame, chunks: DataFrame, scopes: Sequence[Scope], *columns: str) -> DataFrame:
    """Second authorisation before content leaves: ineligible ids silently drop, order stays."""
    return ranked.join(scoped(chunks, scopes, *columns), ["scope_id", "id"])


# ---- sparse -----------------------------------------------------------------------------


def corpus(chunks: DataFrame, scopes: Sequence[Scope]) -> DataFrame:
    """Eligible chunks as (id, scope_ids, has_text, doc_len, terms, counts), counted where they are and written to the shared folder once."""
    session.ensure_checkpoint_dir(chunks.sparkSession)
    marks = F.array(*[F.when(eligible(s), F.lit(s.scope_id)) for s in scopes])
    ids = F.filter(marks, lambda m: m.isNotNull())
    rows = term_counts(chunks.select("id", "content", F.col("content").isNotNull().alias("has_text"), ids.alias("scope_ids")).where(F.size("scope_ids") > 0), "content")
    return rows.select("id", "scope_ids", "has_text", F.aggregate("counts", F.lit(0).cast("bigint"), lambda n, c: n + c).alias("doc_len"), "terms", "counts").checkpoint()


def merged(docs: DataFrame) -> DataFrame:
    """Rows of one id, length and scopes as one row, their counts added up."""
    key = ["id", "scope_ids", "doc_len"]
    long = docs.select(*key, F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy(*key, F.col("t.terms").alias("term")).agg(F.sum("t.counts").alias("n"))
    listed = long.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("term", "n"))).alias("v"))
    return listed.select(*key, F.col("v.term").alias("terms"), F.col("v.n").alias("counts"))


def corpus_statistics(docs: DataFrame) -> DataFrame:
    """Rows per scope, and their mean length: rows without any token count too, rows without a text only as rows."""
    rows = docs.select(F.explode("scope_ids").alias("scope_id"), "doc_len", F.col("has_text").cast("int").alias("has_text"))
    sums = rows.groupBy("scope_id").agg(F.count("*").alias("n_docs"), F.sum("doc_len").alias("words"), F.sum("has_text").alias("texts"))
    return sums.where("words > 0").select("scope_id", "n_docs", (F.col("words") / F.col("texts")).alias("avgdl"))


def term_idf(docs: DataFrame, stats: DataFrame) -> DataFrame:
    """Idf per (scope, term); negative values are floored at a fraction of the scope's mean idf."""
    df = docs.select("scope_ids", F.explode("terms").alias("term")).select(F.explode("scope_ids").alias("scope_id"), "term").groupBy("scope_id", "term").agg(F.count("*").alias("df"))
    raw = df.join(F.broadcast(stats), "scope_id").withColumn(
        "idf", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    )
    mean = raw.groupBy("scope_id").agg(F.avg("idf").alias("mean_idf"))
    floored = F.when(F.col("idf") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("idf"))
    return raw.join(F.broadcast(mean), "scope_id").select("scope_id", "term", floored.alias("idf"))


def _rounded(x: np.ndarray) -> np.ndarray:
    """Nine decimals, halves away from zero."""
    return np.sign(x) * np.floor(np.abs(x) * 1e9 + 0.5) / 1e9


def bm25_scores(docs: DataFrame, terms: pd.DataFrame, k: int | None) -> DataFrame:
    """(id, query_id, scope_id, score) of documents that share a term with a query: a task's ``k`` best of each query, or all.

    ``terms``: query_id, scope_id, term, weight, avgdl. A row is scored where it is; a task holds
    the scores of one slice of rows and its best so far.
    """
    terms = terms.sort_values("term", ignore_index=True)
    known, first, many = np.unique(terms["term"].to_numpy(np.int64), return_index=True, return_counts=True)
    asked = terms[["query_id", "scope_id"]].drop_duplicates(ignore_index=True)
    number = terms.merge(asked.reset_index(), on=["query_id", "scope_id"], how="left")["index"].to_numpy()
    weight, avgdl = terms["weight"].to_numpy(float), terms["avgdl"].to_numpy(float)
    scope = asked["scope_id"].to_numpy()
    whole = {name: pa.types.is_integer(pa.array(asked[name]).type) for name in asked}
    slice_rows = max(1, (1 << 21) // max(1, len(asked)))

    def scores(batch: pa.RecordBatch) -> pd.DataFrame:
        sizes = batch.column("terms").value_lengths().to_numpy()
        term, tf = batch.column("terms").flatten().to_numpy(), batch.column("counts").flatten().to_numpy()
        doc = np.repeat(np.arange(batch.num_rows), sizes)
        at = np.minimum(np.searchsorted(known, term), len(known) - 1)
        hit = known[at] == term
        doc, tf, at = doc[hit], tf[hit], at[hit]
        n = many[at]
        entry = np.repeat(first[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        doc, tf = np.repeat(doc, n), np.repeat(tf, n).astype(float)
        may = np.stack([np.isin(scope, list(ids)) for ids in batch.column("scope_ids").to_pylist()])[doc, number[entry]]
        doc, tf, entry = doc[may], tf[may], entry[may]
        length = batch.column("doc_len").to_numpy()[doc] / avgdl[entry]
        pair = doc * len(asked) + number[entry]
        part = weight[entry] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length))
        total = np.bincount(pair, part)
        met = np.flatnonzero(np.bincount(pair))
        ids = batch.column("id").to_pandas().to_numpy()
        return pd.DataFrame({"id": ids[met // len(asked)], "q": met % len(asked), "score": total[met]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, least = None, np.full(len(asked), -np.inf)
        out = lambda f: pa.RecordBatch.from_pandas(
            pd.DataFrame({"id": f["id"], "query_id": asked["query_id"].to_numpy()[f["q"]], "scope_id": scope[f["q"]], "score": f["score"]}), schema=arrow, preserve_index=False
        )
        for batch in batches:
            arrow = pa.schema([("id", batch.schema.field("id").type), *((name, pa.int64() if whole[name] else pa.string()) for name in ("query_id", "scope_id")), ("score", pa.float64())])
            for start in range(0, batch.num_rows if len(asked) else 0, slice_rows):
                found = scores(batch.slice(start, slice_rows))
                if k is None:
                    yield out(found)
                    continue
                found["score"] = _rounded(found["score"].to_numpy())
                found = found[found["score"].to_numpy() >= least[found["q"].to_numpy()]]
                best = found if best is None else pd.concat([best, found])
                best = best.sort_values(["q", "score", "id"], ascending=[True, False, True], ignore_index=True)
                best = best[best.groupby("q").cumcount() < k]
                full = best.groupby("q")["score"].agg(["size", "min"])
                full = full[full["size"] == k]
                least[full.index] = full["min"]
        if best is not None:
            yield out(best)

    kind = docs.schema["id"].dataType.simpleString()
    of = lambda name: "bigint" if whole[name] else "string"
    return docs.mapInArrow(run, f"id {kind}, query_id {of('query_id')}, scope_id {of('scope_id')}, score double")


def bm25_topk(queries: DataFrame, chunks: DataFrame, scopes: Sequence[Scope], k: int = 50) -> DataFrame:
    """Top ``k`` overlapping chunks per query (query_id, scope_id, text), ties by id."""
    docs = corpus(chunks, scopes)
    single = duplicate_keys(docs.select("id"), ["id"]).isEmpty()
    stats = corpus_statistics(docs)
    if not single:
        docs = merged(docs)
    terms = (
        term_counts(queries.select("query_id", "scope_id", "text"), "text")
        .select("query_id", "scope_id", F.explode(F.arrays_zip("terms", "counts")).alias("t"))
        .groupBy("query_id", "scope_id", F.col("t.terms").alias("term"))
        .agg(F.sum("t.counts").alias("qtf"))
        .join(term_idf(docs, stats), ["scope_id", "term"])
        .join(F.broadcast(stats), "scope_id")
        .select("query_id", "scope_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"), "avgdl")
    )
    asked = terms.limit(MOST_TERMS + 1).toPandas()
    if len(asked) > MOST_TERMS:
        raise ContractError(f"queries have more than {MOST_TERMS} terms: search for fewer at a time")
    scored = bm25_scores(docs, asked, k if single else None).withColumns({c: F.col(c).cast(queries.schema[c].dataType) for c in ("query_id", "scope_id")})
    if not single:
        scored = scored.groupBy("id", "query_id", "scope_id").agg(F.round(F.sum("score"), 9).alias("score"))
    return windows.top_per_group(scored, ["query_id"], [F.desc("score"), F.col("id")], k, "rank")


# ---- dense ------------------------------------------------------------------------------


def term_counts(rows: DataFrame, content: str, slots: int | None = None) -> DataFrame:
    """``content`` becomes ``terms`` (rising), ``counts`` and their ``norm``, the other columns stay: every row is counted where it is.

    A term's number is the first eight bytes of its SHA-256, or the first four modulo ``slots``.
    """
    kept = [f for f in rows.schema.fields if f.name != content]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "terms array<bigint>, counts array<bigint>, norm double"])
    names = [f.name for f in kept]

    def number(token: str) -> int:
        digest = hashlib.sha256(token.encode()).digest()
        return int.from_bytes(digest[:4], "big") % slots if slots else int.from_bytes(digest[:8], "big", signed=True)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, memo = re.compile(text.TOKEN), {}
        for batch in batches:
            ends, terms, counts, norms = [0], [], [], []
            for value in batch.column(content).to_pylist():
                found: dict[int, int] = {}
                for token, n in Counter(pattern.findall((value or "").lower())).items():
                    known = memo.get(token)
                    if known is None:
                        if len(memo) >= MEMO:
                            memo.clear()
                        known = memo[token] = number(token)
                    found[known] = found.get(known, 0) + n
                rising = sorted(found)
                terms += rising
                counts += [found[t] for t in rising]
                ends.append(len(terms))
                norms.append(math.sqrt(sum(n * n for n in found.values())))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int64())) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *lists, pa.array(norms, pa.float64())], [*names, "terms", "counts", "norm"])

    return rows.mapInArrow(count, schema)


def sparse_hash_vectors(docs: DataFrame, key: str, content: str, size: int = VECTOR_SIZE) -> DataFrame:
    """(key, bucket, weight): hashed token counts scaled to unit length, kept sparse.

    A document is counted in its own row, so nothing is shuffled; only where ``key`` repeats
    (asked once) are the counts of its rows added up.
    """
    long = term_counts(docs.select(key, content), content, size)
    if duplicate_keys(docs.select(key), [key]).isEmpty():
        rows = long.select(key, "norm", F.explode(F.arrays_zip("terms", "counts")).alias("t"))
        return rows.select(key, F.col("t.terms").cast("int").alias("bucket"), (F.col("t.counts") / F.col("norm")).alias("weight"))
    rows = long.select(key, F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy(key, F.col("t.terms").cast("int").alias("bucket")).agg(F.sum("t.counts").alias("n"))
    norms = rows.groupBy(F.col(key).alias("same")).agg(F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")).alias("norm"))
    return rows.join(norms, F.col(key).eqNullSafe(F.col("same"))).select(key, "bucket", (F.col("n") / F.col("norm")).alias("weight"))


def hash_embed(texts: pd.Series) -> list[np.ndarray]:
    """Default embedder for Arrow batches: the same hashed vectors, dense; no tokens gives zeros."""
    pattern, seen, out = re.compile(text.TOKEN), {}, []
    for value in texts:
        row = np.zeros(VECTOR_SIZE)
        for token in pattern.findall(value.lower()):
            slot = seen.get(token)
            if slot is None:
                slot = seen[token] = int.from_bytes(hashlib.sha256(token.encode()).digest()[:4], "big") % VECTOR_SIZE
            row[slot] += 1
        size = np.linalg.norm(row)
        out.append(row / size if size else row)
    return out


def embedding_udf(embed=hash_embed):
    @F.pandas_udf("array<double>")
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(x) for x in embed(texts)])

    return encode


def dense_topk(queries: DataFrame, chunks: DataFrame, scopes: Sequence[Scope], k: int = 50, embed=hash_embed) -> DataFrame:
    """Exact cosine top ``k`` per query inside its scope; texts without tokens cannot be found.

    All scopes are one search: a chunk is moved and embedded once, with the scopes that may see it.
    """
    known = [s.scope_id for s in scopes]
    asked = queries.where(F.col("scope_id").isin(known) & (F.size(text.tokens("text")) > 0)).select("query_id", "scope_id", F.col("text").alias("said"))
    marks = F.filter(F.array(*[F.when(eligible(s), F.lit(s.scope_id)) for s in scopes]), lambda m: m.isNotNull())
    rows = chunks.select("id", F.col("content").alias("said"), marks.alias("scope_ids")).where((F.size("scope_ids") > 0) & (F.size(text.tokens("said")) > 0))
    got = vectors.topk_cosine(asked, rows, k, vec="said", embed=embed, scope="scope_id", scopes="scope_ids")
    return got.join(asked.select("query_id", "scope_id"), "query_id")


# ---- fusion -----------------------------------------------------------------------------


def rrf(rankings: DataFrame, n: int | None = None, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of (query_id, list_id, id, rank): repeats drop before ranks count."""
    if k < 1:
        raise ValueError("positive rank constant required")
    first = rankings.groupBy("query_id", "list_id", "id").agg(F.min("rank").alias("rank"))
    w = Window.partitionBy("query_id", "list_id").orderBy("rank", "id")
    dense = first.withColumn("place", F.row_number().over(w))
    score = dense.groupBy("query_id", "id").agg(F.round(F.sum(1 / (k + F.col("place"))), 12).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = score.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= n) if n else ranked


def hybrid_search(
    queries: DataFrame, chunks: DataFrame, scopes: Sequence[Scope], pool: int = 50, embed=hash_embed
) -> DataFrame:
    """Dense and sparse pools, fused, then loaded again under the same scope."""
    dense = dense_topk(queries, chunks, scopes, pool, embed).select("query_id", "id", "rank", F.lit("dense").alias("list_id"))
    sparse = bm25_topk(queries, chunks, scopes, pool).select("query_id", "id", "rank", F.lit("sparse").alias("list_id"))
    fused = rrf(dense.unionByName(sparse), pool)
    asked = queries.select("query_id", "scope_id")
    return reload_scoped(fused.join(asked, "query_id"), chunks, scopes, "content")


def overlap_score(question: str, content: str) -> Column:
    """Default pair score: share of the question's distinct tokens found in the content."""
    asked = F.array_distinct(text.tokens(question))
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, text.tokens(content))) / F.size(asked)).otherwise(F.lit(0.0))


def rerank(shortlist: DataFrame, k: int = 8, scorer=None) -> DataFrame:
    """Re-order (query_id, id, rank, text, content) by token overlap, or by an injected scorer of pairs; ties keep their order."""
    if k < 1:
        raise ValueError("positive k required")
    order = ["query_id"], [F.desc("rerank_score"), F.col("rank")], k, "new_rank"
    if scorer is None:
        return windows.top_per_group(shortlist.withColumn("rerank_score", overlap_score("text", "content")), *order)

    @F.pandas_udf("double")
    def score(questions: pd.Series, contents: pd.Series) -> pd.Series:
        values = np.asarray(scorer(questions, contents), dtype=float).reshape(-1)
        if len(values) != len(questions) or not np.isfinite(values).all():
            raise ValueError("invalid reranker scores")
        return pd.Series(values)

    return windows.top_per_group(shortlist.withColumn("rerank_score", score("text", "content")), *order)


def expand_parents(children, chunks, parents, scope_ok: Column, same: Sequence[str], k: int) -> DataFrame:
    """First ``k`` distinct parents per query in child order; the parent must be allowed itself."""
    ranked = children.join(chunks.select("id", "parent_id", *same), "id").where("parent_id IS NOT NULL")
    allowed = parents.where(scope_ok).select(F.col("id").alias("parent_id"), *same)
    best = (
        ranked.join(allowed, ["parent_id", *same])
        .groupBy("query_id", "parent_id")
        .agg(F.min(F.struct("order_key", "id")).alias("first"))
    )
    return windows.top_per_group(best, ["query_id"], ["first"], k)


# ---- metrics ----------------------------------------------------------------------------


def check_rankings(ranked: DataFrame, judged: DataFrame) -> None:
    if not duplicate_keys(ranked, ["query_id", "id"]).isEmpty():
        raise ContractError("rankings must contain unique ids")
    if not duplicate_keys(ranked, ["query_id", "rank"]).isEmpty():
        raise ContractError("duplicate ranks")
    if not judged.where((F.col("grade") < 0) | F.col("grade").isNull() | F.isnan(F.col("grade").cast("double"))).isEmpty():
        raise ContractError("grades must be finite and nonnegative")
    unjudged = ranked.select("query_id").distinct().join(judged.where("grade > 0"), "query_id", "left_anti")
    if not unjudged.isEmpty():
        raise ContractError("no relevance set: evaluate unanswerability separately")


def retrieval_metrics(ranked: DataFrame, judged: DataFrame, k: int, check: bool = True) -> DataFrame:
    """recall@k, reciprocal rank and linear-gain nDCG@k per query with a relevance set."""
    if not isinstance(k, int) or k < 1:
        raise ValueError("positive integer cutoff required")
    if check:
        check_rankings(ranked, judged)
    relevant = judged.where("grade > 0")
    discount = lambda rank: F.log2(rank.cast("double") + 1)
    sizes = relevant.groupBy("query_id").agg(F.count("*").alias("relevant"))
    ideal = windows.top_per_group(relevant, ["query_id"], [F.desc("grade"), F.col("id")], k, "place")
    best = ideal.groupBy("query_id").agg(F.sum(F.col("grade") / discount(F.col("place"))).alias("idcg"))
    hits = ranked.join(relevant, ["query_id", "id"]).groupBy("query_id").agg(
        F.sum((F.col("rank") <= k).cast("int")).alias("found"),
        F.min("rank").alias("first_rank"),
        F.sum(F.when(F.col("rank") <= k, F.col("grade") / discount(F.col("rank"))).otherwise(0.0)).alias("dcg"),
    )
    return (
        sizes.join(best, "query_id")
        .join(hits, "query_id", "left")
        .select(
            "query_id",
            (F.coalesce("found", F.lit(0)) / F.col("relevant")).alias("recall"),
            F.coalesce(1 / F.col("first_rank"), F.lit(0.0)).alias("reciprocal_rank"),
            (F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).alias("ndcg"),
        )
    )


# ---- revisions --------------------------------------------------------------------------


def check_replacement(current: DataFrame, new: DataFrame, effective: str) -> None:
    """One complete revision per document and space, starting after everything recorded."""
    key = ["document_id", "embed_model"]
    day = F.lit(effective).cast("date")
    if new.isEmpty():
        raise ContractError("effective date and nonempty replacement required")
    shape = new.groupBy(*key).agg(
        F.count_distinct("document_revision").alias("revisions"),
        F.count("*").alias("n"),
        F.count_distinct("chunk_index").alias("distinct_n"),
        F.min("chunk_index").alias("lo"),
        F.max("chunk_index").alias("hi"),
    )
    broken = (F.col("revisions") != 1) | (F.col("n") != F.col("distinct_n")) | (F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1)
    if not shape.where(broken).isEmpty():
        raise ContractError("one complete revision with contiguous unique chunk indices required")
    if not new.where((F.col("valid_from") != day) | F.col("valid_to").isNotNull()).isEmpty():
        raise ContractError("replacement rows do not match document, space, or interval")
    late = current.join(new.select(*key).distinct(), key, "left_semi").where(F.col("valid_from") >= day)
    if not late.isEmpty():
        raise ContractError("replacement must start after all recorded revisions in this space")


def replace_revision(current: DataFrame, new: DataFrame, effective: str, check: bool = True) -> DataFrame:
    """Close the open rows of replaced documents at ``effective`` and append the new revision."""
    if check:
        check_replacement(current, new, effective)
    key = ["document_id", "embed_model"]
    replaced = new.select(*key).distinct().withColumn("__r", F.lit(True))
    closing = F.col("__r") & F.col("valid_to").isNull()
    kept = (
        current.join(replaced, key, "left")
        .withColumn("status", F.when(closing, "closed").otherwise("kept"))
        .withColumn("valid_to", F.when(closing, F.lit(effective).cast("date")).otherwise(F.col("valid_to")))
        .drop("__r")
    )
    return kept.unionByName(new.withColumn("status", F.lit("new")))


# ---- reuse of earlier answers -------------------------------------------------------------


def exact_reuse(queries: DataFrame, answers: DataFrame, ttl_seconds: int) -> DataFrame:
    """Latest live answer with the same scope and text (asked after answered, before expiry).

    Times are cut into TTL-wide buckets; a query can only meet answers of its own or the
    previous bucket, so even one endlessly repeated text spreads over the time axis.
    Answers given at one instant reduce to the one with the largest id.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    slot = lambda c: F.floor(micros(c) / (ttl_seconds * 1_000_000))
    key = ["scope", "digest", "slot"]
    queries, answers = (df.where(F.col("scope").isNotNull() & F.col("text").isNotNull()) for df in (queries, answers))
    digest = F.sha2("text", 256).alias("digest")
    held = (
        answers.select("scope", digest, slot("answered_at").alias("slot"), "answered_at", "answer_id")
        .groupBy(*key, "answered_at")
        .agg(F.max("answer_id").alias("answer_id"))
        .select(*key, F.struct("answered_at", "answer_id").alias("a"))
    )
    # Within one slot only the running latest matters; queries and answers share a timeline.
    asks = queries.select("scope", digest, slot("asked_at").alias("slot"), F.col("asked_at").alias("at"), "query_id")
    last = held.groupBy(*key).agg(F.max("a").alias("a"))
    line = asks.select(*key, "at", F.lit(0).alias("kind"), "query_id", F.lit(None).cast(held.schema["a"].dataType).alias("a")).unionByName(
        held.select(*key, F.col("a.answered_at").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), "a")
    )
    upto = Window.partitionBy(*key).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    here = line.withColumn("a", F.last("a", ignorenulls=True).over(upto)).where("kind = 0").select(*key, "at", "query_id", "a")
    before = last.select("scope", "digest", (F.col("slot") + 1).alias("slot"), F.col("a").alias("p"))
    best = here.join(before, key, "left").withColumn("a", F.coalesce("a", "p"))
    live = F.col("a.answered_at") + F.expr(f"INTERVAL '{ttl_seconds}' SECOND") > F.col("at")
    return best.where(live & (F.col("a.answered_at") < F.col("at"))).select(
        "query_id", F.col("a.answer_id").alias("answer_id"), F.lit(1.0).alias("similarity")
    )


def _best_in_reach(group: pd.DataFrame, ttl: int, threshold: float, columns: list[str]) -> pd.DataFrame:
    """The best live answer of each query of one block: integer products of term counts, a slice of shared terms at a time."""
    group = group[group["terms"].map(len) > 0]
    asks, held = group[group["side"] == 0], group[group["side"] == 1]
    if asks.empty or held.empty:
        return pd.DataFrame({c: [] for c in columns})
    sizes = [[len(x) for x in side["terms"]] for side in (asks, held)]
    rows = [np.repeat(np.arange(len(n)), n) for n in sizes]
    terms, place = np.unique(np.concatenate([*asks["terms"], *held["terms"]]), return_inverse=True)
    places = place[: len(rows[0])], place[len(rows[0]) :]
    counts = [np.concatenate(list(side["counts"])).astype(float) for side in (asks, held)]
    # A term that only one side has adds nothing.
    both = np.flatnonzero(np.logical_and(*[np.bincount(p, minlength=len(terms)) > 0 for p in places]))
    column = np.full(len(terms), -1)
    column[both] = np.arange(len(both))
    dots = np.zeros((len(asks), len(held)))
    for start in range(0, len(both), SLICE):
        dense = []
        for n, row, at, count in zip((len(asks), len(held)), rows, places, counts, strict=True):
            here = (column[at] >= start) & (column[at] < start + SLICE)
            part = np.zeros((n, min(SLICE, len(both) - start)))
            part[row[here], column[at[here]] - start] = count[here]
            dense.append(part)
        dots += dense[0] @ dense[1].T
    norms = [np.sqrt(np.bincount(row, count * count)) for row, count in zip(rows, counts, strict=True)]
    similarity = np.floor(dots / (norms[0][:, None] * norms[1][None, :]) * 1e9 + 0.5) / 1e9
    age = asks["at"].to_numpy()[:, None] - held["at"].to_numpy()[None, :]
    i, j = np.nonzero((similarity >= threshold) & (age > 0) & (age < ttl))
    found = pd.DataFrame({"query_id": asks["id"].to_numpy()[i], "answer_id": held["id"].to_numpy()[j], "answered_at": held["at"].to_numpy()[j], "similarity": similarity[i, j]})
    return found.sort_values(["similarity", "answered_at", "answer_id"], ascending=False).drop_duplicates("query_id")[columns]


def near_reuse(queries: DataFrame, answers: DataFrame, ttl_seconds: int, threshold: float = 0.97, block: int = 1000) -> DataFrame:
    """Best live answer of the scope with cosine >= ``threshold`` (ties: newest, then id).

    Times are cut into TTL-wide slots. A text becomes its distinct term hashes and counts in its own
    row and moves once as a query and twice as an answer (its slot and the next); a slot of a scope
    is one block, and a crowded one is cut into blocks of about ``block`` rows a side.
    """
    ttl = ttl_seconds * 1_000_000
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    own = lambda at: F.floor(micros(at) / ttl)
    slots = {"query_id": lambda at: F.array(own(at)), "answer_id": lambda at: F.array(own(at), own(at) + 1)}

    def side(df: DataFrame, key: str, at: str, number: int) -> DataFrame:
        held = df.where(F.col("scope").isNotNull()).select("scope", F.col(key).alias("id"), micros(at).alias("at"), slots[key](at).alias("slots"), "text")
        wide = term_counts(held, "text").where(F.size("terms") > 0)
        return wide.withColumn("slot", F.explode("slots")).drop("slots").withColumn("side", F.lit(number))

    def sizes(df: DataFrame, key: str, at: str, name: str) -> DataFrame:
        return df.select("scope", F.explode(slots[key](at)).alias("slot")).groupBy("scope", "slot").agg(F.ceil(F.count("*") / block).cast("int").alias(name))

    # Crowded slots only: at most one for each ``block`` rows.
    crowded = F.broadcast(sizes(queries, "query_id", "asked_at", "a").join(sizes(answers, "answer_id", "answered_at", "r"), ["scope", "slot"]).where("a > 1 OR r > 1"))
    every = lambda n: F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1)
    one = lambda n: F.pmod(F.xxhash64("id"), F.coalesce(n, F.lit(1))).cast("int")
    columns = ["scope", "slot", "side", "id", "at", "terms", "counts"]
    asks = side(queries, "query_id", "asked_at", 0).join(crowded, ["scope", "slot"], "left").select(*columns, one(F.col("a")).alias("a"), F.explode(every(F.col("r"))).alias("r"))
    held = side(answers, "answer_id", "answered_at", 1).join(crowded, ["scope", "slot"], "left").select(*columns, F.explode(every(F.col("a"))).alias("a"), one(F.col("r")).alias("r"))
    made = ["query_id", "answer_id", "answered_at", "similarity"]
    kinds = [queries.schema["query_id"].dataType.simpleString(), answers.schema["answer_id"].dataType.simpleString(), "bigint", "double"]
    found = asks.unionByName(held).groupBy("scope", "slot", "a", "r").applyInPandas(
        lambda group: _best_in_reach(group, ttl, threshold, made), ", ".join(f"{n} {k}" for n, k in zip(made, kinds, strict=True))
    )
    order = [F.desc("similarity"), F.desc("answered_at"), F.desc("answer_id")]
    return windows.top_per_group(found, ["query_id"], order, 1).select("query_id", "answer_id", "similarity")


def answer_reuse(queries, answers, ttl_seconds: int = 300, threshold: float = 0.97, verified: Column | None = None) -> DataFrame:
    """Exact text first, otherwise the best near text; ``verified`` is the caller's check of a near pair."""
    exact = exact_reuse(queries, answers, ttl_seconds).withColumn("kind", F.lit("exact"))
    # A query's near answer does not depend on other queries: those with an exact one are left out at the end, without their texts.
    near = near_reuse(queries, answers, ttl_seconds, threshold).join(exact.select("query_id"), "query_id", "left_anti").withColumn("kind", F.lit("near"))
    if verified is not None:
        near = near.where(verified)
    return exact.unionByName(near)
