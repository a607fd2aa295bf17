"""The registered queries' contracts, their SQL, and the pipeline against plain Python."""

import re
import zlib
from collections import defaultdict

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from plumbline.llm import common, queries

CONTRACT = {
    "op1_byte_rnn_langid": "doc_id:bigint held_out:boolean lang_pred:string score:double",
    "op2_line_field_quality": "doc_id:bigint n_words:bigint word_chars:bigint n_symbols:bigint n_dup_lines:bigint n_repeat_words:bigint base_failed:boolean kept:boolean",
    "op3_exact_dedup": "doc_id:bigint keep_id:bigint group_size:bigint kept:boolean text_sha256:string",
    "op4_redirect_url_filter": "page_id:bigint host:string path:string rule:string verdict:string",
    "op5_katz_backoff": "doc_id:bigint held_out:boolean n_tokens:bigint n_known:bigint train_tokens:bigint base_score:double score:double",
    "op6_simhash_near_dedup": "doc_id:bigint fingerprint:string component_id:bigint",
    "op7_token_counts": "doc_id:bigint n_bytes:bigint n_tokens:bigint over_limit:boolean",
    "op8_stock_packing": "doc_id:bigint start:bigint length:bigint ids_crc32:bigint doc_tokens:bigint sequence_id:bigint offset:bigint",
    "op9_secret_links": "doc_id:bigint n_assign:bigint n_access:bigint n_hex:bigint base_sha256:string spans:string",
    "op10_source_mix": "doc_id:bigint size:bigint source_size:bigint target:double taken:bigint first_slot:bigint",
    "op11_odd_sketch_dedup": "doc_id:bigint n_shingles:bigint component_id:bigint kept:boolean",
    "op12_target_resampling": "doc_id:bigint n_features:bigint weight:bigint score:bigint rank:bigint",
    "op13_fill_in_middle": "doc_id:bigint n:bigint form:string prefix_chars:bigint middle_chars:bigint output_sha256:string restored_sha256:string",
}


def test_all_are_registered():
    found = entry.queries()
    assert set(CONTRACT) | {"pipeline"} <= set(found)
    assert set(queries.QUERIES) == set(CONTRACT)
    assert set(queries.ORACLE_SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", CONTRACT)
def test_contract_and_sql(spark, sf, name):
    before = {k: spark.conf.get(k) for k in common._BATCH}
    got = queries.QUERIES[name](spark, sf)
    assert {k: spark.conf.get(k) for k in common._BATCH} == before  # the session is left as it was
    wanted = [tuple(c.split(":")) for c in CONTRACT[name].split()]
    assert got.dtypes[: len(wanted)] == wanted
    rows = got.collect()
    table = "pages" if name.startswith("op4") else "documents"
    assert len(rows) >= spark.read.parquet(f"{sf}/{table}.parquet").count()
    if name in queries.ORACLE_SQL:
        con = duckdb.connect()
        for t in ("documents", "pages", "benchmark"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        cur = con.execute(queries.ORACLE_SQL[name])
        at = [[d[0] for d in cur.description].index(c) for c in got.columns]
        assert sorted(map(str, (tuple(r) for r in rows))) == sorted(str(tuple(r[i] for i in at)) for r in cur.fetchall())


def blank(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def shingles(text):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text).split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def test_pipeline_stage_by_stage(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "source_mix", "packing"]
    docs = common.documents(spark, sf)
    columns, results = docs.columns, []
    for _, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, sf), "test-stage")
        results.append(docs)
    languages, distinct, single, mixed, packed = [r.collect() for r in results]
    assert all(r.columns == columns for r in results[:-1])

    given = {r.doc_id: r.text for r in common.documents(spark, sf).collect()}
    assert all(r.text == given[r.doc_id] for r in languages)
    assert len(languages) >= 0.97 * sum(bool(re.search(r"[^\W\d_]", t or "")) for t in given.values())

    groups = defaultdict(list)
    for r in languages:
        groups[blank(r.text)].append((-len(r.text), r.doc_id))
    assert sorted(r.doc_id for r in distinct) == sorted(min(g)[1] for g in groups.values())

    sets = {r.doc_id: shingles(r.text) for r in distinct}
    kept = {r.doc_id for r in single}
    assert kept <= set(sets)
    for i in set(sets) - kept:  # whatever went is near something that was there
        assert max(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for j in sets if j != i) >= 0.8
    for i in kept:  # what stayed is near no other that stayed
        assert all(i == j or len(sets[i] & sets[j]) / len(sets[i] | sets[j]) < 0.8 for j in kept)

    words, by_source, reads = {}, defaultdict(int), defaultdict(int)
    for r in single:
        words[r.doc_id] = len(r.text.split())
        by_source[r.source] += words[r.doc_id]
    for r in mixed:
        reads[r.doc_id] += 1
    assert set(reads) <= kept and max(reads.values()) <= 2
    taken = sum(words[i] * n for i, n in reads.items())
    assert 1.5 * sum(by_source.values()) - len(by_source) <= taken <= 1.5 * sum(by_source.values()) + len(by_source) * max(words.values())

    tokens = defaultdict(int)
    for r in packed:
        tokens[r.doc_id] += r.length
    lengths = {r.doc_id: r.doc_tokens for r in packed}
    assert tokens == {i: n * lengths[i] for i, n in reads.items()}
    full = defaultdict(int)
    for r in packed:
        full[r.sequence_id] += r.length
    assert all(n == 1024 or not n & (n - 1) for n in full.values())


def test_pipeline_on_odd_and_empty_documents(spark, frame, odd_rows):
    for docs in (frame(odd_rows), frame(odd_rows).limit(0)):
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = common.written(stage(spark, docs, ""), "test-odd")
            assert docs.columns == columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= docs.count()


def test_folds_are_crc32_of_the_id_as_text(spark, sf):
    for name, modulus, remainder in (("op1_byte_rnn_langid", 3, 1), ("op5_katz_backoff", 7, 2)):
        for r in queries.QUERIES[name](spark, sf).select("doc_id", "held_out").collect():
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == remainder)
