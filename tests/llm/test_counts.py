import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plumbline.llm import common, mixing, packing, tokens

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = [*"ab1'!é \n\t", " ", "\x1c", "  ", "<|endoftext|>", "'s", "The", " the,", "Á", "H̱", "ß…", "，"]


@pytest.mark.parametrize(("path", "ids"), [(WORD_BPE, False), (BYTE_BPE, True)])
def test_pieces_equal_the_library(path, ids):
    rng = random.Random(2)
    texts = ["", " ", "x" * 3000, "don't  stop\n\n x "] + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    tokenizer = Tokenizer.from_file(path)
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    got = tokens.Pieces(path, ids).encode(texts)
    assert got == [np.array(w, "<u4").tobytes() if ids else len(w) for w in want]


def test_token_counts_and_the_cache(spark, frame, odd_rows, tmp_path):
    cache = str(tmp_path / "cache")
    docs = frame(odd_rows)
    tokenizer = Tokenizer.from_file(WORD_BPE)
    got = tokens.count_tokens(docs, WORD_BPE, limit=100, cache=cache).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = [(i, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False))) for i, t, *_ in odd_rows]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=key) == sorted(want, key=key)
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)
    stored = spark.read.parquet(cache + "/*")
    assert stored.count() == stored.select("_digest").distinct().count()
    before = stored.count()
    tokens.count_tokens(docs.unionByName(frame([(99, "new words here", "en", "a")])), WORD_BPE, cache=cache).collect()
    assert spark.read.parquet(cache + "/*").count() == before + 1
    assert tokens.count_tokens(docs.limit(0), WORD_BPE).count() == 0


def check_packing(rows, pieces, capacity=1024):
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    want = sorted((str(i), tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])) for i, t, *_ in rows)
    by, sequences = defaultdict(list), defaultdict(list)
    for r in pieces:
        by[str(r.doc_id)].append(r)
        sequences[r.sequence_id].append(r)
    for i, ids in want:
        times = sum(x[0] == i for x in want)
        assert sum(r.length for r in by[i]) == times * len(ids) or i == "None"
        for r in by[i]:
            if times == 1:
                assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(ids)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == capacity or not at & (at - 1)
    assert sum(r.length for r in pieces) == sum(len(ids) for _, ids in want)


def test_packing_is_an_exact_cover_without_padding(frame, odd_rows):
    rng = random.Random(4)
    rows = odd_rows + [(100 + i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.choice([350, 350, 20, 900]))), "en", "a") for i in range(80)]
    check_packing(rows, packing.pack(frame(rows), BYTE_BPE).collect())
    assert packing.pack(frame(rows).limit(0), BYTE_BPE).count() == 0


@pytest.mark.parametrize("histogram", [{600: 50_000, 300: 10, 1023: 7000}, {513: 3000}, {1: 5000, 1000: 2000}, {7: 1}, {512: 9, 256: 3}, {i: 40 for i in range(1, 1024)}])
def test_cutting_plan_uses_every_rank_once_and_pads_nothing(histogram):
    rows, sequences = packing.cutting_plan(histogram, 1024)
    assert sequences * 1024 < sum(n * c for n, c in histogram.items()) + 11 * 1024
    for length, count in histogram.items():
        used = np.zeros(count + 1, int)
        for n, first, ranks, _, _, _, _, part, _, _ in rows:
            if n == length:
                used[first : first + ranks] += part
        assert (used[:-1] == length).all()


def test_column_generation_is_near_the_bound():
    rng = np.random.default_rng(0)
    lengths, counts = np.unique(rng.integers(100, 700, 20_000), return_counts=True)
    uses = packing.column_generation(lengths, counts.astype(float), 1024)
    for i in range(len(lengths)):
        assert abs(sum(dict(p).get(i, 0) * v for p, v in uses) - counts[i]) < 1e-6 * counts[i]
    assert sum(v for _, v in uses) <= 1.01 * (lengths * counts).sum() / 1024


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    keys = sorted(sizes, key=lambda k: (k is None, (k or "").encode()))
    w = {k: weights[i % 3] for i, k in enumerate(keys)}
    target, open_, left = dict.fromkeys(keys, 0.0), set(keys), share * sum(sizes.values())
    while left > 1e-9 and open_:
        total = sum(w[k] for k in open_)
        for k in open_:
            target[k] += left * w[k] / total
        left = 0
        for k in list(open_):
            if target[k] >= cap * sizes[k]:
                left += target[k] - cap * sizes[k]
                target[k] = float(cap * sizes[k])
                open_.discard(k)
    return target


def test_mix_meets_its_targets(frame, odd_rows):
    rng = random.Random(3)
    rows = odd_rows + [(100 + i, "w " * rng.randint(0, 90), "en", rng.choice(["a", "a", "b", "c", "d", None])) for i in range(300)]
    plan = mixing.mix(frame(rows), block=16)
    got = plan.collect()
    assert len(got) == len(rows)
    size_of = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken, source = defaultdict(int), defaultdict(int), {}
    for i, t, _, s in rows:
        sizes[s] += size_of(t)
        source[i] = s
    target = brute_targets(sizes)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
    # Ids 5 and null occur twice; the others name one source.
    for r in got:
        if r.doc_id is not None:
            assert r.source_size == sizes[source[r.doc_id]]
            assert abs(r.target - target[source[r.doc_id]]) < 1e-6
    by_target = defaultdict(int)
    for r in got:
        by_target[r.target, r.source_size] += r.taken
    for (t, _), n in by_target.items():
        assert n <= 2 * t + 1e-6
    assert sum(by_target.values()) >= sum(int(t) for t in target.values()) - 1
    assert sorted(map(str, mixing.mix(frame(rows), block=64).select("doc_id", "taken").collect())) == sorted(map(str, plan.select("doc_id", "taken").collect()))
    assert mixing.mix(frame(rows).limit(0)).count() == 0


def test_schedule_gives_every_block_one_slot_and_spreads_sources(spark):
    plan = spark.createDataFrame([("a", 0, 600), ("b", 600, 1), ("c", 601, 399)], "_key string, _first long, _blocks long")
    got = sorted((r.t, r._key, r.k) for r in mixing.schedule(plan, 1000, 3).collect())
    assert [t for t, *_ in got] == list(range(1000))
    for key, n in (("a", 600), ("b", 1), ("c", 399)):
        assert sorted(k for _, s, k in got if s == key) == list(range(n))
    for i in range(0, 1000, 50):
        assert abs(sum(s == "a" for _, s, _ in got[i : i + 50]) - 30) <= 4


def test_repeated_rows_follow_the_plan(frame, odd_rows):
    docs = frame(odd_rows)
    plan = common.written(mixing.mix(docs), "plan")
    out = mixing.repeated(docs, plan)
    assert out.columns == docs.columns
    reads = sum(-(-r.taken // r.size) for r in plan.collect() if r.taken)
    assert out.count() == reads


def test_rows_of_one_id_and_size_keep_their_texts(frame):
    docs = frame([(1, "a b c", "en", "a"), (1, "d e f", "en", "a"), (2, "g", "en", "a")])
    plan = common.written(mixing.mix(docs, share=1.0), "plan")
    out = [r.text for r in mixing.repeated(docs, plan).collect()]
    assert sorted(out) == ["a b c", "d e f", "g"]


def test_repeated_rows_come_in_the_order_of_their_slots(frame):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(20, 60), "en", rng.choice(["a", "a", "a", "b", "c"])) for i in range(600)]
    docs = frame(rows)
    plan = common.written(mixing.mix(docs, block=16), "plan")
    slots = {r.doc_id: r._slots for r in plan.collect()}
    out = [r.doc_id for r in mixing.repeated(docs, plan).collect()]
    left = {i: list(s or []) for i, s in slots.items()}
    seen = [left[i].pop(0) for i in out]
    assert seen == sorted(seen) and not any(left.values())
    # Any stretch of slots has the sources in about their targets' proportions.
    source, target = {i: s for i, _, _, s in rows}, brute_targets({s: sum(len(t.split()) for _, t, _, x in rows if x == s) for s in "abc"})
    firsts = sorted((r.first_slot, source[r.doc_id]) for r in plan.collect() if r.first_slot is not None)
    assert all(r.first_slot == (r._slots[0] if r._slots else None) for r in plan.collect())
    total = sum(target.values())
    whole = max(t for t, _ in firsts) + 1
    words = {i: len(t.split()) for i, t, *_ in rows}
    for part in (0.25, 0.5):
        taken = {s: sum(words[i] * sum(t < whole * part for t in ts or []) for i, ts in slots.items() if source[i] == s) for s in "abc"}
        share = sum(taken.values())
        assert all(abs(taken[s] / share - target[s] / total) < 0.08 for s in "abc")


def test_a_digest_stored_twice_is_one_count(spark, frame, odd_rows, tmp_path):
    cache = str(tmp_path / "cache")
    docs = frame(odd_rows)
    first = sorted(map(str, tokens.count_tokens(docs, WORD_BPE, cache=cache).collect()))
    spark.read.parquet(cache + "/*").write.parquet(cache + "/again")  # as a retried or a second call would
    assert sorted(map(str, tokens.count_tokens(docs, WORD_BPE, cache=cache).collect())) == first
    assert len(first) == len(odd_rows)
