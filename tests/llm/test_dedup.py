import random
import re
from collections import defaultdict
from itertools import combinations

from plumbline.llm import components, exact_dedup, similar, simhash


def brute_exact(rows):
    groups = defaultdict(list)
    for k, (i, t, *_) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, k))
    return groups


def test_exact_dedup_matches_brute_force(frame, odd_rows):
    rows = odd_rows + [(20 + i, odd_rows[5][1] + " " * (i % 3), "en", "a") for i in range(50)]
    got = exact_dedup.exact_dedup(frame(rows), runs=8, fan_bits=2).collect()
    assert len(got) == len(rows)
    groups = brute_exact(rows)
    assert sorted(r.group_size for r in got) == sorted(len(g) for g in groups.values() for _ in g)
    assert sum(r.kept for r in got) == len(groups)
    want = {rows[min(g)[3]][0] for g in groups.values()}
    assert {r.doc_id for r in got if r.kept} == want
    by_id = {r.doc_id: r for r in got}
    for g in groups.values():
        for *_, k in g:
            assert by_id[rows[k][0]].keep_id == rows[min(g)[3]][0] or sum(r[0] == rows[k][0] for r in rows) > 1


def test_distinct_rows_keep_columns_and_one_of_repeated_rows(frame, odd_rows):
    docs = frame(odd_rows)
    kept = exact_dedup.distinct_rows(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(brute_exact(odd_rows))
    assert exact_dedup.distinct_rows(docs.limit(0)).count() == 0


def test_a_digest_match_alone_does_not_merge(spark, frame, odd_rows):
    from pyspark.sql import functions as F

    docs = frame(odd_rows)
    keys = exact_dedup.text_keys(docs).withColumn("_digest", F.lit(1).cast("bigint")).withColumn("_row", F.monotonically_increasing_id())
    assert exact_dedup.merge_runs(keys, runs=4, fan_bits=1).count() == len(brute_exact(odd_rows))


def test_masks_cover_every_choice_of_positions():
    for radius in (1, 2):
        masks = simhash.covering_masks(radius)
        assert all(any(all(not m >> i & 1 for i in c) for m in masks) for c in combinations(range(64), radius))


def closure(values, radius):
    up = {v: v for v in values}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(values, 2):
        if ((a ^ b) & (2**64 - 1)).bit_count() <= radius:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_links_lose_nothing_in_sparse_and_crowded_buckets(spark):
    rng = random.Random(1)
    values = set()
    for _ in range(4):
        base = rng.getrandbits(64)
        for _ in range(50):
            x = base
            for _ in range(rng.randint(0, 6)):
                x ^= 1 << rng.randrange(64)
            values.add(simhash.signed(x))
            base = x if rng.random() < 0.3 else base
    prints = spark.createDataFrame([(v,) for v in values], "fp long")
    for radius, crowd in ((2, 64), (2, 3), (1, 3)):
        found = {r.node: r.component for r in components.components(simhash.links(prints, radius, crowd), "a", "b").collect()}
        assert {v: found.get(v, v) for v in values} == closure(sorted(values), radius)


def test_fingerprint_follows_its_definition(spark):
    from pyspark.sql import functions as F

    for text in ("", "one", "A b C d e", "x " * 500, "é ü ß 😀 a\nb\tc"):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [r[0] % 2**64 for r in spark.createDataFrame([(s,) for s in shingles], "s string").select(F.xxhash64("s")).collect()]
        want = sum(1 << i for i in range(64) if hashes and 2 * sum(h >> i & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(text) == want


def test_long_text_goes_through_in_chunks(monkeypatch):
    from plumbline.llm import common

    text = " ".join(str(i % 977) for i in range(3000))
    whole, sketch = simhash.fingerprint(text), similar.sketch(text, 5)
    chunks = common.word_chunks
    monkeypatch.setattr(common, "word_chunks", lambda data: chunks(data, 100))
    assert simhash.fingerprint(text) == whole
    assert similar.sketch(text, 5) == sketch


def test_near_groups_on_odd_rows(frame, odd_rows):
    docs = frame(odd_rows)
    got = simhash.near_groups(docs).collect()
    assert len(got) == len(odd_rows)
    prints = {r.fingerprint for r in got}
    labels = closure(sorted(simhash.signed(int(p, 16)) for p in prints), 2)
    least = defaultdict(list)
    for r in got:
        least[labels[simhash.signed(int(r.fingerprint, 16))]].append(r.doc_id)
    for r in got:
        ids = [i for i in least[labels[simhash.signed(int(r.fingerprint, 16))]] if i is not None]
        assert r.component_id == (min(ids) if ids else None)
    assert simhash.near_groups(docs.limit(0)).count() == 0
    assert simhash.one_of_each(docs).columns == docs.columns


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[1000 + i] == 1000 for i in range(300)) and len(got) == 361


def test_similar_groups_find_edited_copies_and_leave_others(spark, frame):
    rng = random.Random(9)
    words = [f"w{rng.getrandbits(40):x}" for _ in range(4000)]
    rows, base_of = [], {}
    for g in range(25):
        base = [rng.choice(words) for _ in range(200)]
        for copy in range(4):
            mine = list(base)
            for _ in range(copy):
                mine[rng.randrange(200)] = rng.choice(words)
            base_of[len(rows)] = g
            rows.append((len(rows), " ".join(mine), "en", "a"))
    kept = similar.one_of_each(frame(rows))
    ids = sorted(r.doc_id for r in kept.select("doc_id").collect())
    assert {base_of[i] for i in ids} == set(range(25))
    assert len(ids) <= 26  # an edited copy may escape now and then


def test_similar_stage_on_odd_rows(frame, odd_rows):
    docs = frame(odd_rows)
    kept = similar.one_of_each(docs)
    assert kept.columns == docs.columns
    assert kept.count() == 6  # blank texts, the prose, the long text, three others
    assert similar.one_of_each(docs.limit(0)).count() == 0


def brute_components(texts, least=0.8, width=5):
    def shingles(text):
        words = text.split()
        return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}

    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-9:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return label


def partition(labels):
    groups = defaultdict(set)
    for i, g in labels.items():
        groups[g].add(i)
    return {frozenset(g) for g in groups.values()}


def edited_texts():
    """Passages put in, taken out and replaced, similarities on both sides of 0.8; one crowded group of several families."""
    rng = random.Random(21)
    word = lambda: f"w{rng.getrandbits(40):x}"
    texts = []
    for _ in range(12):
        base = [word() for _ in range(200)]
        texts.append(base)
        for share in (0.05, 0.1, 0.15, 0.2, 0.22, 0.24, 0.26, 0.3):
            at, size = rng.randrange(150), int(200 * share)
            texts += [base[:at] + [word() for _ in range(size)] + base[at:], base[:at] + base[at + size * 4 // 5 :]]
    common_part = [word() for _ in range(150)]
    for _ in range(6):  # families that share a passage of three quarters, but are not alike
        own = [word() for _ in range(50)]
        for _ in range(12):
            copy = common_part + own
            for _ in range(rng.randrange(5)):
                copy[rng.randrange(200)] = word()
            texts.append(copy)
    return [" ".join(t) for t in texts]


def test_similar_groups_are_those_of_all_pairs(frame):
    texts = edited_texts()
    got = similar.similar_groups(frame([(i, t, "en", "a") for i, t in enumerate(texts)])).collect()
    want = partition(dict(enumerate(brute_components(texts))))
    assert 20 < len(want) < len(texts)
    assert partition({r._id: r.component for r in got}) == want


def pair_ids(frame, pairs):
    rows = [(2 * i + k, " ".join(words), "en", "a") for i, pair in enumerate(pairs) for k, words in enumerate(pair)]
    got = {r._id: r.component for r in similar.similar_groups(frame(rows)).collect()}
    return [got[2 * i] == got[2 * i + 1] for i in range(len(pairs))]


def test_inserted_and_deleted_passages_at_the_similarity_are_found(frame):
    rng = random.Random(33)
    word = lambda: f"w{rng.getrandbits(40):x}"
    pairs = []
    for i in range(40):
        base = [word() for _ in range(404)]  # 400 shingles
        more = [word() for _ in range(95)]  # at most 99 more: 400 / 499 is above 0.8
        pairs.append((base, more + base if i % 2 else base[:200] + [word() for _ in range(70)] + base[200:]))
    assert all(pair_ids(frame, pairs))


def test_long_texts_just_below_the_similarity_stay_apart(frame):
    rng = random.Random(34)
    word = lambda: f"w{rng.getrandbits(40):x}"
    pairs, want = [], []
    for i in range(40):
        base = [word() for _ in range(804)]  # 800 shingles; 200 more are 0.8 exactly, 201 are below
        pairs.append((base, base + [word() for _ in range(200 + i % 2)]))
        want.append(i % 2 == 0)
    assert pair_ids(frame, pairs) == want
