import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from plumbline.llm import common, infill, oddsketch, resample

# ---- odd sketches -----------------------------------------------------------------------------


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, width=4):
    w = words_of(text)
    return {" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute_near(rows, share=(4, 5)):
    sets, label = [shingles(t) for _, t, *_ in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and label[i] != label[j] and both * share[1] >= share[0] * (len(sets[i]) + len(sets[j]) - both):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (i, *_), c in zip(rows, label, strict=True):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    return [(i, len(s), least.get(c), i == least.get(c)) for (i, *_), s, c in zip(rows, sets, label, strict=True)]


def as_rows(got):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got)


def brute_rows(rows):
    return sorted((str(i), n, str(c), k) for i, n, c, k in brute_near(rows))


def test_near_groups_on_odd_rows(frame, odd_rows):
    rows = odd_rows + [(30, "one two", "en", "a"), (31, "One\tTWO", "en", "a"), (32, "one two three", "en", "a")]
    got = oddsketch.near_groups(frame(rows), width=4).collect()
    assert as_rows(got) == brute_rows(rows)
    assert oddsketch.near_groups(frame(rows).limit(0)).count() == 0


def families():
    """Copies with passages put in, taken out and replaced around 0.8, a crowd that shares a passage, and short texts."""
    rng = random.Random(8)
    word = lambda: f"w{rng.getrandbits(32):x}"
    texts = []
    for _ in range(6):
        base = [word() for _ in range(120)]
        texts.append(base)
        for share in (0.05, 0.1, 0.15, 0.2, 0.24, 0.26, 0.3):
            at, size = rng.randrange(80), int(120 * share)
            texts += [base[:at] + [word() for _ in range(size)] + base[at:], base[:at] + base[at + size * 4 // 5 :]]
    passage = [word() for _ in range(60)]
    for _ in range(50):  # share three quarters, yet are not alike: their buckets are crowded
        texts.append(passage + [word() for _ in range(20)])
    for _ in range(45):  # a large family of near copies
        copy = passage + passage[::-1]
        copy[rng.randrange(60, 120)] = word()
        texts.append(copy)
    texts += [[word()] for _ in range(3)] + [["same", "three", "words"]] * 2
    rng.shuffle(texts)
    return [(i, " ".join(t), "en", "a") for i, t in enumerate(texts)]


def test_near_groups_are_those_of_all_pairs(frame, monkeypatch):
    rows = families()
    want = brute_rows(rows)
    assert 60 < len({c for _, _, c, _ in want}) < len(rows)
    for crowd in (32, 4):  # with small buckets, and with most of the work left to the exact way
        monkeypatch.setattr(oddsketch, "CROWD", crowd)
        assert as_rows(oddsketch.near_groups(frame(rows), width=4).collect()) == want


def test_exactly_the_similarity_is_linked(frame):
    rng = random.Random(3)
    word = lambda: f"w{rng.getrandbits(32):x}"
    rows, want = [], []
    for i in range(20):
        base = [word() for _ in range(403)]  # 400 shingles; 100 more are 0.8 exactly, 101 are below
        rows += [(2 * i, " ".join(base), "en", "a"), (2 * i + 1, " ".join(base + [word() for _ in range(100 + i % 2)]), "en", "a")]
        want.append(i % 2 == 0)
    got = {r.doc_id: r.component_id for r in oddsketch.near_groups(frame(rows), width=4).collect()}
    assert [got[2 * i] == got[2 * i + 1] for i in range(20)] == want


def test_sketches_estimate_high_similarities():
    rng = np.random.default_rng(4)
    k = oddsketch.BANDS * oddsketch.ROWS
    factors, summands = oddsketch.coefficients(k)
    for wanted in (0.95, 0.8, 0.6):
        found = []
        for _ in range(60):
            n = 400
            both = round(2 * n * wanted / (1 + wanted))
            draw = lambda m: rng.integers(0, 1 << 63, m).astype(np.uint64) * np.uint64(2)
            base = draw(both)
            sets = [np.unique(np.concatenate([base, draw(n - both)])) for _ in range(2)]
            one, two = oddsketch.odd_sketches(np.stack([oddsketch.samples(s, factors, summands) for s in sets]), oddsketch.BITS)
            differing = sum(int(a ^ b).bit_count() if int(a ^ b) >= 0 else (int(a ^ b) % 2**64).bit_count() for a, b in zip(one, two, strict=True))
            found.append(oddsketch.estimated(differing, k, oddsketch.BITS))
            if wanted == 0.8:
                assert differing <= oddsketch.most_differing(0.8, k, oddsketch.BITS)
        assert abs(np.mean(found) - wanted) < 0.02
    assert oddsketch.estimated(oddsketch.most_differing(0.8, k, oddsketch.BITS), k, oddsketch.BITS) > 0.5


def test_long_texts_go_through_in_chunks(monkeypatch):
    data = " ".join(str(i % 977) for i in range(3000)).encode()
    whole = common.shingle_set(data, 4, common.WordHashes())
    counted = resample.features(data, 2, resample._Buckets(997))
    chunks = common.word_chunks
    monkeypatch.setattr(common, "word_chunks", lambda d: chunks(d, 100))
    stretches = resample.stretches
    monkeypatch.setattr(resample, "stretches", lambda d: stretches(d, 100))
    assert (common.shingle_set(data, 4, common.WordHashes()) == whole).all()
    n, buckets = resample.features(data, 2, resample._Buckets(997))
    assert n == counted[0] == 3000 and Counter(buckets.tolist()) == Counter(counted[1].tolist())


# ---- resampling -------------------------------------------------------------------------------


def brute_resample(rows, targets, width=1, buckets=10_000, seed=2024, percent=10, least=20):
    def of(text):
        words = [w for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
        return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, width + 1) for i in range(len(words) - k + 1)]

    docs, goal = [of(t) for _, t, *_ in rows], [of(t) for t in targets]
    s, t = Counter(b for _, f in docs for b in f), Counter(b for _, f in goal for b in f)
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out = []
    for (i, *_), (n, f) in zip(rows, docs, strict=True):
        weight = sum(gain(b) for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: len(able) * percent // 100], start=1):
        r[4] = rank
    return sorted(str(r[:5]) for r in out)


def test_resampling_matches_brute_force(spark, frame, odd_rows):
    rng = random.Random(6)
    vocabulary = [f"v{i}" for i in range(60)] + ["été", "x-y", "A1"]
    rows = odd_rows + [(100 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 19, 20, 40]))), "en", "a") for i in range(200)]
    targets = ["v1 v2 v3 été v1", None, "", "V1 v9 x-y"]
    goal = spark.createDataFrame([(i, t, "x") for i, t in enumerate(targets)], "item_id int, text string, score string")
    for options in ({}, {"width": 2, "buckets": 97, "percent": 35, "least_words": 6, "few": 8}, {"percent": 100, "few": 1}, {"percent": 0}):
        got = resample.resample(frame(rows), goal, **options).collect()
        plain = {("least" if k == "least_words" else k): v for k, v in options.items() if k != "few"}
        assert sorted(str([r.doc_id, r.n_features, r.weight, r.score, r["rank"]]) for r in got) == brute_resample(rows, targets, **plain)
    assert resample.resample(frame(rows).limit(0), goal).count() == 0
    assert resample.resample(frame(rows), goal.limit(0)).count() == len(rows)


def test_cutoff_with_ties_and_one_large_partition(spark):
    rng = random.Random(1)
    keys = [(rng.choice([1, 2, 3, 50]), rng.choice([None, *range(40)]), i) for i in range(700)]
    order = sorted(keys, key=lambda k: (-k[0], k[1] is None, k[1] or 0, k[2]))
    df = spark.createDataFrame(keys, "score long, _id long, _row long")
    for parts in (1, 5):
        for k in (1, 2, 175, 350, 699, 700):
            got = resample.cutoff(df.repartition(parts), k, few=4)
            assert (got["score"], got["_id"], got["_row"]) == order[k - 1]
    assert resample.cutoff(df, 0) is None


def test_a_pivot_has_a_quarter_on_either_side(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(rng.randrange(10**6), i, i) for i in range(3000)], "score long, _id long, _row long").repartition(7).sortWithinPartitions("score")
    pivot = resample.weighted_median(resample.partition_medians(df))
    ahead = df.where(resample.before(pivot)).count()
    assert 750 <= ahead + 1 and ahead <= 2250


# ---- fill in the middle -----------------------------------------------------------------------


def brute_infill(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    d = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        form, out, sizes = "plain", text, (None, None)
    else:
        form = "spm" if h[3] % 100 < spm else "psm"
        out = f"<P>{pre}<S>{suf}<M>{mid}" if form == "psm" else f"<S>{suf}<P>{pre}<M>{mid}"
        sizes = len(pre), len(mid)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return str((doc_id, n, form, *sizes, sha(out), sha(text)))


def infill_rows(odd_rows):
    rng = random.Random(2)
    lines = ["", "é ü", "a b", "<P", "S>", "x" * 50, "<M"]
    return odd_rows + [(200 + i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(12))) + rng.choice(["", "\n", "\r\n"]), "en", "a") for i in range(150)] + [
        (400, "a <P> b\nc", "en", "a"), (401, "\n", "en", "a"), (402, "\n\n\n", "en", "a"), (403, "<S>", "en", "a"), (404, "😀\n" * 9, "en", "a")
    ]


def test_infill_matches_brute_force_and_restores(frame, odd_rows, monkeypatch):
    rows = infill_rows(odd_rows)
    for piece, options in ((1 << 16, {}), (8, {}), (64, {"rate": 40, "spm_share": 90, "seed": 3})):
        monkeypatch.setattr(infill, "PIECE", piece)
        monkeypatch.setattr(infill.unit_chunks, "__defaults__", (piece,))
        got = infill.transform(frame(rows), **options).collect()
        plain = {("spm" if k == "spm_share" else k): v for k, v in options.items()}
        assert sorted(str(tuple(r)) for r in got) == sorted(brute_infill(i, t, **plain) for i, t, *_ in rows)
    assert infill.transform(frame(rows).limit(0)).count() == 0


def test_pieces_in_order_are_the_output(frame, odd_rows):
    rows = [r for r in infill_rows(odd_rows) if r[0] is not None and r[0] != 5]
    parts = infill.texts(frame(rows)).collect()
    outputs, names = {}, {}
    for p in sorted(parts, key=lambda p: (p["_row"], p["_place"])):
        outputs[p["_row"]] = outputs.get(p["_row"], "") + p["piece"]
        if p["_place"] == 0:
            names[p["_row"]] = p["doc_id"]
    want = {r.doc_id: r.output_sha256 for r in infill.transform(frame(rows)).collect()}
    assert {names[k]: hashlib.sha256(v.encode()).hexdigest() for k, v in outputs.items()} == want


def test_unit_chunks_are_whole_units():
    for data in (b"", b"\n", b"a\nb\nc", b"abc" * 50, b"ab\n" * 40 + b"end"):
        for size in (1, 4, 7, 1000):
            parts = list(infill.unit_chunks(data, size))
            assert b"".join(parts) == data and all(p.endswith(b"\n") for p in parts[:-1])
