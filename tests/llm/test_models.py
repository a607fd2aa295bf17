import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import common, katz, langid, quality

# ---- language ID -----------------------------------------------------------------------------


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = langid.Network.start(3)
    x, target = rng.integers(97, 130, (9, 5)).astype(np.intp), rng.integers(0, 3, 5)
    _, grad = langid.gradients(net, x, target)
    for weight, g in zip(net.parts(), grad.parts(), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = weight[at], 1e-2
        weight[at] = old + step
        up, _ = langid.gradients(net, x, target)
        weight[at] = old - step
        down, _ = langid.gradients(net, x, target)
        weight[at] = old
        assert abs((up - down) / (2 * step) - g[at]) < 2e-3 * max(1, abs(g[at]))


def test_pooling_reads_every_stretch(monkeypatch):
    net = langid.Network.start(3)
    texts = ["", "a", "é" * 500, "abc " * 1000, "12 34", "x" * 64, "y" * 65]
    whole = langid.pooled(net, texts)
    for t, p in zip(texts, whole, strict=True):
        spans = langid.stretches(t)
        votes = langid._VOTES[spans]
        if votes.any():
            each = langid.position_probabilities(net, np.ascontiguousarray(spans.T.astype(np.intp)))
            want = np.einsum("skb,bs->k", each, votes.astype(float)) / votes.sum()
            assert np.allclose(p, want, atol=1e-5)
        else:
            assert not p.any()
    monkeypatch.setattr(langid, "WIDTH", 3)
    assert np.allclose(langid.pooled(net, texts), whole, atol=1e-6)


def test_held_out_accuracy(spark, sf):
    docs = common.documents(spark, sf)
    held_out = common.in_fold("doc_id", 3, 1)
    model = langid.train(docs, usable=~held_out)
    got = langid.identify(docs, model).join(docs.select("doc_id", "lang", held_out.alias("h")), "doc_id").collect()
    held = [r for r in got if r.h]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_rows(frame, odd_rows):
    docs = frame(odd_rows)
    model = langid.train(docs, usable=F.lit(True))
    assert model.languages == ["de", "en", "es", "fr"] or model.languages == ["de", "en", "fr"] or "en" in model.languages
    got = langid.identify(docs, model).collect()
    assert len(got) == len(odd_rows)
    undetermined = {r.doc_id for r in got if r.lang_pred == "und"}
    assert {1, 2, 3, 9} <= undetermined and not {4, 5, 6, 8} & undetermined
    assert langid.train(docs.limit(0), usable=F.lit(True)).languages == []
    assert langid.identify(docs.limit(0), model).count() == 0
    unlabelled = langid.identify(docs, langid.Model([], None)).collect()
    assert {(r.lang_pred, r.score) for r in unlabelled} == {("und", 0.0)}
    kept = langid.accepted(docs, model, 0.0)
    assert kept.columns == docs.columns and kept.count() == sum(r.lang_pred != "und" for r in got)


# ---- quality ---------------------------------------------------------------------------------


def test_viterbi_is_the_best_of_all_labellings():
    rng = random.Random(1)
    draw = lambda: rng.uniform(-2, 2)
    field = quality.Field(tuple(draw() for _ in quality.FEATURES), ((draw(), draw()), (draw(), draw())), (draw(), draw()))

    def value(lines, labels):
        v = field.start[labels[0]] + sum(sum(field.emit[f] for f in line) for line, y in zip(lines, labels, strict=True) if y)
        return v + sum(field.move[a][b] for a, b in zip(labels, labels[1:], strict=False))

    for n in range(1, 8):
        lines = [rng.sample(range(len(quality.FEATURES)), 3) for _ in range(n)]
        best = max(value(lines, [k >> i & 1 for i in range(n)]) for k in range(1 << n))
        assert abs(value(lines, field.viterbi(lines)) - best) < 1e-9


def test_marginals_are_those_of_enumeration():
    rng = np.random.default_rng(2)
    emission, move, start = rng.normal(size=(1, 5, 2)), rng.normal(size=(2, 2)), rng.normal(size=2)
    log_z, labels, pairs, first = quality._marginals(emission, np.ones((1, 5), bool), move, start)
    total, want, want_pairs = 0.0, np.zeros((5, 2)), np.zeros((2, 2))
    for k in range(32):
        y = [k >> i & 1 for i in range(5)]
        p = math.exp(start[y[0]] + sum(emission[0, t, y[t]] for t in range(5)) + sum(move[a, b] for a, b in zip(y, y[1:], strict=False)))
        total += p
        for t in range(5):
            want[t, y[t]] += p
        for a, b in zip(y, y[1:], strict=False):
            want_pairs[a, b] += p
    assert abs(log_z[0] - math.log(total)) < 1e-9
    assert np.allclose(labels[0], want / total) and np.allclose(pairs, want_pairs / total) and np.allclose(first, want[0] / total)


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def test_base_counts(odd_rows):
    rng = random.Random(6)
    texts = [t for _, t, *_ in odd_rows] + ["".join(rng.choice(["a", "b ", " ", "\n", "\r", "é ", "#"]) for _ in range(80)) for _ in range(400)]
    for t in texts:
        assert quality.text_counts(t or "") == brute_counts(t)


def test_quality_agrees_with_labels_and_handles_odd_rows(spark, sf, frame, odd_rows):
    docs, labels = common.documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    field = quality.train(docs, labels)
    got = quality.judge(docs, field).join(labels, "doc_id").collect()
    good = [r for r in got if r.quality == 1 and not r.base_failed]
    bad = [r for r in got if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.97 * len(good)
    assert sum(r.kept for r in bad) <= 0.2 * len(bad)
    odd = quality.judge(frame(odd_rows), field).collect()
    assert len(odd) == len(odd_rows) and not any(r.kept for r in odd if r.doc_id in (1, 2, 3, 8, 9))
    assert quality.judge(frame(odd_rows).limit(0), field).count() == 0
    plain = quality.train(frame(odd_rows), labels.limit(0))
    assert len(plain.emit) == len(quality.FEATURES)


# ---- Katz backoff ----------------------------------------------------------------------------


class Brute:
    """Katz backoff word by word; '^' starts a history that the document's start cuts."""

    def __init__(self, docs, order):
        self.counts, self.d, self.state = [Counter() for _ in range(order + 1)], [None] * (order + 1), [None] * (order + 1)
        for words in docs:
            for j in range(len(words)):
                for n in range(1, order + 1):
                    self.counts[n][self.history(words, j, n), words[j]] += 1
        for n in range(1, order + 1):
            self.d[n] = katz.discounts([sum(v == r for v in self.counts[n].values()) for r in range(1, katz.K + 2)])
            by = defaultdict(list)
            for (h, w), c in self.counts[n].items():
                by[h].append((w, c))
            self.state[n] = {}
            for h, seen in by.items():
                total = sum(c for _, c in seen)
                freed, scale = sum(c * (1 - self.d[n][c - 1]) for _, c in seen if c <= katz.K) / total, 1.0
                if freed <= 0:
                    scale, freed = total / (total + 1), 1 / (total + 1)
                low = sum(self.p(n - 1, self.shorter(n, h), w) for w, _ in seen) if n > 1 else 0
                closed = 1 - low <= 1e-9
                self.state[n][h] = (total, scale / (1 - freed), 0.0) if closed else (total, scale, freed / (1 - low))

    @staticmethod
    def history(words, j, n):
        h = tuple(words[max(0, j - n + 1) : j]) if n > 1 else ()
        return h if len(h) == n - 1 else ("^", *h)

    @staticmethod
    def shorter(n, h):
        return () if n == 2 else h if h == ("^",) else h[1:]

    def p(self, n, h, w):
        if n == 0:
            return 1.0
        if h not in self.state[n]:
            return self.p(n - 1, self.shorter(n, h), w) if n > 1 else 1.0
        total, scale, weight = self.state[n][h]
        c = self.counts[n].get((h, w), 0)
        if c:
            return (self.d[n][c - 1] if c <= katz.K else 1) * c / total * scale
        return weight * (self.p(n - 1, self.shorter(n, h), w) if n > 1 else 1)


@pytest.mark.parametrize(("order", "sizes"), [(2, {}), (2, {"block": 300, "bucket": 200, "often": 20}), (3, {"block": 300, "bucket": 200, "often": 20})])
def test_scores_match_brute_force(spark, sf, frame, odd_rows, order, sizes):
    texts = [(r.doc_id, r.text) for r in common.documents(spark, sf).where("doc_id < 60").collect()]
    rows = [(1000 + i, t if t is None else t[:3000], lang, s) for i, (_, t, lang, s) in enumerate(odd_rows)] + [(i, t, "en", "a") for i, t in texts]
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "\n"] for i, t, *_ in rows}
    training = {i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2}
    brute = Brute([tokens[i] for i in sorted(training)], order)
    model = katz.train(frame(rows), ~common.in_fold("doc_id", 7, 2), order, **sizes)
    got = {r.doc_id: r for r in katz.score(model).collect()}
    assert set(got) == set(tokens)
    n, known = sum(len(tokens[i]) for i in training), {w for _, w in brute.counts[1]}
    for i, words in tokens.items():
        want = sum(math.log10(brute.p(order, brute.history(words, j, order), words[j])) for j in range(len(words)))
        base = sum(math.log10((brute.counts[1].get(((), w), 0) + 1) / (n + len(known) + 1)) for w in words)
        r = got[i]
        assert abs(r.score - want) < 1e-5 * max(1, abs(want)) and abs(r.base_score - base) < 1e-6
        assert (r.train, r.n_tokens, r.n_known, r.train_tokens) == (i in training, len(words), sum(w in known for w in words), n)
    for h in list(brute.state[order])[:20]:
        assert abs(sum(brute.p(order, h, w) for w in known) + brute.p(order, h, "not a word") - 1) < 1e-9


def test_katz_on_empty_and_untrained_tables(frame, odd_rows):
    empty = frame(odd_rows).limit(0)
    assert katz.score(katz.train(empty, F.lit(True))).count() == 0
    untrained = katz.score(katz.train(frame(odd_rows[:4]), F.lit(False))).collect()
    assert {r.train_tokens for r in untrained} == {0} and {r.score for r in untrained} == {0.0}


def test_discounts_fall_back_where_counts_of_counts_are_odd():
    assert np.allclose(katz.discounts([0] * 6), [1 - 0.5 / r for r in range(1, 6)])
    d = katz.discounts([100_000, 40_000, 20_000, 12_000, 8_000, 6_000])
    assert (d > 0).all() and (d < 1).all() and abs(d[0] - (2 * 40_000 / 100_000 - 0.36) / 0.64) < 1e-12


def test_registered_katz_query_backs_off_over_more_than_one_level(spark, sf, monkeypatch):
    from plumbline.llm import queries

    orders, train = [], katz.train

    def spy(*args, **kwargs):
        orders.append((model := train(*args, **kwargs)).order)
        return model

    monkeypatch.setattr(katz, "train", spy)
    queries.op5_katz_backoff(spark, sf)
    assert orders == [3]
