"""The pipeline's near-dedup goes through fingerprints, and loses nothing that they cannot reach."""

import random

from plumbline.llm import similar, simhash


def test_linked_fingerprints_are_compared_first(frame, monkeypatch):
    rng = random.Random(7)
    texts = [" ".join(f"w{rng.getrandbits(30):x}" for _ in range(400)) for _ in range(30)]
    near = [t + " end" for t in texts[:10]]  # few bits differ
    far = [" ".join(w if i % 100 else "edit" for i, w in enumerate(t.split())) for t in texts[10:20]]
    rows = list(enumerate(texts + near + far))
    asked, plain = [], similar.linked_texts

    def seen(docs, made, pairs, *rest):
        asked.append({frozenset((p.a, p.b)) for p in pairs.collect()})
        ids.update({r._row: r._id for r in made.collect()})
        return plain(docs, made, pairs, *rest)

    ids: dict[int, int] = {}
    monkeypatch.setattr(similar, "linked_texts", seen)
    got = {r._id: r.component for r in similar.similar_groups(frame([(i, t, "en", "a") for i, t in rows])).collect()}
    assert all(got[i] == got[30 + i] for i in range(20)) and len(set(got.values())) == 30
    prints = {i: simhash.fingerprint(t) for i, t in rows}
    close = {frozenset((i, j)) for i in prints for j in prints if i < j and (prints[i] ^ prints[j]).bit_count() <= 2}
    assert close and {frozenset(ids[r] for r in p) for p in asked[0]} == close
