"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes (A-Z lower-cased) are cut into stretches of ``SPAN`` bytes; the whole
text is read, stretch by stretch. In each stretch one gated recurrent unit runs forwards
and one backwards; their two states label every position with language probabilities.
A document's probabilities are the mean over the positions of its letters.

The network is trained here, in numpy, by backpropagation through time with Adam, on a
bounded sample of labelled documents. Scoring is one pass over the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import common

#: Bytes of a stretch, size of each direction's state.
SPAN, HIDDEN = 64, 8
#: Documents of each language and stretches of each document that training sees at most.
SAMPLE_DOCS, SAMPLE_SPANS = 400, 12
#: Hash cells in which the sample is chosen first.
CELLS = 256
STEPS, BATCH, RATE, SEED = 500, 256, 0.02, 7
#: Stretches that are run through the network at once.
WIDTH = 4096
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
#: Bytes that vote: ASCII letters and all bytes of other characters.
_VOTES = np.array([97 <= b <= 122 or b >= 128 for b in range(256)])


@dataclass
class Network:
    """Weights. A direction's gates are update, reset and candidate, in this order."""

    byte_f: np.ndarray  # (3H, 256): what each byte adds to the gates
    back_f: np.ndarray  # (3H, H): what the state adds
    byte_b: np.ndarray
    back_b: np.ndarray
    out_f: np.ndarray  # (K, H)
    out_b: np.ndarray
    bias: np.ndarray  # (K, 1)

    def parts(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    @staticmethod
    def start(languages: int, seed: int = SEED) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
        h, k = HIDDEN, languages
        return Network(draw(3 * h, 256), draw(3 * h, h), draw(3 * h, 256), draw(3 * h, h), draw(k, h), draw(k, h), np.zeros((k, 1), np.float32))


def _run(byte: np.ndarray, back: np.ndarray, x: np.ndarray, keep: bool):
    """States (S, H, B) of one direction over ``x`` (S, B); with ``keep`` also what training needs."""
    h = back.shape[1]
    steps, width = x.shape
    byte, back = byte.copy(), back.copy()
    byte[: 2 * h] *= 0.5  # a sigmoid is half a tanh of half its input, plus a half
    back[: 2 * h] *= 0.5
    state = np.zeros((h, width), np.float32)
    states = np.empty((steps, h, width), np.float32)
    gates, rec = np.empty((3 * h, width), np.float32), np.empty((3 * h, width), np.float32)
    held = []
    for t in range(steps):
        np.take(byte, x[t], axis=1, out=gates, mode="clip")
        np.matmul(back, state, out=rec)
        both, cand = gates[: 2 * h], gates[2 * h :]
        both += rec[: 2 * h]
        np.tanh(both, out=both)
        both *= 0.5
        both += 0.5
        if keep:
            held.append((state.copy(), gates.copy(), rec[2 * h :].copy()))
        rec[2 * h :] *= both[h:]
        cand += rec[2 * h :]
        np.tanh(cand, out=cand)
        if keep:
            held[-1][1][2 * h :] = cand
        state -= cand
        state *= both[:h]
        state += cand
        states[t] = state
    return states, held


def _softmax(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(axis=-2, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=-2, keepdims=True)
    return logits


def position_probabilities(net: Network, x: np.ndarray) -> np.ndarray:
    """(S, K, B): a distribution over languages at every position of every stretch."""
    ahead, _ = _run(net.byte_f, net.back_f, x, False)
    behind, _ = _run(net.byte_b, net.back_b, x[::-1], False)
    logits = np.matmul(net.out_f, ahead)
    logits += np.matmul(net.out_b, behind)[::-1]
    logits += net.bias
    return _softmax(logits)


def _through_time(back: np.ndarray, x: np.ndarray, held: list, d_states: np.ndarray, d_byte: np.ndarray, d_back: np.ndarray) -> None:
    """Backpropagate one direction; adds to the gradients of its weights."""
    h = back.shape[1]
    d_next = np.zeros_like(d_states[0])
    for t in range(len(x) - 1, -1, -1):
        before, gates, rec_n = held[t]
        update, reset, cand = gates[:h], gates[h : 2 * h], gates[2 * h :]
        d = d_states[t] + d_next
        d_cand = d * (1 - update) * (1 - cand * cand)
        d_update = d * (before - cand) * update * (1 - update)
        d_reset = d_cand * rec_n * reset * (1 - reset)
        d_gates = np.concatenate([d_update, d_reset, d_cand])
        d_rec = np.concatenate([d_update, d_reset, d_cand * reset])
        d_back += d_rec @ before.T
        d_next = d * update + back.T @ d_rec
        for g in range(len(d_gates)):
            d_byte[g] += np.bincount(x[t], d_gates[g], 256)


def gradients(net: Network, x: np.ndarray, target: np.ndarray) -> tuple[float, Network]:
    """Mean cross-entropy of the voting positions' labels, and its gradient."""
    ahead, held_f = _run(net.byte_f, net.back_f, x, True)
    behind, held_b = _run(net.byte_b, net.back_b, x[::-1], True)
    probs = _softmax(np.matmul(net.out_f, ahead) + np.matmul(net.out_b, behind)[::-1] + net.bias)
    votes = _VOTES[x].astype(np.float32)
    n = max(1.0, float(votes.sum()))
    loss = float(-(np.log(probs[:, target, np.arange(x.shape[1])] + 1e-9) * votes).sum() / n)
    d = probs.copy()
    d[:, target, np.arange(x.shape[1])] -= 1
    d *= votes[:, None, :] / n
    grad = Network(*[np.zeros_like(p) for p in net.parts()])
    grad.out_f += np.matmul(d, ahead.transpose(0, 2, 1)).sum(axis=0)
    grad.out_b += np.matmul(d[::-1], behind.transpose(0, 2, 1)).sum(axis=0)
    grad.bias += d.sum(axis=(0, 2))[:, None]
    _through_time(net.back_f, x, held_f, np.matmul(net.out_f.T, d), grad.byte_f, grad.back_f)
    _through_time(net.back_b, x[::-1], held_b, np.matmul(net.out_b.T, d)[::-1], grad.byte_b, grad.back_b)
    return loss, grad


def fit(spans: np.ndarray, targets: np.ndarray, languages: int, steps: int = STEPS) -> Network:
    """Train on stretches (N, SPAN) of bytes with the language number of each."""
    net, rng = Network.start(languages), np.random.default_rng(SEED)
    first, second = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()]
    for k in range(1, steps + 1):
        pick = rng.integers(0, len(spans), min(BATCH, len(spans)))
        _, grad = gradients(net, np.ascontiguousarray(spans[pick].T.astype(np.intp)), targets[pick])
        norm = float(np.sqrt(sum((g * g).sum() for g in grad.parts())))
        rate = RATE * min(1.0, 2 * (1 - (k - 1) / steps))
        for p, g, m, v in zip(net.parts(), grad.parts(), first, second, strict=True):
            g *= min(1.0, 1 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return net


def stretches(text: str) -> np.ndarray:
    """All of the text as (n, SPAN) bytes, the last one padded with zeros."""
    data = common.utf8(text).lower()
    n = -(-len(data) // SPAN)
    out = np.zeros(n * SPAN, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, SPAN)


def pooled(net: Network, texts: list[str]) -> np.ndarray:
    """(documents, K): the mean over each text's voting positions; zeros where none votes."""
    k = len(net.bias)
    sums, votes = np.zeros((len(texts), k)), np.zeros(len(texts))
    waiting, owners, size = [], [], 0

    def flush() -> None:
        rows, owner = np.concatenate(waiting), np.concatenate(owners)
        for i in range(0, len(rows), WIDTH):
            x = np.ascontiguousarray(rows[i : i + WIDTH].T.astype(np.intp))
            mask = _VOTES[x]
            part = np.einsum("skb,sb->bk", position_probabilities(net, x), mask.astype(np.float32))
            np.add.at(sums, owner[i : i + WIDTH], part)
            np.add.at(votes, owner[i : i + WIDTH], mask.sum(axis=0))
        waiting.clear()
        owners.clear()

    for i, text in enumerate(texts):
        spans = stretches(text)
        # A huge text goes through in parts.
        for j in range(0, len(spans), WIDTH):
            part = spans[j : j + WIDTH]
            waiting.append(part)
            owners.append(np.full(len(part), i))
            size += len(part)
            if size >= WIDTH:
                flush()
                size = 0
    if waiting:
        flush()
    return sums / np.maximum(votes, 1)[:, None]


@dataclass
class Model:
    languages: list[str]
    net: Network | None

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        named, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        read = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if self.net is not None else []
        probs = pooled(self.net, [texts[i] for i in read]) if read else np.zeros((0, 0))
        for i, p in zip(read, probs, strict=True):
            best = int(p.argmax())
            named[i], scores[i] = self.languages[best], min(1.0, float(p[best]))
        return named, scores


@common.own_batches
def train(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from at most SAMPLE_DOCS documents of each label among the ``usable`` ones.

    They are those whose hashed ids are least, so a rerun learns the same. Rows without a
    label or an id are passed over. Without any, the model knows no language.
    """
    labelled = docs.where(usable & F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull())
    ids = labelled.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{lang_col}`").alias("_lang"))
    # First inside hash cells of a language, then over what the cells leave: no task sees a whole language.
    first = lambda df, *keys: df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("_id"), "_id"))).where(F.col("_n") <= SAMPLE_DOCS).drop("_n")
    celled = ids.distinct().withColumn("_cell", F.pmod(F.hash("_id"), F.lit(CELLS)))
    picked = first(first(celled, "_lang", "_cell").drop("_cell"), "_lang")
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{lang_col}`").alias("_lang"), F.col(f"`{text_col}`").alias("_text"))
    sample = rows.join(F.broadcast(picked), ["_id", "_lang"])  # at most SAMPLE_DOCS ids of a language

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            made = []
            for text in common.texts_of(batch.column("_text")):
                spans = stretches(text)
                at = np.unique(np.linspace(0, len(spans) - 1, SAMPLE_SPANS).round().astype(int)) if len(spans) else []
                made.append(spans[at].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("_lang"), batch.column("_id").cast(pa.string()), pa.array(made, pa.binary())], ["_lang", "_key", "spans"])

    common.small_batches(docs.sparkSession)
    found = sample.select("_lang", "_id", "_text").mapInArrow(cut, "_lang string, _key string, spans binary").collect()  # bounded as said
    found = sorted((r for r in found if r["spans"]), key=lambda r: (r["_lang"], r["_key"], r["spans"]))
    languages = sorted({r["_lang"] for r in found})
    if not languages:
        return Model([], None)
    number = {lang: i for i, lang in enumerate(languages)}
    blocks = [np.frombuffer(r["spans"], np.uint8).reshape(-1, SPAN) for r in found]
    targets = np.concatenate([np.full(len(b), number[r["_lang"]]) for r, b in zip(found, blocks, strict=True)])
    return Model(languages, fit(np.concatenate(blocks), targets, len(languages)))


@common.own_batches
def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``lang_pred, score``.

    ``lang_pred`` is ``und`` (score 0) for a null text, one without any letter, or where
    the model knows no language. Every byte of a text is read. Equal texts get equal
    results. An empty table gives no rows. Other columns are not read.
    """
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("_text"))
    schema = T.StructType([rows.schema[id_col], *T._parse_datatype_string("lang_pred string, score double").fields])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            named, scores = model.predict(batch.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(named, pa.string()), pa.array(scores, pa.float64())], schema.names)

    return common.written(rows.mapInArrow(run, schema), "languages")


def accepted(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is determined with a score of at least ``least``, unchanged."""
    common.small_batches(docs.sparkSession)
    known = [f"`{c}`" for c in docs.columns]
    doc = docs.select(F.struct(*[F.col(c) for c in known]).alias("_doc"))

    @F.pandas_udf("double")
    def confidence(texts):
        import pandas as pd

        named, scores = model.predict([None if t is None else t for t in texts])
        return pd.Series([s if n != UNDETERMINED else -1.0 for n, s in zip(named, scores, strict=True)])

    return doc.where(confidence(F.col("_doc").getField(text_col)) >= least).select("_doc.*")
