"""Quality rules by line labelling: a linear-chain CRF marks content and boilerplate.

A document is the sequence of its lines. Each line has a few binary features (length,
symbols, capitals, digits, repetition, endings); neighbours are tied by transitions.
Viterbi decoding labels all lines of a document together, and the share of word
characters in content lines decides whether the document is kept.

The field is trained here, by gradient ascent on the likelihood of partly labelled lines
(forward-backward with and without the known labels), from a bounded sample of labelled
documents: lines of good documents are content, lines of bad ones that look odd by plain
rules are boilerplate, and the rest is left for the model to infer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import common

#: Documents of each label, and lines of each document, that training sees at most.
SAMPLE_DOCS, SAMPLE_LINES = 1500, 64
SYMBOLS = "#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_DIGITS = bytes(range(48, 58))
_ODD = b"#*$%&|<>!=~^_{}[]\\@"
_ENDINGS = (b".", b"!", b"?", b":", b";", b'"', b"'", b")", "…".encode(), "»".encode(), "”".encode())

FEATURES = (
    "bias", "blank", "words_1_3", "words_4_10", "words_over_10", "odd_some", "odd_many", "capitals", "digits",
    "no_letters", "no_ending", "repetitive", "very_repetitive", "seen_before", "long_words", "short_words", "markup", "all_marked",
)
INDEX = {name: i for i, name in enumerate(FEATURES)}
BOILERPLATE, CONTENT, FREE = 0, 1, -1


def line_features(line: bytes, words: list[bytes], seen: bool) -> list[int]:
    """Numbers of the features that hold."""
    n = len(words)
    if not n:
        return [INDEX["bias"], INDEX["blank"]]
    size = len(line)
    letters = size - len(line.translate(None, _LETTERS))
    upper = size - len(line.translate(None, _UPPER))
    odd = size - len(line.translate(None, _ODD))
    digits = size - len(line.translate(None, _DIGITS))
    distinct = len(set(words))
    held = {
        "bias": True, "words_1_3": n <= 3, "words_4_10": 3 < n <= 10, "words_over_10": n > 10,
        "odd_some": 0.05 * n < odd <= 0.3 * n, "odd_many": odd > 0.3 * n, "capitals": letters > 20 and upper > 0.5 * letters,
        "digits": digits > 0.4 * size, "no_letters": not letters, "no_ending": not line.rstrip().endswith(_ENDINGS),
        "repetitive": n >= 10 and 0.2 * n < distinct <= 0.4 * n, "very_repetitive": n >= 10 and distinct <= 0.2 * n, "seen_before": seen,
        "long_words": letters > 18 * n, "short_words": letters < 2 * n, "markup": b"</" in line or b"|" in line,
        "all_marked": n >= 4 and sum(not w[-1:].isalnum() for w in words if w < b"\x80") > 0.7 * n,
    }
    return [INDEX[k] for k, v in held.items() if v]


def lines_of(text: str) -> Iterator[tuple[list[int], int]]:
    """Features and word characters of each line of the whole text, in order."""
    seen: set[bytes] = set()
    for line in common.utf8(text).split(b"\n"):
        words = line.split()
        yield line_features(line, words, bool(words) and line in seen), sum(len(w.decode("utf-8", "ignore")) for w in words) if not line.isascii() else sum(map(len, words))
        if words:
            seen.add(line)


@dataclass(frozen=True)
class Field:
    """Scores of content against boilerplate: per feature, per transition (from, to), at the start."""

    emit: tuple[float, ...]
    move: tuple[tuple[float, float], tuple[float, float]]
    start: tuple[float, float]

    def viterbi(self, lines: list[list[int]]) -> list[int]:
        """The best labels of a whole document."""
        if not lines:
            return []
        emit = self.emit
        (bb, bc), (cb, cc) = self.move
        b, c = self.start[0], self.start[1] + sum(emit[f] for f in lines[0])
        back = []
        for line in lines[1:]:
            gain = sum(emit[f] for f in line)
            to_b, to_c = c + cb > b + bb, c + cc >= b + bc
            back.append((to_b, to_c))
            b, c = (c + cb if to_b else b + bb), (c + cc if to_c else b + bc) + gain
        labels = [int(c >= b)]
        for step in reversed(back):
            labels.append(int(step[labels[-1]]))
        return labels[::-1]


def _marginals(emission: np.ndarray, mask: np.ndarray, move: np.ndarray, start: np.ndarray):
    """Log-partition, label marginals, summed transition and start marginals of padded sequences."""
    d, length, _ = emission.shape
    ahead = np.zeros((d, length, 2))
    ahead[:, 0] = emission[:, 0] + start
    for t in range(1, length):
        step = np.logaddexp(ahead[:, t - 1, :1] + move[0], ahead[:, t - 1, 1:] + move[1]) + emission[:, t]
        ahead[:, t] = np.where(mask[:, t, None], step, ahead[:, t - 1])
    log_z = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
    behind, pairs = np.zeros((d, length, 2)), np.zeros((2, 2))
    for t in range(length - 2, -1, -1):
        onward = behind[:, t + 1] + emission[:, t + 1]
        step = np.logaddexp(onward[:, :1] + move[:, 0], onward[:, 1:] + move[:, 1])
        behind[:, t] = np.where(mask[:, t + 1, None], step, behind[:, t + 1])
        joint = ahead[:, t, :, None] + move + onward[:, None, :] - log_z[:, None, None]
        pairs += (np.exp(joint) * mask[:, t + 1, None, None]).sum(axis=0)
    labels = np.exp(ahead + behind - log_z[:, None, None]) * mask[:, :, None]
    return log_z, labels, pairs, labels[:, 0].sum(axis=0)


def fit(documents: list[tuple[list[list[int]], list[int]]], steps: int = 120, rate: float = 0.1, l2: float = 0.01) -> Field:
    """Train on documents of (features of each line, label of each line or FREE)."""
    emit, move, start = np.zeros(len(FEATURES)), np.zeros((2, 2)), np.zeros(2)
    documents = [d for d in documents if d[0]]
    if documents:
        d, length = len(documents), max(len(x) for x, _ in documents)
        x, mask, known = np.zeros((d, length, len(FEATURES))), np.zeros((d, length), bool), np.zeros((d, length, 2))
        for i, (lines, labels) in enumerate(documents):
            for t, (line, label) in enumerate(zip(lines, labels, strict=True)):
                x[i, t, line] = 1
                mask[i, t] = True
                if label != FREE:
                    known[i, t, 1 - label] = -1e6
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (emit, move, start)]
        for k in range(1, steps + 1):
            emission = np.zeros((d, length, 2))
            emission[:, :, 1] = np.einsum("dlf,f->dl", x, emit)
            _, free, free_pairs, free_start = _marginals(emission, mask, move, start)
            _, held, held_pairs, held_start = _marginals(emission + known, mask, move, start)
            grads = (
                np.einsum("dl,dlf->f", held[:, :, 1] - free[:, :, 1], x) / d - l2 * emit,
                (held_pairs - free_pairs) / d - l2 * move,
                (held_start - free_start) / d - l2 * start,
            )
            for p, g, (m, v) in zip((emit, move, start), grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Field(tuple(emit.tolist()), tuple(map(tuple, move.tolist())), tuple(start.tolist()))


_ODDITIES = {INDEX[n] for n in ("odd_many", "capitals", "digits", "no_letters", "very_repetitive", "seen_before", "short_words")}


def weak_labels(lines: list[list[int]], good: bool | None) -> list[int]:
    """Content in good documents, odd lines of bad ones boilerplate, the rest free."""
    made = []
    for line in lines:
        odd, blank = not _ODDITIES.isdisjoint(line), INDEX["blank"] in line
        if blank:
            made.append(FREE)
        elif good:
            made.append(FREE if odd else CONTENT)
        elif odd:
            made.append(BOILERPLATE)
        else:
            made.append(CONTENT if good is None and INDEX["no_ending"] not in line else FREE)
    return made


@common.own_batches
def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Field:
    """Fit on at most SAMPLE_DOCS documents of each label: those whose hashed ids are least.

    Where no document is labelled, lines are labelled by the plain rules only, on as many
    documents.
    """
    picked = None
    for good in (1, 0):
        least = labels.where((F.col(f"`{label_col}`") == good) & F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("_id"), F.lit(good).alias("_good"))
        least = least.distinct().orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_DOCS)
        picked = least if picked is None else picked.unionByName(least)
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    sample = _sampled(rows.join(F.broadcast(picked), "_id"))  # at most 2 * SAMPLE_DOCS ids
    if not sample:
        some = rows.select("_id").where("_id IS NOT NULL").distinct().orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_DOCS)
        sample = _sampled(rows.join(F.broadcast(some), "_id").withColumn("_good", F.lit(None).cast("int")))
    return fit([(lines, weak_labels(lines, None if good is None else bool(good))) for lines, good in sample])


def _sampled(rows: DataFrame) -> list[tuple[list[list[int]], int | None]]:
    def features(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            made = [[f for f, _ in lines_of(t)][:SAMPLE_LINES] for t in common.texts_of(batch.column("_text"))]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.list_(pa.int32()))), batch.column("_good"), batch.column("_id")], ["lines", "good", "id"])

    common.small_batches(rows.sparkSession)
    schema = T.StructType([*T._parse_datatype_string("lines array<array<int>>, good int").fields, T.StructField("id", rows.schema["_id"].dataType)])
    found = rows.select("_id", "_text", "_good").mapInArrow(features, schema).collect()  # bounded: see SAMPLE_DOCS, SAMPLE_LINES
    return [([list(line) for line in r["lines"]], r["good"]) for r in sorted(found, key=lambda r: (str(r["id"]), str(r["lines"])))]


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words inside windows of ``width`` words that occur twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    codes: dict[bytes, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
    key = ids[:n]
    for i in range(1, width):
        if len(codes) * (int(key.max()) + 1) > 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(codes) + ids[i : i + n]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for i in range(width):
        covered[i : i + n] |= twice
    return int(covered.sum())


def text_counts(text: str) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of the whole text."""
    data = common.utf8(text)
    words = data.split()
    seen: set[bytes] = set()
    again = 0
    for line in data.split(b"\n"):
        if line in seen:
            again += 1
        elif line and not line.isspace():
            seen.add(line)
    spaces = sum(text.count(c) for c in " \t\n\v\f\r")
    return len(words), len(text) - spaces, sum(text.count(c) for c in SYMBOLS), again, repeated_words(words)


@common.own_batches
def judge(docs: DataFrame, field: Field, share: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, the base counts, ``base_failed, kept``, and
    ``content_share, n_content_lines, n_lines``.

    A null text has no words and no lines' worth of content; it and an empty text fail the
    base rules. ``content_share`` is 0 without words. Repeated rows are judged alike. An
    empty table gives no rows. Other columns are not read.
    """
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("_text"))
    added = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, content_share double, n_content_lines bigint, n_lines bigint"
    schema = T.StructType([rows.schema[id_col], *T._parse_datatype_string(added).fields])
    names = schema.names

    def one(text: str) -> tuple:
        counts = text_counts(text)
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        lines = list(lines_of(text))
        labels = field.viterbi([f for f, _ in lines])
        total = sum(n for _, n in lines)
        content = sum(n for (_, n), label in zip(lines, labels, strict=True) if label == CONTENT)
        part = content / total if total else 0.0
        return (*counts, failed, not failed and part >= share, part, sum(labels), len(lines))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 2
        for batch in it:
            made = [one(t) for t in common.texts_of(batch.column("_text"))]
            columns = zip(*made, strict=True) if made else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)

    return common.written(rows.mapInArrow(run, schema), "quality")
