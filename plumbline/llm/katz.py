"""Language-model scoring by Katz backoff with Good-Turing discounts.

A token's probability given its history is the discounted relative frequency where the
n-gram occurs in the training texts, and else the history's backoff weight times the
probability given the shorter history; the recursion ends at single words, whose unseen
ones are one class. A weight makes each history's probabilities sum to exactly one: the
mass that discounting freed, over the shorter history's mass of words not seen here.

Work at scale, level by level (words, pairs, ... up to ``order``):

* texts become blocks of a few million tokens: word hashes and token numbers;
* a block asks for each distinct n-gram it has, once, with its training count: requests
  go to a bucket named by the history (a very frequent history is spread over the buckets
  by the next word, its sums are gathered separately);
* a bucket merges its requests into a stored table of counts (one partition per bucket),
  the counts of counts of all buckets give the discounts, and the answers go back;
* the next level uses the answers as its shorter-history probabilities.

No task holds more than a block or a bucket, and what is sent is packed arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import common

#: Tokens of a block (whole documents), requests of a bucket (about), counts that are discounted.
BLOCK, BUCKET, K = 1 << 20, 1 << 21, 5
#: A history that occurs this often is spread over all buckets.
SPREAD = 1 << 20
_END = xxhash.xxh64_intdigest(b"\n")  # no word has a line feed
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _MIX
    return (x ^ (x >> np.uint64(29))) * _MIX


def _bucket(route: np.ndarray, buckets: int) -> np.ndarray:
    """The top bits."""
    bits = buckets.bit_length() - 1
    return (route >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(route), np.int64)


def _in_order(bucket: np.ndarray, history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Row numbers sorted by bucket, history and word."""
    small = np.uint64(1 << 32)
    if len(word) and bucket.max() < 1 << 16 and history.max() < small and word.max() < small:
        first = np.argsort((history << np.uint64(32)) | word)
        return first[np.argsort(bucket[first].astype(np.uint16), kind="stable")]
    return np.lexsort((word, history, bucket))


#: What an answer's arrays are, by their type.
_MEANING = {"f4": "p", "u8": "ids", "u4": "count"}


# ---- blocks ----------------------------------------------------------------------------------


def blocks(docs: DataFrame, training: Column, id_col: str, text_col: str, block: int = BLOCK) -> DataFrame:
    """``block, ids, train, lens, tokens, words, n_words``: lists of documents as packed arrays.

    ``words`` are the block's distinct word hashes in rising order; ``tokens`` are places in them.
    """
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), training.alias("_train"), F.col(f"`{text_col}`").alias("_text"))
    fields = T._parse_datatype_string("block bigint, train binary, lens binary, tokens binary, words binary, n_words bigint, n_tokens bigint").fields
    schema = T.StructType([T.StructField("ids", T.ArrayType(rows.schema["_id"].dataType)), *fields])

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, kind = TaskContext.get().partitionId() << 32, None
        codes: dict[bytes, int] = {}
        ids, train, lens, tokens = [], [], [], []

        def made() -> pa.RecordBatch:
            hashes = _mixed(np.array([_END, *[xxhash.xxh64_intdigest(w) for w in codes]], np.uint64))
            rising = np.argsort(hashes)
            place = np.empty(len(rising), np.uint32)
            place[rising] = np.arange(len(rising), dtype=np.uint32)
            all_tokens = place[np.concatenate(tokens)]
            columns = [
                [ids], [number], [common.pack(np.array(train, bool).view(np.uint8))], [common.pack(np.array(lens, np.uint32))],
                [common.pack(all_tokens)], [common.pack(np.diff(hashes[rising], prepend=np.uint64(0)))], [len(hashes)], [len(all_tokens)],
            ]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, [pa.list_(kind), pa.int64(), *[pa.binary()] * 4, pa.int64(), pa.int64()], strict=True)], schema.names
            )

        size = 0
        for batch in it:
            kind = batch.column("_id").type
            for doc, used, text in zip(batch.column("_id").to_pylist(), batch.column("_train").to_pylist(), common.texts_of(batch.column("_text")), strict=True):
                words = common.utf8(text).lower().split()
                n = len(words) + 1
                one = np.zeros(n, np.uint32)  # the end is number 0
                one[:-1] = np.fromiter((codes.setdefault(w, len(codes) + 1) for w in words), np.uint32, n - 1)
                ids.append(doc)
                train.append(bool(used))
                lens.append(n)
                tokens.append(one)
                size += n
                if size >= block:
                    yield made()
                    number, size, codes = number + 1, 0, {}
                    ids, train, lens, tokens = [], [], [], []
        if ids:
            yield made()

    return rows.mapInArrow(cut, schema)


@dataclass
class Level:
    """What a block knows of one level: per position the number of its n-gram, per n-gram the answers."""

    at: np.ndarray  # (positions,) -> n-gram number
    order: np.ndarray  # request order of the n-grams
    ids: np.ndarray | None = None
    p: np.ndarray | None = None
    count: np.ndarray | None = None


@dataclass
class Block:
    """One block, with as many levels as answers have come for."""

    ids: list
    train: np.ndarray
    lens: np.ndarray
    tokens: np.ndarray
    starts: np.ndarray
    levels: list[Level] = field(default_factory=list)

    @staticmethod
    def of(ids: list, train: bytes, lens: bytes, tokens: bytes) -> Block:
        (flags,), (sizes,), (numbers,) = common.unpack(train), common.unpack(lens), common.unpack(tokens)
        starts = np.concatenate([[0], np.cumsum(sizes[:-1], dtype=np.int64)])
        return Block(ids, flags.astype(bool), sizes, numbers.astype(np.int64), starts)

    def training_positions(self) -> np.ndarray:
        return np.repeat(self.train, self.lens)

    def grams(self, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (history number, word number) of the next level, and each position's number."""
        last = self.levels[-1].at
        history = np.empty(len(last), np.int64)
        history[1:] = last[:-1] + 1
        history[self.starts] = 0  # the start of a document is a history of its own
        key = history * shift + self.tokens
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        at = np.empty(len(key), np.int64)
        at[order] = np.cumsum(new) - 1
        distinct = ordered[new]
        return distinct // shift, distinct % shift, at

    def begin(self, n_words: int) -> None:
        """The first level: single words, which stand in request order already."""
        self.levels.append(Level(self.tokens, np.arange(n_words)))

    def counts(self) -> np.ndarray:
        """Training counts of the newest level's n-grams."""
        level = self.levels[-1]
        return np.bincount(level.at[self.training_positions()], minlength=len(level.order)).astype(np.uint32)

    def ask(self, spread: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
        """Requests of the next level in order: bucket, history id, word id, training count, lower probability.

        Appends the level."""
        first, last = self.levels[0], self.levels[-1]
        history, word, at = self.grams(len(first.ids))
        # The start's id is 0, that of all others is at least 1.
        histories = np.concatenate([np.zeros(1, np.uint64), last.ids])[history]
        ids = first.ids[word]
        # The shorter history's probability of the same word stands at any position of this n-gram.
        somewhere = np.empty(len(history), np.int64)
        somewhere[at] = np.arange(len(at))
        # (Scoring only needs the order of the requests: then no probability was asked for.)
        lower = last.p[last.at[somewhere]] if last.p is not None else np.zeros(len(history), np.float32)
        route = _mixed(histories)
        where = np.minimum(np.searchsorted(spread, histories), len(spread) - 1)
        hot = spread[where] == histories
        route[hot] ^= _mixed(ids[hot] + np.uint64(1))
        bucket = _bucket(route, buckets)
        order = _in_order(bucket, histories, ids)
        self.levels.append(Level(at, order))
        return bucket[order], histories[order], ids[order], self.counts()[order], lower[order]

    def hear(self, answers: list[tuple[int, bytes]]) -> None:
        """Put the answers (by bucket, in request order) to the newest level's n-grams."""
        level = self.levels[-1]
        parts = [common.unpack(blob) for _, blob in sorted(answers)]
        for arrays in zip(*parts, strict=True):
            got = np.concatenate(arrays)
            put = np.empty_like(got)
            put[level.order] = got
            setattr(level, _MEANING[got.dtype.str[1:]], put)


def _with_answers(table: DataFrame, answers: DataFrame | None, columns: list[str]) -> DataFrame:
    if answers is None:
        return table.select(*columns, F.array().cast("array<struct<level:int,bucket:bigint,blob:binary>>").alias("said"))
    heard = answers.groupBy("block").agg(F.collect_list(F.struct("level", "bucket", "blob")).alias("said"))
    return table.select(*columns).join(heard.hint("shuffle_hash"), "block")


def _blocks_in(batch: pa.RecordBatch, level: int, spreads: list[np.ndarray], buckets: int) -> Iterator[tuple[int, Block]]:
    """Blocks with ``level - 1`` levels answered."""
    for i in range(batch.num_rows):
        row = {n: batch.column(n)[i].as_py() for n in ("block", "ids", "train", "lens", "tokens", "n_words", "said")}
        block = Block.of(row["ids"], row["train"], row["lens"], row["tokens"])
        for n in range(1, level):
            if n == 1:
                block.begin(row["n_words"])
            else:
                block.ask(spreads[n - 1], buckets)
            block.hear([(s["bucket"], s["blob"]) for s in row["said"] if s["level"] == n])
        yield row["block"], block


_COLUMNS = ["block", "ids", "train", "lens", "tokens", "n_words"]


def _cut_by(bucket: np.ndarray) -> list[tuple[int, int]]:
    """First and last row of each bucket in turn."""
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist()
    return list(zip(cuts, [*cuts[1:], len(bucket)], strict=True))


def requests(table: DataFrame, answers: DataFrame | None, level: int, spreads: list[np.ndarray], buckets: int) -> DataFrame:
    """``bucket, block, blob``: what the blocks ask of the buckets at this level."""

    def said(number: int, bucket: np.ndarray, blobs: list[bytes], parts: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([int(bucket[a]) for a, _ in parts], pa.int64()), pa.array([number] * len(parts), pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "block", "blob"]
        )

    def ask_words(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i, (number, block) in enumerate(_blocks_in(batch, 1, spreads, buckets)):
                words = np.cumsum(common.unpack(batch.column("words")[i].as_py())[0], dtype=np.uint64)
                block.begin(len(words))
                count, bucket = block.counts(), _bucket(words, buckets)
                parts = _cut_by(bucket)
                yield said(number, bucket, [common.pack(np.diff(words[a:b], prepend=np.uint64(0)), count[a:b]) for a, b in parts], parts)

    def ask(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for number, block in _blocks_in(batch, level, spreads, buckets):
                bucket, history, word, count, lower = block.ask(spreads[level - 1], buckets)
                parts = _cut_by(bucket)
                blobs = [common.pack(np.diff(history[a:b], prepend=np.uint64(0)), word[a:b], count[a:b], lower[a:b]) for a, b in parts]
                yield said(number, bucket, blobs, parts)

    made = "bucket bigint, block bigint, blob binary"
    if level == 1:
        return _with_answers(table, None, [*_COLUMNS, "words"]).mapInArrow(ask_words, made)
    return _with_answers(table, answers, _COLUMNS).mapInArrow(ask, made)


# ---- buckets ---------------------------------------------------------------------------------

_STORED = (
    "level int, bucket bigint, histories binary, words binary, counts binary, lowers binary, asked array<struct<block:bigint,blob:binary>>, "
    "n_r array<bigint>, total bigint, types bigint, hot array<bigint>, sums array<struct<history:bigint,total:bigint,t:array<bigint>,low:double>>"
)


def _sums(history: np.ndarray, count: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per history (sorted): its id and first row, the total count, types by count 1..K, lower mass of seen words."""
    first = np.flatnonzero(np.concatenate([[True], history[1:] != history[:-1]]))
    total = np.add.reduceat(count.astype(np.int64), first)
    types = np.stack([np.add.reduceat((count == r).astype(np.int64), first) for r in range(1, K + 1)], axis=1)
    low = np.add.reduceat(np.where(count > 0, lower, 0).astype(np.float64), first)
    return history[first], first, total, types, low


def store(asked: DataFrame, level: int, spread: np.ndarray, buckets: int, often: int = SPREAD) -> DataFrame:
    """One row per bucket: its n-grams (sorted by history and word) with training counts, and who asked."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        bucket = int(rows["bucket"].iloc[0])
        parts = []
        for blob in rows["blob"]:
            if level == 1:
                steps, count = common.unpack(blob)
                word = np.cumsum(steps, dtype=np.uint64)
                parts.append((np.zeros(len(word), np.uint64), word, count, np.zeros(len(word), np.float32)))
            else:
                steps, word, count, lower = common.unpack(blob)
                parts.append((np.cumsum(steps, dtype=np.uint64), word, count, lower))
        history, word, count, lower = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = _in_order(np.zeros(len(word), np.int64), history, word)
        h, w = history[order], word[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])])
        first = np.flatnonzero(new)
        place = np.empty(len(h), np.int64)
        place[order] = np.cumsum(new) - 1
        summed = np.add.reduceat(count[order].astype(np.int64), first)
        h, w, low = h[first], w[first], lower[order][first]
        ends = np.cumsum([len(p[1]) for p in parts])
        who = [
            {"block": int(b), "blob": common.pack(np.diff(place[e - len(p[1]) : e], prepend=0).astype(np.uint32))}
            for b, p, e in zip(rows["block"], parts, ends, strict=True)
        ]
        sums = []
        if len(spread):
            ids, _, total, types, mass = _sums(h, summed, low)
            for i in np.flatnonzero(np.isin(ids, spread)):
                sums.append({"history": int(ids[i].astype(np.int64)), "total": int(total[i]), "t": types[i].tolist(), "low": float(mass[i])})
        hot = np.flatnonzero(summed >= often) * buckets + bucket + 1
        row = {
            "level": level, "bucket": bucket, "histories": common.pack(np.diff(h, prepend=np.uint64(0))), "words": common.pack(w),
            "counts": common.pack(summed.astype(np.uint32)), "lowers": common.pack(low), "asked": who,
            "n_r": [int((summed == r).sum()) for r in range(1, K + 2)], "total": int(summed.sum()), "types": int((summed > 0).sum()),
            "hot": hot.tolist(), "sums": sums,
        }
        return pd.DataFrame([row])

    return asked.groupBy("bucket").applyInPandas(merge, _STORED)


def discounts(n_r: list[int]) -> np.ndarray:
    """Good-Turing factors of counts 1..K after Katz. Where the counts of counts give none
    between 0 and 1 (small or odd corpora), half a count is taken off instead."""
    made = np.array([1 - 0.5 / r for r in range(1, K + 1)])
    if n_r[0] > 0:
        big = (K + 1) * n_r[K] / n_r[0]
        for r in range(1, K + 1):
            if n_r[r - 1] > 0 and n_r[r] > 0 and big < 1:
                d = ((r + 1) * n_r[r] / (n_r[r - 1] * r) - big) / (1 - big)
                if 0 < d < 1:
                    made[r - 1] = d
    return made


def probabilities(history: np.ndarray, count: np.ndarray, lower: np.ndarray, d: np.ndarray, level: int, spread: dict[int, tuple]) -> np.ndarray:
    """Katz probabilities of n-grams sorted by history (all of a history's seen words are here, or in ``spread``)."""
    ids, first, total, types, low = _sums(history, count, lower)
    if spread:
        for i in np.flatnonzero(np.isin(ids, np.array(sorted(spread), np.uint64))):
            total[i], types[i], low[i] = spread[int(ids[i])]
    if level == 1:
        low = np.zeros_like(low)  # the unseen words are one class, with all the mass there is
    r = np.arange(1, K + 1)
    sure = np.maximum(total, 1)
    freed = (types * (r * (1 - d))).sum(axis=1) / sure
    scale = np.ones(len(ids))
    none = (freed <= 0) & (total > 0)  # nothing to discount: one more, unseen, event
    scale[none] = total[none] / (total[none] + 1)
    freed = np.where(none, 1 / (total + 1.0), freed)
    rest = 1 - low
    closed = (rest <= 1e-9) & (total > 0)  # every word was seen here
    scale[closed] /= 1 - freed[closed]
    weight = np.where(total > 0, np.where(closed, 0.0, freed / np.where(rest <= 1e-9, 1, rest)), 1.0)
    of = np.repeat(np.arange(len(first)), np.diff([*first, len(history)]))
    factor = np.concatenate([[0.0], d, [1.0]])[np.minimum(count, K + 1)]
    seen = factor * count / sure[of] * scale[of]
    unseen = weight[of] * (lower if level > 1 else 1.0)
    return np.where(count > 0, seen, unseen).astype(np.float32)


def answers(stored: DataFrame, level: int, want: str, d: np.ndarray, spread: dict[int, tuple], buckets: int) -> DataFrame:
    """``level, block, bucket, blob``: of ``p`` (probability), ``ids`` and ``count``, what ``want`` names."""

    def answer(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in ("bucket", "histories", "counts", "lowers", "asked")}
                history = np.cumsum(common.unpack(row["histories"])[0], dtype=np.uint64)
                (count,), (lower,) = common.unpack(row["counts"]), common.unpack(row["lowers"])
                p = probabilities(history, count.astype(np.int64), lower, d, level, spread)
                said = []
                for who in row["asked"]:
                    at = np.cumsum(common.unpack(who["blob"])[0], dtype=np.int64)
                    can = {"p": p, "ids": (np.arange(len(p)) * buckets + row["bucket"] + 1).astype(np.uint64), "count": count}
                    said.append(common.pack(*[can[name][at] for name in want.split()]))
                n = len(said)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([level] * n, pa.int32()), pa.array([w["block"] for w in row["asked"]], pa.int64()), pa.array([row["bucket"]] * n, pa.int64()), pa.array(said, pa.binary())],
                    ["level", "block", "bucket", "blob"],
                )

    return stored.select("bucket", "histories", "counts", "lowers", "asked").mapInArrow(answer, "level int, block bigint, bucket bigint, blob binary")


# ---- the model and the scores ----------------------------------------------------------------


@dataclass
class Katz:
    """A trained model over given blocks: a stored table per level, and what its answers need."""

    order: int
    buckets: int
    table: DataFrame
    stored: list[DataFrame]
    answers: DataFrame
    spreads: list[np.ndarray]
    tokens: int
    types: int


@common.own_batches
def train(
    docs: DataFrame, training: Column, order: int = 2, id_col: str = "doc_id", text_col: str = "text",
    block: int = BLOCK, bucket: int = BUCKET, often: int = SPREAD,
) -> Katz:
    """Count and discount the n-grams of the ``training`` rows; other rows are scored only.

    ``block`` tokens make a block (a longer document is one of its own), ``bucket``
    requests a bucket, and a history that occurs ``often`` is spread over all buckets.
    They change memory and balance, never the result.
    """
    if order < 2:
        raise ValueError("order must be at least 2")
    spark = docs.sparkSession
    table = common.written(blocks(docs, training, id_col, text_col, block), "katz-blocks")
    total = table.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    buckets = common.power_of_two(max(8, total // bucket))
    common.small_batches(spark, rows=1)  # from here on, a row is a block or a bucket
    spreads, kept, known, tokens, types = [np.zeros(1, np.uint64)], [], [], 0, 0

    def said(last: str, first: str) -> DataFrame | None:
        """Answers of all levels so far: ``last`` of the newest, ``first`` of single words, ids of those between."""
        made = None
        for n, (d, spread) in enumerate(known, start=1):
            one = answers(kept[n - 1], n, last if n == len(known) else first if n == 1 else "ids", d, spread, buckets)
            made = one if made is None else made.unionByName(one)
        return made

    for level in range(1, order + 1):
        asked = requests(table, said("p ids", "ids"), level, spreads, buckets)
        stored = common.written(store(asked, level, spreads[-1], buckets, often), f"katz-level{level}")
        kept.append(stored)
        stats = stored.agg(
            *[F.coalesce(F.sum(F.col("n_r")[r]), F.lit(0)).alias(f"n{r}") for r in range(K + 1)],
            F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("types"), F.lit(0)).alias("types"),
        ).first()
        if level == 1:
            tokens, types = stats["total"], stats["types"]
        # Spread histories occur at least ``often`` times each, so they are few: one row each.
        sums = (
            stored.select(F.explode("sums").alias("s")).select("s.*").groupBy("history")
            .agg(F.sum("total").alias("total"), *[F.sum(F.col("t")[r]).alias(f"t{r}") for r in range(K)], F.sum("low").alias("low"))
            .collect()
        )
        spread = {r["history"]: (r["total"], [r[f"t{i}"] for i in range(K)], r["low"]) for r in sums}
        known.append((discounts([stats[f"n{r}"] for r in range(K + 1)]), spread))
        hot = [r["h"] for r in stored.select(F.explode("hot").alias("h")).collect()]
        spreads.append(np.array(sorted({0, *hot}), np.uint64))
    return Katz(order, buckets, table, kept, said("p", "ids count"), spreads, tokens, types)


@common.own_batches
def score(model: Katz, id_col: str = "doc_id") -> DataFrame:
    """One row per document: the id, ``train, n_tokens, n_known, train_tokens, base_score, score``.

    ``score`` is the log10 probability of the whole text, its end included; ``base_score``
    that of single words with one added to each count. A null or empty text is its end
    alone. Repeated rows are scored each for itself. An empty table gives no rows.
    """
    order, spreads, buckets, tokens, types = model.order, model.spreads, model.buckets, model.tokens, model.types

    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            kind = batch.schema.field("ids").type.value_type
            for _, block in _blocks_in(batch, order + 1, spreads, buckets):
                first, last = block.levels[0], block.levels[-1]
                count = first.count.astype(np.float64)
                base = np.log10((count + 1) / (tokens + types + 1))
                each = lambda values: np.add.reduceat(values, block.starts)
                columns = [
                    block.ids, block.train, block.lens.astype(np.int64), each((first.count > 0)[first.at].astype(np.int64)),
                    np.full(len(block.ids), tokens), each(base[first.at]), each(np.log10(last.p.astype(np.float64))[last.at]),
                ]
                kinds = [kind, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    names = [id_col, "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    fields = T._parse_datatype_string("train boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double").fields
    schema = T.StructType([T.StructField(id_col, model.table.schema["ids"].dataType.elementType), *fields])
    common.small_batches(model.table.sparkSession, rows=1)
    return common.written(_with_answers(model.table, model.answers, _COLUMNS).mapInArrow(sums, schema), "katz-scores")
