"""Importance resampling towards a target distribution, by array scores and exact selection.

1. Arrays: a text becomes the array of its features' buckets (hashed word n-grams). Each
   bucket's log ratio of target to source frequency is its gain; a document's weight is
   the floored mean of its buckets' gains. Scores add Gumbel noise drawn from the id.
2. Selection: the cutoff key (score down, id up) of the ``k`` best is found by weighted
   median-of-medians. Every partition names the median of what remains in it; the pivot is
   the median of these, each weighted by its partition's remaining rows, so at least a
   quarter of all remaining rows lies on either side of it. The side that cannot hold
   the cutoff goes, and what is left is written anew, so the rounds cost a geometric sum.
   Neither the scores nor the winners are gathered: the driver sees one row per partition.
3. The winners are sorted: ranges of keys, ranked inside, with the ranges' offsets added.

The source's and the target's counts are arrays of ``buckets`` numbers, a parameter.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import common
from plumbline.operators import ordered

#: ASCII letters in lower case, ASCII digits and all other UTF-8 bytes are word bytes; the rest parts words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Distinct features that a worker remembers the buckets of.
MEMO = 200_000
#: Texts are cut in stretches of about this many bytes.
STRETCH = 1 << 20
#: When so few rows remain, they are ranked in one task.
FEW = 4096


class _Buckets(dict):
    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[feature] = made = zlib.crc32(feature) % self.buckets
        return made


def features(data: bytes, width: int, memo: _Buckets) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every run of 1 to ``width`` words."""
    n, made, tail = 0, [], []
    for start, end in stretches(data):
        words = data[start:end].translate(_FOLD).split()
        n += len(words)
        made.append(np.fromiter(map(memo.__getitem__, words), np.int32, len(words)))
        for k in range(2, width + 1):  # a run that ends in this stretch; its first words may stand in the last one
            line = tail[len(tail) - min(len(tail), k - 1):] + words
            runs = [b" ".join(line[i : i + k]) for i in range(len(line) - k + 1)]
            made.append(np.fromiter(map(memo.__getitem__, runs), np.int32, len(runs)))
        tail = (tail + words)[-(width - 1):] if width > 1 else []
    return n, np.concatenate(made) if made else np.zeros(0, np.int32)


_GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def stretches(data: bytes, size: int = STRETCH) -> Iterator[tuple[int, int]]:
    """Ranges of about ``size`` bytes that end between words."""
    start = 0
    while start < len(data):
        gap = _GAP.search(data, start + size) if start + size < len(data) else None
        end = gap.start() if gap else len(data)
        yield start, end
        start = end


def bucket_arrays(docs: DataFrame, id_col: str | None, text_col: str, width: int, buckets: int) -> DataFrame:
    """``_row, _id, n_words, n_features, _buckets`` of every row; ``_buckets`` packs one number per feature."""
    common.small_batches(docs.sparkSession)
    dtype = "<u2" if buckets <= 1 << 16 else "<u4"
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"), (F.lit(0) if id_col is None else F.col(f"`{id_col}`")).alias("_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")).alias("_text"),
    )
    schema = T.StructType([T.StructField("_row", T.LongType()), rows.schema["_id"], *T._parse_datatype_string("n_words bigint, n_features bigint, _buckets binary").fields])

    def make(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Buckets(buckets)
        for batch in it:
            made = [features(t.as_py(), width, memo) for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([
                batch.column("_row"), batch.column("_id"), pa.array([n for n, _ in made], pa.int64()),
                pa.array([len(b) for _, b in made], pa.int64()), pa.array([b.astype(dtype).tobytes() for _, b in made], pa.binary()),
            ], schema.names)

    return rows.mapInArrow(make, schema)


def bucket_counts(arrays: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs; every task sends one array of sums, and Spark adds them up."""
    dtype = "<u2" if buckets <= 1 << 16 else "<u4"

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in it:
            for blob in batch.column("_buckets"):
                total += np.bincount(np.frombuffer(blob.as_buffer(), dtype), minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(total[hit], pa.int64())], ["bucket", "n"])

    found = arrays.select("_buckets").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    made = np.zeros(buckets, np.int64)
    for r in found:  # at most ``buckets`` rows
        made[r["bucket"]] = r["n"]
    return made


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket 1000 times the log ratio of target to source share (one added to each count), floored."""
    size, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array(
        [math.floor(1000 * math.log((t + 1) * (s_all + size) / ((s + 1) * (t_all + size)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64
    )


def noise(id_col: str, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 8 hex digits of the SHA-256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def weighted(arrays: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """``_row, _id, n_words, n_features, weight, score``; the gains go to every task (``buckets`` numbers)."""
    table = arrays.sparkSession.sparkContext.broadcast(gain)
    dtype = "<u2" if len(gain) <= 1 << 16 else "<u4"
    schema = T.StructType([*[arrays.schema[c] for c in ("_row", "_id", "n_words", "n_features")], T.StructField("weight", T.LongType())])

    def weigh(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worth = table.value
        for batch in it:
            made = []
            for blob in batch.column("_buckets"):
                own = np.frombuffer(blob.as_buffer(), dtype)
                made.append(int(worth[own].sum()) // len(own) if len(own) else 0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("_row", "_id", "n_words", "n_features")], pa.array(made, pa.int64())], schema.names)

    return arrays.mapInArrow(weigh, schema).withColumn("score", F.col("weight") + noise("_id", seed))


# ---- selection ---------------------------------------------------------------------------------

_KEY = ["score", "_id", "_row"]
_BEST_FIRST = [("score", "descending"), ("_id", "ascending"), ("_row", "ascending")]


def before(key: dict) -> Column:
    """True for rows that rank before ``key``: higher score, then smaller id (null last), then row."""
    score, i, row = F.col("score"), F.col("_id"), F.col("_row")
    if key["_id"] is None:
        same_id, smaller = i.isNull(), i.isNotNull()
    else:
        same_id, smaller = i.eqNullSafe(F.lit(key["_id"])), F.coalesce(i < F.lit(key["_id"]), F.lit(False))
    same = score == F.lit(key["score"])
    return (score > F.lit(key["score"])) | (same & smaller) | (same & same_id & (row < F.lit(key["_row"])))


def partition_medians(keys: DataFrame) -> list:
    """Per partition its median key and number of rows."""
    schema = T.StructType([*[keys.schema[c] for c in _KEY], T.StructField("rows", T.LongType())])

    def median(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in it if b.num_rows]
        if parts:
            all_rows = pa.Table.from_batches(parts)
            middle = pc.sort_indices(all_rows, sort_keys=_BEST_FIRST)[(len(all_rows) - 1) // 2].as_py()
            one = all_rows.slice(middle, 1).combine_chunks()
            yield from one.append_column("rows", pa.array([len(all_rows)], pa.int64())).to_batches()

    return keys.mapInArrow(median, schema).collect()


def weighted_median(medians: list) -> dict:
    """The median key at which the rows of the partitions up to it reach half of all rows."""
    order = sorted(medians, key=lambda m: (-m["score"], m["_id"] is None, 0 if m["_id"] is None else m["_id"], m["_row"]))
    half, run = sum(m["rows"] for m in order) / 2, 0
    for m in order:
        run += m["rows"]
        if run >= half:
            return {c: m[c] for c in _KEY}
    raise ValueError("no rows")


def cutoff(keys: DataFrame, k: int, few: int = FEW) -> dict | None:
    """The ``k``-th key of ``keys`` (``score, _id, _row``) in rank order, or None if ``k`` is 0."""
    if k <= 0:
        return None
    left = keys.count()
    if k > left:
        raise ValueError("fewer rows than asked for")
    while left > few:
        pivot = weighted_median(partition_medians(keys))
        ahead = before(pivot)
        first = keys.where(ahead).count()  # rows before the pivot; the pivot is the next one
        if k == first + 1:
            return pivot
        if k <= first:
            keys, left = keys.where(ahead), first
        else:
            is_pivot = (F.col("_row") == F.lit(pivot["_row"])) & (F.col("score") == F.lit(pivot["score"]))
            keys, left, k = keys.where(~ahead & ~is_pivot), left - first - 1, k - first - 1
        keys = common.written(keys, "resample-left")
    rest = keys.orderBy(F.desc("score"), F.asc_nulls_last("_id"), "_row").limit(k).collect()  # at most ``few`` rows
    return {c: rest[-1][c] for c in _KEY}


@common.own_batches
def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
    width: int = 1, buckets: int = 10_000, seed: int = 2024, percent: int = 10, least_words: int = 20, few: int = FEW,
) -> DataFrame:
    """One row per input row: the id, ``n_features, weight, score, rank`` (all long).

    Of the rows with at least ``least_words`` words the floor of ``percent`` per cent with
    the highest scores are drawn; ``rank`` counts them from 1, ties in score to the smaller id
    (null last, then in table order), and is null for all others. A null or empty text has no
    features and weight 0. A null id draws its noise as an empty one. Repeated rows are rows
    of their own. An empty target makes all its counts 0; an empty table gives no rows. Other
    columns are not read.
    """
    arrays = common.written(bucket_arrays(docs, id_col, text_col, width, buckets), "resample-arrays")
    gain = gains(bucket_counts(arrays, buckets), bucket_counts(bucket_arrays(target, None, target_text, width, buckets), buckets))
    scored = common.written(weighted(arrays, gain, seed), "resample-scores")
    able = scored.where(F.col("n_words") >= least_words)
    last = cutoff(able.select(*_KEY), able.count() * percent // 100, few)
    names = [F.col("_id").alias(id_col), "n_features", "weight", "score"]
    if last is None:
        return scored.select(*names, F.lit(None).cast("bigint").alias("rank"))
    won = able.where(before(last) | (F.col("_row") == F.lit(last["_row"])))
    ranked = ordered.numbered(won, [F.desc("score"), F.asc_nulls_last("_id"), F.col("_row")], "rank").select("_row", "rank")
    return scored.join(ranked, "_row", "left").select(*names, "rank")
