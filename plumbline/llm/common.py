"""Helpers shared by the operators: scans, fixed character classes, written tables, batches."""

from __future__ import annotations

import io
import re
import struct
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache, wraps

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import session
from plumbline.sources import tables

#: A word: a run of anything but the six ASCII space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Words that a worker remembers the hashes of; an odd number that spreads bits.
WORDS, MIX = 200_000, 0x9E3779B97F4A7C15
#: One ASCII space character.
SPACE = r"[\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.scan(session.configure(spark), sf_dir, "documents")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh folder that all executors share and read it back.

    This cuts the lineage: a later loss of executors costs no recomputation of what
    was written, and every reader sees the same rows. Nothing reads the shuffle files of
    the write again, so Spark may remove them when it ends.
    """
    spark = df.sparkSession
    path = session.shared_dir(spark, name)
    with settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.written_at = path
    return made


def discard(df: DataFrame) -> None:
    """Delete the folder of a :func:`written` table that nothing will read any more."""
    where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
    where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for a while; they are put back as they were."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def own_batches(operator):
    """For an operator that sets Arrow batch sizes on its way: the session has its own again afterwards."""

    @wraps(operator)
    def run(first, *args, **kwargs):
        spark = (first if isinstance(first, DataFrame) else first.table).sparkSession
        with settings(spark, {name: spark.conf.get(name) for name in _BATCH}):
            return operator(first, *args, **kwargs)

    return run


_BATCH = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bound what one Python worker receives at once, in rows and in bytes."""
    for name, value in zip(_BATCH, (rows, 8 << 20), strict=True):
        spark.conf.set(name, str(value))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def power_of_two(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def id_remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null for a null id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(modulus))


def in_fold(doc_id: str | Column, modulus: int, remainder: int) -> Column:
    """True where the id falls in the fold; a null id falls in none."""
    return F.coalesce(id_remainder(doc_id, modulus) == remainder, F.lit(False))


def word_count(text: str | Column) -> Column:
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("bigint")


def texts_of(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def utf8(text: str) -> bytes:
    """UTF-8 bytes; a lone surrogate (not valid Unicode) becomes '?'."""
    return text.encode("utf-8", "replace")


def batches(it: Iterator[pa.RecordBatch], names: list[str], types: list[pa.DataType], make) -> Iterator[pa.RecordBatch]:
    """Map each Arrow batch with ``make(batch) -> list of columns``."""
    for batch in it:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(make(batch), types, strict=True)], names)


@lru_cache(maxsize=1)
def _compressor() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=1)


@lru_cache(maxsize=1)
def _decompressor() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def pack(*arrays) -> bytes:
    """Several numpy arrays as one compressed blob; bytes of equal weight stand together."""
    import numpy as np

    out = io.BytesIO()
    out.write(struct.pack("<B", len(arrays)))
    for a in arrays:
        a = np.ascontiguousarray(a)
        kind = a.dtype.str.encode().ljust(4)
        out.write(struct.pack("<4sQ", kind, len(a)))
        out.write(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
    return _compressor().compress(out.getvalue())


def unpack(blob: bytes) -> list:
    import numpy as np

    raw = _decompressor().decompress(bytes(blob))
    n, at, arrays = raw[0], 1, []
    for _ in range(n):
        kind, length = struct.unpack_from("<4sQ", raw, at)
        dtype = np.dtype(kind.decode().strip())
        at += 12
        size = length * dtype.itemsize
        if not length:
            arrays.append(np.zeros(0, dtype))
            continue
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(dtype.itemsize, length)
        arrays.append(np.ascontiguousarray(planes.T).view(dtype).reshape(length))
        at += size
    return arrays


_GAP = re.compile(rb"[\x20\x09-\x0D]")


def word_chunks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of ``data``, about ``size`` bytes at a time, so that a huge text needs little memory."""
    if len(data) <= size:
        yield data.split()
        return
    start = 0
    while start < len(data):
        gap = _GAP.search(data, min(start + size, len(data)))
        end = gap.start() if gap else len(data)
        yield data[start:end].split()
        start = end


def mixed(x):
    """64-bit numbers (an unsigned numpy array) with their bits mixed."""
    import numpy as np

    x = (x ^ (x >> np.uint64(31))) * np.uint64(MIX)
    return x ^ (x >> np.uint64(29))


class WordHashes(dict):
    """64-bit hashes of words, as many as a worker may remember."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        self[word] = made = xxhash.xxh64_intdigest(word, 11)
        return made


def shingle_set(data: bytes, width: int, memo: WordHashes):
    """64-bit hashes of the distinct shingles, sorted: one for fewer than ``width`` words, none without words."""
    import numpy as np

    steps = np.array([pow(0x5851F42D4C957F2D, k + 1, 1 << 64) for k in range(width)], np.uint64)
    made, tail = [], []
    for words in word_chunks(data.lower()):
        words = tail + words
        n = len(words) - width + 1
        if n > 0:
            w = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
            made.append(np.unique(mixed(sum(w[k : k + n] * steps[k] for k in range(width)))))
        tail = words[-(width - 1):] if width > 1 else []
    if not made:
        return np.array([xxhash.xxh64_intdigest(b" ".join(tail), 12)] if tail else [], np.uint64)
    return np.unique(np.concatenate(made)) if len(made) > 1 else made[0]


def mark(text: str | Column) -> Column:
    """A 64-bit hash of the text as it stands; with the id it tells a table's rows apart."""
    col = F.col(f"`{text}`") if isinstance(text, str) else text
    return F.xxhash64(F.coalesce(col, F.lit("")))


def same_mark(a: DataFrame, b: DataFrame) -> Column:
    return a["_id"].eqNullSafe(b["_id"]) & (a["_mark"] == b["_mark"])


def keep_once(docs: DataFrame, stays: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` named by ``stays`` (``_id, _mark, _times``), each once, with all columns.

    Where a document is stored ``_times`` > 1 times, the row whose columns hash least stays.
    """
    stays = written(stays.select("_id", "_mark", "_times"), "stays")
    doc = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    rows = doc.select("_doc", F.col("_doc").getField(id_col).alias("_id"), mark(F.col("_doc").getField(text_col)).alias("_mark"))
    once = stays.where("_times = 1")
    kept = rows.join(once, same_mark(rows, once), "left_semi").select("_doc")
    if stays.where("_times > 1").take(1):
        twice = stays.where("_times > 1")
        kept = kept.unionByName(
            rows.join(twice, same_mark(rows, twice), "left_semi")
            .groupBy("_id", "_mark")
            .agg(F.min_by("_doc", F.xxhash64(F.to_json("_doc"))).alias("_doc"))
            .select("_doc")
        )
    return kept.select("_doc.*")
