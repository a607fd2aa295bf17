"""Fill-in-middle transformation by secondary-sort assembly.

A text is cut into units (lines). Two places between units, drawn from a hash of the id,
part it into prefix, middle and suffix. The parts travel as pieces of whole units, each
keyed by its document and its place in the output:

1. the scan emits the pieces; one shuffle brings a document's pieces to one partition,
   sorted by (document, output place) - ``repartition`` and ``sortWithinPartitions``, the
   DataFrame form of ``repartitionAndSortWithinPartitions``;
2. the sorted pieces stream through an incremental digest of the output. What streams is
   the output itself, sentinels included; from it and the form alone each piece gets its
   place in the restored text;
3. the partition is sorted again by (document, restored place), which needs no shuffle,
   and the pieces stream through the digest of the restored text.

No task holds more than a batch of pieces, however many documents or units it has; a hot
source is spread, as documents are dealt by row. Texts stay bytes, so any text is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import common

#: The sentinels of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes of a piece, about: it ends with the unit that reaches this size.
PIECE = 1 << 16
#: The order of parts in the output, by form; each part stands behind its sentinel.
LAYOUT = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
#: The order of parts in the text.
TEXT_ORDER = (PREFIX, MIDDLE, SUFFIX)
#: Restored places: part number times this, plus the piece's place in the output.
PART = 1 << 40


def draws(id_col: str, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of ``seed:id`` (a null id is empty)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]


def code_points(data: bytes) -> int:
    """Code points of UTF-8 bytes: those that are no continuation bytes."""
    return int((np.frombuffer(data, np.uint8) & 0xC0 != 0x80).sum()) if data else 0


def parted(data: bytes, h: tuple[int, int, int, int], rate: int, spm_share: int) -> tuple[int, str, list[bytes]]:
    """Number of units, form, and prefix, middle, suffix (a plain text is one part)."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1 if data else np.zeros(0, np.int64)
    if data and (not len(ends) or ends[-1] != len(data)):
        ends = np.append(ends, len(data))
    n = len(ends)
    if not data or h[2] % 100 >= rate or any(s in data for s in TEXT_ORDER):
        return n, "plain", [data]
    one, two = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = (int(ends[k - 1]) if k else 0 for k in (one, two))
    return n, "spm" if h[3] % 100 < spm_share else "psm", [data[:a], data[a:b], data[b:]]


def unit_chunks(data: bytes, size: int = PIECE) -> Iterator[bytes]:
    """Whole units, about ``size`` bytes at a time; an empty part is one empty piece."""
    at = 0
    while True:
        end = data.find(b"\n", min(at + size, len(data)) - 1) + 1 if len(data) - at > size else 0
        if not end:
            yield data[at:]
            return
        yield data[at:end]
        at = end
        if at == len(data):
            return


def pieces(docs: DataFrame, id_col: str, text_col: str, seed: int, rate: int, spm_share: int) -> DataFrame:
    """``_row, _place, _id, n, form, prefix_chars, middle_chars, _bytes``: the output in pieces.

    What describes the document stands on its first piece only. ``_bytes`` is the output
    at ``_place``: a part's first piece begins with its sentinel.
    """
    common.small_batches(docs.sparkSession, rows=500)
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col(f"`{id_col}`").alias("_id"), F.array(*draws(id_col, seed)).alias("_h"),
        F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")).alias("_text"),
    )
    fields = T._parse_datatype_string("n bigint, form string, prefix_chars bigint, middle_chars bigint, _bytes binary").fields
    schema = T.StructType([T.StructField("_row", T.LongType()), T.StructField("_place", T.LongType()), rows.schema["_id"], *fields])

    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), None, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        for batch in it:
            kinds[2] = batch.column("_id").type
            out: list[tuple] = []
            for row, i, h, text in zip(*[batch.column(c) for c in ("_row", "_id", "_h", "_text")], strict=True):
                n, form, parts = parted(text.as_py(), h.as_py(), rate, spm_share)
                if form == "plain":
                    made, sizes = unit_chunks(parts[0]), (None, None)
                else:
                    by_name = dict(zip(TEXT_ORDER, parts, strict=True))
                    made = (c if k else s + c for s in LAYOUT[form] for k, c in enumerate(unit_chunks(by_name[s])))
                    sizes = code_points(parts[0]), code_points(parts[1])
                head = (i.as_py(), n, form, *sizes)
                for place, chunk in enumerate(made):
                    out.append((row.as_py(), place, *(head if not place else (None,) * 5), chunk))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], schema.names)

    return rows.mapInArrow(emit, schema)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bool]]:
    """First and last row of each document's pieces in a sorted batch, and whether its first piece is there."""
    row = batch.column("_row").to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])).tolist() if len(row) else []
    return zip(cuts, [*cuts[1:], len(row)], strict=False)


def assembled(made: DataFrame, parts: int | None = None) -> DataFrame:
    """Pieces with ``_restored``, the place in the restored text, and ``output_sha256`` on a closing row each.

    The pieces of one document are one after another; the digest needs no more than one at
    a time. The closing row repeats what describes the document and has no bytes.
    """
    names = [*made.columns, "_restored", "output_sha256"]
    schema = T.StructType([*made.schema.fields, T.StructField("_restored", T.LongType()), T.StructField("output_sha256", T.StringType())])
    arrow = {"_row": pa.int64(), "_place": pa.int64(), "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(),
             "middle_chars": pa.int64(), "_bytes": pa.binary(), "_restored": pa.int64(), "output_sha256": pa.string()}
    head_names = ["_id", "n", "form", "prefix_chars", "middle_chars"]
    rank = {s: k for k, s in enumerate(TEXT_ORDER)}

    def stream(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, head, digest, part, last = None, None, None, 0, 0
        kind = None

        def closing() -> tuple:
            return (row, last, *head, None, len(TEXT_ORDER) * PART, digest.hexdigest())

        for batch in it:
            kind = batch.column("_id").type
            out = []
            columns = [batch.column(c) for c in ("_row", "_place", *head_names, "_bytes")]
            for a, b in _runs(batch):
                if columns[0][a].as_py() != row:
                    if row is not None:
                        out.append(closing())
                    row, head, digest, part = columns[0][a].as_py(), tuple(c[a].as_py() for c in columns[2:7]), hashlib.sha256(), 0
                for i in range(a, b):
                    chunk, last = columns[7][i].as_py(), columns[1][i].as_py()
                    digest.update(chunk)
                    if head[2] != "plain" and chunk[:3] in rank:
                        part, chunk = rank[chunk[:3]], chunk[3:]
                    out.append((row, last, None, None, None, None, None, chunk, part * PART + last, None))
            if out:
                yield table(out, kind)
        if row is not None:
            yield table([closing()], kind)

    def table(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        kinds = [kind if c == "_id" else arrow[c] for c in names]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    dealt = made.repartition(F.col("_row")) if parts is None else made.repartition(parts, F.col("_row"))
    return dealt.sortWithinPartitions("_row", "_place").mapInArrow(stream, schema)


def restored(placed: DataFrame, id_col: str) -> DataFrame:
    """One row per document from :func:`assembled`, whose partitions it sorts again: both digests."""
    fields = T._parse_datatype_string("n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string").fields
    schema = T.StructType([T.StructField(id_col, placed.schema["_id"].dataType), *fields])

    def stream(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = hashlib.sha256()
        for batch in it:
            closes, made = [], []
            ends = batch.column("output_sha256").is_valid().to_pylist()
            for i, chunk in enumerate(batch.column("_bytes")):
                if ends[i]:
                    closes.append(i)
                    made.append(digest.hexdigest())
                    digest = hashlib.sha256()
                else:
                    digest.update(chunk.as_py())
            rows = batch.take(pa.array(closes, pa.int64()))
            keep = [rows.column(c) for c in ("_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(made, pa.string())], schema.names)

    return placed.sortWithinPartitions("_row", "_restored").mapInArrow(stream, schema)


@common.own_batches
def transform(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm_share: int = 50
) -> DataFrame:
    """One row per input row: the id, ``n, form, prefix_chars, middle_chars, output_sha256, restored_sha256``.

    ``n`` is the number of units (lines with their line feed; the last may lack it). Of 100
    texts about ``rate`` are transformed, of these about ``spm_share`` suffix first. A text
    that is empty, null (counts as empty) or holds a sentinel stays plain, with null
    ``prefix_chars`` and ``middle_chars``. A null id is drawn for as an empty one. Repeated rows
    are documents of their own with equal results. An empty table gives no rows. Other
    columns are not read. :func:`texts` returns the outputs themselves.
    """
    return common.written(restored(assembled(pieces(docs, id_col, text_col, seed, rate, spm_share)), id_col), "infill")


def texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm_share: int = 50
) -> DataFrame:
    """The transformed texts in pieces: ``_row`` (a document), ``_place``, the id on its first piece, ``form``, ``piece``.

    Written in this order the pieces of a document are its output; a document of any length is never one value.
    """
    made = pieces(docs, id_col, text_col, seed, rate, spm_share)
    return made.repartition(F.col("_row")).sortWithinPartitions("_row", "_place").select(
        "_row", "_place", F.col("_id").alias(id_col), "form", F.col("_bytes").cast("string").alias("piece")
    )
