"""Near-duplicates by SimHash with covering locality-sensitive hashing.

A 64-bit fingerprint links to another that differs in at most ``radius`` bits. Bit i
gets a non-zero vector m(i) of radius + 1 bits; for every non-zero v there is a table
whose mask holds the bits i with <m(i), v> = 1. The positions in which a linked pair
differs span at most ``radius`` dimensions, so some v is orthogonal to all of them: the
pair agrees on that whole mask and meets in that table. No linked pair is ever missed.

Equal fingerprints are one node from the start. A bucket with few fingerprints compares
its pairs. A crowded bucket forms no pairs: its members join through neighbours one bit
away outside the mask (two fingerprints differ in at most two bits exactly if they have
such a neighbour in common), which is linear in the bucket and loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import common
from plumbline.llm.components import components

BITS = 64
SEED = 42
CROWD = 64


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(radius: int) -> list[int]:
    """2^(radius+1) - 1 bit masks; any ``radius`` bit positions miss at least one of them."""
    top = (1 << (radius + 1)) - 1
    vector = [1 + i % top for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (vector[i] & v).bit_count() & 1) for v in range(1, top + 1)]


def fingerprint(text: str, width: int = 3) -> int:
    """SimHash of the word shingles (repeats count), unsigned; 0 for a text without words."""
    return fingerprint_bytes(common.utf8(text), width)


def fingerprint_bytes(data: bytes, width: int = 3) -> int:
    """:func:`fingerprint` of a text's UTF-8 bytes."""
    counts, n, tail = np.zeros(BITS, np.int64), 0, []
    for words in common.word_chunks(data.lower()):
        words = tail + words
        shingles = map(b" ".join, zip(*[words[i:] for i in range(width)], strict=False))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
        tail = words[-(width - 1):] if width > 1 else []
    if not n and tail:
        return fingerprint_of([xxhash.xxh64_intdigest(b" ".join(tail), SEED)])
    return sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist())


def fingerprint_of(hashes: list[int]) -> int:
    return sum(1 << i for i in range(BITS) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``_id, _mark, fp`` of every row; ``_mark`` hashes the text as it stands."""
    common.small_batches(docs.sparkSession)

    def compute(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            made = [signed(fingerprint(t, width)) for t in common.texts_of(batch.column("_text"))]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_mark"), pa.array(made, pa.int64())], ["_id", "_mark", "fp"])

    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), common.mark(text).alias("_mark"), text.alias("_text"))
    schema = T.StructType([rows.schema["_id"], T.StructField("_mark", T.LongType()), T.StructField("fp", T.LongType())])
    return rows.mapInArrow(compute, schema)


def links(prints: DataFrame, radius: int = 2, crowd: int = CROWD) -> DataFrame:
    """``a, b``: links that connect exactly what all links within ``radius`` bits connect.

    ``prints`` has distinct fingerprints ``fp``.
    """
    if radius not in (1, 2):
        raise ValueError("radius must be 1 or 2")
    masks = covering_masks(radius)
    tables = prints.select(
        "fp",
        F.explode(F.array(*[
            F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(masks)
        ])).alias("_in"),
    ).select("fp", "_in.t", "_in.key")
    full = tables.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    placed = common.written(tables.join(full, ["t", "key"]), "simhash-buckets")
    few = placed.where(F.col("n") <= crowd)
    pairs = (
        few.select("t", "key", F.col("fp").alias("a"))
        .join(few.select("t", "key", F.col("fp").alias("b")), ["t", "key"])
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
        .select("a", "b")
    )
    free = [[signed(1 << i) for i in range(BITS) if not m >> i & 1] for m in masks]
    flips = F.element_at(F.array(*[F.array(*[F.lit(x) for x in f]) for f in free]), F.col("t") + 1)
    many = placed.where(F.col("n") > crowd).select("fp", F.explode(flips).alias("_flip"))
    if radius == 2:
        hubs = many.select("fp", F.col("fp").bitwiseXOR(F.col("_flip")).alias("hub"), F.lit(0).cast("bigint").alias("_bit"))
        own = placed.where(F.col("n") > crowd).select("fp", F.col("fp").alias("hub"), F.lit(0).cast("bigint").alias("_bit"))
        hubs = hubs.unionByName(own).distinct()
    else:  # a pair differs in one bit: both are the same without it
        hubs = many.select("fp", F.col("fp").bitwiseAND(F.bitwise_not("_flip")).alias("hub"), F.col("_flip").alias("_bit")).distinct()
    centre = hubs.groupBy("hub", "_bit").agg(F.min("fp").alias("b"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    star = hubs.join(centre, ["hub", "_bit"]).where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(star).distinct()


@common.own_batches
def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2, crowd: int = CROWD) -> DataFrame:
    """One row per input row: the id, ``fingerprint`` (16 hex digits), ``component_id``, ``_mark``.

    ``component_id`` is the smallest id reachable over links, the row's own included
    (null ids are passed over; a component of null ids only has a null one). Texts are
    lower-cased (A-Z) and cut into words; a text with fewer than ``width`` words is one
    shingle; null, empty and blank texts have fingerprint zero and are linked like any
    other. Repeated rows give repeated rows. An empty table gives none. Other columns
    are not read.
    """
    prints = common.written(fingerprints(docs, id_col, text_col, width), "simhash-prints")
    nodes = prints.groupBy("fp").agg(F.min("_id").alias("_least"))
    found = components(links(nodes.select("fp"), radius, crowd), "a", "b")
    of = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "_least", F.coalesce("component", "fp").alias("_c"))
    of = common.written(of, "simhash-nodes")
    least = of.groupBy("_c").agg(F.min("_least").alias("component_id"))
    named = of.join(least, "_c").select("fp", "component_id")
    return prints.join(named, "fp").select(
        F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "_mark"
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """The rows of ``docs``, one of each component of :func:`near_groups`: the one with the
    smallest id (nulls last). Columns stay as they are."""
    groups = common.written(near_groups(docs, id_col, text_col, width, radius), "simhash-groups")
    rank = F.struct(F.col(f"`{id_col}`").isNull(), F.col(f"`{id_col}`"), "_mark")
    first = groups.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("_f")).agg(F.min(rank).alias("_r"))
    stays = first.select(F.col("_r").getField(id_col).alias("_id"), F.col("_r._mark").alias("_mark"))
    times = groups.groupBy(F.col(f"`{id_col}`").alias("_id"), "_mark").agg(F.count("*").alias("_times"))
    return common.keep_once(docs, times.join(stays, common.same_mark(times, stays), "left_semi"), id_col, text_col)
