"""Near-duplicates by MinHash bands, with odd sketches before the exact comparison.

A text's distinct shingles give ``bands * rows`` MinHash samples. Texts that agree on all
``rows`` samples of a band meet there; at a similarity of 0.8 and 40 bands of 4 a pair
misses every band with a probability below 1e-9. The same samples are folded into an odd
sketch: each (place, sample) flips one bit of a parity bitmap, so the bits in which two
bitmaps differ count the samples that differ: ``bits / 2 * (1 - exp(-4 k (1 - J) / bits))``
of them are expected. High similarities are told apart with few bits, by XOR and a
population count in the JVM. A pair whose count lies beyond six deviations of the one at
the wanted similarity (a chance below 1e-8) is no candidate any more; for the rest the
full shingle sets decide.

Equal sets are one node from the start. Only components are wanted, so pairs that are
linked already need no comparison: in every bucket rows are first compared with a hub
(the same one in all buckets of a family), for two rounds; then small buckets compare
the pairs that are left. What is left in a crowded bucket (texts that share a passage and
no more) forms no pairs there: those rows go through an exact prefix filter.
Sets are made anew for rows that a candidate names, not stored for all.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import common, similar
from plumbline.llm.components import components

#: Bands, samples of a band, bits of the odd sketch.
BANDS, ROWS, BITS = 40, 4, 512
#: A larger bucket goes through hubs and the prefix filter only; rounds of hubs. Work only: results do not depend on them.
CROWD, ROUNDS = 32, 2
#: Rows compared with one copy of a hub.
SHARE = 4096
def coefficients(k: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands of ``k`` hash functions; the same in every process."""
    rng = np.random.Generator(np.random.PCG64(20_11))
    return rng.integers(0, 1 << 31, k, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, k, np.uint32)


def samples(hashes: np.ndarray, factors: np.ndarray, summands: np.ndarray, part: int = 1024) -> np.ndarray:
    """The least value of each hash function over the set."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(factors), np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(low), part):
        least = np.minimum(least, (factors[:, None] * low[None, i : i + part] + summands[:, None]).min(axis=1))
    return least


def band_keys(drawn: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per text and band, of the band's samples and number."""
    parts = drawn.astype(np.uint64).reshape(len(drawn), bands, rows)
    key = np.zeros(parts.shape[:2], np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(common.MIX)
    for r in range(rows):
        key = common.mixed(key + parts[:, :, r])
    return key.view(np.int64)


def odd_sketches(drawn: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmaps, ``bits / 64`` words of each text: every (place, sample) flips one bit."""
    n, k = drawn.shape
    at = common.mixed(drawn.astype(np.uint64) + (np.arange(1, k + 1, dtype=np.uint64) << np.uint64(32))) % np.uint64(bits)
    flips = np.bincount((at.astype(np.int64) + np.arange(n)[:, None] * bits).ravel(), minlength=n * bits) & 1
    return np.packbits(flips.reshape(n, bits).astype(np.uint8), axis=1, bitorder="little").view(np.int64)


def most_differing(similarity: float, k: int, bits: int, deviations: float = 6.0) -> int:
    """Differing bits beyond which a pair is certainly (but for a chance below 1e-8) less similar.

    Differing samples are binomial; given them, the bits that differ are those hit an odd
    number of times, whose variance is at most that of ``bits`` independent ones.
    """
    mean, sd = k * (1 - similarity), math.sqrt(k * similarity * (1 - similarity))
    expected = lambda d: bits / 2 * (1 - (1 - 2 / bits) ** (2 * d))
    slope = (expected(mean + sd) - expected(mean - sd)) / 2
    p = expected(mean) / bits
    folding = max(0.0, bits * p * (1 - p) - 2 * mean * (1 - 2 / bits) ** (4 * mean))
    return math.ceil(expected(mean) + deviations * math.sqrt(slope * slope + folding))


def estimated(differing: int, k: int, bits: int) -> float:
    """The similarity that so many differing bits stand for."""
    return 1 + bits / (4 * k) * math.log(max(1e-12, 1 - 2 * differing / bits))


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int, bits: int) -> DataFrame:
    """``_row, _id, _mark, _k, n, _set, bands, sketch`` of every row: size and digest of its set, band keys, odd sketch."""
    common.small_batches(docs.sparkSession)
    keyed = similar.keyed(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("_row"), "_id", "_mark", "_k", "_text")
    kept = ["_row", "_id", "_mark", "_k"]
    schema = T.StructType([*[keyed.schema[c] for c in kept], *T._parse_datatype_string("n bigint, _set binary, bands array<bigint>, sketch array<bigint>").fields])

    def make(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, (factors, summands) = common.WordHashes(), coefficients(bands * rows)
        for batch in it:
            sets = [common.shingle_set(t.as_py(), width, memo) for t in batch.column("_text")]
            drawn = np.array([samples(s, factors, summands) for s in sets], np.uint32).reshape(len(sets), len(factors))
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.int64())) for x in (band_keys(drawn, bands, rows), odd_sketches(drawn, bits))]
            yield pa.RecordBatch.from_arrays([
                *[batch.column(c) for c in kept], pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.md5(s.tobytes()).digest() for s in sets], pa.binary()), *lists,
            ], schema.names)

    return keyed.mapInArrow(make, schema)


class _Search:
    """What the steps share: the signatures, the texts, and the wanted similarity."""

    def __init__(self, docs, made, id_col, text_col, width, similarity, bits, k):
        self.docs, self.made, self.id_col, self.text_col = docs, made, id_col, text_col
        self.width, self.similarity, self.share = width, similarity, Fraction(str(similarity))
        self.words, self.most = bits // 64, most_differing(similarity, k, bits)

    def sets(self, rows: DataFrame) -> DataFrame:
        """``_row, n, hashes`` of ``rows`` (``_row``), made anew from their texts; written."""
        return similar.sets_of(self.docs, self.made, rows, self.id_col, self.text_col, self.width)

    def sketched(self, pairs: DataFrame) -> DataFrame:
        """Of the pairs ``row, hub`` those whose sizes and odd sketches allow the similarity."""
        side = lambda name, s: self.made.select(
            F.col("_row").alias(name), F.col("n").alias(f"_n{s}"), *[F.col("sketch")[i].alias(f"_{s}{i}") for i in range(self.words)]
        )
        both = pairs.join(side("row", "a"), "row").join(side("hub", "b"), "hub")
        differing = sum((F.bit_count(F.col(f"_a{i}").bitwiseXOR(F.col(f"_b{i}"))) for i in range(1, self.words)), F.bit_count(F.col("_a0").bitwiseXOR(F.col("_b0"))))
        long_enough = F.least("_na", "_nb") * self.share.denominator >= F.greatest("_na", "_nb") * self.share.numerator
        return both.where(long_enough & (differing <= self.most)).select("row", "hub")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Links ``a, b``: the candidate pairs ``row, hub`` whose full sets are similar enough.

        A row's set moves once to each of its pairs; a hub that many rows ask for is copied
        for every ``SHARE`` of them, so no task holds all of its rows.
        """
        pairs = common.written(self.sketched(pairs), "odd-candidates")
        sets = self.sets(pairs.select(F.explode(F.array("row", "hub")).alias("_row")))
        copies = pairs.groupBy("hub").agg(F.ceil(F.count("*") / SHARE).alias("_copies"))
        asked = pairs.join(copies, "hub").withColumn("_copy", F.pmod(F.xxhash64("row"), F.col("_copies")))
        hubs = copies.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1)))
        held = hubs.join(sets.select(F.col("_row").alias("hub"), F.col("hashes").alias("_y")), "hub").select("hub", "_copy", "_y")
        met = asked.select("row", "hub", "_copy").join(sets.select(F.col("_row").alias("row"), F.col("hashes").alias("_x")), "row").join(held, ["hub", "_copy"])
        num, den = self.share.numerator, self.share.denominator

        @F.pandas_udf("boolean")
        def alike(x, y):
            import pandas as pd

            made = []
            for i, j in zip(x, y, strict=True):
                a, b = np.frombuffer(i, np.uint64), np.frombuffer(j, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                made.append(both * den >= num * (len(a) + len(b) - both))
            return pd.Series(made, dtype="bool")

        return common.written(met.where(alike("_x", "_y")).select(F.col("row").alias("a"), F.col("hub").alias("b")), "odd-links")


def band_links(search: _Search, heads: DataFrame) -> DataFrame:
    """Edges ``a, b`` whose components are those of all pairs at the wanted similarity among ``heads`` (``_row, bands``)."""
    postings = heads.select("_row", F.explode("bands").alias("key"))
    met = postings.groupBy("key").agg(F.count("*").alias("_m")).where("_m > 1")
    open_ = common.written(postings.join(met, "key").select("key", "_row"), "odd-buckets")
    links = labels = None
    for turn in range(ROUNDS):
        state = similar.labelled(open_, labels)
        # One order for all buckets, so a family that meets in many buckets has one hub, or few.
        rank = F.struct(F.xxhash64("_row", F.lit(turn)).alias("r"), F.col("_row").alias("row"), F.col("label").alias("label"))
        buckets = state.groupBy("key").agg(F.min("label").alias("_l"), F.max("label").alias("_h"), F.min(rank).alias("_hub")).where("_l < _h")
        asked = common.written(state.join(buckets, "key").select("key", "_row", "label", "_hub"), "odd-open")
        pairs = asked.where("label <> _hub.label").groupBy("_row").agg(F.min("_hub").alias("_hub")).select(F.col("_row").alias("row"), F.col("_hub.row").alias("hub"))
        open_ = asked.select("key", "_row")
        if not pairs.take(1):
            break
        new = search.confirmed(pairs)
        links, labels = new if links is None else links.unionByName(new), similar.relabelled(labels, new)
    state = similar.labelled(open_, labels)
    buckets = state.groupBy("key").agg(F.count("*").alias("_m"), F.min("label").alias("_l"), F.max("label").alias("_h")).where("_l < _h")
    rest = common.written(state.join(buckets, "key").select("key", "_row", "label", "_m"), "odd-rest")
    few = rest.where(F.col("_m") <= CROWD)
    one, two = (few.select("key", F.col("_row").alias(n), F.col("label").alias(f"_{n}")) for n in ("row", "hub"))
    pairs = one.join(two, "key").where("row < hub AND _row <> _hub").select("row", "hub").distinct()
    last = search.confirmed(pairs)
    links, labels = last if links is None else links.unionByName(last), similar.relabelled(labels, last)
    state = similar.labelled(rest.where(F.col("_m") > CROWD).select("key", "_row"), labels)
    left = state.groupBy("key").agg(F.min("label").alias("_l"), F.max("label").alias("_h")).where("_l < _h")
    crowded = common.written(state.join(left, "key").select("_row").distinct(), "odd-crowded")
    if crowded.take(1):  # the exact way for what bands alone cannot tell apart
        entries = similar.with_prefixes(search.sets(crowded), search.similarity)
        links = links.unionByName(similar.similar_links(entries, search.similarity, lambda pairs: similar.linked_sets(pairs, search.similarity, search.sets), labels, rounds=1))
    # Rows under their label are stars already; of the links only those between labels are new.
    stars = labels.where("_row <> label").select(F.col("_row").alias("a"), F.col("label").alias("b"))
    named = similar.labelled(links.select(F.col("a").alias("_row"), "b"), labels).select(F.col("b").alias("_row"), F.col("label").alias("a"))
    between = similar.labelled(named, labels).select("a", F.col("label").alias("b")).where("a <> b")
    return stars.unionByName(between.distinct())


@common.own_batches
def near_groups(
    docs: DataFrame, similarity: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text",
    bands: int = BANDS, rows: int = ROWS, bits: int = BITS,
) -> DataFrame:
    """One row per input row: the id, ``n_shingles, component_id, kept``.

    A text's set holds its distinct ``width``-word shingles (A-Z lower-cased, words parted by
    the six ASCII space characters); with fewer words the whole sequence is the one shingle.
    Two texts are linked if their sets' Jaccard similarity is at least ``similarity`` (compared
    exactly, on 64-bit shingle hashes). ``component_id`` is the smallest id reachable, the
    row's own included (null ids are passed over). Null, empty and blank texts have no
    shingles and are linked with nothing. Repeated rows are linked, and give repeated rows.
    ``kept`` is whether the id is the component's (a null id: only if its component has no
    other). An empty table gives no rows. Other columns are not read.
    """
    made = common.written(signatures(docs, id_col, text_col, width, bands, rows, bits), "odd-signatures")
    some = made.where("n > 0").select("_row", "_set")
    firsts = common.written(some.groupBy("_set").agg(F.min("_row").alias("_first"), F.count("*").alias("_m")).where("_m > 1"), "odd-firsts")
    repeated = common.written(some.join(firsts, "_set").where("_row <> _first").select(F.col("_first").alias("a"), F.col("_row").alias("b")), "odd-repeated")
    heads = made.where("n > 0").select("_row", "bands").join(repeated.select(F.col("b").alias("_row")), "_row", "left_anti")
    search = _Search(docs, made, id_col, text_col, width, similarity, bits, bands * rows)
    found = components(band_links(search, heads).unionByName(repeated), "a", "b")
    named = common.written(
        made.select("_row", "_id", "n").join(found.select(F.col("node").alias("_row"), "component"), "_row", "left").select("_id", "n", F.coalesce("component", "_row").alias("_c"), F.col("component").isNull().alias("_alone")),
        "odd-named",
    )
    least = named.where("not _alone").groupBy("_c").agg(F.min("_id").alias("_least"))
    rows_ = named.join(least, "_c", "left")
    component = F.when(F.col("_alone"), F.col("_id")).otherwise(F.col("_least"))
    return rows_.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))
