"""Near-duplicates at a stated Jaccard similarity of five-word shingles, found exactly.

Of texts whose shingle sets are equal one stands for all. Of the others, those whose SimHash
fingerprints link (:mod:`plumbline.llm.simhash`) are compared first: near copies mostly. More
bits than fingerprints reach may differ at the wanted similarity, so the rest goes through a
prefix filter: with the shingles of every text in one common order, rare ones first, two
texts of similarity ``t`` share one of the first ``n - ceil(t * n) + 1`` shingles of each.
Rows that meet in such a shingle (a bucket) are candidates, less those whose lengths or
positions rule ``t`` out; the whole shingle sets of a candidate pair decide. The order
is by estimated document frequency and steers the work only: any common order is exact.
Sets are not stored: a row keeps its first shingles, and sets of candidates are made anew.

Only components are wanted, so a pair that is linked already needs no comparison. In
crowded buckets each row is first compared with one hub, for a few rounds; then every pair
of a bucket that is still in different components is compared, so no pair is left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import common, simhash
from plumbline.llm.components import components

#: Buckets of more members first go through this many rounds of hubs. Work only: results do not depend on them.
CROWD, ROUNDS = 16, 3
#: Shingles are counted in 2 ** CELL_BITS cells; a task reports its MOST fullest, all tasks' KEPT fullest order the shingles.
CELL_BITS, MOST, KEPT = 21, 4096, 1 << 16
#: Bits of the filter for rows whose sets are compared.
NAMED_BITS = 23
#: Rows compared with one copy of a text.
SHARE = 4096
#: Words of a fingerprint's shingles, bits in which linked fingerprints may differ.
PRINT_WIDTH, RADIUS = 3, 2


def sketch(text: str, width: int) -> bytes:
    """The 64-bit hashes of all distinct shingles, sorted; a text without words has one, of nothing."""
    return _set(common.utf8(text), width, common.WordHashes()).tobytes()


def _set(data: bytes, width: int, memo: common.WordHashes) -> np.ndarray:
    made = common.shingle_set(data, width, memo)
    return made if len(made) else np.zeros(1, np.uint64)


def jaccard(a: bytes, b: bytes) -> float:
    return alike(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64))


def alike(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def least_shared(n: int, similarity: float) -> int:
    """So many of ``n`` shingles at least are shared with any text at ``similarity``."""
    return max(1, math.ceil(similarity * n - 1e-9))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id, _mark, _k, _text``; ``_mark`` and ``_k`` together name an (id, text)."""
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), common.mark(text).alias("_mark"), F.coalesce(text.cast("binary"), F.lit(b"")).alias("_text"))
    return rows.select("_id", "_mark", F.xxhash64(F.lit(1), "_id", F.col("_id").isNull(), "_mark").alias("_k"), "_text")


def texts_of(docs: DataFrame, named: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``named`` (written; ``_k, _mark`` say which text a row has) with ``_text``.

    A filter of fixed size keeps other texts from moving; beyond its 2 ** NAMED_BITS cells it
    lets more through, and the join decides.
    """
    cell = F.pmod(F.col("_k"), F.lit(1 << NAMED_BITS))
    bit = f"shiftleft(1L, cast(pmod(_k, {1 << NAMED_BITS}L) & 63 as int))"
    words = named.groupBy(F.shiftright(cell, 6).alias("_word")).agg(F.bit_or(F.expr(bit)).alias("_bits"))
    met = keyed(docs, id_col, text_col).withColumn("_word", F.shiftright(cell, 6)).join(F.broadcast(words), "_word").where(F.expr(f"(_bits & {bit}) <> 0"))
    once = met.groupBy("_k", "_mark").agg(F.any_value("_text").alias("_text"))
    return once.join(named, ["_k", "_mark"])


def linked_texts(docs: DataFrame, made: DataFrame, pairs: DataFrame, id_col: str, text_col: str, width: int, similarity: float) -> DataFrame:
    """The ``pairs`` (``a, b``) whose whole sets have the similarity; written.

    Texts move to the pairs' ``b``, once for each pair, and sets are made there: a text is smaller than its
    set. A ``b`` that many rows ask for is copied for every ``SHARE`` of them, so no task holds all of its rows.
    """
    common.small_batches(docs.sparkSession)
    copies = pairs.groupBy("b").agg(F.ceil(F.count("*") / SHARE).alias("_copies"))
    asked = pairs.join(copies, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("_copies")).alias("_copy"))
    sides = asked.select(F.col("a").alias("_row"), "b", "_copy", F.lit(1).alias("_side")).unionByName(
        asked.select(F.col("b").alias("_row"), "b", "_copy", F.lit(0).alias("_side")).distinct()
    )
    named = common.written(made.select("_row", "_k", "_mark").join(sides, "_row"), "similar-named")

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, at, held = common.WordHashes(), None, None
        for batch in it:
            found: list[tuple[int, int]] = []
            for b, copy, side, row, text in zip(*(batch.column(c) for c in ("b", "_copy", "_side", "_row", "_text")), strict=True):
                here, own = (b.as_py(), copy.as_py()), _set(text.as_py(), width, memo)
                if side.as_py() == 0:
                    at, held = here, own
                elif at == here and alike(own, held) >= similarity - 1e-9:
                    found.append((row.as_py(), here[0]))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    placed = texts_of(docs, named, id_col, text_col).select("b", "_copy", "_side", "_row", "_text")
    placed = placed.repartition("b", "_copy").sortWithinPartitions("b", "_copy", "_side")
    links = common.written(placed.mapInArrow(compare, "a bigint, b bigint"), "similar-links")
    common.discard(named)
    return links


def sets_of(docs: DataFrame, made: DataFrame, rows: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``_row, n, hashes`` of ``rows`` (``_row``), made anew from their texts; written. ``made`` has ``_row, _k, _mark``."""
    named = common.written(made.select("_row", "_k", "_mark").join(rows.select("_row").distinct(), "_row", "left_semi"), "similar-named")

    def make(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = common.WordHashes()
        for batch in it:
            sets = [_set(t.as_py(), width, memo) for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([
                batch.column("_row"), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary())
            ], ["_row", "n", "hashes"])

    found = texts_of(docs, named, id_col, text_col).select("_row", "_text")
    return common.written(found.mapInArrow(make, "_row bigint, n int, hashes binary"), "similar-sets")


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def common_cells(rows: DataFrame, hashes_of) -> tuple[np.ndarray, np.ndarray]:
    """The fullest cells, sorted, and the shingles counted in them; of bounded size. ``hashes_of(batch)`` gives the sets."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << CELL_BITS, np.int64)
        for batch in it:
            sets = hashes_of(batch)
            counts += np.bincount(_cells(np.concatenate(sets)), minlength=1 << CELL_BITS) if sets else 0
        top = np.argpartition(counts, -MOST)[-MOST:]
        top = top[counts[top] > 1]
        yield pa.RecordBatch.from_arrays([pa.array(top, pa.int64()), pa.array(counts[top], pa.int64())], ["cell", "n"])

    per_task = rows.mapInArrow(count, "cell bigint, n bigint")
    found = per_task.groupBy("cell").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "cell").limit(KEPT).collect()
    found.sort()
    return np.array([r.cell for r in found], np.int64), np.array([r.n for r in found], np.int64)


def prefix(hashes: np.ndarray, cells: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles in the common order, as many as ``similarity`` asks for."""
    n, rank = len(hashes), np.zeros(len(hashes), np.int64)
    if len(cells):
        own = _cells(hashes)
        at = np.minimum(np.searchsorted(cells, own), len(cells) - 1)
        rank = np.where(cells[at] == own, counts[at], 0)
    return hashes[np.lexsort((hashes, rank))[: n - least_shared(n, similarity) + 1]]


def signed_rows(docs: DataFrame, id_col: str, text_col: str, width: int, similarity: float) -> DataFrame:
    """``_row, _id, _mark, _k, n, _set, fp, prefix`` of every row: size and digest of its set, fingerprint, first shingles."""
    common.small_batches(docs.sparkSession)
    rows = keyed(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("_row"), "_id", "_mark", "_k", "_text")
    memo = common.WordHashes  # a fresh one in every task

    def hashes_of(batch: pa.RecordBatch) -> list[np.ndarray]:
        known = memo()
        return [_set(t.as_py(), width, known) for t in batch.column("_text")]

    table = docs.sparkSession.sparkContext.broadcast(common_cells(rows.select("_text"), hashes_of))
    kept = ["_row", "_id", "_mark", "_k"]
    schema = T.StructType([*[rows.schema[c] for c in kept], *T._parse_datatype_string("n int, _set binary, fp bigint, prefix binary").fields])

    def make(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, counts = table.value
        for batch in it:
            sets = hashes_of(batch)
            yield pa.RecordBatch.from_arrays([
                *[batch.column(c) for c in kept], pa.array([len(s) for s in sets], pa.int32()), pa.array([hashlib.md5(s.tobytes()).digest() for s in sets], pa.binary()),
                pa.array([simhash.signed(simhash.fingerprint_bytes(t.as_py(), PRINT_WIDTH)) for t in batch.column("_text")], pa.int64()), pa.array([prefix(s, cells, counts, similarity).tobytes() for s in sets], pa.binary()),
            ], schema.names)

    return rows.mapInArrow(make, schema)


def with_prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """``_row, n, prefix`` of ``sets`` (``_row, n, hashes``), in the order of their own shingle counts."""
    stored = lambda batch: [np.frombuffer(h.as_py(), np.uint64) for h in batch.column("hashes")]
    table = sets.sparkSession.sparkContext.broadcast(common_cells(sets.select("hashes"), stored))

    def make(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, counts = table.value
        for batch in it:
            made = [prefix(s, cells, counts, similarity).tobytes() for s in stored(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("n"), pa.array(made, pa.binary())], ["_row", "n", "prefix"])

    return common.written(sets.mapInArrow(make, "_row bigint, n int, prefix binary"), "similar-entries")


def postings_of(entries: DataFrame) -> DataFrame:
    """``key, _row, n, pos``: the first shingles of every row with their places."""

    def first(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            parts = [np.frombuffer(p.as_py(), np.int64) for p in batch.column("prefix")]
            sizes = [len(p) for p in parts]
            if parts:
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(parts)), pa.array(np.repeat(batch.column("_row").to_numpy(zero_copy_only=False), sizes)),
                    pa.array(np.repeat(batch.column("n").to_numpy(zero_copy_only=False), sizes)), pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in sizes])),
                ], ["key", "_row", "n", "pos"])

    return entries.select("_row", "n", "prefix").mapInArrow(first, "key bigint, _row bigint, n int, pos int")


def possible(similarity: float, na: Column, nb: Column, pa_: Column, pb: Column) -> Column:
    """False only if two rows whose first common shingle has these places are below ``similarity``."""
    need = F.lit(similarity / (1 + similarity)) * (na + nb) - 1e-6
    return (F.least(na, nb) >= F.lit(similarity) * F.greatest(na, nb) - 1e-6) & (F.least(na - pa_, nb - pb) >= need)


def labelled(shared: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``shared`` with ``label``: equal labels are linked already; a row without one is its own."""
    if labels is None:
        return shared.withColumn("label", F.col("_row"))
    return shared.join(labels.withColumnRenamed("label", "_c"), "_row", "left").withColumn("label", F.coalesce("_c", "_row")).drop("_c")


def relabelled(labels: DataFrame | None, linked: DataFrame) -> DataFrame:
    """``_row, label`` of all rows linked so far, after the links ``a, b`` joined their labels.

    Every label that a link leads to a smaller one takes the least of them, and what that
    one took itself. This is no full search for components (a chain of many labels joined
    at once may stay in parts), but equal labels are always linked, and it is a few joins.
    """
    ends = linked.select(F.posexplode(F.array("a", "b")).alias("_side", "_row"), F.struct("a", "b").alias("_link"))
    named = labelled(ends, labels)
    links = named.groupBy("_link").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    to = common.written(links.groupBy(F.col("high").alias("label")).agg(F.min("low").alias("_to")), "similar-joined")
    further = to.select(F.col("label").alias("_to"), F.col("_to").alias("_further"))
    to = to.join(further, "_to", "left").select("label", F.coalesce("_further", "_to").alias("_to"))
    known = named.select("_row", "label").distinct()
    if labels is not None:
        known = known.unionByName(labels.join(known, "_row", "left_anti"))
    return common.written(known.join(to, "label", "left").select("_row", F.coalesce("_to", "label").alias("label")), "similar-labels")


def linked_sets(pairs: DataFrame, similarity: float, sets_for) -> DataFrame:
    """The ``pairs`` (``a, b``) whose whole sets have the similarity; ``sets_for(rows)`` gives ``_row, hashes`` of ``rows`` (``_row``)."""

    @F.pandas_udf("double")
    def exact(x, y):
        import pandas as pd

        return pd.Series([jaccard(i, j) for i, j in zip(x, y, strict=True)], dtype="float64")

    live = sets_for(pairs.select(F.explode(F.array("a", "b")).alias("_row")))
    one = pairs.join(live.select(F.col("_row").alias("a"), F.col("hashes").alias("_x")), "a")
    two = one.join(live.select(F.col("_row").alias("b"), F.col("hashes").alias("_y")), "b")
    return common.written(two.where(exact("_x", "_y") >= similarity - 1e-9).select("a", "b"), "similar-links")


def print_pairs(entries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a, b``: rows of ``entries`` (``_row, fp``) with equal or linked fingerprints, as many as connect them; written."""
    heads = common.written(entries.groupBy("fp").agg(F.min("_row").alias("_head")), "similar-heads")
    same = entries.join(heads, "fp").where("_row <> _head").select(F.col("_row").alias("a"), F.col("_head").alias("b"))
    links = simhash.links(heads.select("fp"), radius)
    side = lambda c: heads.select(F.col("fp").alias(c), F.col("_head").alias(f"_{c}"))
    near = links.join(side("a"), "a").join(side("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    return common.written(same.unionByName(near), "similar-print-pairs")


def similar_links(entries: DataFrame, similarity: float, linked, labels: DataFrame | None = None, rounds: int = ROUNDS) -> DataFrame:
    """Edges ``a, b`` between rows of ``entries`` (``_row, n, prefix``) whose components are those of all pairs at ``similarity``.

    ``linked(pairs)`` gives those of the ``pairs`` (``a, b``) that have the similarity, written. ``labels``
    (``_row, label``) says what is linked already; those links are not returned again.
    """
    common.small_batches(entries.sparkSession)
    postings = postings_of(entries)
    met = postings.groupBy("key").agg(F.count("*").alias("_m")).where("_m > 1").select("key")
    # Only the newest table of postings is kept.
    kept = shared = common.written(postings.join(met, "key"), "similar-shared")
    links = None
    for turn in range(rounds):
        state = labelled(shared, labels)
        # A text without edits of its own has its shared shingles first: the best hub of a group of copies.
        rank = F.col("pos").cast("bigint") if turn == 0 else F.xxhash64("_row", F.lit(turn))
        buckets = state.groupBy("key").agg(
            F.count("*").alias("_m"), F.min("label").alias("_l"), F.max("label").alias("_h"),
            F.min(F.struct(rank.alias("r"), F.col("_row").alias("row"), F.col("label").alias("label"), F.col("n").alias("n"))).alias("_hub"),
        ).where("_l < _h")
        shared = common.written(state.join(buckets.where("_l < _h"), "key").select("key", "_row", "n", "pos", "label", "_m", "_hub"), "similar-open")
        common.discard(kept)
        kept = shared
        far = F.least("n", "_hub.n") < F.lit(similarity) * F.greatest("n", "_hub.n") - 1e-6
        tried = shared.where((F.col("_m") > CROWD) & (F.col("label") != F.col("_hub.label")) & ~far)
        pairs = tried.groupBy("_row").agg(F.min("_hub").alias("_hub")).select(F.col("_row").alias("a"), F.col("_hub.row").alias("b"))
        pairs = common.written(pairs, "similar-hubs")
        shared = shared.select("key", "_row", "n", "pos")
        if not pairs.take(1):
            break
        new = linked(pairs)
        links, labels = new if links is None else links.unionByName(new), relabelled(labels, new)
    rest = common.written(labelled(shared, labels), "similar-rest")
    common.discard(kept)
    one, two = (rest.select("key", *[F.col(c).alias(f"_{side}{c}") for c in ("_row", "n", "pos", "label")]) for side in "ab")
    cross = one.join(two, "key").where(
        (F.col("_a_row") < F.col("_b_row")) & (F.col("_alabel") != F.col("_blabel"))
        & possible(similarity, F.col("_an"), F.col("_bn"), F.col("_apos"), F.col("_bpos"))
    )
    pairs = common.written(cross.select(F.col("_a_row").alias("a"), F.col("_b_row").alias("b")).distinct(), "similar-pairs")
    common.discard(rest)
    last = linked(pairs)
    return last if links is None else links.unionByName(last)


@common.own_batches
def similar_groups(docs: DataFrame, similarity: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``_id, _mark, component``.

    ``component`` names a set of rows linked by a Jaccard similarity of at least
    ``similarity`` of their distinct shingles. Texts are lower-cased (A-Z); one with fewer
    than ``width`` words is a single shingle; null, empty and blank texts are alike. Equal
    rows are linked. An empty table gives no rows. Other columns are not read.
    """
    made = common.written(signed_rows(docs, id_col, text_col, width, similarity), "similar-rows")
    firsts = common.written(made.groupBy("_set").agg(F.min("_row").alias("_first"), F.count("*").alias("_m")).where("_m > 1"), "similar-firsts")
    repeated = made.select("_row", "_set").join(firsts, "_set").where("_row <> _first").select("_row", "_first")
    repeated = common.written(repeated, "similar-repeated")
    entries = made.select("_row", "n", "fp", "prefix").join(repeated.select("_row"), "_row", "left_anti")
    linked = lambda pairs: linked_texts(docs, made, pairs, id_col, text_col, width, similarity)
    first = linked(print_pairs(entries))
    links = first.unionByName(similar_links(entries.drop("fp"), similarity, linked, relabelled(None, first)))
    found = components(links.unionByName(repeated.select(F.col("_first").alias("a"), F.col("_row").alias("b"))), "a", "b")
    rows = made.select("_id", "_mark", "_row")
    return rows.join(found, rows["_row"] == found["node"], "left").select("_id", "_mark", F.coalesce("component", "_row").alias("component"))


def one_of_each(docs: DataFrame, similarity: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, one of each group: the one with the smallest id (nulls last), unchanged."""
    groups = common.written(similar_groups(docs, similarity, width, id_col, text_col), "similar-groups")
    first = groups.groupBy("component").agg(F.min(F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_mark").alias("m"))).alias("_r"))
    stays = first.select(F.col("_r.i").alias("_id"), F.col("_r.m").alias("_mark"))
    times = groups.groupBy("_id", "_mark").agg(F.count("*").alias("_times"))
    return common.keep_once(docs, times.join(stays, common.same_mark(times, stays), "left_semi"), id_col, text_col)
