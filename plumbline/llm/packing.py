"""Packing documents into fixed sequences by cutting-stock column generation.

A document of n tokens gives n // C full sequences of its own and a rest shorter than the
capacity C. The rests are a cutting-stock problem over their length histogram (at most
C - 1 classes, whatever the corpus size):

* the linear program chooses how often each pattern (a set of rests that fits) is used;
* its duals price the classes, a knapsack dynamic program finds the best new pattern, and
  the two alternate until the bound by total length, or by the duals, is reached;
* counts are rounded down; what is left over (less than one use of each pattern) is
  packed best-fit-decreasing, and its gaps are filled by cutting the emptiest sequences'
  rests; the very last tokens make sequences of powers of two, which need no padding.
  Patterns that leave a gap lend some of their own uses to fill it, so nothing is padded
  even if one length dominates.

Only the histogram and the patterns pass through the driver; both are bounded by C. The
documents are ranked inside their length class (two-level ranks, no window over a whole
class) and pick up pattern, place and sequence by a join on class and rank.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import common, tokens
from plumbline.operators import ordered

Pattern = tuple[tuple[int, int], ...]


def _knapsack(lengths: np.ndarray, price: np.ndarray, capacity: int) -> tuple[float, Pattern]:
    """The most valuable multiset of lengths within the capacity."""
    use = price > 1e-12
    lengths, price, where = lengths[use], price[use], np.flatnonzero(use)
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        k = np.searchsorted(lengths, c, side="right")
        best[c] = best[c - 1]
        if k:
            values = best[c - lengths[:k]] + price[:k]
            i = int(values.argmax())
            if values[i] > best[c] + 1e-12:
                best[c], took[c] = values[i], i
    counts: dict[int, int] = {}
    c = capacity
    while c > 0:
        i = took[c]
        if i < 0:
            c -= 1
        else:
            counts[int(where[i])] = counts.get(int(where[i]), 0) + 1
            c -= int(lengths[i])
    return float(best[capacity]), tuple(sorted(counts.items()))


def _enter(inverse: np.ndarray, d: np.ndarray, out: int) -> None:
    """Update the basis inverse for the pattern (``d`` in terms of the basis) at place ``out``."""
    row = inverse[out] / d[out]
    hit = np.flatnonzero(d)
    inverse[hit] -= d[hit, None] * row
    inverse[out] = row


def _in_basis(inverse: np.ndarray, pattern: Pattern) -> np.ndarray:
    return sum(inverse[:, i] * n for i, n in pattern)


def _crash(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[list[Pattern], np.ndarray, np.ndarray]:
    """A feasible basis (patterns, uses, inverse): filled greedily, longest first, each pattern uses up one class.

    A class that is used up is in no later pattern, so every pattern enters in the place of its class.
    """
    number = {int(n): i for i, n in enumerate(lengths)}
    alive = np.zeros(capacity + 1, bool)
    alive[lengths] = True
    m = len(lengths)
    left, patterns, x, inverse = demand.astype(float), [()] * m, np.zeros(m), np.eye(m)
    while alive.any():
        room, parts = capacity, []
        while room and alive[1 : room + 1].any():
            largest = int(np.flatnonzero(alive[: room + 1])[-1])
            pairs = np.flatnonzero(alive[1:room] & alive[1:room][::-1]) if parts and not alive[room] else ()
            parts += [int(pairs[-1]) + 1, room - int(pairs[-1]) - 1] if len(pairs) else [largest]
            room = capacity - sum(parts)
        counts = {n: parts.count(n) for n in parts}
        times, scarce = min((left[number[n]] / c, n) for n, c in counts.items())
        for n, c in counts.items():
            left[number[n]] = max(0.0, left[number[n]] - times * c)
        alive[scarce] = False
        at = number[scarce]
        patterns[at], x[at] = tuple(sorted((number[n], c) for n, c in counts.items())), times
        _enter(inverse, _in_basis(inverse, patterns[at]), at)
    return patterns, x, inverse


def column_generation(lengths: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 5e-4, rounds: int = 1000) -> list[tuple[Pattern, float]]:
    """Patterns over class numbers and how often the linear program uses each.

    Ends when the value is within ``gap`` of a lower bound (total length, or the dual
    bound); any earlier set of patterns is a valid, slightly longer cutting plan.
    """
    if not len(lengths):
        return []
    patterns, x, inverse = _crash(lengths, demand, capacity)
    bound = float((lengths * demand).sum()) / capacity
    for _ in range(rounds):
        if x.sum() <= bound * (1 + gap):
            break
        price = inverse.sum(axis=0)  # every pattern costs one sequence
        worth, pattern = _knapsack(lengths, price, capacity)
        if worth <= 1 + 1e-9:
            break
        bound = max(bound, float((price * demand).sum()) / worth)
        d = _in_basis(inverse, pattern)
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        x = np.maximum(x - step * d, 0)
        x[out] = step
        _enter(inverse, d, out)
        patterns[out] = pattern
    return [(p, float(v)) for p, v in zip(patterns, x, strict=True)]


def _best_fit(rests: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Best-fit decreasing; ``rests`` are given longest first."""
    by_room: dict[int, list[list]] = {}
    rooms = 0  # bit r is set if a sequence has room r
    for i, n in enumerate(rests):
        fits = rooms >> n
        room = n + (fits & -fits).bit_length() - 1 if fits else capacity
        at = by_room[room].pop() if fits else []
        if fits and not by_room[room]:
            rooms &= ~(1 << room)
        at.append((i, 0, n))
        by_room.setdefault(room - n, []).append(at)
        rooms |= 1 << (room - n)
    return [b for room in sorted(by_room) for b in by_room[room]]


def _leftover(rests: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of ``(item, start, length)`` for the given rests (longest first), without padding."""
    bins = _best_fit(rests, capacity)
    held = [sum(n for _, _, n in b) for b in bins]
    whole = [b for b, n in zip(bins, held, strict=True) if n == capacity]
    opened = [b for b, n in zip(bins, held, strict=True) if n < capacity]
    keep = sum(n for n in held if n < capacity) // capacity
    spare = [p for b in reversed(opened[keep:]) for p in b]

    def take(n: int) -> list[tuple[int, int, int]]:
        got = []
        while n:
            i, start, length = spare.pop()
            used = min(n, length)
            got.append((i, start, used))
            if used < length:
                spare.append((i, start + used, length - used))
            n -= used
        return got

    filled = [b + take(capacity - sum(n for _, _, n in b)) for b in opened[:keep]]
    rest = sum(n for _, _, n in spare)
    tail = [take(1 << b) for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return whole + filled + tail


def cutting_plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple], int]:
    """Rows ``(length, first_rank, ranks, each, sequence, offset, start, part, filled, gap)`` and the number of sequences.

    Ranks ``first_rank .. first_rank + ranks - 1`` of a length class go ``each`` to a
    sequence, from ``sequence`` and ``offset`` on; tokens ``start .. start + part - 1`` of
    each are meant. A pattern that cannot fill its sequences (``gap`` tokens short) lends:
    some uses are taken apart, laid end to end, and cut to fill the gaps of the others
    exactly; such rows have ``gap > 0`` and in ``filled`` the pattern's length. Few uses of
    such a pattern, and what rounding leaves, go to the leftover instead.
    """
    lengths = np.array(sorted(histogram), int)
    demand = np.array([histogram[n] for n in lengths], float)
    next_rank = dict.fromkeys(range(len(lengths)), 0)
    rows, sequence = [], 0

    def use(pattern: Pattern, times: int, at: int, filled: int = 0, gap: int = 0) -> None:
        offset = 0
        for i, n in pattern:
            size = int(lengths[i])
            rows.append((size, next_rank[i], times * n, n, at, offset, 0, size, filled, gap))
            next_rank[i] += times * n
            offset += n * size

    for pattern, times in column_generation(lengths, demand, capacity):
        times = min([int(times + 1e-9), *[(int(demand[i]) - next_rank[i]) // n for i, n in pattern]])
        filled = sum(int(lengths[i]) * n for i, n in pattern)
        gap = capacity - filled
        if times <= 0:
            continue
        if not gap or not filled & (filled - 1):
            use(pattern, times, sequence)
            sequence += times
            continue
        cycle = capacity // math.gcd(filled, gap)  # so many uses fill themselves exactly
        lent = times // cycle * gap // math.gcd(filled, gap)
        if lent:
            kept = lent * filled // gap
            use(pattern, kept, sequence)
            use(pattern, lent, sequence, filled, gap)
            sequence += kept
    left = [(int(lengths[i]), r) for i in reversed(range(len(lengths))) for r in range(next_rank[i], int(demand[i]))]
    for parts in _leftover([n for n, _ in left], capacity):
        offset = 0
        for item, start, n in parts:
            size, rank = left[item]
            rows.append((size, rank, 1, 1, sequence, offset, start, n, 0, 0))
            offset += n
        sequence += 1
    return rows, sequence


@common.own_batches
def pack(
    docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: the id, ``start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is its tokenizer ids and then ``end_id``, so a null or empty text is one
    token. Every id is in exactly one piece; the pieces of a sequence fill it from offset 0
    without gaps. Sequences are full, or hold a power of two. Repeated rows are documents
    of their own. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = tokens.token_rows(docs, path, capacity, end_id, id_col, text_col).withColumn("_row", F.monotonically_increasing_id())
    rows = common.written(rows, "pack-tokens")
    buckets = 1 << rows.count().bit_length() // 2  # about as many as a bucket has rows
    rows = rows.withColumn("_len", (F.col("doc_tokens") % capacity).cast("int"))
    slim = rows.select(
        "_row", "_id", "doc_tokens", "_len", "_rest_crc", F.size("_full").cast("bigint").alias("_n_full"),
        F.pmod(F.xxhash64("_id"), F.lit(buckets)).alias("_b"),
    )
    order = ["_b", "_id", "_row"]
    ranked = common.written(ordered.row_numbers(slim.where("_len > 0"), ["_len"], F.col("_b"), order, "_rank"), "pack-ranks")
    counts = ranked.groupBy("_len").count().collect()  # at most capacity - 1 rows
    plan, sequences = cutting_plan({r["_len"]: r["count"] for r in counts}, capacity)
    plan_rows = spark.createDataFrame(
        plan, "_len int, _r0 bigint, _ranks bigint, _each bigint, _seq bigint, _off bigint, _from bigint, length bigint, _filled bigint, _gap bigint"
    )
    at = F.col("_rank") - 1 - F.col("_r0")
    use, copy = F.floor(at / F.col("_each")), at % F.col("_each")
    matched = (
        ranked.join(F.broadcast(plan_rows), "_len")  # bounded by the capacity, not by the corpus
        .where((at >= 0) & (at < F.col("_ranks")))
        .withColumns({"_use": use, "_at": F.col("_off") + copy * F.col("_len")})
    )
    names = ["_row", "_id", "doc_tokens", "_len", "_rest_crc", "_from", "length", "sequence_id", "offset"]
    placed = matched.where("_gap = 0").withColumns({"sequence_id": F.col("_seq") + F.col("_use"), "offset": F.col("_at")}).select(*names)
    # Lent rests lie end to end; each stretch of _gap tokens ends one sequence.
    begin = F.col("_use") * F.col("_filled") + F.col("_at")
    end = begin + F.col("_len")
    first = F.greatest("_begin", F.col("_j") * F.col("_gap"))
    lent = (
        matched.where("_gap > 0")
        .withColumns({"_begin": begin, "_end": end})
        .withColumn("_j", F.explode(F.sequence(F.floor(F.col("_begin") / F.col("_gap")), F.floor((F.col("_end") - 1) / F.col("_gap")))))
        .withColumns({
            "_from": first - F.col("_begin"),
            "length": F.least("_end", (F.col("_j") + 1) * F.col("_gap")) - first,
            "sequence_id": F.col("_seq") + F.col("_j"),
            "offset": F.col("_filled") + first - F.col("_j") * F.col("_gap"),
        })
        .select(*names)
    )
    placed = placed.unionByName(lent)
    begin = F.col("doc_tokens") - F.col("_len") + F.col("_from")
    out = [F.col("_id").alias(id_col), begin.alias("start"), "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole = placed.where("length = _len").withColumn("ids_crc32", F.col("_rest_crc")).select(*out)
    cut = _cut_crcs(placed.where("length < _len"), rows).select(*out)

    numbered = ordered.running_sums(slim.where("_n_full > 0"), [], F.col("_b"), order, {"_done": F.col("_n_full")})
    full = (
        rows.where("doc_tokens >= " + str(capacity))
        .select("_row", "_full")
        .join(numbered.select("_row", "_id", "doc_tokens", (F.col("_done") - F.col("_n_full") + sequences).alias("_s")), "_row")
        .select("_id", "doc_tokens", "_s", F.posexplode("_full").alias("_p", "ids_crc32"))
        .select(
            F.col("_id").alias(id_col), (F.col("_p") * F.lit(capacity).cast("bigint")).alias("start"), F.lit(capacity).cast("bigint").alias("length"),
            "ids_crc32", "doc_tokens", (F.col("_s") + F.col("_p")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"),
        )
    )
    return full.unionByName(whole).unionByName(cut)


def _cut_crcs(cut: DataFrame, rows: DataFrame) -> DataFrame:
    """``ids_crc32`` of the parts of cut rests (leftovers and lent rests only)."""
    joined = cut.join(rows.select("_row", "_rest"), "_row")

    def crcs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            made = []
            for blob, start, n in zip(*[batch.column(c).to_pylist() for c in ("_rest", "_from", "length")], strict=True):
                made.append(zlib.crc32(blob[4 * start : 4 * (start + n)]))
            keep = [n for n in batch.schema.names if n != "_rest"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], pa.array(made, pa.int64())], [*keep, "ids_crc32"])

    schema = T.StructType([f for f in joined.schema if f.name != "_rest"] + [T.StructField("ids_crc32", T.LongType())])
    return joined.mapInArrow(crcs, schema)
