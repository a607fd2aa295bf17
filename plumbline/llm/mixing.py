"""Mixing sources to target weights with a low-discrepancy schedule.

1. Targets: the sources share ``share`` times all words by weight; a target stops at
   ``cap`` times its source, and the excess goes to the others by weight. The result is
   ``min(cap * size, level * weight)`` with one level for all, found from running sums
   over the sources (one row each), so no loop is needed.
2. Blocks: the documents of a source are shuffled (by a hash of the id) and laid on a
   line; the line, read up to ``cap`` times, is cut into blocks of ``block`` words.
3. Schedule: slot t is the point frac(t * golden ratio). Mapped through the cumulative
   block counts it names a source; the k-th slot of a source takes its k-th block. Slots
   beyond a source's last block (a handful, by low discrepancy) go to the sources that
   are as many short, so every wanted block has exactly one slot.
4. The blocks' document pieces join the slots on (source, k); a document's taken words
   are the sum of its pieces, and its first slot says where in the mix it is met first.
   Every stretch of slots holds the sources in about their targets' proportions.

All of it is DataFrame work. Running sums and slot ranks are two-level (inside a hash or
slot bucket, then over buckets), so a source with a third of all rows is no hot task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import common
from plumbline.operators import ordered

#: 2^31 divided by the golden ratio, made odd: t * STEP mod 2^31 visits every point once.
STEP, MODULUS = 1327217885, 2147483648
SLOT_BUCKET = 1 << 16


def source_key(source: Column) -> Column:
    """Non-null text that sorts by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def targets(sources: DataFrame, weights: Sequence[int], share: float, cap: int) -> DataFrame:
    """``_key, source_size`` (one row per source) with its ``target``."""
    everything = Window.partitionBy(F.lit(0))
    by_key = everything.orderBy("_key")
    # A capped source's limit per weight comes first; ties have equal level and need no order of their own.
    by_limit = everything.orderBy("_limit", "_key").rowsBetween(Window.unboundedPreceding, -1)
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    weighted = (
        sources.withColumn("_w", F.element_at(cycle, (F.pmod(F.row_number().over(by_key) - 1, F.lit(len(weights))) + 1).cast("int")))
        .withColumn("_cap", F.col("source_size") * cap)
        .withColumn("_limit", F.col("_cap") / F.col("_w"))
        .withColumn("_total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("_all_w", F.sum("_w").over(everything))
    )
    leveled = weighted.withColumn(
        "_level",
        (F.col("_total") - F.coalesce(F.sum("_cap").over(by_limit), F.lit(0)))
        / (F.col("_all_w") - F.coalesce(F.sum("_w").over(by_limit), F.lit(0))),
    )
    # The first source (by limit) whose level does not exceed its limit sets the level of all.
    level = F.min(F.when(F.col("_level") <= F.col("_limit"), F.struct("_limit", "_key", "_level"))).over(everything)["_level"]
    return leveled.select("_key", "source_size", F.least(F.col("_cap").cast("double"), level * F.col("_w")).alias("target"))


def schedule(plan: DataFrame, slots: int, sources: int) -> DataFrame:
    """``t, _key, k``: the slots in order, each with its source and the block it takes.

    ``plan`` has ``_key, _first, _blocks``: cumulative block counts of the sources.
    """
    spark = plan.sparkSession
    cells = max(4096, 4 * sources)
    width = max(1, -(-slots // cells))
    point = F.pmod(F.pmod(F.col("id"), F.lit(MODULUS)) * F.lit(STEP), F.lit(MODULUS)) / F.lit(float(MODULUS))
    drawn = spark.range(slots).select(
        F.col("id").alias("t"), F.least(F.floor(point * F.lit(float(slots))), F.lit(slots - 1)).cast("bigint").alias("_at")
    ).withColumn("_cell", F.floor(F.col("_at") / width))
    last = F.col("_first") + F.col("_blocks") - 1
    held = plan.where("_blocks > 0").withColumn(
        "_cell", F.explode(F.sequence(F.floor(F.col("_first") / width), F.floor(last / width)))
    )
    named = drawn.join(held, "_cell").where((F.col("_at") >= F.col("_first")) & (F.col("_at") <= last)).select("t", "_key", "_blocks")
    ranked = common.written(
        ordered.row_numbers(named, ["_key"], F.floor(F.col("t") / SLOT_BUCKET), ["t"], "rn").withColumn("k", F.col("rn") - 1).drop("rn"),
        "mix-slots",
    )
    used = ranked.where(F.col("k") < F.col("_blocks")).select("t", "_key", "k")
    # Per source a few slots too many or too few: their number is bounded by the points' discrepancy.
    one = Window.partitionBy(F.lit(0))
    spare = ranked.where(F.col("k") >= F.col("_blocks")).select("t", F.row_number().over(one.orderBy("t")).alias("_n"))
    counts = ranked.groupBy("_key").agg(F.count("*").alias("_got"))
    short = (
        plan.join(counts, "_key", "left")
        .withColumn("_got", F.coalesce("_got", F.lit(0)))
        .where(F.col("_got") < F.col("_blocks"))
        .select("_key", F.explode(F.sequence(F.col("_got"), F.col("_blocks") - 1)).alias("k"))
        .withColumn("_n", F.row_number().over(one.orderBy("_key", "k")))
    )
    return used.unionByName(spare.join(short, "_n").select("t", "_key", "k"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: int = 2, block: int = 256, seed: str = "mix",
) -> DataFrame:
    """One row per input row: the id, ``size, source_size, target, taken, first_slot``, and ``_slots, _row, _mark``.

    ``first_slot`` is the first slot (0, 1, ...) whose block holds words of the row, null if
    none are taken; ``_slots`` has that of each pass over its source that reads it. ``size`` is the number of words (null text: 0). ``taken`` counts the words that the
    mix takes, repeats included: 0 to ``cap`` times the size. A source's taken words are
    its target rounded down. Null sources are one source, ordered last. A row that occurs
    twice is two documents. Sources without words get target 0; an empty table gives no
    rows. Other columns are not read. Reruns agree: the order depends on ids only.
    """
    sized = common.written(
        docs.select(
            F.col(f"`{id_col}`").alias("_id"),
            source_key(F.col(f"`{source_col}`")).alias("_key"),
            common.word_count(F.col(f"`{text_col}`")).alias("size"),
            common.mark(text_col).alias("_mark"),
        ).withColumn("_row", F.monotonically_increasing_id()),
        "mix-sizes",
    )
    by_source = sized.groupBy("_key").agg(F.sum("size").alias("source_size"))
    plan = targets(by_source, weights, share, cap).withColumn("_words", F.floor("target").cast("bigint"))
    plan = plan.withColumn("_blocks", F.ceil(F.col("_words") / block).cast("bigint"))
    before = Window.partitionBy(F.lit(0)).orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    plan = common.written(plan.withColumn("_first", F.coalesce(F.sum("_blocks").over(before), F.lit(0))), "mix-plan")
    total = plan.agg(F.coalesce(F.sum("_blocks"), F.lit(0)).alias("slots"), F.count("*").alias("sources")).first()
    slots = schedule(plan, total["slots"], total["sources"])

    # About as many hash buckets as a bucket has rows: neither level of the running sums is long.
    digits = 1 + (sized.count().bit_length() // 2) // 4
    order = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("_id").cast("string"), F.lit(""))))
    placed = ordered.running_sums(
        sized.drop("_mark").withColumn("_h", order), ["_key"], F.substring("_h", 1, digits), ["_h", "_id", "size", "_row"], {"_end": F.col("size")}
    ).join(plan.select("_key", "source_size", "_words"), "_key")
    start = F.col("_end") - F.col("size") + F.col("_pass") * F.col("source_size")
    pieces = (
        placed.where("size > 0")
        .withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(cap - 1))))
        .select("_row", "_key", "_words", "_pass", start.alias("_from"), (start + F.col("size")).alias("_to"))
        .withColumn("_to", F.least("_to", "_words"))
        .where("_from < _to")
        .withColumn("k", F.explode(F.sequence(F.floor(F.col("_from") / block), F.floor((F.col("_to") - 1) / block))))
        .withColumn("_in", F.least("_to", (F.col("k") + 1) * block) - F.greatest("_from", F.col("k") * block))
    )
    passes = pieces.join(slots, ["_key", "k"]).groupBy("_row", "_pass").agg(F.sum("_in").alias("_in"), F.min("t").alias("_t"))
    taken = passes.groupBy("_row").agg(F.sum("_in").alias("taken"), F.sort_array(F.collect_list("_t")).alias("_slots"))  # at most ``cap`` passes
    return (
        sized.join(taken, "_row", "left")
        .join(plan.select("_key", "source_size", "target"), "_key")
        .select(F.col("_id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), F.col("_slots")[0].alias("first_slot"), "_slots", "_row", "_mark")
    )


def repeated(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as ``plan`` (a result of :func:`mix`) reads it, with all columns.

    A partly read pass counts as one. Rows come in the order of their slots, so files read
    one after another follow the schedule. A row that is not read goes. Of rows with the
    same id and text one stands for all of them, and takes all their slots.
    """
    reads = plan.select(F.col(f"`{id_col}`").alias("_id"), "_mark", F.explode("_slots").alias("_slot"))
    doc = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    rows = doc.select("_doc", F.col("_doc").getField(id_col).alias("_id"), common.mark(F.col("_doc").getField(text_col)).alias("_mark"))
    twins = plan.groupBy(F.col(f"`{id_col}`").alias("_id"), "_mark").agg(F.count("*").alias("_rows")).where("_rows > 1")
    if twins.take(1):
        twins = common.written(twins, "mix-twins")
        once = rows.join(twins, common.same_mark(rows, twins), "left_anti")
        rows = once.unionByName(
            rows.join(twins, common.same_mark(rows, twins), "left_semi").groupBy("_id", "_mark").agg(F.min_by("_doc", F.xxhash64(F.to_json("_doc"))).alias("_doc")).select("_doc", "_id", "_mark")
        )
    met = rows.join(reads, common.same_mark(rows, reads)).select("_doc", "_slot")
    return met.repartitionByRange("_slot").sortWithinPartitions("_slot").select("_doc.*")
