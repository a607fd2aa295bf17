"""Exact deduplication by a tree merge of sorted digest runs.

Every input partition becomes a run: its rows sorted by a 64-bit digest of the
normalised text, equal texts already reduced to one row. There are P runs, P a power
of two, and the merge takes log2(P) / ``fan_bits`` binomial rounds. In a round the
2^fan_bits runs whose numbers differ only in that round's bits exchange parts: run p
receives, from each partner, the rows whose digest has p's own bits there. The parts
arrive, are merged in digest order, and equal texts are reduced again, so a group of
copies sends at most one row per run in every round, however large it is. After the
last round each text is one row in the run that its digest names.

A digest match alone decides nothing: rows are reduced only if their SHA-256 agrees
too, at every level. Only digests move; whole texts are read once, in the scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import common


def text_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, _mark, _sha, _digest, _len`` of every row; a null text counts as empty."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(
        F.col(f"`{id_col}`").alias("_id"),
        F.regexp_replace(text, common.SPACE, "").alias("_norm"),
        F.char_length(text).cast("bigint").alias("_len"),
        common.mark(text).alias("_mark"),
    ).select("_id", "_mark", F.unhex(F.sha2("_norm", 256)).alias("_sha"), F.xxhash64("_norm").alias("_digest"), "_len")


def _starts(batch: pa.RecordBatch) -> np.ndarray:
    """First rows of equal texts; a digest match is verified by SHA-256."""
    digest = batch.column("_digest").to_numpy(zero_copy_only=False)
    sha = batch.column("_sha")
    differ = pc.not_equal(sha.slice(1), sha.slice(0, len(sha) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.concatenate([[True], (digest[1:] != digest[:-1]) | differ]))


def _reduced(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows in, one row per text out: the first row stays, counts add up."""
    held = None
    for batch in it:
        if not batch.num_rows:
            continue
        if held is not None:
            columns = [pa.concat_arrays([a, b]) for a, b in zip(held.columns, batch.columns, strict=True)]
            batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
        at = _starts(batch)
        sums = np.add.reduceat(batch.column("_n").to_numpy(zero_copy_only=False), at)
        out = batch.take(pa.array(at))
        n = out.schema.get_field_index("_n")
        out = pa.RecordBatch.from_arrays([pa.array(sums) if i == n else c for i, c in enumerate(out.columns)], schema=out.schema)
        held = out.slice(out.num_rows - 1)
        if out.num_rows > 1:
            yield out.slice(0, out.num_rows - 1)
    if held is not None:
        yield held


def _merged(runs: DataFrame) -> DataFrame:
    order = ["_digest", "_sha", F.desc("_len"), F.asc_nulls_last("_id"), "_row"]
    return runs.sortWithinPartitions(*order).mapInArrow(_reduced, runs.schema)


def merge_runs(keys: DataFrame, runs: int | None = None, fan_bits: int = 3) -> DataFrame:
    """One row per distinct text: ``_digest, _sha, _len, _id, _row`` of the row that stays, ``_n`` rows."""
    if runs is None:
        runs = max(16, common.shuffle_partitions(keys.sparkSession))
    runs = common.power_of_two(runs)
    level = _merged(
        keys.select(
            "_digest", "_sha", "_len", "_id", "_row",
            F.lit(1).cast("bigint").alias("_n"),
            F.pmod(F.spark_partition_id(), F.lit(runs)).alias("_run"),
        )
    )
    bits = runs.bit_length() - 1
    for low in range(0, bits, fan_bits):
        mask = ((1 << min(fan_bits, bits - low)) - 1) << low
        own = F.col("_run").bitwiseAND(F.lit(~mask))
        named = F.col("_digest").bitwiseAND(F.lit(mask).cast("bigint")).cast("int")
        level = _merged(level.withColumn("_run", own.bitwiseOR(named)).repartitionById(runs, F.col("_run")))
    return level.drop("_run")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int | None = None, fan_bits: int = 3) -> DataFrame:
    """One row per input row: the id, ``keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after deleting the six ASCII space characters. Of
    equal texts the row with most code points stays, then the one with the smallest id
    (a null id is the largest). A null text counts as empty, so nulls, empty texts and
    texts of spaces form one group. A row that occurs twice with the same id and text is
    two members of its group and only one of them is kept. An empty table gives no
    rows. Other columns are not read.
    """
    keys = common.written(text_keys(docs, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()), "exact-keys")
    texts = merge_runs(keys, runs, fan_bits).where("_n > 1")
    groups = texts.select("_sha", F.struct(F.col("_id").alias("id"), F.col("_row").alias("row"), F.col("_n").alias("n")).alias("_group"))
    rows = keys.join(groups, "_sha", "left")
    alone = F.col("_group").isNull()
    return rows.select(
        F.col("_id").alias(id_col),
        F.when(alone, F.col("_id")).otherwise(F.col("_group.id")).alias("keep_id"),
        F.coalesce("_group.n", F.lit(1).cast("bigint")).alias("group_size"),
        (alone | (F.col("_group.row") == F.col("_row"))).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def distinct_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with all their columns."""
    keys = common.written(text_keys(docs, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()), "exact-keys")
    winners = merge_runs(keys).select("_row")
    stays = keys.join(winners, "_row", "left_semi").select("_id", "_mark")
    times = keys.groupBy("_id", "_mark").agg(F.count("*").alias("_times"))
    return common.keep_once(docs, times.join(stays, common.same_mark(times, stays), "left_semi"), id_col, text_col)
