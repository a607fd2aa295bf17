"""Verification as a checks table: check, value, expected, passed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import joins


def line(one_row: DataFrame, name: str, value, expected=0.0) -> DataFrame:
    got = value.cast("double")
    want = F.lit(expected).cast("double") if not hasattr(expected, "cast") else expected.cast("double")
    return one_row.select(F.lit(name).alias("check"), got.alias("value"), want.alias("expected"), F.coalesce(got == want, F.lit(False)).alias("passed"))


def stack(lines: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, lines)


def duplicate_rows(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows beyond the first of each key."""
    extra = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("x"))
    return line(extra, name, F.col("x"))


def recomputed_windows(grid: DataFrame, events: DataFrame, at: str, days: int = 90) -> DataFrame:
    """Trailing and forward sums of every grid row from cumulative day totals (an independent method)."""
    ev = events.select("supplier_id", F.col(at).cast("date").alias("d"), "severity")
    edges = grid.select("supplier_id", "month_end", F.explode(F.array(F.lit(-days), F.lit(0), F.lit(days))).alias("off")).withColumn(
        "d", F.date_add("month_end", F.col("off"))
    )
    sums = {"n": F.lit(1), "harm": F.col("severity")}
    cum = joins.totals_before(edges, ev, ["supplier_id"], "d", sums)
    at_edges = edges.join(cum.hint("merge"), ["supplier_id", "d"])
    pick = lambda off, c: F.max(F.when(F.col("off") == off, F.col(c)))
    return at_edges.groupBy("supplier_id", "month_end").agg(
        (pick(0, "n") - pick(-days, "n")).alias("trailing_n"), (pick(days, "harm") - pick(0, "harm")).alias("forward_harm")
    )
