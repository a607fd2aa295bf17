"""Joins that need more than an equality: validated, range, as-of, recursive, prior-window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from plumbline import session
from plumbline.operators import ordered


class ContractError(ValueError):
    """Input data break a stated contract."""


def broadcast_checked(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Hint a broadcast only when the side is counted to be small; otherwise leave it to the planner."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def validated_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str, validate: str) -> DataFrame:
    """Join that refuses duplicate keys: ``many_to_one``, ``one_to_many`` or ``one_to_one``."""
    if validate not in {"many_to_one", "one_to_many", "one_to_one"}:
        raise ValueError(f"unknown validation {validate!r}")
    if validate in {"many_to_one", "one_to_one"} and not duplicate_keys(right, on).isEmpty():
        raise ContractError(f"right side has duplicate keys {list(on)}: not {validate}")
    if validate in {"one_to_many", "one_to_one"} and not duplicate_keys(left, on).isEmpty():
        raise ContractError(f"left side has duplicate keys {list(on)}: not {validate}")
    return left.join(right, list(on), how)


def pairs_within_days(events: DataFrame, key: str, at: str, row_id: str, days: int) -> DataFrame:
    """Ordered pairs of one key at most ``days`` apart, each pair once.

    The time axis is cut into ``days``-wide buckets; the later row is copied into its
    own and the previous bucket, so the join is a plain equality on (key, bucket) and
    a hot key spreads over all buckets. Only pairs in range are ever compared.
    """
    day = F.datediff(F.col(at).cast("date"), F.lit("1970-01-01").cast("date"))
    bucket = F.floor(day / days)
    first = events.select(key, F.col(at).alias("t1"), F.col(row_id).alias("first_id"), bucket.alias("b"))
    second = events.select(
        key, F.col(at).alias("t2"), F.col(row_id).alias("second_id"), F.explode(F.array(bucket, bucket - 1)).alias("b")
    )
    later = F.struct("t2", "second_id") > F.struct("t1", "first_id")
    near = F.col("t2") <= F.col("t1") + F.expr(f"INTERVAL '{days}' DAY")
    return first.join(second, [key, "b"]).where(later & near).select(key, "first_id", "second_id", "t1", "t2")


def totals_before(
    points: DataFrame, events: DataFrame, key: Sequence[str], day: str, sums: dict[str, Column]
) -> DataFrame:
    """For each distinct (key, day) of ``points``: sums over events strictly before that day.

    One union timeline of daily sums and asked days, one running window: the
    equivalent of a sorted array and binary search, without a range join.
    """
    daily = events.groupBy(*key, day).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    asked = points.select(*key, day).distinct().select("*", *[F.lit(0).alias(n) for n in sums], F.lit(True).alias("ask"))
    line = daily.withColumn("ask", F.lit(False)).unionByName(asked)
    perday = line.groupBy(*key, day).agg(*[F.sum(n).alias(n) for n in sums], F.max("ask").alias("ask"))
    before = Window.partitionBy(*key).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    return (
        perday.select(*key, day, "ask", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums])
        .where("ask")
        .drop("ask")
    )


def counts_around(
    anchors: DataFrame, events: DataFrame, key: str, anchor_day: str, event_day: str, days: int
) -> DataFrame:
    """Per distinct (key, anchor day): events in the ``days`` before and from then on."""
    a = anchors.select(key, F.col(anchor_day).alias("a")).distinct()
    edges = a.select(key, "a", F.explode(F.array(F.lit(-days), F.lit(0), F.lit(days))).alias("off")).withColumn(
        "d", F.date_add("a", F.col("off"))
    )
    ev = events.select(key, F.col(event_day).cast("date").alias("d"))
    cum = totals_before(edges, ev, [key], "d", {"n": F.lit(1)})
    at = edges.join(cum, [key, "d"])
    pick = lambda off: F.max(F.when(F.col("off") == off, F.col("n")))
    return at.groupBy(key, F.col("a").alias(anchor_day)).agg(
        (pick(0) - pick(-days)).alias("before_count"), (pick(days) - pick(0)).alias("after_count")
    )


def recurrence(cars: DataFrame, events: DataFrame, keys: Sequence[str], asof: str, months: int = 6) -> DataFrame:
    """Each mature closed case with whether a same-key event followed within ``months``.

    Existence only needs the distinct event days of a key, so both sides are reduced
    to (keys, day) first and bucketed by month before the equality join.
    """
    at = F.lit(asof).cast("date")
    until = F.add_months("closed_at", months)
    mature = cars.where((until <= at) & F.col(keys[-1]).isNotNull())
    closings = mature.select(*keys, "closed_at").distinct()
    slots = closings.withColumn(
        "m", F.explode(F.sequence(F.trunc("closed_at", "MM"), F.trunc(until, "MM"), F.expr("interval 1 month")))
    )
    days = (
        events.where(F.col("adjudicated_at") <= at)
        .select(*keys, F.col("discovered_at").cast("date").alias("d"))
        .distinct()
        .withColumn("m", F.trunc("d", "MM"))
    )
    hit = (
        slots.join(days, [*keys, "m"])
        .where((F.col("d") > F.col("closed_at")) & (F.col("d") <= until))
        .select(*keys, "closed_at")
        .distinct()
        .withColumn("recurred", F.lit(1))
    )
    return mature.join(hit, [*keys, "closed_at"], "left").withColumn("recurred", F.coalesce("recurred", F.lit(0)))


def overlapping_revisions(rows: DataFrame, keys: Sequence[str], revision: str) -> DataFrame:
    """Pairs of revisions of one key whose half-open validity intervals overlap."""
    far = F.lit("9999-12-31").cast("date")
    spans = rows.select(*keys, revision, "valid_from", F.coalesce("valid_to", far).alias("valid_to")).distinct()
    a = spans.select(*keys, *[F.col(c).alias(f"a_{c}") for c in (revision, "valid_from", "valid_to")])
    b = spans.select(*keys, *[F.col(c).alias(f"b_{c}") for c in (revision, "valid_from", "valid_to")])
    return (
        a.join(b, list(keys))
        .where(
            (F.col(f"a_{revision}") < F.col(f"b_{revision}"))
            & (F.col("a_valid_from") < F.col("b_valid_to"))
            & (F.col("b_valid_from") < F.col("a_valid_to"))
        )
        .select(*keys, F.col(f"a_{revision}").alias("earlier_key"), F.col(f"b_{revision}").alias("later_key"))
        .distinct()
    )


def explode_hierarchy(edges: DataFrame, root, max_level: int = 20) -> DataFrame:
    """All descendants of ``root`` with their level; the depth guard stops cycles.

    One equality join per level. Each frontier is checkpointed to the shared folder,
    so a lost executor replays one level, and the loop ends at the first empty level.
    """
    session.ensure_checkpoint_dir(edges.sparkSession)
    edges = edges.select("part_id", "parent_id", "quantity")
    level = edges.where(F.col("parent_id") == root).withColumn("level", F.lit(1)).checkpoint()
    found = level
    for depth in range(2, max_level + 1):
        if level.isEmpty():
            break
        parents = level.select(F.col("part_id").alias("parent_id"))
        level = edges.join(parents, "parent_id").select(edges.columns).withColumn("level", F.lit(depth)).checkpoint()
        found = found.unionByName(level)
    return found


def last_outcomes(
    cycles: DataFrame, machine: str, start: str, done: str, outcome: str, row_id: str, n: int = 5
) -> DataFrame:
    """Per row: sum of ``outcome`` over the last ``n`` rows of its machine completed strictly before its start.

    Completions are numbered in order and carry a running total; the answer for a row
    is the total at its position minus the total ``n`` places earlier, which is an
    equality join on (machine, position). No per-machine group is ever collected.
    """
    starts = cycles.select(
        machine, F.col(start).alias("at"), F.lit(0).alias("kind"), F.col(row_id).alias("rid"), F.lit(0).alias("x")
    )
    ends = cycles.select(
        machine, F.col(done).alias("at"), F.lit(1).alias("kind"), F.col(row_id).alias("rid"), F.col(outcome).alias("x")
    )
    line = ordered.running_sums(
        starts.unionByName(ends),
        [machine],
        F.col("at").cast("date"),
        ["at", "kind", "rid"],
        {"seen": F.col("kind").cast("bigint"), "total": F.col("x").cast("bigint")},
    )
    marks = line.where("kind = 1").select(machine, F.col("seen").alias("back"), F.col("total").alias("total_back"))
    asks = line.where("kind = 0").withColumn("back", F.col("seen") - n)
    return asks.join(marks, [machine, "back"], "left").select(
        machine, F.col("rid").alias(row_id), (F.col("total") - F.coalesce("total_back", F.lit(0))).alias("prior_fails")
    )


#: Rows of one key from which on it is dealt to stretches of time.
BUSY_KEY = 100_000


def prior_history(events: DataFrame, key: str, at: str, row_id: str, days: int = 90, shown: int = 10, busy: int = BUSY_KEY) -> DataFrame:
    """For every event: how many of its key fell in the ``days`` before it, and the latest ``shown`` ids.

    A row moves once, to its key, where totals are differences of two running counts and the listed
    ids are the ``shown`` rows before an instant, so the work is linear. A key with more than ``busy`` rows is
    cut into stretches of ``days``; its rows move to their own and, to be seen, to the next one.
    """
    day = F.datediff(F.col(at).cast("date"), F.lit("1970-01-01").cast("date"))
    stretch = F.coalesce(F.floor(day / days), F.lit(0))
    crowded = events.groupBy(key).count().where(F.col("count") > busy).select(key, F.lit(True).alias("__busy"))
    places = F.when(F.col("__busy"), F.array(stretch, stretch + 1)).otherwise(F.array(F.lit(0).cast("bigint")))
    ev = events.select(key, at, F.col(row_id).alias("rid"), F.unix_micros(F.col(at).cast("timestamp")).alias("us"))
    # At most one row for every ``busy`` rows of the table.
    ev = ev.join(F.broadcast(crowded), key, "left").select(key, "rid", "us", F.posexplode(places).alias("seen_only", "place"))
    width, spot = days * 86_400_000_000, Window.partitionBy(key, "place")
    # Latest first, ties by ascending id: of one instant the largest id comes first, and its list is everyone's.
    before = spot.orderBy("us", F.desc("rid")).rowsBetween(-shown, -1)
    moment = Window.partitionBy(key, "place", "us").orderBy(F.desc("rid")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    until = lambda last: F.count("*").over(spot.orderBy("us").rangeBetween(Window.unboundedPreceding, last))
    line = (
        ev.withColumn("listed", F.collect_list(F.struct("us", "rid")).over(before))
        .withColumn("listed", F.first("listed").over(moment))
        .withColumns({"earlier": until(-1), "older": until(-width - 1)})
        .where("seen_only = 0")
    )
    recent = F.transform(F.reverse(F.filter("listed", lambda r: r["us"] >= F.col("us") - width)), lambda r: r["rid"])
    known = F.col(key).isNotNull() & F.col("us").isNotNull()
    none = F.array().cast(ArrayType(events.schema[row_id].dataType))
    return line.select(
        key,
        F.col("rid").alias(row_id),
        F.when(known, F.col("earlier") - F.col("older")).otherwise(0).alias("total_in_window"),
        F.when(known, recent).otherwise(none).alias("recent"),
    )
