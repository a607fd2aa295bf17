"""Usage pricing, audit-event lifecycles and monthly spend, over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# USD per million text tokens (input, output, 5-minute cache write, cache read).
PRICES = {
    "frontier": ("5.0", "25.0", "6.25", "0.50"),
    "standard": ("2.0", "10.0", "2.50", "0.20"),
    "fast": ("1.0", "5.0", "1.25", "0.10"),
}
BATCH_FACTOR = "0.5"
SCALE = "decimal(18,8)"


def price_table(spark, prices=PRICES) -> DataFrame:
    cells = ", ".join(f"('{m}', " + ", ".join(f"CAST({x} AS DECIMAL(8,4))" for x in p) + ")" for m, p in prices.items())
    return spark.sql(f"SELECT * FROM VALUES {cells} AS t(model, p_in, p_out, p_5m, p_read)")


def usage_cost(calls: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Cost per call in exact decimals; unpriceable calls carry a ``problem`` and no cost.

    One-hour cache writes cost twice the input rate and the batch tier half of everything.
    """
    prices = price_table(calls.sparkSession) if prices is None else prices
    tier = F.coalesce("tier", F.lit("standard"))
    tokens = lambda c: F.col(c).cast("decimal(12,0)")
    raw = (
        tokens("input_tokens") * F.col("p_in")
        + tokens("output_tokens") * F.col("p_out")
        + tokens("write_5m") * F.col("p_5m")
        + tokens("write_1h") * 2 * F.col("p_in")
        + tokens("cache_read") * F.col("p_read")
    )
    factor = F.when(tier == "batch", F.lit(BATCH_FACTOR).cast("decimal(3,2)")).otherwise(F.lit("1").cast("decimal(3,2)"))
    problem = (
        F.when(F.col("p_in").isNull(), "no verified price for response model")
        .when(~tier.isin("standard", "batch"), "pricing modifier required for this service tier")
        .when(F.col("write_5m") + F.col("write_1h") != F.col("written"), "cache write breakdown does not match total")
    )
    return (
        calls.join(F.broadcast(prices), "model", "left")
        .withColumn("problem", problem)
        .withColumn("cost_usd", F.when(F.col("problem").isNull(), (raw * factor / 1000000).cast("decimal(20,10)")))
        .drop("p_in", "p_out", "p_5m", "p_read")
    )


def exploded_codes(events: DataFrame) -> DataFrame:
    """One row per block code of a blocked or failed event; a missing array adds none."""
    codes = F.from_json(F.get_json_object("record", "$.block_codes"), "array<string>")
    return events.where(F.col("event").isin("blocked", "failed")).select("trace_id", "ts", F.explode(codes).alias("code"))


def block_codes(events: DataFrame) -> DataFrame:
    """Distinct traces per code (a trace may log several lifecycle events)."""
    return exploded_codes(events).groupBy("code").agg(F.count_distinct("trace_id").alias("n"))


def trace_lifecycle(events: DataFrame) -> DataFrame:
    """One row per trace: latest event, latency, and whether an intent is still pending.

    A plain aggregate: each trace is reduced map-side, nothing is sorted.
    """
    at = lambda kind: F.min(F.when(F.col("event") == kind, F.col("ts")))
    end = F.max(F.when(F.col("event").isin("completed", "failed"), F.col("ts")))
    got = events.groupBy("trace_id").agg(
        at("received").alias("received_at"),
        at("intent").alias("intent_at"),
        end.alias("ended_at"),
        F.max_by("event", F.struct("ts", "event")).alias("last_event"),
        F.max((F.col("event") == "blocked").cast("int")).alias("was_blocked"),
    )
    millis = (F.unix_micros(F.col("ended_at").cast("timestamp")) - F.unix_micros(F.col("intent_at").cast("timestamp"))) / 1000
    return got.withColumn("latency_ms", millis).withColumn(
        "pending", F.col("intent_at").isNotNull() & F.col("ended_at").isNull()
    )


def month_balance(reservations: DataFrame, cap, soft: float = 0.8) -> DataFrame:
    """Month ledger after all rows: settled money is spent, reserved and uncertain money stays reserved."""
    cap, soft = F.lit(str(cap)).cast(SCALE), F.lit(str(soft)).cast("decimal(6,4)")
    money = lambda c: F.ceil(F.col(c), F.lit(8)).cast(SCALE)
    spent = F.sum(F.when(F.col("status") == "settled", money("actual")).otherwise(F.lit(0).cast(SCALE)))
    held = F.sum(F.when(F.col("status") == "settled", F.lit(0).cast(SCALE)).otherwise(money("quoted")))
    got = reservations.groupBy("period").agg(spent.alias("spent"), held.alias("reserved"), F.count("*").alias("n"))
    used = F.col("spent") + F.col("reserved")
    return got.withColumn("state", F.when(used > cap, "over").when(used >= soft * cap, "soft").otherwise("ok"))
