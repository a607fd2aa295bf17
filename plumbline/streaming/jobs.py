"""Event-time jobs on Structured Streaming.

Sources are any streaming frame with a TIMESTAMP column; watermark delays are
parameters. Sinks write Parquet below the shared folder with their own checkpoint, so
a restarted job continues where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import session
from plumbline.operators import contracts, guard, triage
from plumbline.sources import tables
from plumbline.sources.views import Views


class StreamViews(Views):
    """The canonical projections over streaming scans of the same tables."""

    def raw(self, name: str) -> DataFrame:
        """A table is a folder of part files, or one file: then its folder is read through a name filter."""
        reader, path = self.spark.readStream.schema(tables.SCHEMAS[name]), f"{self.sf_dir.rstrip('/')}/{name}.parquet"
        if session.is_folder(self.spark, path):
            return reader.parquet(path)
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(self.sf_dir)


def event_time(df: DataFrame, col: str, delay: str) -> DataFrame:
    """Watermarks need TIMESTAMP, not the zone-less type: cast in the UTC session, then mark."""
    return df.withColumn(col, F.col(col).cast("timestamp")).withWatermark(col, delay)


def run_available(stream: DataFrame, name: str, mode: str = "append", conf: Mapping[str, str] | None = None) -> DataFrame:
    """Process everything available, then read the sink back as a table; ``conf`` holds settings the job needs."""
    spark = stream.sparkSession
    base = session.shared_dir(spark, name)
    writer = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{base}/state")
    with session.settings(spark, dict(conf or {})):
        writer.trigger(availableNow=True).start(f"{base}/out").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def run_batches(stream: DataFrame, name: str, handle: Callable[[DataFrame, str], None]) -> str:
    """Process everything available through ``handle(batch, folder)``; returns the folder."""
    spark = stream.sparkSession
    base = session.shared_dir(spark, name)
    handle(spark.createDataFrame([], stream.schema), f"{base}/out")  # the folder exists even if nothing arrives
    writer = stream.writeStream.foreachBatch(lambda batch, _: handle(batch, f"{base}/out"))
    writer.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return f"{base}/out"


# ---- windows ------------------------------------------------------------------------------


def tumbling_means(stream: DataFrame, at: str, keys: list[str], value: str, width: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    marked = event_time(stream, at, delay)
    grouped = marked.groupBy(F.window(at, width), *keys).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    return grouped.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "mean", "n")


def alarms(windows: DataFrame, keys: list[str], limit: float = 0.70, needed: int = 3) -> DataFrame:
    """Windows closing ``needed`` adjacent windows below the limit; a missing window breaks the chain."""
    w = Window.partitionBy(*keys).orderBy("start")
    low = F.col("mean") < limit
    chain = low
    for i in range(1, needed):
        chain = chain & F.coalesce(F.lag(low, i).over(w) & (F.lag("end", i).over(w) == F.lag("start", i - 1).over(w) if i > 1 else F.lag("end", 1).over(w) == F.col("start")), F.lit(False))
    return windows.withColumn("alarm", chain)


def rolling_yield(stream: DataFrame, at: str, key: str, good: Column, width: str = "30 days", slide: str = "1 day", delay: str = "1 day") -> DataFrame:
    marked = event_time(stream.withColumn("__good", good.cast("int")), at, delay)
    grouped = marked.groupBy(F.window(at, width, slide), key).agg(F.count("*").alias("n"), F.sum("__good").alias("ok"))
    return grouped.select(key, F.col("window.end").alias("until"), "n", (F.col("ok") / F.col("n")).alias("yield_share"))


def sessions(stream: DataFrame, at: str, key: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Lifecycle events of a trace until it falls quiet; a session with an intent and no end is pending."""
    has = lambda *kinds: F.max(F.col("event").isin(*kinds).cast("int"))
    grouped = event_time(stream, at, delay).groupBy(F.session_window(at, gap), key).agg(
        F.count("*").alias("n"), has("intent").alias("intent"), has("completed", "failed").alias("ended")
    )
    return grouped.select(
        key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n",
        ((F.col("intent") == 1) & (F.col("ended") == 0)).alias("pending"),
    )


# ---- stateless and deduplicating -----------------------------------------------------------


def dedup_intake(raw: DataFrame, at: str, delay: str = "1 hour") -> DataFrame:
    """Accepted intake events, one per dedup key within the delay."""
    accepted = contracts.intake(raw).where("status = 202")
    return event_time(accepted, at, delay).dropDuplicatesWithinWatermark(["dedup_key"])


def rule_decisions(reports: DataFrame) -> DataFrame:
    """Rule fields and identifier kinds of arriving incident texts."""
    ruled = triage.rule_fields(reports, "description", "family_supplier")
    return ruled.select(
        "ncr_id", "rule_severity", "rule_category", F.array_join("rules_fired", ",").alias("rules"),
        F.array_join(guard.pii_kinds("description"), ",").alias("kinds"),
    )


def append_batch(batch: DataFrame, folder: str) -> None:
    batch.write.mode("append").parquet(folder)


# ---- joins ---------------------------------------------------------------------------------


def recurrence(closures: DataFrame, events: DataFrame, keys: list[str], delay: str = "30 days") -> DataFrame:
    """Same-cause events within six months after a closure: an interval join of two streams.

    186 days bound the state; the exact calendar limit is checked on top of it.
    """
    c = event_time(closures, "closed_at", delay).select(*[F.col(k).alias(f"c_{k}") for k in keys], "car_id", "closed_at")
    e = event_time(events, "discovered_at", delay).select(*keys, "ncr_id", "discovered_at")
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(f"c_{k}") == F.col(k))
    near = (F.col("discovered_at") > F.col("closed_at")) & (F.col("discovered_at") <= F.col("closed_at") + F.expr("INTERVAL 186 DAYS"))
    exact = F.col("discovered_at").cast("date") <= F.add_months(F.col("closed_at").cast("date"), 6)
    return c.join(e, same & near).where(exact).select("car_id", "ncr_id", *keys, "closed_at", "discovered_at")


class Intake:
    """Sides of an arriving stream, batch by batch: accepted, quarantined and late rows, none of them lost.

    A row is late if it is older than ``delay`` before the newest row of earlier batches; a
    key is accepted once within that reach: its earliest row, of one instant the one least in ``tie``. Every batch writes folders of its own number
    and reads only those of smaller numbers, so a batch that is run again after a failure
    replaces what it wrote and changes nothing else.
    """

    SIDES = ("accepted", "quarantine", "late")

    def __init__(self, spark, folder: str, at: str, key: str = "dedup_key", delay: str = "1 hour", tie: Sequence[str] = ()):
        self.spark, self.folder, self.at, self.key, self.delay, self.tie = spark, folder, at, key, delay, tie

    def _write(self, rows: DataFrame, side: str, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{side}/batch={number}")

    def read(self, side: str, schema, before: int | None = None) -> DataFrame:
        """All rows of a side, or those of batches before one; ``batch`` is among the columns."""
        from pyspark.errors import AnalysisException

        full = T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])
        try:
            rows = self.spark.read.schema(full).parquet(f"{self.folder}/{side}")
        except AnalysisException:  # no batch yet
            rows = self.spark.createDataFrame([], full)
        return rows if before is None else rows.where(F.col("batch") < before)

    def handle(self, batch: DataFrame, number: int) -> None:
        judged = contracts.intake(batch)
        marks = T.StructType([T.StructField("newest", judged.schema[self.at].dataType)])
        newest = self.read("marks", marks, number).agg(F.max("newest")).first()[0]
        known = F.col("status") == 202
        late = F.lit(False) if newest is None else F.col(self.at) < F.lit(newest) - F.expr(f"INTERVAL {self.delay}")
        self._write(judged.where(~known), "quarantine", number)
        self._write(judged.where(known & late), "late", number)
        whole = F.struct(*judged.columns)
        first = judged.where(known & ~late).groupBy(self.key).agg(F.min_by(whole, F.struct(self.at, *self.tie, F.xxhash64(*judged.columns))).alias("r")).select("r.*")
        done = self.read("accepted", judged.schema, number)
        done = done if newest is None else done.where(F.col(self.at) >= F.lit(newest) - F.expr(f"INTERVAL {self.delay}") - F.expr(f"INTERVAL {self.delay}"))
        self._write(first.join(done.select(self.key), self.key, "left_anti").select(judged.columns), "accepted", number)
        self._write(batch.agg(F.max(self.at).alias("newest")), "marks", number)

    def sides(self, schema) -> DataFrame:
        rows = [self.read(s, schema).withColumn("side", F.lit(s)) for s in self.SIDES]
        return rows[0].unionByName(rows[1]).unionByName(rows[2])


def intake_sides(raw: DataFrame, at: str, name: str, delay: str = "1 hour", tie: Sequence[str] = ()) -> DataFrame:
    """Run :class:`Intake` over everything available; rows with their ``side`` and ``batch``."""
    spark = raw.sparkSession
    base = session.shared_dir(spark, name)
    job = Intake(spark, f"{base}/out", at, delay=delay, tie=tie)
    marked = raw.withColumn(at, F.col(at).cast("timestamp"))
    writer = marked.writeStream.foreachBatch(job.handle).option("checkpointLocation", f"{base}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return job.sides(contracts.intake(marked).schema)
