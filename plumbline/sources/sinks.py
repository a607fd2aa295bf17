"""Reads and writes beyond a plain scan: text formats, guarded writes, staged refresh, extracts."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.contracts import require_columns
from plumbline.operators.joins import ContractError, duplicate_keys


def read_csv(spark: SparkSession, path: str, schema: str, dates: Sequence[str] = (), date_format: str = "yyyy-MM-dd") -> DataFrame:
    """CSV with a header, a declared schema and the named columns parsed as dates."""
    df = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    for name in dates:
        df = df.withColumn(name, F.to_date(name, date_format))
    return df


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_no_clobber(df: DataFrame, path: str, fmt: str = "parquet", **options) -> str:
    """Write that refuses any existing output."""
    if fmt not in {"parquet", "csv", "json"}:
        raise ValueError(f"unsupported format {fmt!r}")
    writer = df.write.mode("errorifexists").format(fmt)
    for key, value in options.items():
        writer = writer.option(key, value)
    writer.save(path)
    return path


def append_decisions(df: DataFrame, path: str, day: str) -> str:
    """Append one row per attempt, partitioned by day. Nothing is ever updated."""
    df.withColumn("day", F.col(day).cast("date")).write.mode("append").partitionBy("day").parquet(path)
    return path


def refresh_panel(panel: DataFrame, path: str, keys: Sequence[str], partition: str) -> DataFrame:
    """Replace the months present in ``panel`` and leave every other month as it was.

    The new rows are staged in a folder of their own, checked there for the grain,
    and only then overwrite their partitions; readers of the path keep their view.
    """
    spark = panel.sparkSession
    staged = f"{path.rstrip('/')}__staged"
    panel.write.mode("overwrite").parquet(staged)
    fresh = spark.read.parquet(staged)
    if not duplicate_keys(fresh, keys).isEmpty():
        raise ContractError(f"duplicate grain {list(keys)}")
    (
        fresh.withColumn("p", F.col(partition))
        .repartition("p")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("p")
        .parquet(path)
    )
    return spark.read.parquet(path).drop("p")


def jdbc_reader(spark: SparkSession, url: str, fetch_size: int = 100_000, **options) -> Callable[[Mapping], DataFrame]:
    """Reader for ``extract``: only required columns, optional partitioned read and watermark."""

    def read(entry: Mapping) -> DataFrame:
        reader = spark.read.format("jdbc").option("url", url).option("fetchsize", fetch_size)
        reader = reader.option("dbtable", entry["source"])
        if "partition_column" in entry:
            for spark_name, key in (
                ("partitionColumn", "partition_column"), ("lowerBound", "lower"), ("upperBound", "upper"), ("numPartitions", "partitions")
            ):
                reader = reader.option(spark_name, entry[key])
        for key, value in options.items():
            reader = reader.option(key, value)
        df = reader.load()
        if entry.get("since") is not None:
            # An ordinary filter: Spark pushes it into the source query, quoted for its dialect.
            df = df.where(F.col(entry["watermark"]) > F.lit(entry["since"]))
        return df

    return read


def _swap(spark: SparkSession, root: str, run: str, names: Sequence[str]) -> None:
    """Rename the staged folders into place, all or none; the old ones go at the end."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(f"{root}/__old-{run}"))
    done: list[tuple[str, str]] = []

    def move(source: str, to: str) -> None:
        if not fs.rename(path(source), path(to)):
            raise OSError(f"cannot rename {source}")
        done.append((source, to))

    try:
        for table in names:
            if fs.exists(path(f"{root}/{table}")):
                move(f"{root}/{table}", f"{root}/__old-{run}/{table}")
            move(f"{root}/__staged-{run}/{table}", f"{root}/{table}")
    except Exception:
        for source, to in reversed(done):
            fs.rename(path(to), path(source))
        raise
    fs.delete(path(f"{root}/__old-{run}"), True)
    fs.delete(path(f"{root}/__staged-{run}"), True)


def extract(manifest: Sequence[Mapping], read: Callable[[Mapping], DataFrame], target: str) -> DataFrame:
    """Copy the listed tables, all or nothing, and return rows per table.

    Every table is read, checked for its columns and staged before any target is touched.
    The swap only renames folders; if one rename fails, those before it are undone, so the
    targets are either all new or all as they were. Runs stage in folders of their own.
    Entries are mappings with ``table``, ``source`` and ``columns``.
    """
    if not manifest:
        raise ContractError("manifest lists no tables")
    root, run = target.rstrip("/"), os.urandom(6).hex()
    names = [entry["table"] for entry in manifest]
    for entry in manifest:
        checked = require_columns(read(entry), entry["columns"]).select(*entry["columns"])
        checked.write.parquet(f"{root}/__staged-{run}/{entry['table']}")
    spark = SparkSession.active()
    _swap(spark, root, run, names)
    counts = [spark.read.parquet(f"{root}/{table}").agg(F.lit(table).alias("table"), F.count(F.lit(1)).alias("rows")) for table in names]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out
