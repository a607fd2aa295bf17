"""One place that builds a SparkSession with the settings the library relies on."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Semantics the operators depend on; set on whatever session is handed to us.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(app: str = "plumbline", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**REQUIRED, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def local(cores: str | int = "*", **conf: str) -> SparkSession:
    """A single-JVM session for tests and the bench."""
    return build(
        master=f"local[{cores}]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
            "spark.sql.autoBroadcastJoinThreshold": "10m",
            **conf,
        },
    )


def configure(spark: SparkSession) -> SparkSession:
    """Apply the session settings that change results (never cluster sizing)."""
    for key, value in REQUIRED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir``; a temporary one is used only
    where that setting is absent (single-machine tests).
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return os.path.join(base, f"{name}-{os.urandom(6).hex()}")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for a while; they are put back as they were."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


#: Shuffle files of a job whose rows are stored when it ends are not read again: Spark may remove them then.
STORED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh shared folder and read it back: lineage ends, and every reader sees the same rows."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    with settings(spark, STORED):
        df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.written_at = path
    return made


def discard(df: DataFrame) -> None:
    """Delete the folder of a :func:`written` table that nothing will read any more."""
    where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
    where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def is_folder(spark: SparkSession, path: str) -> bool:
    """Asks the file system that Spark itself would use, whatever the path's scheme."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        spark.sparkContext.setCheckpointDir(base or shared_dir(spark, "checkpoint"))
