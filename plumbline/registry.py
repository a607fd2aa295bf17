"""Query registry: a name, an output contract, a Spark job and (if SQL can say it) an oracle.

The output contract is a string such as ``"supplier_id:i month:d fpy:f"``. Both
engines are normalised to it, so that the two results have one schema:

``i`` BIGINT, ``f`` DOUBLE rounded to six places, ``s`` STRING, ``b`` BOOLEAN,
``d`` date as ``YYYY-MM-DD`` text, ``t`` timestamp as epoch microseconds.
Operators themselves keep native types; only this edge casts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.oracle_views import with_views
from plumbline.sources.views import Views


@dataclass(frozen=True)
class Query:
    name: str
    columns: tuple[tuple[str, str], ...]
    job: Callable[[Views], DataFrame]
    oracle: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return project(self.job(Views(spark, sf_dir)), self.columns)

    def oracle_sql(self) -> str | None:
        if self.oracle is None:
            return None
        body = ", ".join(_duck_cast(c, k) for c, k in self.columns)
        inner = self.oracle.strip().rstrip(";")
        return with_views(inner, body)


QUERIES: dict[str, Query] = {}


def parse_columns(spec: str) -> tuple[tuple[str, str], ...]:
    pairs = []
    for item in spec.split():
        name, _, kind = item.partition(":")
        if kind not in {"i", "f", "s", "b", "d", "t"}:
            raise ValueError(f"bad column kind in {item!r}")
        pairs.append((name, kind))
    return tuple(pairs)


def query(name: str, columns: str, oracle: str | None = None):
    def register(job: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(name, parse_columns(columns), job, oracle)
        return job

    return register


def project(df: DataFrame, columns) -> DataFrame:
    return df.select(*[_spark_cast(F.col(f"`{c}`"), k).alias(c) for c, k in columns])


def _spark_cast(col, kind: str):
    if kind == "i":
        return col.cast("bigint")
    if kind == "f":
        x = F.round(col.cast("double"), 6)
        return F.when(x == 0, F.lit(0.0)).otherwise(x)
    if kind == "b":
        return col.cast("boolean")
    if kind == "d":
        return col.cast("date").cast("string")
    if kind == "t":
        return F.unix_micros(col.cast("timestamp"))
    return col.cast("string")


def _duck_cast(name: str, kind: str) -> str:
    q = f'"{name}"'
    if kind == "i":
        return f"CAST({q} AS BIGINT) AS {q}"
    if kind == "f":
        x = f"round(CAST({q} AS DOUBLE), 6)"
        return f"CASE WHEN {x} = 0 THEN CAST(0 AS DOUBLE) ELSE {x} END AS {q}"
    if kind == "b":
        return f"CAST({q} AS BOOLEAN) AS {q}"
    if kind == "d":
        return f"CAST(CAST({q} AS DATE) AS VARCHAR) AS {q}"
    if kind == "t":
        return f"epoch_us(CAST({q} AS TIMESTAMP)) AS {q}"
    return f"CAST({q} AS VARCHAR) AS {q}"
