"""Dense vectors: arithmetic as array expressions and exact top-k search as a block join."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries that one partition answers together; items scored at once.
GROUP, ITEM_BLOCK = 2048, 512


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; a zero vector is an error, not a zero."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale).otherwise(F.raise_error(F.lit("zero-length vector")).cast("double"))


def mean_vectors(df: DataFrame, key: str, vec: str) -> DataFrame:
    """Mean vector per key, summed element-wise so that partial sums combine map-side."""
    cells = df.select(key, F.posexplode(vec).alias("pos", "x"))
    means = cells.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias(vec)
    )


def topk_cosine(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    *,
    query_id: str = "query_id",
    item_id: str = "id",
    vec: str = "embedding",
    embed: Callable[[pd.Series], list] | None = None,
    scope: str | None = None,
    scopes: str | None = None,
    group: int = GROUP,
) -> DataFrame:
    """Exact cosine top-k of every query over all items, as a block join: one pass over the items.

    Items are dealt over cells, queries over groups of about ``group``; every (cell, group)
    is one partition that gets the group's queries first and then its items, sorted by
    their angle to one pivot vector. Per query a heap of ``k`` is kept and sent once. By the
    triangle inequality of angles a block is skipped for the queries it cannot serve, and
    the scan ends where no later block can serve any. Neither all scores nor the queries
    ever meet in one place; items move once for each group of queries.

    With ``embed`` the ``vec`` columns hold texts, which move instead of vectors and are
    embedded where they are compared (then without the pivot). With ``scope`` (queries) and
    ``scopes`` (items, an array) a query only sees items that hold its scope.
    """
    if not 1 <= k <= 1000:
        raise ValueError("k must be in [1, 1000]")
    spark = items.sparkSession
    cells = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    groups = max(1, -(-queries.count() // group))
    q_type, i_type = queries.schema[query_id].dataType, items.schema[item_id].dataType
    angle = F.lit(0.0)
    if embed is None:
        pivot = items.agg(F.min_by(F.col(vec).cast("array<double>"), item_id)).first()[0]  # one vector
        if pivot is not None and any(pivot):
            line = F.array(*[F.lit(float(x)) for x in pivot])
            angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col(vec), line) / (norm(F.col(vec)) * norm(line)))))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    one_scope = F.lit(None).cast("bigint")
    asked = queries.select(
        every(cells).alias("cell"), F.pmod(F.xxhash64(query_id), F.lit(groups)).cast("int").alias("grp"), F.lit(0).alias("kind"), angle.alias("turn"),
        F.col(query_id).alias("q"), F.lit(None).cast(i_type).alias("i"), F.col(vec).alias("v"),
        (F.col(scope).cast("bigint") if scope else one_scope).alias("s"), F.lit(None).cast("array<bigint>").alias("ss"),
    )
    held = items.select(
        F.pmod(F.xxhash64(item_id), F.lit(cells)).cast("int").alias("cell"), every(groups).alias("grp"), F.lit(1).alias("kind"), angle.alias("turn"),
        F.lit(None).cast(q_type).alias("q"), F.col(item_id).alias("i"), F.col(vec).alias("v"),
        one_scope.alias("s"), (F.col(scopes).cast("array<bigint>") if scopes else F.lit(None).cast("array<bigint>")).alias("ss"),
    )
    if embed is None:
        asked, held = (df.withColumn("v", F.col("v").cast("array<double>")) for df in (asked, held))
    rows = asked.unionByName(held).withColumn("part", F.col("cell") * groups + F.col("grp"))
    dealt = rows.repartitionById(cells * groups, F.col("part")).sortWithinPartitions("part", "kind", "turn")
    local = dealt.mapInPandas(
        _heaps(k, query_id, item_id, embed, scope is not None), f"{query_id} {q_type.simpleString()}, {item_id} {i_type.simpleString()}, similarity double"
    )
    w = Window.partitionBy(query_id).orderBy(F.desc("similarity"), item_id)
    return local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _unit(matrix: np.ndarray) -> np.ndarray:
    if not np.isfinite(matrix).all():
        raise ValueError("vectors must be finite")
    size = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    if (size == 0).any():
        raise ValueError("zero-length vector")
    return matrix / size


class _Heaps:
    """The queries of one (cell, group) with their best items so far."""

    def __init__(self, k: int, scoped: bool):
        self.k, self.scoped = k, scoped
        self.ids, self.scopes, self.angles, self.parts, self.best, self.matrix, self.over = [], [], [], [], [], None, False

    def ask(self, batch: pd.DataFrame, vectors_: np.ndarray) -> None:
        self.ids += batch["q"].tolist()
        self.scopes += batch["s"].tolist()
        self.angles += batch["turn"].tolist()
        self.parts.append(vectors_)
        self.best += [[] for _ in range(len(batch))]

    def start(self) -> None:
        if self.matrix is None:
            self.matrix = np.concatenate(self.parts) if self.parts else np.zeros((0, 0))
            self.scope_of, self.angle_of = np.asarray(self.scopes), np.asarray(self.angles, dtype=float)
            self.floor = np.full(len(self.ids), -np.inf)

    def possible(self, low: float, high: float) -> np.ndarray:
        """Queries that an item between these angles to the pivot may serve; ends the scan where none is left."""
        away = np.maximum(0.0, np.maximum(self.angle_of - high, low - self.angle_of))
        reach = np.arccos(np.clip(self.floor - 1e-8, -1.0, 1.0))
        self.over = bool(len(self.ids)) and bool((low - self.angle_of > reach).all())
        return np.flatnonzero(away <= reach)

    def meet(self, items: pd.DataFrame, vectors_: np.ndarray, live: np.ndarray) -> None:
        # Nine decimals make equal vectors tie whatever the matrix kernel does.
        scores = np.round(vectors_ @ self.matrix[live].T, 9)
        keys = items["i"].tolist()
        if self.scoped:
            seen = [frozenset(x) if x is not None else frozenset() for x in items["ss"]]
            for s in set(self.scope_of[live].tolist()):
                out = np.array([s not in x for x in seen])
                scores[np.ix_(out, self.scope_of[live] == s)] = -np.inf
        for column, j in enumerate(live.tolist()):
            mine = scores[:, column]
            limit = self.floor[j]
            if len(mine) > self.k:
                limit = max(limit, np.partition(mine, len(mine) - self.k)[len(mine) - self.k])
            new = [(-float(mine[r]), keys[r]) for r in np.flatnonzero((mine >= limit) & (mine > -np.inf)).tolist()]
            if new:
                self.best[j] = sorted(self.best[j] + new)[: self.k]
                if len(self.best[j]) == self.k:
                    self.floor[j] = -self.best[j][-1][0]

    def rows(self, query_id: str, item_id: str) -> pd.DataFrame:
        flat = [(q, i, -s) for q, best in zip(self.ids, self.best, strict=True) for s, i in best]
        return pd.DataFrame(flat, columns=[query_id, item_id, "similarity"])


def _heaps(k: int, query_id: str, item_id: str, embed: Callable | None, scoped: bool):
    def unit(values: pd.Series) -> np.ndarray:
        made = embed(values) if embed is not None else values.to_numpy()
        return _unit(np.stack([np.asarray(x, dtype=float) for x in made]))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, heaps = None, None
        for batch in batches:
            for key, run in batch.groupby(["part", "kind"], sort=True):
                if key[0] != part:
                    if heaps is not None and heaps.ids:
                        yield heaps.rows(query_id, item_id)
                    part, heaps = key[0], _Heaps(k, scoped)
                if key[1] == 0:
                    heaps.ask(run, unit(run["v"]))
                    continue
                heaps.start()
                for at in range(0, len(run), ITEM_BLOCK):
                    block = run.iloc[at : at + ITEM_BLOCK]
                    live = heaps.possible(block["turn"].iloc[0], block["turn"].iloc[-1]) if len(heaps.ids) and not heaps.over else ()
                    if len(live):
                        heaps.meet(block, unit(block["v"]), live)
        if heaps is not None and heaps.ids:
            yield heaps.rows(query_id, item_id)

    return search
