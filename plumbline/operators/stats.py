"""Statistics as aggregates: standardising, tests, resampling, information measures."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import special
from plumbline.operators import ordered, vectors
from plumbline.operators.joins import ContractError


def shares(df: DataFrame, key: str) -> DataFrame:
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(whole)).withColumn("share", F.col("n") / F.col("total"))


def zscore(df: DataFrame, columns: Sequence[str], check: bool = True) -> DataFrame:
    """Standardise with the population deviation (``z_<column>``); constant or non-finite data are errors."""
    moments = df.agg(
        F.count("*").alias("__n"),
        *[F.avg(F.col(c).cast("double")).alias(f"__m_{c}") for c in columns],
        *[F.stddev_pop(F.col(c).cast("double")).alias(f"__s_{c}") for c in columns],
    )
    if check:
        row = moments.first()
        eps = float(np.finfo(float).eps)
        for c in columns:
            mean, sd = row[f"__m_{c}"], row[f"__s_{c}"]
            if row["__n"] < 2 or mean is None or not np.isfinite([mean, sd]).all():
                raise ContractError("need two or more finite values")
            if sd <= eps * max(1.0, abs(mean)):
                raise ContractError("constant column")
    out = df.join(F.broadcast(moments))
    for c in columns:
        out = out.withColumn(f"z_{c}", (F.col(c).cast("double") - F.col(f"__m_{c}")) / F.nullif(F.col(f"__s_{c}"), F.lit(0.0)))
    return out.drop("__n", *[f"__{k}_{c}" for k in "ms" for c in columns])


Statistic = Callable[[Column, Column], Column]

#: Fixed values of the replicate draws: a prime modulus and multipliers below it.
P31, MIX = 2147483647, (48271, 69621, 16807, 40692)


def draw_key(value: Column) -> Column:
    """The number that a value's draws start from: its millionths, modulo the prime."""
    return F.pmod(F.round(value * 1_000_000).cast("bigint"), F.lit(P31))


def uniform_draws(key: int, n_boot: int, seed: int) -> np.ndarray:
    """One uniform number per replicate: squarings and multiplications modulo a prime, which any SQL can repeat."""
    a, b, c, d = MIX
    rep = np.arange(1, n_boot + 1, dtype=np.int64)
    x = (key * a + rep * b + seed * c + 1) % P31
    for _ in range(3):
        x = (x * x + rep * d + key) % P31
        x = (x * c + 1) % P31
    return (x + 0.5) / P31


def poisson_limits(n: int) -> np.ndarray:
    """Cumulative Poisson(n) probabilities as far as they matter; a draw is the number of limits at or below it."""
    top = n + 12 * math.isqrt(n) + 40
    terms = np.array([math.exp(k * math.log(n) - n - math.lgamma(k + 1)) for k in range(top)])
    return np.cumsum(terms)


def value_weights(hist: DataFrame, n_boot: int, seed: int):
    """Per row of ``value, n, key``: the value and its weight in every replicate."""

    def weights(batch: pd.DataFrame) -> Iterator[tuple[float, np.ndarray]]:
        for x, n, key in zip(batch["value"], batch["n"], batch["key"], strict=True):
            yield float(x), np.searchsorted(poisson_limits(int(n)), uniform_draws(int(key), n_boot, seed), side="right")

    return weights


def histogram(df: DataFrame, value: str) -> DataFrame:
    hist = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("value")).agg(F.count("*").alias("n"))
    return hist.withColumn("key", draw_key(F.col("value")))


def replicates(df: DataFrame, value: str, n_boot: int, seed: int) -> DataFrame:
    """(replicate, value, weight): Poisson resampling of the value histogram, for statistics that need the values.

    A value occurring c times gets a Poisson(c) weight in each replicate, which is the
    sum of c Poisson(1) row weights. Draws depend on the value only, so partitioning never
    changes them.
    """
    hist = histogram(df, value)
    weights = value_weights(hist, n_boot, seed)

    def draw(batches):
        for batch in batches:
            for x, w in weights(batch):
                kept = np.flatnonzero(w)
                yield pd.DataFrame({"replicate": kept, "value": x, "weight": w[kept]})

    return hist.mapInPandas(draw, "replicate int, value double, weight bigint")


def replicate_sums(df: DataFrame, value: str, n_boot: int, seed: int) -> DataFrame:
    """``replicate, w, wx``: sums of weights and of weighted values.

    Every task adds its values up into two vectors of ``n_boot`` numbers and sends those, so
    what is shuffled depends on tasks and replicates, never on the number of values.
    """
    hist = histogram(df, value)
    weights = value_weights(hist, n_boot, seed)

    def add(batches):
        w_sum, wx_sum = np.zeros(n_boot), np.zeros(n_boot)
        for batch in batches:
            for x, w in weights(batch):
                w_sum += w
                wx_sum += w * x
        yield pd.DataFrame({"w": [w_sum], "wx": [wx_sum]})

    parts = hist.mapInPandas(add, "w array<double>, wx array<double>")
    cells = parts.select(F.posexplode(F.arrays_zip("w", "wx")).alias("replicate", "c"))
    return cells.groupBy("replicate").agg(F.sum("c.w").alias("w"), F.sum("c.wx").alias("wx"))


def _replicate_stats(df, value, stat: Statistic | None, n_boot: int, seed: int, name: str) -> DataFrame:
    if stat is None:
        return replicate_sums(df, value, n_boot, seed).select("replicate", (F.col("wx") / F.nullif("w", F.lit(0.0))).alias(name))
    return replicates(df, value, n_boot, seed).groupBy("replicate").agg(stat(F.col("value"), F.col("weight")).alias(name))


def _check_boot(n_boot: int, alpha: float) -> None:
    if n_boot < 1 or not 0 < alpha < 1:
        raise ValueError("n_boot > 0 and 0 < alpha < 1 required")


def _interval(stats: DataFrame, name: str, alpha: float) -> DataFrame:
    return stats.agg(F.percentile(name, F.lit(alpha / 2)).alias("low"), F.percentile(name, F.lit(1 - alpha / 2)).alias("high"))


def bootstrap_ci(df, value: str, stat: Statistic | None = None, n_boot: int = 10_000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Percentile interval of a statistic of independent rows: the mean, or ``stat(value, weight)``."""
    _check_boot(n_boot, alpha)
    if df.limit(2).count() < 2:
        raise ContractError("need at least two observations")
    return _interval(_replicate_stats(df, value, stat, n_boot, seed, "stat"), "stat", alpha)


def bootstrap_diff_ci(a, b, value: str, stat: Statistic | None = None, n_boot: int = 10_000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Interval of ``stat(b) - stat(a)``; the two groups are resampled independently."""
    _check_boot(n_boot, alpha)
    if min(a.limit(2).count(), b.limit(2).count()) < 2:
        raise ContractError("need two observations in each group")
    sa = _replicate_stats(a, value, stat, n_boot, seed, "stat_a")
    sb = _replicate_stats(b, value, stat, n_boot, seed + 1_000_003, "stat_b")
    both = sa.join(sb, "replicate").withColumn("diff", F.col("stat_b") - F.col("stat_a"))
    return _interval(both, "diff", alpha)


def welch_t(df: DataFrame, group: str, value: str, first, second) -> DataFrame:
    """Welch's t (first minus second), its degrees of freedom and two-sided p."""
    x = F.col(value).cast("double")
    pick = lambda g: F.when(F.col(group) == g, x)
    m = df.agg(
        *[f(pick(g)).alias(f"{n}{i}") for i, g in ((1, first), (2, second)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]
    )
    e1, e2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    t = (F.col("m1") - F.col("m2")) / F.sqrt(e1 + e2)
    dof = (e1 + e2) * (e1 + e2) / (e1 * e1 / (F.col("n1") - 1) + e2 * e2 / (F.col("n2") - 1))
    got = m.select("n1", "n2", t.alias("t"), dof.alias("df"))
    return got.withColumn("p", special.t_p_value("t", "df"))


def mann_whitney(df: DataFrame, group: str, value: str, first, second) -> DataFrame:
    """U of the first group and two-sided normal p with tie and continuity corrections."""
    rows = df.where(F.col(group).isin(first, second) & F.col(value).isNotNull())
    ranks = ordered.midranks(rows, value, n1=(F.col(group) == F.lit(first)).cast("bigint"))
    got = ranks.agg(
        F.sum("n").alias("n"),
        F.sum("n1").alias("n1"),
        F.sum(F.col("midrank") * F.col("n1")).alias("r1"),
        F.sum((F.col("n") * F.col("n") * F.col("n") - F.col("n")).cast("double")).alias("ties"),
    )
    n, n1 = F.col("n").cast("double"), F.col("n1").cast("double")
    n2 = n - n1
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = (F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sd
    out = got.select(n1.cast("bigint").alias("n1"), n2.cast("bigint").alias("n2"), u.alias("u"), z.alias("z"))
    return out.withColumn("p", F.least(F.lit(1.0), special.normal_p_value("z")))


def chi2_independence(df: DataFrame, a: str, b: str, floor: float = 5.0) -> DataFrame:
    """Chi-square of independence; no p when any expected cell is below ``floor``."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    rows = cells.groupBy(a).agg(F.sum("n").alias("ra"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("cb"))
    total = cells.agg(F.sum("n").alias("total"))
    # chi2 over the full grid is the sum of n^2 / expected over the filled cells, minus the total.
    n, e = F.col("n").cast("double"), F.col("ra") * F.col("cb") / F.col("total")
    filled = cells.join(rows, a).join(cols, b).join(F.broadcast(total)).agg((F.sum(n * n / e) - F.sum(n)).alias("chi2"))
    # Small expected cells, filled or not: equal row totals and equal column totals each count once.
    row_sizes = rows.groupBy("ra").agg(F.count("*").alias("nr"))
    col_sizes = cols.groupBy("cb").agg(F.count("*").alias("nc"))
    # A row total asks how many columns lie below its bound: running counts on one line.
    asked = row_sizes.join(F.broadcast(total)).select(
        (F.lit(floor) * F.col("total") / F.col("ra")).alias("x"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("nc"), "nr"
    )
    held = col_sizes.select(F.col("cb").cast("double").alias("x"), F.lit(1).alias("kind"), "nc", F.lit(0).cast("bigint").alias("nr"))
    hit = ordered.running_sums(asked.unionByName(held), [], F.floor(F.log2(F.col("x") + 1) * 64), ["x", "kind"], {"upto": F.col("nc")}).where("kind = 0")
    sides = rows.agg(F.count("*").alias("na")).join(F.broadcast(cols.agg(F.count("*").alias("nb"))))
    shape = hit.agg(F.coalesce(F.sum(F.col("nr") * F.col("upto")), F.lit(0)).alias("small_cells")).join(F.broadcast(sides)).select(
        "small_cells", ((F.col("na") - 1) * (F.col("nb") - 1)).alias("dof")
    )
    got = filled.join(F.broadcast(shape))
    usable = F.col("small_cells") == 0
    return got.withColumn("p", F.when(usable, special.chi2_p_value("chi2", "dof"))).withColumn("chi2", F.when(usable, F.col("chi2")))


def count_tails(monthly: DataFrame, key: str, count: str, level: float = 0.99) -> DataFrame:
    """Upper tail and ``level`` limit of each count under its group's Poisson or negative binomial.

    Overdispersed groups (variance above mean) use the negative binomial. Tails are
    incomplete gamma and beta functions in log space, so a large mean does not underflow;
    they are computed once per distinct (mean, variance, count), in Arrow batches.
    """
    # Counts are whole numbers: exact sums decide which groups are overdispersed (rounding would decide
    # where variance and mean are equal) and are the keys of the joins.
    x = F.col(count).cast("decimal(18,0)")
    sums = monthly.where(F.col(count).isNotNull()).groupBy(key).agg(
        F.count("*").alias("__n"), F.sum(x).cast("decimal(19,0)").alias("__s1"), F.sum((x * x).cast("decimal(28,0)")).cast("decimal(28,0)").alias("__s2")
    )
    n, s1 = F.col("__n").cast("decimal(9,0)"), F.col("__s1")
    excess = (n * F.col("__s2")).cast("decimal(38,0)") - (s1 * s1).cast("decimal(38,0)")  # n (n - 1) times the variance
    mu = s1.cast("double") / F.col("__n")
    var = excess.cast("double") / F.nullif((F.col("__n") * (F.col("__n") - 1)).cast("double"), F.lit(0.0))
    wide = (F.col("__n") > 1) & (excess > (s1 * (n - 1)).cast("decimal(38,0)"))
    by = ["__n", "__s1", "__s2"]
    measured = [mu.alias("mu"), var.alias("var"), wide.alias("overdispersed"), F.when(wide, var).alias("v")]
    groups = sums.select(*by).distinct().select(*by, *measured).withColumn("limit", special.count_limit("mu", "v", F.lit(float(level))))
    joined = monthly.join(sums, key)
    cases = joined.select(*by, count).distinct().join(groups, by).withColumn("tail", special.count_tail("mu", "v", F.col(count)))
    return joined.join(cases, [*by, count]).withColumn("high", F.col(count) > F.col("limit")).select(
        *monthly.columns, "mu", "var", "overdispersed", "limit", "tail", "high"
    )


def entropy_kl(df: DataFrame, key: str, category: str) -> DataFrame:
    """Entropy, its effective number, cross-entropy and KL of each key's shares against the whole."""
    cells = df.groupBy(key, category).agg(F.count("*").alias("n"))
    own = cells.groupBy(key).agg(F.sum("n").alias("own"))
    whole = cells.groupBy(category).agg(F.sum("n").alias("all_n"))
    total = whole.agg(F.sum("all_n").alias("total"))
    q = F.col("all_n") / F.col("total")
    p = F.col("n") / F.col("own")
    rows = cells.join(own, key).join(whole, category).join(F.broadcast(total))
    return rows.groupBy(key).agg(
        F.sum(-p * F.log2(p)).alias("entropy"),
        F.pow(F.lit(2.0), F.sum(-p * F.log2(p))).alias("effective"),
        F.sum(-p * F.log2(q)).alias("cross_entropy"),
        F.sum(p * F.log2(p / q)).alias("kl"),
    )


def cosine_to_anchor(df: DataFrame, key: str, columns: Sequence[str], anchor: DataFrame) -> DataFrame:
    """Cosine of every entity with one anchor entity, on raw and on standardised columns."""
    known = df.where(F.array_size(F.filter(F.array(*columns), lambda x: x.isNull())) == 0)
    z = zscore(known, columns, check=False)
    raw_vec = F.array(*[F.col(c).cast("double") for c in columns])
    z_vec = F.array(*[F.col(f"z_{c}") for c in columns])
    both = z.select(key, raw_vec.alias("raw"), z_vec.alias("std"))
    one = both.join(F.broadcast(anchor.select(key)), key, "left_semi").select(F.col("raw").alias("raw0"), F.col("std").alias("std0"))
    return both.join(F.broadcast(one)).select(
        key, vectors.cosine(F.col("raw"), F.col("raw0")).alias("cos_raw"), vectors.cosine(F.col("std"), F.col("std0")).alias("cos_std")
    )


def svd_energy(matrix: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cumulative energy of the column-centred matrix and the relative error of each rank.

    Only the columns x columns Gram matrix leaves the executors; rows stay distributed.
    """
    from pyspark.ml.feature import PCA, VectorAssembler

    assembled = VectorAssembler(inputCols=list(columns), outputCol="v").transform(matrix).select("v")
    shares_ = PCA(k=len(columns), inputCol="v", outputCol="p").fit(assembled).explainedVariance.toArray()
    cumulative = np.minimum(np.cumsum(shares_), 1.0)
    rows = [(i + 1, float(s), float(c), float(np.sqrt(max(0.0, 1 - c)))) for i, (s, c) in enumerate(zip(shares_, cumulative, strict=True))]
    return matrix.sparkSession.createDataFrame(rows, "component int, share double, energy double, relative_error double")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation: midranks of each column, then Pearson on the ranks."""
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    rx = ordered.midranks(known, x).select(x, F.col("midrank").alias("__rx"))
    ry = ordered.midranks(known, y).select(y, F.col("midrank").alias("__ry"))
    pairs = known.groupBy(x, y).agg(F.count("*").alias("w")).join(rx, x).join(ry, y)
    w, a, b = F.col("w").cast("double"), F.col("__rx"), F.col("__ry")
    s = pairs.agg(
        F.sum(w).alias("n"), F.sum(w * a).alias("sa"), F.sum(w * b).alias("sb"), F.sum(w * a * b).alias("sab"),
        F.sum(w * a * a).alias("saa"), F.sum(w * b * b).alias("sbb"),
    )
    cov = F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")
    va, vb = F.col("saa") - F.col("sa") * F.col("sa") / F.col("n"), F.col("sbb") - F.col("sb") * F.col("sb") / F.col("n")
    return s.select(F.col("n").cast("bigint").alias("n"), (cov / F.nullif(F.sqrt(va * vb), F.lit(0.0))).alias("rho"))


def bayes_rate(df: DataFrame, segment: str, flag: Column, truth: Column) -> DataFrame:
    """Posterior of the condition given a flag, from each segment's own rates."""
    counts = df.groupBy(segment).agg(
        F.count("*").alias("n"),
        F.avg(truth.cast("int")).alias("prevalence"),
        F.avg(F.when(truth, flag.cast("int"))).alias("sensitivity"),
        F.avg(F.when(~truth, flag.cast("int"))).alias("false_positive_rate"),
    )
    hit = F.coalesce(F.col("sensitivity") * F.col("prevalence"), F.lit(0.0))
    flagged = hit + F.coalesce(F.col("false_positive_rate") * (1 - F.col("prevalence")), F.lit(0.0))
    return counts.withColumn("p_flag", flagged).withColumn("posterior", hit / F.nullif(flagged, F.lit(0.0)))
