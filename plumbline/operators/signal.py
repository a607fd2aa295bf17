"""Sensor-window features: one array row per machine cycle, nothing is ever shuffled.

A window row is ``serial, valid_len, ch ARRAY<ARRAY<FLOAT>>`` (channels x samples at
10 Hz). Moments and excursions are array expressions; only the spectrum needs NumPy,
and the whole feature row is then computed in the same Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import arrays

# Channel order, sample rate, bands and alarm levels.
SENSORS = ("spindle_speed", "feed_rate", "vibration", "tool_temp", "coolant_flow")
RATE = 10.0
BANDS = ((0.0, 1.0), (1.0, 2.5), (2.5, 5.0))
LIMITS = {"vibration": 2.5, "tool_temp": 180.0}
CONTEXT = ("part_family", "machine_id", "shift")
MAX_SAMPLES = 512
EPS = 1e-9


def channel_table(windows: DataFrame, *keep: str) -> DataFrame:
    """(serial, channel, x): the valid samples of each channel, as doubles."""
    names = F.array(*[F.lit(s) for s in SENSORS])
    cells = F.arrays_zip(names.alias("channel"), F.col("ch").alias("x"))
    flat = windows.select("serial", *keep, "valid_len", F.inline(cells))
    return flat.select("serial", *keep, "channel", F.slice("x", 1, F.col("valid_len")).cast("array<double>").alias("x"))


def moments(x: Column) -> dict[str, Column]:
    """Mean, population deviation, extremes, biased skewness and excess kurtosis of an array."""
    # One fold collects power sums of the distances from the first sample; a shift that
    # lies among the data keeps the central moments accurate.
    first = F.element_at(x, 1)
    start = F.struct(*[F.lit(0.0).alias(f"s{k}") for k in range(1, 5)])

    def step(acc, v):
        d = v - first
        return F.struct(
            (acc["s1"] + d).alias("s1"), (acc["s2"] + d * d).alias("s2"),
            (acc["s3"] + d * d * d).alias("s3"), (acc["s4"] + d * d * d * d).alias("s4"),
        )

    s, n = F.aggregate(x, start, step), F.size(x)
    a, b, c, d = (s[f"s{k}"] / F.nullif(n, F.lit(0)) for k in range(1, 5))
    var = b - a * a
    third = c - 3 * a * b + 2 * a * a * a
    fourth = d - 4 * a * c + 6 * a * a * b - 3 * a * a * a * a
    flat = F.array_max(x) == F.array_min(x)
    return {
        "mean": first + a,
        "std": F.sqrt(F.greatest(var, F.lit(0.0))),
        "min": F.array_min(x),
        "max": F.array_max(x),
        "skew": F.when(flat, F.lit(0.0)).otherwise(third / F.nullif(F.pow(var, F.lit(1.5)), F.lit(0.0))),
        "kurt": F.when(flat, F.lit(0.0)).otherwise(fourth / F.nullif(var * var, F.lit(0.0)) - 3),
    }


def excursions(x: Column, limit: Column) -> dict[str, Column]:
    """Fraction above the limit, longest run in seconds, number of runs: one fold over the array."""
    start = F.struct(*[F.lit(0).alias(n) for n in ("above", "run", "longest", "runs")])

    def step(acc, v):
        hot = v > limit
        run = F.when(hot, acc["run"] + 1).otherwise(0)
        return F.struct(
            (acc["above"] + hot.cast("int")).alias("above"),
            run.alias("run"),
            F.greatest(acc["longest"], run).alias("longest"),
            (acc["runs"] + (hot & (acc["run"] == 0)).cast("int")).alias("runs"),
        )

    s = F.aggregate(x, start, step)
    return {
        "frac_above": s["above"] / F.nullif(F.size(x), F.lit(0)),
        "longest_run_s": s["longest"] / RATE,
        "excursions": s["runs"],
    }


def spectrum_shares(x: np.ndarray) -> list[float]:
    """Fractions of squared spectrum magnitude per band of the mean-removed signal, and high/low ratio."""
    power = np.abs(np.fft.rfft(x - x.mean())) ** 2
    freq = np.fft.rfftfreq(len(x), d=1 / RATE)
    total = power.sum() + EPS
    edges = np.searchsorted([hi for _, hi in BANDS[:-1]], freq, side="right")
    inside = freq <= BANDS[-1][1]
    shares = [float(power[(edges == i) & inside].sum() / total) for i in range(len(BANDS))]
    return [*shares, shares[-1] / (shares[0] + EPS)]


def band_energy(windows: DataFrame, channels: Sequence[str] = tuple(LIMITS)) -> DataFrame:
    """(serial, channel, band shares, ratio) for the vibration-like channels."""
    flat = channel_table(windows).where(F.col("channel").isin(list(channels)))
    names = ["band_low", "band_mid", "band_high", "band_ratio"]

    def run(batches: Iterator[pd.DataFrame]):
        for batch in batches:
            values = [spectrum_shares(np.asarray(x, dtype=float)) for x in batch["x"]]
            yield pd.concat(
                [batch[["serial", "channel"]].reset_index(drop=True), pd.DataFrame(values, columns=names)], axis=1
            )

    return flat.mapInPandas(run, "serial bigint, channel string, " + ", ".join(f"{n} double" for n in names))


def feature_names() -> list[str]:
    """Names of the 51 predictors, in order: 44 from signals, 4 numeric and 3 categorical context columns."""
    names = []
    for sensor in SENSORS:
        names += [f"{sensor}_{k}" for k in ("mean", "std", "min", "max", "skew", "kurt")]
        if sensor in LIMITS:
            names += [f"{sensor}_band_{lo}_{hi}" for lo, hi in BANDS] + [f"{sensor}_band_ratio"]
            names += [f"{sensor}_{k}" for k in ("frac_above", "longest_run_s", "excursions")]
    return names + ["cycle_seconds", "cycle_vs_nominal", "tool_life_pct", "prior5_fail_count"] + list(CONTEXT)


def cycle_features(windows: DataFrame, keep: Sequence[str] = ("failed",)) -> DataFrame:
    """One feature row per cycle. Array expressions give the moments and excursions, NumPy the spectra."""
    wide = windows
    columns: list[Column] = []
    for i, sensor in enumerate(SENSORS):
        x = F.slice(F.col("ch")[i], 1, F.col("valid_len")).cast("array<double>")
        wide = wide.withColumn(sensor, x)
        parts = moments(F.col(sensor))
        columns += [c.alias(f"{sensor}_{k}") for k, c in parts.items()]
        if sensor in LIMITS:
            columns += [c.cast("double").alias(f"{sensor}_{k}") for k, c in excursions(F.col(sensor), F.lit(LIMITS[sensor])).items()]
    shares = _spectrum_udf()
    for sensor in LIMITS:
        wide = wide.withColumn(f"__{sensor}", shares(sensor))
        labels = [f"{sensor}_band_{lo}_{hi}" for lo, hi in BANDS] + [f"{sensor}_band_ratio"]
        columns += [F.col(f"__{sensor}")[i].alias(name) for i, name in enumerate(labels)]
    seconds = F.col("valid_len") / RATE
    columns += [
        seconds.alias("cycle_seconds"),
        (seconds / F.nullif("nominal_seconds", F.lit(0.0))).alias("cycle_vs_nominal"),
        F.col("tool_life_pct").cast("double").alias("tool_life_pct"),
        F.col("prior5_fails").cast("double").alias("prior5_fail_count"),
        *[F.col(c) for c in CONTEXT],
    ]
    got = wide.select("serial", *keep, *columns)
    return got.select("serial", *keep, *[F.col(f"`{n}`") for n in feature_names()])


def _spectrum_udf():
    from pyspark.sql.types import ArrayType, DoubleType

    @F.pandas_udf(ArrayType(DoubleType()))
    def shares(xs: pd.Series) -> pd.Series:
        return pd.Series([spectrum_shares(np.asarray(x, dtype=float)) for x in xs])

    return shares


def contract_violations(features: DataFrame) -> DataFrame:
    """Per predictor: values that are missing or not finite (numeric) or missing (categorical)."""
    checks = []
    for name in feature_names():
        c = F.col(f"`{name}`")
        bad = c.isNull() if name in CONTEXT else (c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
        checks.append(F.struct(F.lit(name).alias("feature"), F.sum(bad.cast("int")).alias("bad")).alias(name.replace(".", "_")))
    return features.agg(*checks).select(F.inline(F.array(*[name.replace(".", "_") for name in feature_names()])))


def predictors(features: DataFrame) -> DataFrame:
    """The 51 predictors only; refuses other shapes and unusable values."""
    from plumbline.operators.joins import ContractError

    missing = sorted(set(feature_names()) - set(features.columns))
    if missing:
        raise ContractError(f"expected the {len(feature_names())} named feature columns; missing {missing}")
    broken = contract_violations(features).where("bad > 0")
    if not broken.isEmpty():
        raise ContractError("finite numeric features and present categories required")
    return features.select("serial", *[F.col(f"`{n}`") for n in feature_names()])


def channel_statistics(windows: DataFrame) -> DataFrame:
    """Mean and deviation per channel over valid samples; a flat channel scales by 1."""
    flat = channel_table(windows)
    per = flat.select(
        "channel",
        F.size("x").alias("n"),
        arrays.total(F.col("x")).alias("s"),
        arrays.total(F.transform("x", lambda v: v * v)).alias("ss"),
    )
    sums = per.groupBy("channel").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    mean = F.col("s") / F.col("n")
    scale = F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0)))
    return sums.select("channel", mean.alias("mean"), F.when(scale > 1e-8, scale).otherwise(F.lit(1.0)).alias("scale"))


def normalise_pad(windows: DataFrame, statistics: DataFrame, size: int = MAX_SAMPLES) -> tuple[DataFrame, DataFrame]:
    """(rows with ``x`` normalised and zero-padded to ``size``, quarantined rows). Statistics are five rows."""
    usable = (
        F.col("valid_len").between(2, size)
        & (F.size("ch") == len(SENSORS))
        & F.forall("ch", lambda c: F.size(c) >= F.col("valid_len"))
        & F.forall("ch", lambda c: F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))))
    )
    stats = F.map_from_entries(F.collect_list(F.struct("channel", F.struct("mean", "scale"))))
    joined = windows.withColumn("__ok", F.coalesce(usable, F.lit(False))).join(F.broadcast(statistics.agg(stats.alias("__stats"))))
    channel = lambda i: F.slice(F.col("ch")[i], 1, F.col("valid_len"))

    def fitted(i: int) -> Column:
        s = F.col("__stats")[SENSORS[i]]
        return arrays.pad(F.transform(channel(i), lambda v: (v.cast("double") - s["mean"]) / s["scale"]), size)

    good = joined.where("__ok").withColumn("x", F.array(*[fitted(i) for i in range(len(SENSORS))]))
    return good.drop("__ok", "__stats"), joined.where(~F.col("__ok")).drop("__ok", "__stats")
