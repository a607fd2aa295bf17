"""Sensor-window jobs and the two-stage gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import cascade, evaluation, joins, signal
from plumbline.registry import query
from plumbline.sources.oracle_views import register_view

BASE = (1000.0, 50.0, 2.4, 178.0, 9.0)
SCALE = (400.0, 20.0, 1.5, 30.0, 0.0)

register_view("samples", "SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT vec_id AS serial, '{name}' AS channel, pos - 1 AS i, CAST(CAST(x * {scale} + {base} AS FLOAT) AS DOUBLE) AS x, label
    FROM (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)"""
    for name, base, scale in zip(signal.SENSORS, BASE, SCALE, strict=True)) + ") WHERE i < 64 - serial % 5")
register_view("scored_cycles", """
SELECT serial, machine_id, cycle_start, inspection_completed_at, failed, CAST(value AS DOUBLE) / 500 AS p1, (serial * 7919 % 1000) / 1000 AS p2 FROM cycles""")


def windows(v):
    """Five-channel windows: each channel is the whole vector under its own scale and offset."""
    e = F.col("embedding")
    channel = lambda base, scale: F.transform(e, lambda x: (x.cast("double") * scale + base).cast("float"))
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (n % len(names) + 1).cast("int"))
    return v.raw("embeddings").select(
        F.col("vec_id").alias("serial"),
        (64 - F.col("vec_id") % 5).cast("int").alias("valid_len"),
        F.array(*[channel(b, s) for b, s in zip(BASE, SCALE, strict=True)]).alias("ch"),
        F.lit(4.8).alias("nominal_seconds"),
        (F.col("vec_id") % 100).alias("tool_life_pct"),
        (F.col("vec_id") % 6).alias("prior5_fails"),
        pick(("fitting", "rib-web", "bracket"), F.col("label")).alias("part_family"),
        F.concat(F.lit("M-"), "label").alias("machine_id"),
        pick(("day", "night"), F.col("vec_id")).alias("shift"),
        (F.col("label") == 0).cast("int").alias("failed"),
    )


@query("channel_aggregates", "serial:i channel:s mean:f std:f min:f max:f skew:f kurt:f", """
WITH m AS (SELECT *, x - avg(x) OVER (PARTITION BY serial, channel) AS d FROM samples)
SELECT serial, channel, avg(x) AS mean, sqrt(avg(d * d)) AS std, min(x) AS "min", max(x) AS "max",
  CASE WHEN min(x) = max(x) THEN 0 ELSE avg(d ** 3) / avg(d * d) ** 1.5 END AS skew, CASE WHEN min(x) = max(x) THEN 0 ELSE avg(d ** 4) / avg(d * d) ** 2 - 3 END AS kurt FROM m GROUP BY ALL""")
def channel_aggregates(v):
    flat = signal.channel_table(windows(v))
    return flat.select("serial", "channel", *[c.alias(n) for n, c in signal.moments(F.col("x")).items()])


@query("band_energy", "serial:i channel:s band_low:f band_mid:f band_high:f band_ratio:f", """
WITH m AS (SELECT serial, channel, i, x - avg(x) OVER (PARTITION BY serial, channel) AS d, count(*) OVER (PARTITION BY serial, channel) AS n FROM samples WHERE channel IN ('vibration', 'tool_temp')),
p AS (SELECT serial, channel, k, n, sum(d * cos(2 * pi() * k * i / n)) ** 2 + sum(d * sin(2 * pi() * k * i / n)) ** 2 AS pw
  FROM m JOIN (SELECT unnest(generate_series(0, 32)) AS k) ON k <= n // 2 GROUP BY serial, channel, k, n),
b AS (SELECT serial, channel, sum(pw) + 1e-9 AS t, sum(pw) FILTER (WHERE k * 10.0 / n < 1) AS l, sum(pw) FILTER (WHERE k * 10.0 / n >= 1 AND k * 10.0 / n < 2.5) AS mi, sum(pw) FILTER (WHERE k * 10.0 / n >= 2.5) AS h FROM p GROUP BY ALL)
SELECT serial, channel, l / t AS band_low, mi / t AS band_mid, h / t AS band_high, (h / t) / (l / t + 1e-9) AS band_ratio FROM b""")
def band_energy(v):
    return signal.band_energy(windows(v))


@query("excursions", "serial:i channel:s frac_above:f longest_run_s:f excursions:i", """
WITH s AS (SELECT *, x > CASE channel WHEN 'vibration' THEN 2.5 ELSE 180 END AS hot FROM samples WHERE channel IN ('vibration', 'tool_temp')),
g AS (SELECT *, i - row_number() OVER (PARTITION BY serial, channel, hot ORDER BY i) AS isl FROM s),
r AS (SELECT serial, channel, isl, count(*) AS len FROM g WHERE hot GROUP BY ALL)
SELECT s.serial, s.channel, avg(CAST(hot AS INT)) AS frac_above, coalesce((SELECT max(len) FROM r WHERE r.serial = s.serial AND r.channel = s.channel), 0) / 10 AS longest_run_s,
  (SELECT count(*) FROM r WHERE r.serial = s.serial AND r.channel = s.channel) AS excursions FROM s GROUP BY s.serial, s.channel""")
def excursions(v):
    flat = signal.channel_table(windows(v)).where(F.col("channel").isin(list(signal.LIMITS)))
    limit = F.when(F.col("channel") == "vibration", signal.LIMITS["vibration"]).otherwise(signal.LIMITS["tool_temp"])
    return flat.select("serial", "channel", *[c.alias(n) for n, c in signal.excursions(F.col("x"), limit).items()])


@query("cycle_features", "serial:i n_features:i vibration_mean:f tool_temp_longest_run_s:f vibration_band_ratio:f cycle_vs_nominal:f machine_id:s")
def cycle_features(v):
    return signal.cycle_features(windows(v)).withColumn("n_features", F.lit(len(signal.feature_names())))


@query("channel_norm_stats", "channel:s mean:f scale:f", """
SELECT channel, avg(x) AS mean, CASE WHEN sqrt(greatest(avg(x * x) - avg(x) ** 2, 0)) > 1e-8 THEN sqrt(greatest(avg(x * x) - avg(x) ** 2, 0)) ELSE 1 END AS scale FROM samples GROUP BY channel""")
def channel_norm_stats(v):
    return signal.channel_statistics(windows(v))


@query("normalise_pad", "serial:i channel_no:i padded:i head:f total:f", """
WITH st AS (SELECT channel, avg(x) AS mean, CASE WHEN sqrt(greatest(avg(x * x) - avg(x) ** 2, 0)) > 1e-8 THEN sqrt(greatest(avg(x * x) - avg(x) ** 2, 0)) ELSE 1 END AS scale FROM samples GROUP BY channel)
SELECT serial, list_position(['spindle_speed','feed_rate','vibration','tool_temp','coolant_flow'], s.channel) - 1 AS channel_no, 512 AS padded,
  max((x - mean) / scale) FILTER (WHERE i = 0) AS head, sum((x - mean) / scale) AS total FROM samples s JOIN st USING (channel) GROUP BY ALL""")
def normalise_pad(v):
    from plumbline.functions import arrays

    w = windows(v)
    good, _ = signal.normalise_pad(w, signal.channel_statistics(w))
    flat = good.select("serial", F.posexplode("x").alias("channel_no", "c"))
    return flat.select("serial", "channel_no", F.size("c").alias("padded"), F.col("c")[0].alias("head"), arrays.total(F.col("c")).alias("total"))


@query("predictor_contract", "feature:s bad:i",
       "SELECT unnest([" + ", ".join(f"'{n}'" for n in signal.feature_names()) + "]) AS feature, 0 AS bad FROM (SELECT count(*) AS n FROM embeddings) WHERE n > 0")
def predictor_contract(v):
    return signal.contract_violations(signal.cycle_features(windows(v)))


def scored(v):
    return v.cycles.withColumn("p1", F.col("value").cast("double") / 500).withColumn("p2", F.col("serial") * 7919 % 1000 / 1000)


@query("availability_split", "part:s fold:i role:s rows:i", """
WITH o AS (SELECT *, row_number() OVER (ORDER BY cycle_start, serial) AS rn, count(*) OVER () AS n FROM cycles),
c AS (SELECT max(cycle_start) FILTER (WHERE rn = floor(n * 0.4) + 1) AS a, max(cycle_start) FILTER (WHERE rn = floor(n * 0.5) + 1) AS b, max(cycle_start) FILTER (WHERE rn = floor(n * 0.7) + 1) AS c, max(cycle_start) FILTER (WHERE rn = floor(n * 0.85) + 1) AS d FROM o),
r AS (SELECT CASE WHEN cycle_start < a AND inspection_completed_at < a THEN 'fit' WHEN cycle_start >= a AND cycle_start < b AND inspection_completed_at < b THEN 'calibrate'
  WHEN cycle_start >= b AND cycle_start < c AND inspection_completed_at < c THEN 'stage2_fit' WHEN cycle_start >= c AND cycle_start < d AND inspection_completed_at < d THEN 'stage2_validate'
  WHEN cycle_start >= d THEN 'test' ELSE 'unavailable' END AS role FROM cycles, c),
f AS (SELECT k AS fold, n - (5 - k + 1) * (n // 10) + 1 AS first, n // 10 AS size FROM (SELECT DISTINCT n FROM o), (SELECT unnest([1,2,3,4,5]) AS k)),
t AS (SELECT f.*, o.cycle_start AS ts FROM f JOIN o ON o.rn = f.first),
h AS (SELECT t.fold, o.*, row_number() OVER (PARTITION BY t.fold ORDER BY o.cycle_start, o.serial) AS place, count(*) OVER (PARTITION BY t.fold) AS hn FROM o JOIN t ON o.inspection_completed_at < t.ts AND o.cycle_start < t.ts AND o.rn < t.first),
k AS (SELECT fold, max(cycle_start) FILTER (WHERE place = floor(hn * 0.8) + 1) AS cut FROM h GROUP BY fold)
SELECT 'time' AS part, 0 AS fold, role, count(*) AS rows FROM r GROUP BY role
UNION ALL SELECT 'block', fold, CASE WHEN cycle_start >= cut THEN 'calibrate' WHEN inspection_completed_at < cut THEN 'fit' ELSE 'unavailable' END, count(*) FROM h JOIN k USING (fold) GROUP BY ALL
UNION ALL SELECT 'block', fold, 'test', count(*) FROM o JOIN t ON o.rn >= t.first AND o.rn < t.first + t.size GROUP BY fold""")
def availability_split(v):
    roles = cascade.availability_roles(v.cycles, "cycle_start", "inspection_completed_at", "serial")
    by_time = roles.groupBy("role").agg(F.count("*").alias("rows")).select(F.lit("time").alias("part"), F.lit(0).alias("fold"), "role", "rows")
    size = v.cycles.count() // 10
    blocks = cascade.block_folds(v.cycles, "cycle_start", "inspection_completed_at", "serial", size)
    return by_time.unionByName(blocks.select(F.lit("block").alias("part"), "fold", "role", "rows"))


@query("flag_rate_threshold", "threshold:f n:i achieved_rate:f", """
WITH q AS (SELECT quantile_cont(p1, 0.95) AS threshold FROM scored_cycles) SELECT threshold, count(*) AS n, avg(CAST(p1 >= threshold AS INT)) AS achieved_rate FROM scored_cycles, q GROUP BY 1""")
def flag_rate_threshold(v):
    return cascade.flag_rate_threshold(scored(v), "p1", 0.05)


@query("stage1_fit", "model:s rows:i roc_auc:f flag_rate:f")
def stage1_fit(v):
    from plumbline.operators import learning

    features = signal.cycle_features(windows(v), keep=["failed"])
    return learning.stage1_report(features, "failed", "serial")


@query("capacity_cost_threshold", "threshold:f flags:i caught:i cost:i", """
WITH c AS (SELECT DISTINCT p1 AS t FROM scored_cycles UNION SELECT 0 UNION SELECT 1.0000000000000002),
h AS (SELECT p1, count(*) AS n, sum(failed) AS f FROM scored_cycles GROUP BY p1),
w AS (SELECT sum(n) AS n, sum(f) AS f FROM h),
x AS (SELECT c.t AS threshold, coalesce(sum(h.n), 0) AS flags, coalesce(sum(h.f), 0) AS caught FROM c LEFT JOIN h ON h.p1 >= c.t GROUP BY c.t)
SELECT threshold, flags, caught, 85 * (flags - caught) + 4100 * (w.f - caught) AS cost FROM x, w WHERE flags / w.n <= 100 / 3800 ORDER BY cost, threshold LIMIT 1""")
def capacity_cost_threshold(v):
    rows = scored(v)
    return cascade.capacity_threshold(rows, "p1", "failed", rows.agg(F.count("*").alias("population")))


@query("cascade_decide", "serial:i p1:f stage2_score:f decision:s", """
SELECT serial, p1, CASE WHEN p1 >= 0.6 THEN p2 END AS stage2_score, CASE WHEN p1 >= 0.6 AND p2 >= 0.7 THEN 'qa_hold' ELSE 'no_model_flag' END AS decision FROM scored_cycles""")
def cascade_decide(v):
    rows = scored(v)
    return cascade.cascade_decisions(rows.drop("p2"), rows.select("serial", "p2"), "serial", 0.6, 0.7)


@query("cascade_gate", "metric:s value:f relation:s limit:f passed:b", """
WITH d AS (SELECT *, p1 >= 0.6 AND p2 >= 0.7 AS hold FROM scored_cycles),
s AS (SELECT count(*) AS n, sum(failed) AS f, sum(CAST(hold AS INT)) AS fl, sum(CAST(hold AND failed = 1 AS INT)) AS ca, sum(CAST(p1 >= 0.6 AS INT)) AS g, sum(CAST(p1 >= 0.6 AND failed = 1 AS INT)) AS gc FROM d),
h AS (SELECT p1, count(*) AS c, sum(failed) AS p FROM d GROUP BY p1),
ap AS (SELECT sum(p * cp / cn) / sum(p) AS ap FROM (SELECT p, sum(p) OVER (ORDER BY p1 DESC) AS cp, sum(c) OVER (ORDER BY p1 DESC) AS cn FROM h)),
l AS (SELECT unnest(['stage1_average_precision','stage1_recall','stage1_flag_rate','cascade_recall','cascade_precision','cascade_flag_rate']) AS metric,
  unnest([ap, gc / nullif(f, 0), g / n, ca / nullif(f, 0), ca / nullif(fl, 0), fl / n]) AS value, unnest(['min','min','max','min','min','max']) AS relation, unnest([0.2, 0.9, 0.05, 0.7, 0.2, 100 / 3800]) AS lim FROM s, ap)
SELECT metric, value, relation, lim AS "limit", coalesce(CASE WHEN relation = 'min' THEN value >= lim ELSE value <= lim END, false) AS passed FROM l""")
def cascade_gate(v):
    rows = scored(v)
    decisions = cascade.cascade_decisions(rows.drop("p2"), rows.select("serial", "p2"), "serial", 0.6, 0.7)
    ap = evaluation.ranking_metrics(rows, "p1", "failed").select("average_precision")
    gate = rows.agg(
        (F.sum(((F.col("p1") >= 0.6) & (F.col("failed") == 1)).cast("int")) / F.sum("failed")).alias("recall"),
        F.avg((F.col("p1") >= 0.6).cast("int")).alias("flag_rate"),
    )
    return cascade.acceptance_checks(cascade.cascade_summary(decisions), gate.join(F.broadcast(ap)))


@query("inspection_match", "serial:i inspected:b", """
SELECT c.serial, i.serial IS NOT NULL AS inspected FROM cycles c LEFT JOIN (SELECT serial FROM cycles WHERE machine_id % 9 <> 0) i ON i.serial = c.serial""")
def inspection_match(v):
    inspected = v.cycles.where("machine_id % 9 <> 0").select("serial", F.lit(True).alias("found"))
    both = joins.validated_join(v.cycles.select("serial"), inspected, ["serial"], "left", "one_to_one")
    return both.withColumn("inspected", F.coalesce("found", F.lit(False)))
