"""Statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import panel, stats, windows
from plumbline.registry import query
from plumbline.sources.oracle_views import register_view

register_view("lots", """
SELECT supplier_id, CAST(date_trunc('month', inspected_at) AS DATE) AS month, CASE WHEN inspected_at < DATE '1998-07-01' THEN 'before' ELSE 'after' END AS period,
  sum(CAST(passed AS INT)) / count(*) AS fpy FROM inspections GROUP BY ALL""")


def lots(v):
    monthly = panel.monthly_yield(v.inspections)
    early = F.col("month") < F.lit("1998-07-01").cast("date")
    return monthly.withColumn("period", F.when(early, "before").otherwise("after"))


@query("zscore", "ncr_id:s z_severity:f z_quantity:f", """
SELECT ncr_id, (severity - avg(severity) OVER ()) / stddev_pop(severity) OVER () AS z_severity, (quantity - avg(quantity) OVER ()) / stddev_pop(quantity) OVER () AS z_quantity FROM ncrs""")
def zscore(v):
    return stats.zscore(v.ncrs.select("ncr_id", "severity", "quantity"), ["severity", "quantity"])


@query("trend_slope", "supplier_id:i slope:f", """
SELECT supplier_id, CASE WHEN count(*) >= 6 THEN regr_slope(fpy, year(month) * 12 + month(month)) END AS slope FROM lots GROUP BY supplier_id""")
def trend_slope(v):
    return windows.trend_slopes(panel.monthly_yield(v.inspections), "supplier_id", "month", "fpy", check=False)


# The draws are sums modulo a prime of the value's millionths, the replicate and the seed; a Poisson
# weight is the number of cumulative probabilities at or below the draw.
REPLICATES = """
replicate_means AS (
  WITH RECURSIVE h AS (SELECT side, seed, fpy, count(*) AS n, CAST(round(fpy * 1000000) AS BIGINT) % 2147483647 AS key FROM sides GROUP BY ALL),
  r AS (
    SELECT side, fpy, n, key, rep, 0 AS turn, (key * 48271 + rep * 69621 + seed * 16807 + 1) % 2147483647 AS x FROM h, (SELECT unnest(range(1, 10001)) AS rep)
    UNION ALL SELECT side, fpy, n, key, rep, turn + 1, ((x * x + rep * 40692 + key) % 2147483647 * 16807 + 1) % 2147483647 FROM r WHERE turn < 3),
  k AS (SELECT n, unnest(range(0, n + 12 * CAST(floor(sqrt(n)) AS BIGINT) + 40)) AS k FROM (SELECT DISTINCT n FROM h)),
  c AS (SELECT n, k, sum(exp(k * ln(n) - n - lgamma(k + 1))) OVER (PARTITION BY n ORDER BY k) AS upto FROM k),
  d AS (SELECT side, fpy, rep, n, (x + 0.5) / 2147483647 AS u FROM r WHERE turn = 3),
  w AS (SELECT d.side, d.rep, d.fpy, coalesce(c.k + 1, 0) AS weight FROM d ASOF LEFT JOIN c ON c.n = d.n AND c.upto <= d.u)
  SELECT side, rep, sum(weight * fpy) / sum(weight) AS mean FROM w GROUP BY ALL)"""


@query("bootstrap_ci", "low:f high:f", f"""
WITH sides AS (SELECT 'all' AS side, 0::BIGINT AS seed, fpy FROM lots), {REPLICATES}
SELECT quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM replicate_means""")
def bootstrap_ci(v):
    return stats.bootstrap_ci(lots(v), "fpy", n_boot=10_000)


@query("bootstrap_diff_ci", "low:f high:f", f"""
WITH sides AS (SELECT period AS side, CASE WHEN period = 'after' THEN 1000003 ELSE 0 END::BIGINT AS seed, fpy FROM lots), {REPLICATES}
SELECT quantile_cont(b.mean - a.mean, 0.025) AS low, quantile_cont(b.mean - a.mean, 0.975) AS high
FROM replicate_means a JOIN replicate_means b ON a.rep = b.rep AND a.side = 'before' AND b.side = 'after'""")
def bootstrap_diff_ci(v):
    both = lots(v)
    return stats.bootstrap_diff_ci(both.where("period = 'before'"), both.where("period = 'after'"), "fpy", n_boot=10_000)


# The oracle integrates the densities by Simpson's rule.
SIMPSON = "(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) / 12000.0"


@query("welch_t", "n1:i n2:i t:f df:f p:f", f"""
WITH g AS (SELECT period, count(*) AS n, avg(fpy) AS m, var_samp(fpy) / count(*) AS e FROM lots GROUP BY period),
w AS (SELECT b.n AS n1, a.n AS n2, (b.m - a.m) / sqrt(b.e + a.e) AS t, (b.e + a.e) ** 2 / (b.e ** 2 / (b.n - 1) + a.e ** 2 / (a.n - 1)) AS df
FROM g b, g a WHERE b.period = 'before' AND a.period = 'after')
SELECT *, 1 - 2 * (SELECT sum({SIMPSON} * abs(t) * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * (1 + (t * i / 4000.0) ** 2 / df) ** (-(df + 1) / 2)) FROM generate_series(0, 4000) s(i)) AS p FROM w""")
def welch_t(v):
    return stats.welch_t(lots(v), "period", "fpy", "before", "after")


@query("mann_whitney", "n1:i n2:i u:f z:f p:f", f"""
WITH r AS (SELECT period, fpy, rank() OVER (ORDER BY fpy) + (count(*) OVER (PARTITION BY fpy) - 1) / 2 AS mr FROM lots),
s AS (SELECT count(*) AS n, count(*) FILTER (WHERE period = 'before') AS n1, sum(mr) FILTER (WHERE period = 'before') AS r1 FROM r),
t AS (SELECT sum(CAST(c AS DOUBLE) ** 3 - c) AS ties FROM (SELECT count(*) AS c FROM lots GROUP BY fpy)),
u AS (SELECT n, n1, n - n1 AS n2, r1 - n1 * (n1 + 1) / 2 AS u, ties FROM s, t),
z AS (SELECT n1, n2, u, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))) AS z FROM u)
SELECT *, least(1, 1 - 2 * (SELECT sum({SIMPSON} * abs(z) * exp(-0.5 * (z * i / 4000.0) ** 2) / sqrt(2 * pi())) FROM generate_series(0, 4000) s(i))) AS p FROM z""")
def mann_whitney(v):
    return stats.mann_whitney(lots(v), "period", "fpy", "before", "after")


@query("chi2_independence", "chi2:f dof:i small_cells:i p:f", f"""
WITH c AS (SELECT supplier_id AS a, category AS b, count(*) AS n FROM ncrs GROUP BY ALL),
g AS (SELECT r.a, k.b, r.t * k.t / (SELECT sum(n) FROM c) AS e FROM (SELECT a, sum(n) AS t FROM c GROUP BY a) r, (SELECT b, sum(n) AS t FROM c GROUP BY b) k),
x AS (SELECT CASE WHEN count(*) FILTER (WHERE e < 5) = 0 THEN sum((coalesce(n, 0) - e) ** 2 / e) END AS chi2, (count(DISTINCT g.a) - 1) * (count(DISTINCT g.b) - 1) AS dof,
  count(*) FILTER (WHERE e < 5) AS small_cells FROM g LEFT JOIN c USING (a, b))
SELECT *, 1 - (SELECT sum({SIMPSON} * chi2 * CASE WHEN i = 0 THEN 0 ELSE exp((dof / 2.0 - 1) * ln(chi2 * i / 4000.0) - chi2 * i / 8000.0 - lgamma(dof / 2.0) - dof / 2.0 * ln(2)) END) FROM generate_series(0, 4000) s(i)) AS p FROM x""")
def chi2_independence(v):
    return stats.chi2_independence(v.ncrs, "supplier_id", "category")


@query("count_tails", "supplier_id:i month:d ncr_count:i tail:f limit:i high:b", """
WITH m AS (SELECT supplier_id, CAST(date_trunc('month', discovered_at) AS DATE) AS month, count(*) AS ncr_count FROM ncrs GROUP BY 1, 2),
g AS (SELECT supplier_id, avg(ncr_count) AS mu, var_samp(ncr_count) AS va FROM m GROUP BY 1),
pm AS (SELECT supplier_id, k, CASE WHEN va > mu THEN exp(lgamma(k + mu * mu / (va - mu)) - lgamma(mu * mu / (va - mu)) - lgamma(k + 1) + mu * mu / (va - mu) * ln(mu / va) + k * ln(1 - mu / va))
   ELSE exp(k * ln(mu) - mu - lgamma(k + 1)) END AS p FROM g, (SELECT unnest(generate_series(0, 400)) AS k)),
c AS (SELECT supplier_id, k, sum(p) OVER (PARTITION BY supplier_id ORDER BY k) AS cdf FROM pm),
l AS (SELECT supplier_id, min(k) FILTER (WHERE cdf >= 0.99) AS lim FROM c GROUP BY 1)
SELECT m.supplier_id, m.month, m.ncr_count, 1 - c.cdf AS tail, lim AS "limit", m.ncr_count > lim AS high FROM m JOIN c ON c.supplier_id = m.supplier_id AND c.k = m.ncr_count - 1 JOIN l ON l.supplier_id = m.supplier_id""")
def count_tails(v):
    return stats.count_tails(panel.monthly_ncrs(v.ncrs).select("supplier_id", "month", "ncr_count"), "supplier_id", "ncr_count")


@query("entropy_kl", "supplier_id:i entropy:f effective:f cross_entropy:f kl:f", """
WITH c AS (SELECT supplier_id, category, count(*) AS n FROM ncrs GROUP BY ALL),
s AS (SELECT supplier_id, n / sum(n) OVER (PARTITION BY supplier_id) AS p, sum(n) OVER (PARTITION BY category) / sum(n) OVER () AS q FROM c)
SELECT supplier_id, -sum(p * log2(p)) AS entropy, 2 ** -sum(p * log2(p)) AS effective, -sum(p * log2(q)) AS cross_entropy, sum(p * log2(p / q)) AS kl FROM s GROUP BY 1""")
def entropy_kl(v):
    return stats.entropy_kl(v.ncrs, "supplier_id", "category")


@query("cosine_entities", "supplier_id:i cos_raw:f cos_std:f", """
WITH f AS (SELECT n.supplier_id, n.c, n.s, i.fpy FROM (SELECT supplier_id, count(*) AS c, avg(severity) AS s FROM ncrs GROUP BY 1) n
  JOIN (SELECT supplier_id, avg(CAST(passed AS INT)) AS fpy FROM inspections GROUP BY 1) i USING (supplier_id)),
z AS (SELECT *, (c - avg(c) OVER ()) / stddev_pop(c) OVER () AS zc, (s - avg(s) OVER ()) / stddev_pop(s) OVER () AS zs, (fpy - avg(fpy) OVER ()) / stddev_pop(fpy) OVER () AS zf FROM f),
o AS (SELECT * FROM z ORDER BY c DESC, supplier_id LIMIT 1)
SELECT z.supplier_id, (z.c * o.c + z.s * o.s + z.fpy * o.fpy) / (sqrt(z.c ** 2 + z.s ** 2 + z.fpy ** 2) * sqrt(o.c ** 2 + o.s ** 2 + o.fpy ** 2)) AS cos_raw,
  (z.zc * o.zc + z.zs * o.zs + z.zf * o.zf) / (sqrt(z.zc ** 2 + z.zs ** 2 + z.zf ** 2) * sqrt(o.zc ** 2 + o.zs ** 2 + o.zf ** 2)) AS cos_std FROM z, o""")
def cosine_entities(v):
    ncr = v.ncrs.groupBy("supplier_id").agg(F.count("*").alias("c"), F.avg("severity").alias("s"))
    yields = v.inspections.groupBy("supplier_id").agg(F.avg(F.col("passed").cast("int")).alias("fpy"))
    entities = ncr.join(yields, "supplier_id")
    largest = ncr.orderBy(F.desc("c"), "supplier_id").limit(1)
    return stats.cosine_to_anchor(entities, "supplier_id", ["c", "s", "fpy"], largest)


@query("svd_energy", "component:i share:f energy:f relative_error:f")
def svd_energy(v):
    # Calendar month of year as the column axis: twelve columns whatever the data span.
    return stats.svd_energy(_month_matrix(v), [f"m{i}" for i in range(1, 13)])


def _month_matrix(v):
    month = F.month("discovered_at")
    return v.ncrs.groupBy("supplier_id").agg(*[F.sum((month == i).cast("int")).alias(f"m{i}") for i in range(1, 13)])


@query("spearman", "n:i rho:f", """
WITH r AS (SELECT rank() OVER (ORDER BY severity) + (count(*) OVER (PARTITION BY severity) - 1) / 2 AS a, rank() OVER (ORDER BY cost) + (count(*) OVER (PARTITION BY cost) - 1) / 2 AS b FROM ncrs WHERE cost IS NOT NULL)
SELECT count(*) AS n, corr(a, b) AS rho FROM r""")
def spearman(v):
    return stats.spearman(v.ncrs.select("severity", "cost"), "severity", "cost")


@query("bayes_rate", "supplier_id:i n:i prevalence:f p_flag:f posterior:f", """
WITH r AS (SELECT supplier_id, avg(CAST(severity >= 4 AS INT)) AS prevalence, avg(CASE WHEN severity >= 4 THEN CAST(quantity > 30 AS INT) END) AS se, avg(CASE WHEN NOT severity >= 4 THEN CAST(quantity > 30 AS INT) END) AS fp, count(*) AS n FROM ncrs GROUP BY 1)
SELECT supplier_id, n, prevalence, coalesce(se * prevalence, 0) + coalesce(fp * (1 - prevalence), 0) AS p_flag, coalesce(se * prevalence, 0) / nullif(coalesce(se * prevalence, 0) + coalesce(fp * (1 - prevalence), 0), 0) AS posterior FROM r""")
def bayes_rate(v):
    return stats.bayes_rate(v.ncrs, "supplier_id", F.col("quantity") > 30, F.col("severity") >= 4)
