"""SQL of queries whose results rest on tail probabilities, kernels or spectra, written out for an engine without them."""

from __future__ import annotations

from trialspark.operators import rates
from trialspark.plans.event_queries import E
from trialspark.plans.flagship import _BOTH


def _phi(x: str) -> str:
    """The normal distribution function, by Simpson's rule from 0 to x."""
    terms = f"lambda i: (CASE WHEN i IN (0, 1000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-0.5::DOUBLE * (({x}) * i / 1000.0::DOUBLE) ** 2)"
    return f"(0.5::DOUBLE + ({x}) / 3000 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 1001), {terms})))"


def _signed_rank(source: str, keys: str, digits: int, exact: int = 15) -> str:
    """CTEs up to `st`: the signed-rank test of (keys, x, y) in source, its p exact over all signs up to `exact` used pairs."""
    n = "n_used"
    z = f"CASE WHEN {n} > 0 THEN sign(w_plus - {n} * ({n} + 1) / 4.0::DOUBLE) * greatest(abs(w_plus - {n} * ({n} + 1) / 4.0::DOUBLE) - 0.5, 0) / sqrt({n} * ({n} + 1) * (2 * {n} + 1) / 24.0::DOUBLE - tie / 48.0::DOUBLE) ELSE 0 END"
    return f"""sd AS (SELECT {keys}, x, y, round(x - y, {digits}) AS d FROM {source} WHERE x IS NOT NULL AND y IS NOT NULL),
su AS (SELECT {keys}, d, rank() OVER (PARTITION BY {keys} ORDER BY abs(d)) + (count(*) OVER (PARTITION BY {keys}, abs(d)) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY {keys}, abs(d)) AS ties FROM sd WHERE d <> 0),
sw AS (SELECT {keys}, count(*) AS n_used, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus, sum(ties * ties - 1) AS tie FROM su GROUP BY ALL),
sn AS (SELECT {keys}, count(*) AS n, median(x) AS x_median, median(y) AS y_median FROM sd GROUP BY ALL),
sb AS (SELECT sn.*, coalesce(n_used, 0) AS n_used, coalesce(w_plus, 0) AS w_plus, coalesce(w_minus, 0) AS w_minus, tie FROM sn LEFT JOIN sw USING ({keys})),
sx AS (SELECT {keys}, r, row_number() OVER (PARTITION BY {keys}) - 1 AS i, count(*) OVER (PARTITION BY {keys}) AS k FROM su),
sm AS (SELECT {keys}, unnest(range(0, (1::BIGINT << k::BIGINT))) AS m FROM (SELECT DISTINCT {keys}, k FROM sx WHERE k <= {exact})),
sv AS (SELECT {keys}, m, sum(CASE WHEN (m >> i) & 1 = 1 THEN r ELSE 0 END) AS w FROM sm JOIN sx USING ({keys}) GROUP BY ALL),
se AS (SELECT {keys}, least(1.0::DOUBLE, 2 * least(avg((w <= w_plus + 1e-6)::INT), avg((w >= w_plus - 1e-6)::INT))) AS p_exact FROM sv JOIN sb USING ({keys}) GROUP BY ALL),
sz AS (SELECT sb.*, {z} AS z, p_exact FROM sb LEFT JOIN se USING ({keys})),
sp AS (SELECT *, CASE WHEN n_used = 0 THEN 1.0::DOUBLE ELSE coalesce(p_exact, 2 * (1 - {_phi('abs(z)')})) END AS p FROM sz),
st AS (SELECT *, CASE WHEN p < 0.05 THEN CASE WHEN y_median <> x_median THEN sign(y_median - x_median) ELSE sign(w_minus - w_plus) END ELSE 0 END::INT AS direction FROM sp)"""


_KERNEL = f"{rates._table(1.0, 8.0, 4000)}"

ORACLES = {
    "t2_signed_rank_p": f"""WITH pr AS (SELECT l_suppkey, l_linenumber, avg(l_discount) AS x, avg(l_tax) AS y FROM lineitem GROUP BY 1, 2), {_signed_rank('pr', 'l_suppkey', 9)}
SELECT l_suppkey, n, round(x_median, 6) AS x_median, round(y_median, 6) AS y_median, n_used, w_plus, w_minus, round(z, 6) AS z, round(p, 6) AS p, direction FROM st""",
    "t2_significant_units": f"""{_BOTH}, pr AS (SELECT event_type, stationary_fr AS x, motion_fr AS y FROM b), {_signed_rank('pr', 'event_type', 12)}
SELECT event_type, n, round(x_median, 12) AS x_median, round(y_median, 12) AS y_median, n_used, w_plus, w_minus, round(z, 6) AS z, round(p, 6) AS p, direction FROM st""",
    "t7_lilliefors": f"""{E}, k AS (SELECT {_KERNEL} AS a), m AS (SELECT event_type, avg(value) AS mean, stddev_samp(value) AS sd, count(*) AS n FROM e GROUP BY 1),
v AS (SELECT event_type, value, count(*) AS c FROM e GROUP BY 1, 2), w AS (SELECT *, sum(c) OVER (PARTITION BY event_type ORDER BY value)::BIGINT AS upto FROM v),
x AS (SELECT event_type, n, c, upto, greatest(0, least(4000, ((value - mean) / sd + 8) * 250.0::DOUBLE)) AS pos FROM w JOIN m USING (event_type)),
y AS (SELECT *, a[least(floor(pos), 3999)::INT + 1] + (a[least(floor(pos), 3999)::INT + 2] - a[least(floor(pos), 3999)::INT + 1]) * (pos - least(floor(pos), 3999)) AS cdf FROM x, k),
d AS (SELECT event_type, max(n) AS n, max(greatest(abs(upto / n - cdf), abs(cdf - (upto - c) / n))) AS d FROM y GROUP BY 1)
SELECT event_type, n, round(d, 6) AS d, round(0.895 / (sqrt(n) - 0.01 + 0.85 / sqrt(n)), 6) AS critical, d <= 0.895 / (sqrt(n) - 0.01 + 0.85 / sqrt(n)) AS normal FROM d""",
    "h2_band_power": f"""{E}, x AS (SELECT user_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM e),
h AS (SELECT user_id, i, n, v, CASE WHEN n > 1 THEN 0.54 - 0.46 * cos(2 * pi() * i / (n - 1)) ELSE 1 END AS w FROM x), s AS (SELECT user_id, sum(w * w) AS ww FROM h GROUP BY 1),
f AS (SELECT user_id, n, k, sum(v * w * cos(2 * pi() * k * i / n)) AS re, sum(v * w * sin(2 * pi() * k * i / n)) AS im FROM (SELECT *, unnest(range(0, n // 2 + 1)) AS k FROM h) GROUP BY ALL),
p AS (SELECT f.user_id, n, k, (re * re + im * im) / (10 * ww) * CASE WHEN k = 0 OR (n % 2 = 0 AND k = n // 2) THEN 1 ELSE 2 END AS power FROM f JOIN s USING (user_id))
SELECT user_id, round(coalesce(sum(power) FILTER (WHERE k * 10.0::DOUBLE / n BETWEEN 1 AND 4), 0) * 10.0::DOUBLE / any_value(n), 6) AS power FROM p GROUP BY 1""",
    "t10_tukey_kramer": f"""WITH x AS (SELECT l_linestatus, l_returnflag AS g, rank() OVER (PARTITION BY l_linestatus ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_linestatus, l_quantity) - 1) / 2.0::DOUBLE AS r,
count(*) OVER (PARTITION BY l_linestatus, l_quantity) AS ties FROM lineitem), m AS (SELECT l_linestatus, g, avg(r) AS m, count(*) AS n FROM x GROUP BY 1, 2),
t AS (SELECT l_linestatus, count(*)::DOUBLE AS n, count(DISTINCT g) AS k, sum(ties * ties - 1) AS tie FROM x GROUP BY 1),
q AS (SELECT a.l_linestatus, a.g AS a, b.g AS b, a.m - b.m AS difference, k, abs(a.m - b.m) / sqrt((t.n * (t.n + 1) / 12 - tie / (12 * (t.n - 1))) / 2 * (1 / a.n + 1 / b.n)) AS q
FROM m a JOIN m b ON a.l_linestatus = b.l_linestatus AND a.g < b.g JOIN t ON t.l_linestatus = a.l_linestatus),
z AS (SELECT unnest(range(0, 801)) * 0.02::DOUBLE - 8 AS z), zp AS (SELECT z, {_phi('z')} AS base, exp(-z * z / 2) / sqrt(2 * pi()) AS phi FROM z),
w AS (SELECT l_linestatus, a, b, k, difference, q, sum(CASE WHEN abs(z) > 7.999 THEN 0.5 ELSE 1 END * 0.02 * phi * greatest(0, least(1, base - {_phi('z - q')})) ** (k - 1)) AS s FROM q, zp GROUP BY ALL)
SELECT l_linestatus, a, b, round(difference, 6) AS difference, round(CASE WHEN q <= 0 THEN 1 ELSE greatest(0, 1 - k * s) END, 6) AS p FROM w""",
}
