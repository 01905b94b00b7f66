"""Calibration, grading against bands, robust fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilth.operators import robust, scoring
from tilth.plans.tables import table


def calibration_bands(spark, sf_dir):
    return robust.calibration_bands(table(spark, sf_dir, "events"), "event_type", "value").select("event_type", "n", "median", "mad", "lo", "hi", "p10", "p90")


def calibration_one_sided(spark, sf_dir):
    return robust.calibration_bands(table(spark, sf_dir, "events"), "event_type", "value", one_sided=("click", "view"), floors={"view": 1.0})


def _graded(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    bands = robust.calibration_bands(items, "l_returnflag", "l_quantity", k=1.0)
    return scoring.grade(items, bands, rule="l_returnflag", value="l_quantity", tolerance=0.8)


def segment_status(spark, sf_dir):
    return _graded(spark, sf_dir).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_quantity", "status")


def batch_rollup(spark, sf_dir):
    return scoring.roll_up(_graded(spark, sf_dir), rule="l_returnflag", advisory=("R",))


def robust_fit(spark, sf_dir):
    return robust.theil_sen(table(spark, sf_dir, "part"), ["p_brand"], "p_size", "p_retailprice").select("p_brand", "n", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


def plausibility_outliers(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    fit = robust.theil_sen(part, ["p_brand"], "p_size", "p_retailprice")
    found = robust.outliers(part, fit, ["p_brand"], "p_size", "p_retailprice", min_abs=905.0, mad_k=1.2, ratio_low=0.8, ratio_high=1.2)
    return found.where("outlier").select("p_partkey", "p_brand", F.round("ratio", 4).alias("ratio"), "reason")


_BANDS = """
stats AS (SELECT {rule} AS rule, count(*) AS n, median(x) AS med, list_sort(list(x)) AS xs FROM kept GROUP BY 1),
mads AS (SELECT k.{rule} AS rule, median(abs(k.x - s.med)) AS mad FROM kept k JOIN stats s ON k.{rule} = s.rule GROUP BY 1),
spots AS (SELECT s.rule, n, med, CASE WHEN mad = 0 THEN 1e-9 ELSE mad END AS mad,
  xs[cast(round_even(0.05::double*(n-1),0) AS bigint)+1] AS p05, xs[cast(round_even(0.10::double*(n-1),0) AS bigint)+1] AS p10,
  xs[cast(round_even(0.90::double*(n-1),0) AS bigint)+1] AS p90, xs[cast(round_even(0.95::double*(n-1),0) AS bigint)+1] AS p95
  FROM stats s JOIN mads m ON s.rule = m.rule WHERE n >= 5)
"""
_FIT = """
r AS (SELECT p_brand, p_partkey, p_size::double AS x, p_retailprice AS y, count(*) OVER (PARTITION BY p_brand) AS n FROM part),
s AS (SELECT a.p_brand, (b.y - a.y) / (b.x - a.x) AS s FROM r a JOIN r b ON a.p_brand = b.p_brand AND a.x <> b.x AND b.p_partkey > a.p_partkey WHERE a.n >= 8),
m AS (SELECT p_brand, median(s) AS slope FROM s GROUP BY 1),
fit AS (SELECT r.p_brand, count(*) AS n, any_value(slope) AS slope, median(y - slope * x) AS intercept FROM r JOIN m ON r.p_brand = m.p_brand GROUP BY 1)
"""
_GRADED = (
    "WITH kept AS (SELECT l_returnflag, l_quantity AS x FROM lineitem), "
    + _BANDS.format(rule="l_returnflag")
    + """, bands AS (SELECT rule, greatest(0.0, med - mad) AS lo, med + mad AS hi FROM spots),
graded AS (SELECT l.*, CASE WHEN b.rule IS NULL OR l_quantity IS NULL THEN 'unknown' WHEN l_quantity < lo - 0.8 OR l_quantity > hi + 0.8 THEN 'warn' ELSE 'ok' END AS status
  FROM lineitem l LEFT JOIN bands b ON l.l_returnflag = b.rule) """
)

QUERIES = {f.__name__: f for f in (calibration_bands, calibration_one_sided, segment_status, batch_rollup, robust_fit, plausibility_outliers)}
SQL = {
    "calibration_bands": "WITH kept AS (SELECT event_type, value AS x FROM events WHERE value IS NOT NULL), "
    + _BANDS.format(rule="event_type")
    + "SELECT rule AS event_type, n, med AS median, mad, greatest(0.0, med - 3*mad) AS lo, med + 3*mad AS hi, p10, p90 FROM spots",
    "calibration_one_sided": "WITH kept AS (SELECT event_type, value AS x FROM events WHERE value IS NOT NULL AND (event_type NOT IN ('click','view') OR value >= CASE WHEN event_type = 'view' THEN 1.0 ELSE 3.0 END)), "
    + _BANDS.format(rule="event_type")
    + """SELECT rule AS event_type, n, med AS median, mad, CASE WHEN rule IN ('click','view') THEN p05 ELSE greatest(0.0, med - 3*mad) END AS lo,
  CASE WHEN rule IN ('click','view') THEN p95 ELSE med + 3*mad END AS hi, p10, p90, rule IN ('click','view') AS one_sided FROM spots""",
    "segment_status": _GRADED + "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_quantity, status FROM graded",
    "batch_rollup": _GRADED
    + """SELECT l_returnflag, l_returnflag = 'R' AS advisory, count(*) FILTER (status <> 'warn') AS n_ok, count(*) FILTER (status = 'warn') AS n_warn,
  count(*) FILTER (status <> 'warn') / count(*)::double AS pass_rate FROM graded WHERE status <> 'missing_audio' GROUP BY 1""",
    "robust_fit": "WITH " + _FIT + "SELECT p_brand, n, round(slope, 6) AS slope, round(intercept, 6) AS intercept FROM fit",
    "plausibility_outliers": "WITH "
    + _FIT
    + """, e AS (SELECT r.*, slope * x + intercept AS expected, y - (slope * x + intercept) AS residual FROM r JOIN fit ON r.p_brand = fit.p_brand),
c AS (SELECT p_brand, median(residual) AS m FROM e GROUP BY 1),
d AS (SELECT e.p_brand, any_value(m) AS m, median(abs(residual - m)) AS d FROM e JOIN c ON e.p_brand = c.p_brand GROUP BY 1),
z AS (SELECT e.*, abs(residual - m) / CASE WHEN d = 0 THEN 1e-9 ELSE d END AS z, CASE WHEN expected > 0 THEN y / expected ELSE 0 END AS ratio FROM e JOIN d ON e.p_brand = d.p_brand)
SELECT p_partkey, p_brand, round(ratio, 4) AS ratio, CASE WHEN y < 905 THEN 'too_short_abs' WHEN ratio > 1.2 THEN 'too_long' ELSE 'too_short' END AS reason
FROM z WHERE y < 905 OR (z > 1.2 AND (ratio < 0.8 OR ratio > 1.2))""",
}
