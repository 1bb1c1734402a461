"""Queries of fills, shapes, extended records and choices over the test tables, with what SQL can say of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.functions import columns as C
from freshet.operators import extension, grids, models, network, products, report, resampling, selection, shapes, temperature, windows
from freshet.plans.oracles import _DAILY, _MONTHLY, _WINDOWS, _YEARLY
from freshet.plans.queries import WINDOWS, _rounded, _zones
from freshet.plans.views import Tables
from freshet.sources.shared import settled

BY = ("variable", "period")
_SPLINE = "[" + ",".join("[" + ",".join(repr(float(x)) for x in row) + "]" for row in shapes.spline_matrix()) + "]"
_DAYS = "[31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]"
_SHAPES = f"""months AS (SELECT id, list(q::DOUBLE ORDER BY month) AS q FROM monthly GROUP BY 1 HAVING count(q) = 12),
spread AS (SELECT id, doy::INT AS doy, month(DATE '2001-01-01' + (doy - 1)::INT) AS month, greatest(list_inner_product(b[doy], q), 0) AS y FROM months, (SELECT {_SPLINE} AS b), range(1, 366) d(doy)),
shaped AS (SELECT id, month, doy, CASE WHEN sum(y) OVER w = 0 THEN 1 / count(*) OVER w ELSE y / sum(y) OVER w END AS weight, sum(y) OVER w = 0 AS flat FROM spread WINDOW w AS (PARTITION BY id, month))"""
#: Donors of a supplier's record: the suppliers within twelve numbers.
_CHAIN = "chain AS (SELECT a.s_suppkey::VARCHAR AS target, b.s_suppkey::VARCHAR AS donor, abs(a.s_suppkey - b.s_suppkey)::DOUBLE AS distance FROM supplier a JOIN supplier b ON abs(a.s_suppkey - b.s_suppkey) BETWEEN 1 AND 12)"


def _values(t: Tables) -> DataFrame:
    """Yearly means, and days of the year made of them."""
    y = t.yearly()
    return y.selectExpr("station", "'q_mean' as variable", "'all' as period", "year", "value").unionByName(y.selectExpr("station", "'q_cov_day' as variable", "'all' as period", "year", "value * 4 as value"))


_VALUES = f"{_YEARLY}, vals AS (SELECT station, 'q_mean' AS variable, year, value, ln(value) AS v FROM yearly UNION ALL SELECT station, 'q_cov_day', year, value * 4, value * 4 FROM yearly)"


def _chain(t: Tables) -> DataFrame:
    places = t.supplier.selectExpr("cast(s_suppkey as string) as place", "cast(s_suppkey as double) as x", "0D as y")
    near = network.nearest_candidates(places.withColumnRenamed("place", "station"), places, 12.0, 25)
    return near.where("station <> place").selectExpr("station as target", "place as donor", "distance")


def _targets(t: Tables) -> DataFrame:
    return _values(t).where("cast(station as int) % 3 = 0 and year between 1996 and 1999").withColumnRenamed("station", "target")


def _extended(t: Tables, method: str) -> DataFrame:
    return _rounded(extension.extend(_targets(t), _values(t).withColumnRenamed("station", "donor"), _chain(t), method, residuals=(-0.1, 0.2))).drop("period")


_T = "t AS (SELECT station AS target, variable, year, value, v FROM vals WHERE station::INT % 3 = 0 AND year BETWEEN 1996 AND 1999)"


def _extend_sql(method: str) -> str:
    quantiles = "[" + ", ".join(repr(extension.t_quantile(0.95, i)) for i in range(1, 10)) + "]"
    half = f"{quantiles}[(n - 2)::INT]::DOUBLE * sqrt(greatest(syy - sxy * sxy / sxx, 0) / (n - 2)) * sqrt(1 + 1 / n + (x - mx) ^ 2 / sxx)"
    g, low, high = {
        "ols": ("my + sxy / sxx * (x - mx)", f"-{half}", half),
        "move1": ("my + CASE WHEN sxy < 0 THEN -1 ELSE 1 END * sqrt(syy / sxx) * (x - mx)", "-0.1", "0.2"),
        "ratio": ("CASE WHEN variable = 'q_mean' THEN ln(x0 * my0 / mx0) ELSE x0 * my0 / mx0 END", "-0.1", "0.2"),
    }[method]
    back = lambda x: f"round(CASE WHEN variable = 'q_mean' THEN exp({x}) ELSE {x} END, 6)"
    return f"""WITH {_VALUES}, {_CHAIN}, {_T}, own AS (SELECT target, variable, count(*) AS m FROM t GROUP BY ALL),
f AS (SELECT c.target, c.donor, c.distance, t.variable, count(*)::DOUBLE AS n, avg(d.v) AS mx, avg(t.v) AS my, regr_sxx(t.v, d.v) AS sxx, regr_syy(t.v, d.v) AS syy, regr_sxy(t.v, d.v) AS sxy, avg(d.value) AS mx0, avg(t.value) AS my0
  FROM chain c JOIN t ON t.target = c.target JOIN vals d ON d.station = c.donor AND d.variable = t.variable AND d.year = t.year GROUP BY ALL),
k AS (SELECT f.*, row_number() OVER (PARTITION BY target, variable ORDER BY distance, donor) AS i FROM f JOIN own USING (target, variable) WHERE n = m AND n >= 3{" AND sxx > 0" if method != "ratio" else ""}),
e AS (SELECT k.*, d.year, d.v AS x, d.value AS x0, row_number() OVER (PARTITION BY k.target, k.variable, d.year ORDER BY i) AS j FROM k JOIN vals d ON d.station = k.donor AND d.variable = k.variable ANTI JOIN t ON t.target = k.target AND t.variable = k.variable AND t.year = d.year WHERE i <= 5),
g AS (SELECT target, variable, year, donor, {g} AS g, {low} AS l, {high} AS h FROM e WHERE j = 1)
SELECT target, variable, year, {back("g")} AS value, {back("g + l")} AS lower, {back("g + h")} AS upper, donor, 'extended' AS source FROM g
UNION ALL SELECT target, variable, year, round(value, 6), round(value, 6), round(value, 6), NULL, 'observed' FROM t"""


def _pseudo(t: Tables) -> DataFrame:
    return extension.pseudo_records(_values(t), _chain(t), 3)


_PSEUDO = f"""{_VALUES}, {_CHAIN}, r AS (SELECT *, year - row_number() OVER (PARTITION BY station, variable ORDER BY year) AS run FROM vals),
p AS (SELECT *, (row_number() OVER (PARTITION BY station, variable, run ORDER BY year) - 1) // 3 AS part FROM r),
b AS (SELECT * FROM (SELECT station, variable, year, value, v, min(year) OVER w AS block, count(*) OVER w AS n FROM p WINDOW w AS (PARTITION BY station, variable, run, part)) WHERE n = 3),
f AS (SELECT b.station, b.block, b.variable, c.donor, c.distance, avg(d.v) AS mx, avg(b.v) AS my, regr_sxx(b.v, d.v) AS sxx, regr_syy(b.v, d.v) AS syy, regr_sxy(b.v, d.v) AS sxy, avg(d.value) AS mx0, avg(b.value) AS my0, count(*)::DOUBLE AS n
  FROM b JOIN chain c ON c.target = b.station JOIN vals d ON d.station = c.donor AND d.variable = b.variable AND d.year = b.year GROUP BY ALL HAVING count(*) = 3 AND regr_sxx(b.v, d.v) > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY station, block, variable ORDER BY distance, donor) AS i FROM f),
e AS (SELECT k.*, d.year, d.v AS x, d.value AS x0, o.value AS own, o.v AS ov, row_number() OVER (PARTITION BY k.station, k.block, k.variable, d.year ORDER BY i) AS j
  FROM k JOIN vals d ON d.station = k.donor AND d.variable = k.variable JOIN vals o ON o.station = k.station AND o.variable = k.variable AND o.year = d.year WHERE i <= 5 AND d.year NOT BETWEEN k.block AND k.block + 2),
q AS (SELECT station, block, variable, year, ov, ov - (my + sxy / sxx * (x - mx)) AS r_ols, ov - (my + CASE WHEN sxy < 0 THEN -1 ELSE 1 END * sqrt(syy / sxx) * (x - mx)) AS r_move1, ov - CASE WHEN variable = 'q_mean' THEN ln(x0 * my0 / mx0) ELSE x0 * my0 / mx0 END AS r_ratio,
  {extension.t_quantile(0.95, 1)!r} * sqrt(greatest(syy - sxy * sxy / sxx, 0)) * sqrt(1 + 1 / n + (x - mx) ^ 2 / sxx) AS half FROM e WHERE j = 1),
held AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY station, block, variable) AS hn FROM q) WHERE hn >= 3)"""


def _gauges(t: Tables) -> DataFrame:
    weights = models.within_month(windows.day_climatology(t.sparse()).withColumn("month", C.month_of_common_day(F.col("doy"))))
    days = weights.groupBy("station").agg(F.transform(F.array_sort(F.collect_list(F.struct("doy", "weight"))), lambda d: d["weight"]).alias("weights")).where("size(weights) = 365")
    return days.join(t.supplier.selectExpr("cast(s_suppkey as string) as station", "s_acctbal / 1000D as balance", "s_nationkey + 0D as nation"), "station")


def _basis(t: Tables) -> DataFrame:
    gauges = settled(_gauges(t), "gauges")  # read three times below
    fit = shapes.fit_basis(gauges, ["balance", "nation"], 3)
    return _rounded(shapes.predict_basis(fit, gauges, "station"), 8)


def _temperature(t: Tables) -> tuple[DataFrame, DataFrame]:
    lines = t.lineitem.selectExpr("cast(l_linenumber as string) as station", "cast(l_shipdate as date) as date", "cast(l_quantity as double) / 4 as water", "cast(l_tax as double) * 200 as air")
    temp = lines.groupBy("station", "date").agg(F.avg("water").alias("t_mean_c")).where("dayofyear(date) % 29 > 4")
    air = lines.groupBy(F.col("station").alias("id"), "date").agg(F.avg("air").alias("value")).withColumn("variable", F.lit("tmean"))
    return temp, air


def _product(t: Tables) -> DataFrame:
    months = shapes._months(t.monthly(), "id").select("id", F.col("_months").alias("months"))
    watersheds = months.join(products.day_weights(shapes.spline_shape(t.monthly())), "id").withColumn("area", 1e6 * (1 + F.col("id") % 4))
    segments = t.supplier.selectExpr("s_suppkey as segment", "s_nationkey as id", "s_suppkey % 10 / 10D as coverage", "'1981-2010' as period", "s_suppkey % 3 <> 0 as pick")
    return _rounded(products.balance_days(segments.join(watersheds, "id", "left_semi"), watersheds), 4)


def _cells(t: Tables) -> DataFrame:
    return t.part.selectExpr("cast(p_partkey % 40 as int) as x", "cast(p_partkey div 40 as int) as y", "case when p_size % 3 <> 0 and p_partkey % 40 not between 8 and 13 then cast(p_size as double) end as value")


_NESTED = {"za": ["za"], "raw": ["raw"]}


def _nested_sql() -> str:
    fits = lambda by: ", ".join(f"regr_slope(z.obs, z.{x}) AS b_{x}, regr_intercept(z.obs, z.{x}) AS a_{x}" for x in ("za", "raw"))
    return f"""WITH z AS (SELECT p_partkey AS id, p_brand AS fold, p_partkey % 7 / 7 AS za, p_size::DOUBLE AS raw, p_size + p_partkey * 37 % 101 / 10 AS obs FROM part),
folds AS (SELECT DISTINCT fold FROM z), two AS (SELECT o.fold AS o, i.fold AS i, {fits("")} FROM folds o JOIN folds i ON o.fold <> i.fold JOIN z ON z.fold <> o.fold AND z.fold <> i.fold GROUP BY ALL),
e AS (SELECT o, avg(abs(100 * (a_za + b_za * za - obs) / obs)) AS m_za, avg(abs(100 * (a_raw + b_raw * raw - obs) / obs)) AS m_raw FROM two JOIN z ON z.fold = two.i GROUP BY 1),
one AS (SELECT o.fold AS o, {fits("")} FROM folds o JOIN z ON z.fold <> o.fold GROUP BY ALL)
SELECT id, fold, CASE WHEN m_za <= m_raw THEN 'za' ELSE 'raw' END AS chosen, round(obs, 6) AS obs, round(CASE WHEN m_za <= m_raw THEN a_za + b_za * za ELSE a_raw + b_raw * raw END, 6) AS mod FROM z JOIN e ON e.o = fold JOIN one ON one.o = fold"""


def _checked(t: Tables) -> DataFrame:
    months = t.monthly().selectExpr("id as station", "month", "q as obs", "case when (id + month) % 13 <> 0 then q * (0.7 + ((id * 7 + month * 3) % 11) / 16D) end as mod")
    year = months.groupBy("station").agg(F.lit(0).alias("month"), F.avg("obs").alias("obs"), F.avg("mod").alias("mod"))
    return months.unionByName(year).selectExpr("*", "station % 5 as grp", "station % 2 as half")


PAIRS = {
    "shape_spline": (
        lambda t: _rounded(shapes.spline_shape(t.monthly()), 8),
        f"WITH {_MONTHLY}, {_SHAPES} SELECT id, month, doy, round(weight, 8) AS weight, flat FROM shaped",
    ),
    "shape_basis": (_basis, None),
    "temperature_fill": (lambda t: _rounded(temperature.fill(*_temperature(t), min_days=300), 3), None),
    "window_extend_intervals_ols": (lambda t: _extended(t, "ols"), _extend_sql("ols")),
    "window_extend_intervals_move1": (lambda t: _extended(t, "move1"), _extend_sql("move1")),
    "window_extend_intervals_ratio": (lambda t: _extended(t, "ratio"), _extend_sql("ratio")),
    "window_extend_report": (
        lambda t: extension.report(_targets(t).withColumn("value", F.expr("case when (year + cast(target as int)) % 5 = 0 and target % 2 = 0 then 0D else value end")), _values(t).withColumnRenamed("station", "donor"), _chain(t)).drop("period"),
        f"""WITH {_VALUES}, {_CHAIN}, {_T}, u AS (SELECT target, variable, year, CASE WHEN (year + target::INT) % 5 = 0 AND target::INT % 2 = 0 THEN 0 ELSE value END AS value FROM t),
g AS (SELECT * FROM u WHERE variable = 'q_cov_day' OR value > 0), own AS (SELECT target, variable, count(*) FILTER (variable = 'q_cov_day' OR value > 0) AS n_years, count(*) FILTER (variable <> 'q_cov_day' AND value <= 0) AS dropped FROM u GROUP BY ALL),
s AS (SELECT g.target, g.variable, c.donor, count(*) AS n FROM g JOIN chain c ON c.target = g.target JOIN vals d ON d.station = c.donor AND d.variable = g.variable AND d.year = g.year AND (d.variable = 'q_cov_day' OR d.value > 0) GROUP BY ALL),
w AS (SELECT target, variable, count(*) AS n_donors FROM s JOIN own USING (target, variable) WHERE n = n_years GROUP BY ALL)
SELECT target, variable, n_years, dropped, coalesce(n_donors, 0) AS n_donors, CASE WHEN n_years < 3 THEN 'too few years' WHEN n_donors IS NULL THEN 'no donor has every year' END AS reason FROM own LEFT JOIN w USING (target, variable)""",
    ),
    "pseudo_scores": (
        lambda t: _rounded(extension.pseudo_scores(_pseudo(t))).drop("period"),
        f"""WITH {_PSEUDO}, n AS (SELECT station, block, variable, 1 - sum(r_ols ^ 2) / (var_pop(ov) * count(*)) AS ols, 1 - sum(r_move1 ^ 2) / (var_pop(ov) * count(*)) AS move1, 1 - sum(r_ratio ^ 2) / (var_pop(ov) * count(*)) AS ratio FROM held GROUP BY ALL)
SELECT station, variable, count(*) AS n_blocks, round(median(ols), 6) AS ols, round(median(move1), 6) AS move1, round(median(ratio), 6) AS ratio FROM n GROUP BY ALL""",
    ),
    "pseudo_coverage": (
        lambda t: _rounded(extension.pseudo_coverage(_pseudo(t))).drop("period"),
        f"""WITH {_PSEUDO}, s AS (SELECT DISTINCT station, variable FROM held),
o AS (SELECT s.station, s.variable, quantile_cont(h.r_move1, 0.05) AS ml, quantile_cont(h.r_move1, 0.95) AS mh, quantile_cont(h.r_ratio, 0.05) AS rl, quantile_cont(h.r_ratio, 0.95) AS rh FROM s JOIN held h ON h.variable = s.variable AND h.station <> s.station GROUP BY ALL),
c AS (SELECT variable, abs(r_ols) <= half AS ols, r_move1 BETWEEN ml AND mh AS move1, r_ratio BETWEEN rl AND rh AS ratio FROM held JOIN o USING (station, variable)),
m AS (SELECT variable, unnest(['ols', 'move1', 'ratio']) AS method, unnest([ols, move1, ratio]) AS hit FROM c) SELECT variable, method, count(*) AS n, round(avg(hit::INT), 6) AS coverage FROM m GROUP BY ALL""",
    ),
    "quantiles_of_others": (
        lambda t: _rounded(extension.quantiles_of_others(t.yearly(), "station", "value", (0.05, 0.5, 0.95), ["year"])),
        f"WITH {_YEARLY}, s AS (SELECT DISTINCT station, year FROM yearly) SELECT s.year, s.station, round(quantile_cont(y.value, 0.05), 6) AS q_1, round(quantile_cont(y.value, 0.5), 6) AS q_2, round(quantile_cont(y.value, 0.95), 6) AS q_3 FROM s LEFT JOIN yearly y ON y.year = s.year AND y.station <> s.station GROUP BY ALL",
    ),
    "nested_choice": (lambda t: _rounded(selection.nested_predictions(_zones(t), "obs", _NESTED)[0]), _nested_sql()),
    "neighbour_fill": (
        lambda t: _rounded(grids.fill_from_neighbours(_cells(t))),
        """WITH RECURSIVE cells AS (SELECT (p_partkey % 40)::INT AS x, (p_partkey // 40)::INT AS y, CASE WHEN p_size % 3 <> 0 AND p_partkey % 40 NOT BETWEEN 8 AND 13 THEN p_size::DOUBLE END AS v FROM part),
s AS (SELECT x, y, v, 0 AS fill_pass, 0 AS turn FROM cells
  UNION ALL SELECT a.x, a.y, coalesce(any_value(a.v), avg(b.v)), CASE WHEN any_value(a.v) IS NULL AND avg(b.v) IS NOT NULL THEN a.turn + 1 ELSE any_value(a.fill_pass) END, a.turn + 1
  FROM s a LEFT JOIN s b ON a.v IS NULL AND b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 WHERE EXISTS (SELECT 1 FROM s WHERE v IS NULL) GROUP BY a.x, a.y, a.turn)
SELECT x, y, round(v, 6) AS value, fill_pass FROM s WHERE turn = (SELECT max(turn) FROM s)""",
    ),
    "daily_product": (
        _product,
        f"""WITH {_MONTHLY}, {_SHAPES}, laid AS (SELECT id, doy, q[month] * {_DAYS}[month] * weight AS q FROM shaped JOIN months USING (id))
SELECT s_suppkey AS segment, doy, round(q * 86400 / (1e6 * (1 + id % 4)) * 1000, 4) AS runoff_mm, round(q, 4) AS q_m3s, round(s_suppkey % 10 / 10, 4) AS coverage, 'balance' AS source, '1981-2010' AS period, s_suppkey % 3 <> 0 AS pick FROM supplier JOIN laid ON laid.id = s_nationkey""",
    ),
    "trend_significance": (
        lambda t: _rounded(models.trend_significance(t.yearly())),
        f"""WITH {_YEARLY}, p AS (SELECT a.station, median((b.value - a.value) / (b.year - a.year)) AS slope, sum(sign(b.value - a.value))::BIGINT AS s FROM yearly a JOIN yearly b ON a.station = b.station AND a.year < b.year GROUP BY a.station),
t AS (SELECT station, sum(t)::BIGINT AS n, sum(t * (t - 1) * (2 * t + 5)) AS c FROM (SELECT station, value, count(*) AS t FROM yearly GROUP BY ALL) GROUP BY station), v AS (SELECT *, (n * (n - 1) * (2 * n + 5) - c)::DOUBLE / 18 AS var_s FROM p JOIN t USING (station)),
z AS (SELECT *, CASE WHEN s > 0 THEN (s - 1) / sqrt(var_s) WHEN s < 0 THEN (s + 1) / sqrt(var_s) ELSE 0 END AS z, 1 / (1 + 0.2316419::DOUBLE * abs(z)) AS u FROM v)
SELECT station, n, round(slope, 6) AS slope, s, round(var_s, 6) AS var_s, round(z, 6) AS z, CASE WHEN n >= 4 THEN round(CASE WHEN var_s > 0 THEN least(1, 2 * exp(-z * z / 2) * 0.3989422804014327::DOUBLE * u * (0.319381530::DOUBLE + u * (-0.356563782::DOUBLE + u * (1.781477937::DOUBLE + u * (-1.821255978::DOUBLE + u * 1.330274429::DOUBLE))))) ELSE 1 END, 6) END AS p FROM z""",
    ),
    "validation_table": (
        lambda t: _rounded(models.validation_table(_checked(t), ("grp", "half"), 145000.0)),
        f"""WITH {_MONTHLY}, m AS (SELECT id AS station, month, q::DOUBLE AS obs, CASE WHEN (id + month) % 13 <> 0 THEN q * (0.7 + ((id * 7 + month * 3) % 11) / 16)::DOUBLE END AS mod FROM monthly),
r AS (SELECT * FROM m UNION ALL SELECT station, 0, avg(obs), avg(mod) FROM m GROUP BY station), g AS (SELECT *, unnest(['all', 'grp', 'half']) AS grouping, unnest(['all', (station % 5)::VARCHAR, (station % 2)::VARCHAR]) AS level FROM r),
e AS (SELECT *, obs >= 145000 AND mod IS NOT NULL AS good, CASE WHEN obs >= 145000 AND mod IS NOT NULL THEN 100 * (mod - obs) / obs END AS e, CASE WHEN obs >= 145000 AND mod > 0 THEN ln(mod / obs) END AS l FROM g WHERE month = 0),
a AS (SELECT grouping, level, count(e) AS n, count(*) FILTER (obs < 145000) AS left_out, count(*) FILTER (mod IS NULL) AS no_model, avg(e) AS mean_error, median(e) AS median_error, avg(abs(e)) AS mae, avg((abs(e) <= 20)::INT) AS within_20, median(l) AS median_log, stddev_samp(l) AS sd_log FROM e GROUP BY ALL),
k AS (SELECT *, avg(obs) OVER (PARTITION BY grouping, level, station) AS mm FROM g WHERE month > 0 AND obs IS NOT NULL AND mod IS NOT NULL), s AS (SELECT grouping, level, station, 1 - sum((mod - obs) ^ 2) / sum((obs - mm) ^ 2) AS nse FROM k GROUP BY ALL HAVING count(*) = 12),
b AS (SELECT grouping, level, median(nse) AS nse_months FROM s GROUP BY ALL)
SELECT grouping, level, n, left_out, no_model, round(mean_error, 6) AS mean_error, round(median_error, 6) AS median_error, round(mae, 6) AS mae, round(within_20, 6) AS within_20, round(median_log, 6) AS median_log, round(sd_log, 6) AS sd_log, round(nse_months, 6) AS nse_months FROM a LEFT JOIN b USING (grouping, level)""",
    ),
    "station_departures": (
        lambda t: _rounded(report.departures(t.flagged(), WINDOWS, (1996, 1999), ("mean", "frac_below"), 3, 3, 1.0, 1996, 0.1)),
        f"""WITH {_DAILY}, {_WINDOWS}, mon AS (SELECT station, year(date) AS y, month(date) AS m, avg(q) AS q, count(*) AS n FROM daily GROUP BY ALL), comp AS (SELECT station, y FROM mon WHERE n >= 20 GROUP BY ALL HAVING count(*) = 12),
cnt AS (SELECT station, count(*) FILTER (y BETWEEN 1996 AND 1999) >= 3 AS inside FROM comp GROUP BY 1 HAVING count(*) >= 3), used AS (SELECT station, y FROM comp JOIN cnt USING (station) WHERE NOT inside OR y BETWEEN 1996 AND 1999),
mm AS (SELECT station, m, avg(q) AS q FROM mon JOIN used USING (station, y) GROUP BY ALL), lev AS (SELECT station, sum(q * CASE WHEN m = 2 THEN 28.25 WHEN m IN (4, 6, 9, 11) THEN 30 ELSE 31 END::DOUBLE) / 365.25::DOUBLE AS t FROM mm GROUP BY 1),
ends AS (SELECT station, min(date) AS a, max(date) AS b FROM daily GROUP BY 1),
d AS (SELECT d.station, period, s, e, q, q < t AS low, q % 3 = 0 AS ice, year(date) >= 2000 AS prov, a, b, year(date) - CASE WHEN e < s AND strftime(date, '%m-%d') <= e THEN 1 ELSE 0 END AS year
  FROM daily d JOIN ends USING (station) LEFT JOIN lev USING (station) JOIN wins ON CASE WHEN e < s THEN strftime(date, '%m-%d') >= s OR strftime(date, '%m-%d') <= e ELSE strftime(date, '%m-%d') BETWEEN s AND e END),
x AS (SELECT *, make_date(year, s[1:2]::INT, s[4:5]::INT) AS f, CASE WHEN e = '02-29' THEN last_day(make_date(year + (e < s)::INT, 2, 1)) ELSE make_date(year + (e < s)::INT, e[1:2]::INT, e[4:5]::INT) END AS l FROM d),
w AS (SELECT station, period, year::BIGINT AS year, count(*) AS n_days, avg(q) AS mean, avg(low::INT) AS below, avg(ice::INT) AS frac_ice, avg(prov::INT) AS frac_provisional FROM x WHERE f >= a AND l <= b GROUP BY station, period, year, f, l HAVING count(*) >= 0.1 * (l - f + 1)),
k AS (SELECT *, unnest(['q_mean', 'q_frac_below']) AS variable, unnest([mean, below]) AS value FROM w WHERE NOT (period IN ('djf', 'feb') AND frac_provisional > 0)),
nb AS (SELECT station, variable, period, avg(value) FILTER (year BETWEEN 1996 AND 1999) AS normal, count(*) FILTER (year BETWEEN 1996 AND 1999) AS n_base FROM k WHERE value IS NOT NULL GROUP BY ALL),
mv AS (SELECT k.*, normal, n_base, CASE WHEN variable = 'q_mean' THEN 100 * (value - normal) / normal ELSE value - normal END AS anomaly FROM k JOIN nb USING (station, variable, period) WHERE value IS NOT NULL AND n_base >= 3),
since AS (SELECT station, variable, period, year, anomaly FROM mv WHERE year >= 1996),
pr AS (SELECT a.station, a.variable, a.period, median((b.anomaly - a.anomaly) / (b.year - a.year)) AS slope, sum(sign(b.anomaly - a.anomaly)) AS s FROM since a JOIN since b ON a.station = b.station AND a.variable = b.variable AND a.period = b.period AND a.year < b.year GROUP BY ALL),
ti AS (SELECT station, variable, period, sum(t)::BIGINT AS n, sum(t * (t - 1) * (2 * t + 5)) AS c FROM (SELECT station, variable, period, anomaly, count(*) AS t FROM since GROUP BY ALL) GROUP BY ALL),
z AS (SELECT *, (n * (n - 1) * (2 * n + 5) - c)::DOUBLE / 18 AS vs, CASE WHEN s > 0 THEN (s - 1) / sqrt(vs) WHEN s < 0 THEN (s + 1) / sqrt(vs) ELSE 0 END AS z, 1 / (1 + 0.2316419::DOUBLE * abs(z)) AS u FROM pr JOIN ti USING (station, variable, period)),
tr AS (SELECT station, variable, period, slope, n AS n_trend, CASE WHEN n >= 4 THEN CASE WHEN vs > 0 THEN least(1, 2 * exp(-z * z / 2) * 0.3989422804014327::DOUBLE * u * (0.319381530::DOUBLE + u * (-0.356563782::DOUBLE + u * (1.781477937::DOUBLE + u * (-1.821255978::DOUBLE + u * 1.330274429::DOUBLE))))) ELSE 1 END END AS p FROM z)
SELECT station, variable, period, year, round(value, 6) AS value, round(normal, 6) AS normal, n_base, round(anomaly, 6) AS anomaly, n_days, round(frac_ice, 6) AS frac_ice, round(frac_provisional, 6) AS frac_provisional, round(slope, 6) AS slope, round(p, 6) AS p, n_trend
FROM mv LEFT JOIN tr USING (station, variable, period)""",
    ),
    "change_interval": (
        lambda t: _rounded(resampling.change_interval(t.yearly().selectExpr("*", "year % 2 = 0 as extended"), t.yearly().selectExpr("station", "(value - 25) / 4 as r"), (1995, 1997), (1998, 2001), 500)),
        f"""WITH {_YEARLY}, part AS (SELECT station, CASE WHEN year <= 1997 THEN 'base' ELSE 'recent' END AS part, year, value, year % 2 = 0 AS ext FROM yearly WHERE year BETWEEN 1995 AND 2001),
held AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY station, part) AS n FROM part WINDOW w AS (PARTITION BY station, part ORDER BY year)),
errs AS (SELECT station, list((value - 25) / 4 ORDER BY (value - 25) / 4) AS r FROM yearly GROUP BY 1), dr AS (SELECT unnest(range(1, 501)) AS draw),
z AS (SELECT station, part, draw, i, n, value + CASE WHEN ext THEN r[floor(('0x' || substr(md5(station || ':' || draw || ':' || part || ' error:' || i), 1, 13))::BIGINT::DOUBLE / 4503599627370496 * len(r))::BIGINT + 1] ELSE 0 END AS z FROM held JOIN errs USING (station), dr),
k AS (SELECT station, part, draw, floor(('0x' || substr(md5(station || ':' || draw || ':' || part || ':' || slot), 1, 13))::BIGINT::DOUBLE / 4503599627370496 * n)::BIGINT AS i FROM (SELECT DISTINCT station, part, n FROM held) h, dr, range(1, 9) s(slot) WHERE slot <= n AND n >= 2),
m AS (SELECT station, draw, avg(z) FILTER (part = 'recent') - avg(z) FILTER (part = 'base') AS d FROM k JOIN z USING (station, part, draw, i) GROUP BY ALL HAVING count(DISTINCT part) = 2),
w AS (SELECT station, avg(value) FILTER (part = 'recent') - avg(value) FILTER (part = 'base') AS change FROM held GROUP BY 1)
SELECT station, round(any_value(change), 6) AS change, round(quantile_cont(d, 0.05), 6) AS low, round(quantile_cont(d, 0.95), 6) AS high FROM m JOIN w USING (station) GROUP BY station""",
    ),
    "change_coverage": (lambda t: _rounded(resampling.change_coverage(t.yearly().selectExpr("*", "year % 2 = 0 as extended"), t.yearly().selectExpr("station", "(value - 25) / 4 as r"), (1995, 1997), (1998, 2001), 20, 40)), None),
}

QUERIES = {name: query for name, (query, _) in PAIRS.items()}
ORACLES = {name: sql for name, (_, sql) in PAIRS.items() if sql}
