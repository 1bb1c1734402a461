"""Queries of rebuilds, closures of groups, snow years, registered sources and complete years over the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.operators import network, rebuild, series, snow, windows
from freshet.plans.oracles import _DAILY, _MONTHLY, _TREE, _under, _up
from freshet.plans.queries import _rounded
from freshet.plans.views import Tables
from freshet.sources.registry import Entry, Registry
from freshet.sources.shared import settled

_GRP = "CASE WHEN id >= 2000000 THEN 'LOWS' WHEN id >= 1000000 THEN 'TOP' || chr(65 + CAST(id % 5 AS INT)) ELSE 'W' || chr(65 + CAST(id % 3 AS INT)) || 'S' || chr(64 + CAST(substr(w, 12, 6) AS INT)) END"


def _grouped(t: Tables) -> DataFrame:
    return t.tree().selectExpr("*", f"{_GRP} as grp")


_GROUPED = f"{_TREE}, g AS (SELECT *, {_GRP} AS grp FROM tree)"
_CLOSED = f"{_GROUPED}, closed AS (SELECT DISTINCT c.grp, t.id, t.grp AS own FROM g c JOIN g t ON {_under('t.w', 'c.w')})"


def _renewed(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The network, and the same with other values at some places, a place moved and one gone."""
    old = _grouped(t)
    new = old.where("id % 613 <> 60").selectExpr("id", "w", "case when id % 509 = 11 then w else l end as l", "area", "case when id % 401 = 7 then coalesce(v, 0D) + 5 else v end as v", "grp")
    return old, new


def _rebuilt(t: Tables) -> DataFrame:
    old, new = _renewed(t)
    changed = settled(rebuild.changed_rows(old, new, ["area", "v"]))
    return rebuild.rebuild_groups(new, settled(rebuild.affected_groups(new, changed, "grp")), lambda ws: network.upstream_mean(ws, "v"), "grp")


_NEW = f"""{_GROUPED}, n AS (SELECT id, w, CASE WHEN id % 509 = 11 THEN w ELSE l END AS l, area, CASE WHEN id % 401 = 7 THEN coalesce(v, 0) + 5 ELSE v END AS v, grp FROM g WHERE id % 613 <> 60),
changed AS (SELECT id, w, l FROM g WHERE id % 613 = 60 UNION ALL SELECT g.id, g.w, g.l FROM g JOIN n USING (id) WHERE (g.l, g.v) IS DISTINCT FROM (n.l, n.v) UNION ALL SELECT n.id, n.w, n.l FROM g JOIN n USING (id) WHERE (g.l, g.v) IS DISTINCT FROM (n.l, n.v)),
hit AS (SELECT DISTINCT a.grp FROM n a JOIN changed b ON {_up('a', 'b')}),
m AS (SELECT a.id, sum(b.area) AS a, coalesce(sum(b.area) FILTER (b.v IS NOT NULL), 0) AS c, coalesce(sum(b.area * b.v), 0) AS x FROM n a JOIN n b ON {_up('a', 'b')} GROUP BY 1),
r AS (SELECT n.id, grp, CASE WHEN c > 0 THEN x / c END AS mean, coalesce(c / a, 0) AS coverage, a IS NULL AS empty FROM n JOIN hit USING (grp) LEFT JOIN m USING (id))"""


def _compared(t: Tables) -> DataFrame:
    """What a rebuild says against the state before the change."""
    old, _ = _renewed(t)
    rows = settled(_rebuilt(t))
    before = network.upstream_mean(old, "v").join(old.join(rows.select("grp").distinct(), "grp", "left_semi").select("id"), "id", "left_semi")
    return _rounded(rebuild.against_published(rows, settled(before), ["id"], {"mean": 1e-9, "coverage": 1e-9}))


_SNOW_CELLS = "SELECT c_nationkey AS watershed, c_custkey % 400 AS cell, CAST(1 + c_custkey % 4 AS DOUBLE) / 8 AS fraction FROM customer"
_SNOW_VALUES = "SELECT 'swe' AS variable, CAST(year(o_orderdate) AS INT) AS year, o_custkey % 400 AS cell, max(CAST(o_totalprice AS DOUBLE)) / 100 AS value FROM orders WHERE o_custkey % 9 <> 0 GROUP BY 2, 3 UNION ALL SELECT 'doy', CAST(year(o_orderdate) AS INT), o_custkey % 400, CAST(min(dayofyear(o_orderdate)) AS DOUBLE) FROM orders WHERE o_custkey % 7 <> 0 GROUP BY 2, 3"


def _snow(t: Tables) -> DataFrame:
    cells = t.spark.sql(_SNOW_CELLS.replace("FROM customer", "FROM {c}"), c=t.customer)
    values = t.spark.sql(_SNOW_VALUES.replace("FROM orders", "FROM {o}"), o=t.orders)
    return _rounded(snow.snow_years(cells, values, ["swe", "doy"], caps={"swe": 3000.0}))


def _registered(t: Tables) -> DataFrame:
    months = t.monthly().selectExpr("id as segment", "month", "q / 1000 as q")
    months.selectExpr("*", "'wide' as model", "explode(array('historical', 'future')) as scenario").selectExpr("segment", "month", "case when scenario = 'future' then -q else q end as q", "model", "scenario").createOrReplaceTempView("freshet_routed_runs")
    months.selectExpr("segment", "month", "q * 2 as q").createOrReplaceTempView("freshet_balance_months")
    registry = Registry([
        Entry("tables", "routed", "freshet_routed_runs", (("model", "wide"), ("scenario", "historical")), "load the runs"), Entry("tables", "balance", "freshet_balance_months", made_by="build the balance"),
    ])
    return _rounded(registry.read(t.spark, "tables"), 4)


def _routed_years(t: Tables) -> DataFrame:
    of = t.customer.groupBy("c_nationkey").agg(F.avg(F.col("c_acctbal").cast("double")).alias("b"))
    subs = t.nation.join(of, F.expr("n_nationkey = c_nationkey"), "left").selectExpr("n_nationkey as subid", "coalesce(b, 0D) / 100 as b")
    days = subs.selectExpr("subid", "b", "explode(sequence(date'1995-01-01', date'1996-12-31')) as date").selectExpr("subid", "date", "b - day(date) * 2 as q_local", "b + month(date) * 10 as q_acc")
    return _rounded(network.routed_years(days, t.weights(), 1995, 1996).selectExpr("segment", "date", "round(q, 3) as q"), 3)


def _degree_days(t: Tables) -> DataFrame:
    warmth = t.daily().groupBy("date").agg(F.sum("q").alias("q")).selectExpr("'all' as station", "date", "q % 17 - 6 + 8 * sin(dayofyear(date) / 58D - 1.5D) as t")
    return _rounded(series.degree_days(warmth.where("month(date) <> 8 or year(date) <> 1995"), start=2.0, end=-2.0))


def _calendar_sql() -> str:
    listed = ", ".join(f"('{n}', '{s}', '{e}')" for n, s, e in windows.calendar())
    return f"wins AS (SELECT * FROM (VALUES {listed}) t(period, s, e))"


PAIRS = {
    "calendar_windows": (
        lambda t: windows.windows_of_record(t.daily(), windows.calendar()),
        f"""WITH {_DAILY}, {_calendar_sql()}, span AS (SELECT station, min(date) AS first, max(date) AS last FROM daily GROUP BY 1), years AS (SELECT station, first, last, unnest(range(year(first) - 1, year(last) + 1)) AS year FROM span),
spans AS (SELECT station, period, s, e, year, make_date(year, s[1:2]::INT, s[4:5]::INT) AS a, CASE WHEN e = '02-29' THEN last_day(make_date(year + (e < s)::INT, 2, 1)) ELSE make_date(year + (e < s)::INT, e[1:2]::INT, e[4:5]::INT) END AS b, first, last FROM years, wins),
k AS (SELECT i.station, period, s, e, year, b - a + 1 AS length, count(*) AS n FROM spans i JOIN daily d ON d.station = i.station AND d.date BETWEEN a AND b WHERE a >= first AND b <= last GROUP BY ALL)
SELECT station, period, s AS start, e AS "end", count(*) AS years, count(*) FILTER (n = length) AS complete, sum(n)::BIGINT AS days, sum(length - n)::BIGINT AS lacking FROM k GROUP BY ALL""",
    ),
    "closure_groups": (
        lambda t: network.closure_table(_grouped(t)),
        f"""WITH {_CLOSED}, tops AS (SELECT grp, w FROM g c WHERE NOT EXISTS (SELECT 1 FROM g o WHERE o.grp = c.grp AND starts_with(c.w, o.w || '.'))),
irr AS (SELECT b.id, count(*) AS n FROM g a JOIN g b ON NOT {_under('b.l', 'b.w')} AND {_up('a', 'b')} GROUP BY 1)
SELECT grp, count(*) AS n, string_agg(DISTINCT own, ',' ORDER BY own) AS groups, (SELECT string_agg(DISTINCT w[1:3], ',' ORDER BY w[1:3]) FROM tops WHERE tops.grp = closed.grp) AS codes, coalesce(sum(irr.n), 0)::BIGINT AS irregular FROM closed LEFT JOIN irr USING (id) GROUP BY grp""",
    ),
    "irregular_pairs": (
        lambda t: network.irregular_pairs(t.tree()),
        f"WITH {_TREE} SELECT a.id, b.id AS id_up FROM tree a JOIN tree b ON NOT {_under('b.l', 'b.w')} AND {_up('a', 'b')}",
    ),
    "group_rebuild": (lambda t: _rounded(_rebuilt(t)), f"WITH {_NEW} SELECT id, round(mean, 6) AS mean, CASE WHEN empty THEN 0 ELSE round(coverage, 6) END AS coverage, grp FROM r"),
    "group_rebuild_compared": (
        _compared,
        f"""WITH {_NEW}, mo AS (SELECT a.id, a.grp, coalesce(sum(b.area), 0) AS a, coalesce(sum(b.area) FILTER (b.v IS NOT NULL), 0) AS c, coalesce(sum(b.area * b.v), 0) AS x FROM g a LEFT JOIN g b ON {_up('a', 'b')} GROUP BY ALL),
o AS (SELECT id, CASE WHEN c > 0 THEN x / c END AS mean, CASE WHEN a > 0 THEN c / a END AS coverage FROM mo JOIN hit USING (grp)),
j AS (SELECT r.id AS i, o.id AS j, unnest(['mean', 'coverage']) AS value, unnest([r.mean, r.coverage]) AS x, unnest([o.mean, o.coverage]) AS y FROM r FULL JOIN o ON r.id = o.id),
s AS (SELECT value, count(*) FILTER (j IS NULL) AS only_a, count(*) FILTER (i IS NULL) AS only_b, count(*) FILTER (i IS NOT NULL AND j IS NOT NULL) AS compared, count(*) FILTER (i IS NOT NULL AND j IS NOT NULL AND x IS DISTINCT FROM y AND NOT coalesce(abs(x - y) <= 1e-9 * greatest(abs(x), abs(y)), false)) AS differing, max(abs(x - y)) FILTER (i IS NOT NULL AND j IS NOT NULL) AS m FROM j GROUP BY 1)
SELECT value, only_a, only_b, compared, differing, round(m, 6) AS max_abs_diff, only_a = 0 AND only_b = 0 AND differing = 0 AS same FROM s""",
    ),
    "snow_years": (
        _snow,
        f"""WITH c AS (SELECT watershed, cell, least(sum(fraction), 1) AS f FROM ({_SNOW_CELLS}) GROUP BY ALL), v AS ({_SNOW_VALUES}), w AS (SELECT watershed, sum(f) AS area FROM c GROUP BY 1), y AS (SELECT DISTINCT year FROM v WHERE variable = 'swe'),
j AS (SELECT watershed, year, variable, sum(f * CASE WHEN variable = 'swe' THEN least(value, 3000) ELSE value END) / sum(f) AS m, sum(f) AS h FROM c JOIN v USING (cell) GROUP BY ALL)
SELECT w.watershed, y.year::BIGINT AS year, round(a.m, 6) AS swe, round(b.m, 6) AS doy, round(coalesce(a.h, 0) / area, 6) AS cover FROM w CROSS JOIN y LEFT JOIN j a ON a.watershed = w.watershed AND a.year = y.year AND a.variable = 'swe' LEFT JOIN j b ON b.watershed = w.watershed AND b.year = y.year AND b.variable = 'doy'""",
    ),
    "registered_sources": (
        _registered,
        f"WITH {_MONTHLY} SELECT id AS segment, month, round(q / 1000, 4) AS q, 'routed' AS source FROM monthly UNION ALL SELECT id, month, round(q / 1000 * 2, 4), 'balance' FROM monthly",
    ),
    "routed_years": (
        _routed_years,
        """WITH s AS (SELECT n_nationkey AS subid, n_regionkey AS r, coalesce(avg(c_acctbal::DOUBLE), 0) / 100 AS b FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY ALL), d AS (SELECT s.*, x::DATE AS date FROM s, range(DATE '1995-01-01', DATE '1997-01-01', INTERVAL 1 DAY) t(x)),
q AS (SELECT subid AS segment, date, (b - day(date) * 2) * (0.25 + subid % 4 / 4) AS q FROM d UNION ALL SELECT a.subid, d.date, d.b + month(d.date) * 10 FROM s a JOIN d ON d.r = a.r AND d.subid < a.subid)
SELECT segment, date, round(greatest(sum(q), 0), 3) AS q FROM q GROUP BY ALL""",
    ),
    "degree_days": (
        _degree_days,
        f"""WITH {_DAILY}, k AS (SELECT date, sum(q) % 17 - 6 + 8 * sin(dayofyear(date) / 58 - 1.5) AS t FROM daily WHERE (month(date) <> 8 OR year(date) <> 1995) AND month(date) BETWEEN 3 AND 11 GROUP BY date),
y AS (SELECT year(date) AS year, count(*) AS n_days FROM k GROUP BY 1), days AS (SELECT year, unnest(range(make_date(year, 3, 1)::TIMESTAMP, make_date(year, 12, 1)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date FROM y),
w AS (SELECT a.year, a.date, CASE WHEN count(*) = 7 THEN avg(t) END AS m FROM days a JOIN k ON k.date BETWEEN a.date AND a.date + 6 GROUP BY ALL),
f AS (SELECT year, min(date) FILTER (m > 2) AS f FROM w GROUP BY 1), e AS (SELECT f.year, f.f, coalesce(min(w.date), make_date(f.year, 12, 1)) AS e FROM f LEFT JOIN w ON w.year = f.year AND w.date > f.f AND w.m < -2 GROUP BY f.year, f.f),
s AS (SELECT e.year, sum(t) FILTER (d.date >= f AND d.date < e) AS s, bool_or(t IS NULL AND ((d.date >= f AND d.date < e) OR (d.date < f AND f - d.date <= 7))) AS cut FROM e JOIN days d USING (year) LEFT JOIN k ON k.date = d.date GROUP BY 1)
SELECT 'all' AS station, year, CASE WHEN f IS NULL THEN 0 WHEN NOT coalesce(cut, false) THEN round(s, 6) END AS value, n_days FROM y LEFT JOIN e USING (year) LEFT JOIN s USING (year)""",
    ),
}

QUERIES = {name: query for name, (query, _) in PAIRS.items()}
ORACLES = {name: sql for name, (_, sql) in PAIRS.items() if sql}
