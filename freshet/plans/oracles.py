"""What each query returns, as DuckDB SQL over the same tables, written apart from the operators."""

from __future__ import annotations

_DAILY = "daily AS (SELECT l_returnflag AS station, l_shipdate::DATE AS date, sum(l_quantity)::DOUBLE AS q FROM lineitem GROUP BY ALL)"
_SPARSE = "sparse AS (SELECT l_suppkey::VARCHAR AS station, l_shipdate::DATE AS date, sum(l_quantity)::DOUBLE AS q FROM lineitem GROUP BY ALL)"
_YEARLY = "yearly AS (SELECT l_suppkey::VARCHAR AS station, year(l_shipdate)::BIGINT AS year, avg(l_quantity)::DOUBLE AS value FROM lineitem GROUP BY ALL)"
_MONTHLY = "monthly AS (SELECT c_nationkey AS id, month(o_orderdate)::BIGINT AS month, avg(o_totalprice) AS q FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"
_READINGS = "readings AS (SELECT (user_id % 5)::VARCHAR AS station, ts, value, event_type IN ('purchase', 'signup') AS final, (-8 + user_id % 5) * 3600 AS offset_s FROM events)"
_SOURCES = """sources AS (SELECT l_partkey AS id, (sum(l_quantity) FILTER (l_returnflag = 'A'))::DOUBLE AS routed,
  (sum(l_quantity) FILTER (l_returnflag = 'R'))::DOUBLE * (1 + l_partkey % 9) AS balance, p_size % 5 <> 0 AS own_line FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_partkey, p_size),
picked AS (SELECT *, CASE WHEN routed IS NULL THEN CASE WHEN balance IS NULL THEN NULL ELSE 'balance' END
  WHEN balance IS NOT NULL AND routed < 0.2 * balance AND own_line THEN 'balance' ELSE 'routed' END AS pick FROM sources)"""
_BINS = """bins AS (SELECT c_nationkey AS subid, month(o_orderdate)::BIGINT AS month, day(o_orderdate)::BIGINT AS day, CASE WHEN month(any_value(o_orderdate)) = 2 AND day(any_value(o_orderdate)) = 29 THEN 7 ELSE 30 END AS n_days,
  avg(o_totalprice) / 1000 - 120 AS q_local, avg(o_totalprice) / 100 AS q_acc FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
folded AS (SELECT subid, month, CASE WHEN month = 2 AND day = 29 THEN 28 ELSE day END AS d, sum(n_days)::BIGINT AS n_days,
  sum(q_local * n_days) / sum(n_days) AS q_local, sum(q_acc * n_days) / sum(n_days) AS q_acc FROM bins GROUP BY ALL)"""
_TREE = """tree0 AS (SELECT c_custkey AS id, '100.' || lpad((c_nationkey % 5 + 1)::VARCHAR, 6, '0') || '.' || lpad((c_nationkey + 1)::VARCHAR, 6, '0') AS w FROM customer),
tree AS (SELECT id, w, CASE WHEN id % 97 = 0 THEN '100.000003.000005.000002' WHEN id % 40 = 0 THEN w WHEN id % 7 = 0 THEN w || '.' || lpad((id % 40)::VARCHAR, 6, '0') || '.000002' ELSE w || '.' || lpad((id % 40)::VARCHAR, 6, '0') END AS l,
  (id % 50 + 1)::DOUBLE AS area, CASE WHEN id % 11 <> 0 THEN (id % 23)::DOUBLE END AS v FROM tree0
  UNION ALL SELECT 1000000 + r_regionkey, '100.' || lpad((r_regionkey + 1)::VARCHAR, 6, '0'), '100.' || lpad((r_regionkey + 1)::VARCHAR, 6, '0'), 10, 1 FROM region
  UNION ALL SELECT 2000000 + r_regionkey, '100', '100.' || lpad((r_regionkey + 1)::VARCHAR, 6, '0'), 3, NULL FROM region)"""


def _under(a: str, b: str) -> str:
    return f"({a} = {b} OR starts_with({a}, {b} || '.'))"


def _up(a: str, b: str) -> str:
    """The pairwise predicate, as defined."""
    w, lo, w2, l2 = f"{a}.w", f"{a}.l", f"{b}.w", f"{b}.l"
    return f"""({_under(w2, w)} AND CASE WHEN {w} = {lo} THEN {_under(l2, w)}
      ELSE ({w2} > {lo} AND NOT {_under(w2, lo)} AND {_under(l2, w)} AND {l2} > {lo}) OR ({w2} = {w} AND {l2} >= {lo}) END)"""


_PAIRS = f"{_TREE}, pairs AS (SELECT a.id, b.id AS id_up, b.area, b.v FROM tree a JOIN tree b ON {_up('a', 'b')})"
_WINDOWS = "wins AS (SELECT * FROM (VALUES ('jul', '07-01', '07-31'), ('djf', '12-01', '02-29'), ('jja', '06-01', '08-31'), ('feb', '02-01', '02-29')) t(period, s, e))"


def _window_stats(source: str, min_frac: float) -> str:
    """Builds every window-year of the calendar first and looks its days up: the other way round than the operator."""
    return f"""{_WINDOWS},
span AS (SELECT station, min(date) AS first, max(date) AS last FROM {source} GROUP BY station),
years AS (SELECT station, first, last, unnest(range(year(first) - 1, year(last) + 1)) AS year FROM span),
spans AS (SELECT station, period, year, make_date(year, s[1:2]::INT, s[4:5]::INT) AS a,
  CASE WHEN e = '02-29' THEN last_day(make_date(year + (e < s)::INT, 2, 1)) ELSE make_date(year + (e < s)::INT, e[1:2]::INT, e[4:5]::INT) END AS b, first, last FROM years, wins),
inside AS (SELECT * FROM spans WHERE a >= first AND b <= last),
days AS (SELECT i.station, period, year, b - a + 1 AS length, date - a + 1 AS n, d.* EXCLUDE (station) FROM inside i JOIN {source} d ON d.station = i.station AND d.date BETWEEN a AND b),
more AS (SELECT *, CASE WHEN count(*) OVER w7 = 7 THEN avg(q) OVER w7 END AS m7, sum(q) OVER (PARTITION BY station, period, year ORDER BY n) AS run, sum(q) OVER (PARTITION BY station, period, year) AS total
  FROM days WINDOW w7 AS (PARTITION BY station, period, year ORDER BY n RANGE BETWEEN 6 PRECEDING AND CURRENT ROW)),
stats AS (SELECT station, period, year::BIGINT AS year, count(*) AS n_days, round(avg(q), 6) AS mean, min(q) AS min, max(q) AS max, round(min(m7), 6) AS min7, round(avg((q < 50)::INT), 6) AS frac_below,
  CASE WHEN count(*) = any_value(length) THEN min(n) FILTER (total > 0 AND run >= total / 2) END::BIGINT AS cov_day FROM more GROUP BY station, period, year HAVING count(*) >= {min_frac} * any_value(length))"""


_DOY = f"""{_DAILY},
folded AS (SELECT station, year(date) AS y, dayofyear(date) - (dayofyear(date) >= 60 AND dayofyear(make_date(year(date), 12, 31)) = 366)::INT AS doy, avg(q) AS q FROM daily GROUP BY ALL),
seen AS (SELECT station, doy::BIGINT AS doy, avg(q) AS q FROM folded GROUP BY ALL),
rounds AS (SELECT station, doy + 365 * k AS nth, q FROM seen, (VALUES (-1), (0), (1)) v(k)),
grid AS (SELECT station, unnest(range(1, 366)) AS doy FROM (SELECT DISTINCT station FROM seen)),
doy AS (SELECT g.station, g.doy, CASE WHEN a.nth = b.nth THEN a.q ELSE a.q + (b.q - a.q) * (g.doy - a.nth) / (b.nth - a.nth) END AS q
  FROM grid g ASOF JOIN rounds a ON a.station = g.station AND a.nth <= g.doy ASOF JOIN rounds b ON b.station = g.station AND b.nth >= g.doy)"""
_DOY_MONTH = "month(make_date(2001, 1, 1) + (doy - 1)::INT)::BIGINT"
_COMPLETE = lambda source, n: f"full_months AS (SELECT station, year(date)::BIGINT AS year, month(date) AS m FROM {source} GROUP BY ALL HAVING count(*) >= {n}), complete AS (SELECT station, year FROM full_months GROUP BY ALL HAVING count(*) = 12)"
_RECORD = f"""{_SPARSE}, arc AS (SELECT * FROM sparse WHERE date < '1999-01-01' AND dayofyear(date) % 9 <> 0),
prov AS (SELECT * FROM sparse WHERE date BETWEEN '1998-06-01' AND '2000-05-31'), rt AS (SELECT * FROM sparse WHERE date >= '2000-01-01' AND month(date) <> 6),
r1 AS (SELECT *, 'archive' AS source FROM arc UNION ALL SELECT p.*, 'provisional' FROM prov p WHERE NOT EXISTS (SELECT 1 FROM arc a WHERE a.station = p.station AND a.date >= p.date)),
record AS (SELECT * FROM r1 UNION ALL SELECT t.*, 'realtime' FROM rt t WHERE NOT EXISTS (SELECT 1 FROM r1 a WHERE a.station = t.station AND a.date >= t.date))"""
_VALID = f"{_MONTHLY}, val AS (SELECT id % 5 AS grp, id, month, q AS obs, CASE WHEN (id + month) % 13 <> 0 THEN q * (0.7 + ((id * 7 + month * 3) % 11) / 16.0::DOUBLE) END AS mod FROM monthly)"


def _skill(by: str, low: float) -> str:
    group = f"GROUP BY {by}" if by else ""
    return f"""WITH {_VALID}, e AS (SELECT *, CASE WHEN obs >= {low} AND mod IS NOT NULL THEN 100 * (mod - obs) / obs END AS e, CASE WHEN obs >= {low} AND mod IS NOT NULL THEN ln(mod / obs) END AS g FROM val)
SELECT {by + ', ' if by else ''} count(e) AS n, count(*) FILTER (obs < {low}) AS left_out, count(*) FILTER (mod IS NULL) AS no_model, round(avg(e), 6) AS mean_error, round(median(e), 6) AS median_error, round(avg(abs(e)), 6) AS mae,
  round(avg(CASE WHEN e IS NOT NULL THEN (abs(e) <= 20)::INT END), 6) AS within_20, round(median(g), 6) AS median_log, round(stddev_samp(g), 6) AS sd_log FROM e {group}"""


def _extend(method: str) -> str:
    f = "ln(value)" if method != "ratio" else "value"
    back = "exp" if method != "ratio" else ""
    fit = {
        "ratio": "avg(y) / avg(x) AS b, 0 AS a",
        "move1": "CASE WHEN coalesce(corr(y, x), 0) < 0 THEN -1 ELSE 1 END * stddev_samp(y) / nullif(stddev_samp(x), 0) AS b, avg(y) - CASE WHEN coalesce(corr(y, x), 0) < 0 THEN -1 ELSE 1 END * stddev_samp(y) / nullif(stddev_samp(x), 0) * avg(x) AS a",
        "ols": "regr_slope(y, x) AS b, regr_intercept(y, x) AS a",
    }[method]
    return f"""WITH {_YEARLY}, short AS (SELECT station, year, {f} AS v FROM yearly WHERE (station::INT % 3 <> 0 OR year BETWEEN 1996 AND 1999) AND value > 0),
chain AS (SELECT t.station AS target, d.station AS donor, abs(t.station::INT - d.station::INT) * 100000 + d.station::INT AS rank FROM (SELECT DISTINCT station FROM yearly) t, (SELECT DISTINCT station FROM yearly) d WHERE t.station::INT % 3 = 0 AND d.station::INT % 3 <> 0 AND abs(t.station::INT - d.station::INT) <= 40),
shared AS (SELECT c.*, t.v AS y, d.v AS x FROM chain c JOIN short t ON t.station = target JOIN short d ON d.station = donor AND d.year = t.year),
own AS (SELECT station AS target, count(*) AS k FROM short GROUP BY station),
fits AS (SELECT * FROM (SELECT target, donor, rank, count(*) AS n, {fit} FROM shared GROUP BY target, donor, rank) JOIN own USING (target) WHERE n >= 3 AND n = k),
made AS (SELECT target, d.year, {back}(a + b * d.v) AS value, donor, row_number() OVER (PARTITION BY target, d.year ORDER BY rank) AS i FROM fits JOIN short d ON d.station = donor
  WHERE NOT EXISTS (SELECT 1 FROM short s WHERE s.station = target AND s.year = d.year))
SELECT target, year, round(value, 6) AS value, donor FROM made WHERE i = 1"""


ORACLES = {
    "window_stats": f"WITH {_DAILY}, {_window_stats('daily', 0.8)} SELECT *, NULL::DOUBLE AS frac_ice, NULL::DOUBLE AS frac_provisional FROM stats",
    "window_stats_sparse": f"WITH {_SPARSE}, {_window_stats('sparse', 0.2)} SELECT *, NULL::DOUBLE AS frac_ice, NULL::DOUBLE AS frac_provisional FROM stats",
    "window_stats_long": f"""WITH {_DAILY}, {_window_stats('daily', 0.8)}, long AS (
  SELECT station, 'q_mean' AS variable, period, year, mean AS value, 'percent' AS anomaly_type, n_days FROM stats UNION ALL SELECT station, 'q_min', period, year, min, 'percent', n_days FROM stats
  UNION ALL SELECT station, 'q_max', period, year, max, 'percent', n_days FROM stats UNION ALL SELECT station, 'q_min7', period, year, min7, 'percent', n_days FROM stats
  UNION ALL SELECT station, 'q_frac_below', period, year, frac_below, 'absolute', n_days FROM stats UNION ALL SELECT station, 'q_cov_day', period, year, cov_day::DOUBLE, 'absolute', n_days FROM stats)
SELECT * FROM long WHERE value IS NOT NULL""",
    "window_fraction_flags": f"WITH {_DAILY}, {_window_stats('daily', 0.8)} SELECT station, period, year::BIGINT AS year, round(avg((q % 3 = 0)::INT), 6) AS frac_ice, round(avg((year(date) >= 2000)::INT), 6) AS frac_provisional FROM more GROUP BY ALL HAVING count(*) >= 0.8 * any_value(length)",
    "flow_window_monthly": f"""WITH {_MONTHLY}, need AS (SELECT * FROM (VALUES ('jul', 7, 31), ('djf', 12, 31), ('djf', 1, 31), ('djf', 2, 28), ('jja', 6, 30), ('jja', 7, 31), ('jja', 8, 31), ('feb', 2, 28)) t(period, month, n)),
ids AS (SELECT DISTINCT id FROM monthly)
SELECT ids.id, period, CASE WHEN count(q) = count(*) THEN round(sum(q * n) / sum(n), 4) END AS value, 'monthly' AS basis FROM ids CROSS JOIN need LEFT JOIN monthly USING (id, month) GROUP BY ALL""",
    "flow_window_daily": f"""WITH {_DOY}, mon AS (SELECT *, {_DOY_MONTH} AS m FROM doy), w AS (SELECT * FROM (VALUES ('jul', [7]), ('djf', [12, 1, 2]), ('jja', [6, 7, 8]), ('feb', [2])) t(period, ms))
SELECT station, period, round(avg(q), 6) AS value, 'daily' AS basis FROM mon JOIN w ON list_contains(ms, m) GROUP BY ALL""",
    "station_doy": f"WITH {_DOY} SELECT station, doy, round(q, 8) AS q, round(q / sum(q) OVER (PARTITION BY station), 8) AS share FROM doy",
    "readings_to_days": f"""WITH {_READINGS}, hours AS (SELECT station, floor((epoch(ts) // 1 + offset_s) / 3600)::BIGINT AS h, avg(value) AS m, min(value) AS lo, max(value) AS hi, bool_and(final) AS f FROM readings WHERE value BETWEEN -1 AND 60 GROUP BY ALL)
SELECT station, DATE '1970-01-01' + floor(h / 24)::INT AS date, round(avg(m), 6) AS t_mean, min(lo) AS t_min, max(hi) AS t_max, count(*) AS n_hours, CASE WHEN bool_and(f) THEN 'approved' ELSE 'provisional' END AS status FROM hours GROUP BY 1, 2 HAVING count(*) >= 12""",
    "unpivot_daily": f"WITH {_DAILY} SELECT * FROM daily",
    "complete_years": f"WITH {_SPARSE}, {_COMPLETE('sparse', 5)} SELECT * FROM complete",
    "station_select": f"WITH {_SPARSE}, {_COMPLETE('sparse', 3)} SELECT station, count(*) AS n_years FROM complete JOIN supplier ON station = s_suppkey::VARCHAR WHERE s_suppkey % 7 = 0 AND s_nationkey % 2 = 0 GROUP BY station HAVING count(*) >= 2",
    "station_monthly": f"""WITH {_DAILY}, {_COMPLETE('daily', 20)}, ym AS (SELECT station, year(date) AS y, month(date)::BIGINT AS month, avg(q) AS q FROM daily SEMI JOIN complete ON complete.station = daily.station AND complete.year = year(date) GROUP BY ALL),
m0 AS (SELECT station, month, avg(q) AS q FROM ym GROUP BY ALL),
m AS (SELECT *, q * CASE WHEN month = 2 THEN 28.25 WHEN month IN (4, 6, 9, 11) THEN 30 ELSE 31 END::DOUBLE AS vol FROM m0)
SELECT station, month, round(q, 6) AS q, round(vol / sum(vol) OVER (PARTITION BY station), 6) AS share FROM m UNION ALL SELECT station, 0, round(sum(vol) / 365.25, 6), 1 FROM m GROUP BY station""",
    "annual_from_months": f"WITH {_MONTHLY} SELECT id, 0::BIGINT AS month, CASE WHEN count(q) = 12 THEN round(avg(q), 4) END AS q FROM monthly GROUP BY id",
    "annual_mean_total": f"WITH {_DAILY}, y AS (SELECT station, year(date) AS y, sum(q) AS t FROM daily GROUP BY ALL HAVING count(*) = dayofyear(make_date(year(any_value(date)), 12, 31))) SELECT station, round(avg(t), 6) AS mean_total, count(*) AS n_years FROM y GROUP BY station",
    "joined_daily_record": f"WITH {_RECORD} SELECT station, date, q, source FROM record",
    "record_gaps": f"WITH {_RECORD}, s AS (SELECT station, lag(date) OVER w AS last_day, date AS next_day, source, lag(source) OVER w AS before FROM record WINDOW w AS (PARTITION BY station ORDER BY date)) SELECT station, last_day, next_day, source FROM s WHERE source <> before AND next_day - last_day > 1",
    "year_runs": f"WITH {_SPARSE}, {_COMPLETE('sparse', 4)}, g AS (SELECT *, year - row_number() OVER (PARTITION BY station ORDER BY year) AS k FROM complete) SELECT station, min(year) AS first_year, max(year) AS last_year, count(*) AS n FROM g GROUP BY station, k",
    "year_blocks": f"WITH {_DAILY}, {_COMPLETE('daily', 20)}, g AS (SELECT *, year - row_number() OVER (PARTITION BY station ORDER BY year) AS k FROM complete), b AS (SELECT *, (row_number() OVER (PARTITION BY station, k ORDER BY year) - 1) // 2 AS i FROM g) SELECT station, min(year) AS first_year, max(year) AS last_year, count(*) AS n FROM b GROUP BY station, k, i HAVING count(*) = 2",
    "hour_of_extreme": f"WITH {_READINGS} SELECT station, ts::DATE AS day, min(hour(ts)) FILTER (value = hi)::BIGINT AS hour_max, min(hour(ts)) FILTER (value = lo)::BIGINT AS hour_min FROM (SELECT *, max(value) OVER (PARTITION BY station, ts::DATE) AS hi, min(value) OVER (PARTITION BY station, ts::DATE) AS lo FROM readings) GROUP BY ALL",
    "dedup_first_file": "SELECT l_orderkey, l_linenumber, min(l_partkey * 1000000 + l_suppkey) AS file FROM lineitem GROUP BY ALL",
    "arg_max_attrs": "SELECT user_id AS station, arg_max(event_type, ts) AS last_kind, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY user_id",
    "junk_histogram": "SELECT value, count(*) AS n FROM events GROUP BY value ORDER BY n DESC, value LIMIT 8",
    "dense_grid": f"WITH {_MONTHLY}, kept AS (SELECT 'balance' AS source, * FROM monthly WHERE (id + month) % 5 <> 0) SELECT source, id, month, round(q, 4) AS q FROM (SELECT id, source, month FROM (SELECT DISTINCT id FROM monthly), (VALUES ('balance'), ('routed')) s(source), (SELECT unnest(range(1, 13)) AS month)) g LEFT JOIN kept USING (source, id, month)",
    "compare_values": f"WITH {_MONTHLY}, a AS (SELECT * FROM monthly WHERE id <> 3), b AS (SELECT id, month, CASE WHEN month = id % 12 + 1 THEN q + 10 ELSE q END AS r FROM monthly WHERE id <> 4) SELECT count(*) FILTER (r IS NULL) AS only_a, count(*) FILTER (q IS NULL) AS only_b, count(*) FILTER (q IS NOT NULL AND r IS NOT NULL) AS compared, count(*) FILTER (abs(q - r) > 1e-9 * greatest(abs(q), abs(r))) AS differing, round(max(abs(q - r)), 3) AS max_abs_diff FROM a FULL JOIN b USING (id, month)",
    "source_pick": f"WITH {_SOURCES} SELECT * FROM picked",
    "segment_tally": f"""WITH {_SOURCES} SELECT own_line, count(*) FILTER (routed IS NOT NULL AND balance IS NOT NULL) AS "both", count(*) FILTER (routed IS NOT NULL AND balance IS NULL) AS routed_only, count(*) FILTER (routed IS NULL AND balance IS NOT NULL) AS balance_only,
  count(*) FILTER (routed IS NULL AND balance IS NULL) AS neither, count(*) FILTER (pick = 'routed') AS picked_routed, count(*) FILTER (pick = 'balance') AS picked_balance FROM picked GROUP BY own_line""",
    "route_fold_366": f"WITH {_BINS} SELECT subid, month, d AS day, n_days, round(q_local, 9) AS q_local, round(q_acc, 9) AS q_acc FROM folded",
    "route_days": f"""WITH {_BINS}, raw AS (SELECT subid AS segment, month, d, q_local * (0.25 + subid % 4 / 4.0::DOUBLE) AS q FROM folded
  UNION ALL SELECT a.n_nationkey, month, d, q_acc FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND b.n_nationkey < a.n_nationkey JOIN folded ON subid = b.n_nationkey)
SELECT segment, month, d AS day, round(greatest(sum(q), 0)::DECIMAL(30, 10), 5)::DOUBLE AS q, sum(q) < 0 AS clamped FROM raw GROUP BY ALL""",
    "route_period_mean": f"WITH {_BINS} SELECT subid, month, round(sum(q_acc * n_days) / sum(n_days), 6) AS q_acc FROM bins GROUP BY ALL",
    "upstream_pairs": f"WITH {_PAIRS} SELECT id, count(*) AS n_up, sum(id_up)::BIGINT AS sum_up FROM pairs GROUP BY id",
    "upstream_sums": f"WITH {_PAIRS} SELECT t.id, coalesce(sum(p.area), 0) AS area FROM tree t LEFT JOIN pairs p USING (id) GROUP BY t.id",
    "upstream_mean_covered": f"WITH {_PAIRS}, s AS (SELECT t.id, coalesce(sum(p.area), 0) AS a, coalesce(sum(p.area) FILTER (p.v IS NOT NULL), 0) AS c, coalesce(sum(p.area * p.v), 0) AS x FROM tree t LEFT JOIN pairs p USING (id) GROUP BY t.id) SELECT id, CASE WHEN c > 0 THEN round(x / c, 6) END AS mean, CASE WHEN a > 0 THEN round(c / a, 6) END AS coverage FROM s",
    "upstream_mean_total": f"WITH {_PAIRS}, s AS (SELECT t.id, coalesce(sum(p.area), 0) AS a, coalesce(sum(p.area) FILTER (p.v IS NOT NULL), 0) AS c, coalesce(sum(p.area * p.v), 0) AS x FROM tree t LEFT JOIN pairs p USING (id) GROUP BY t.id) SELECT id, CASE WHEN c > 0 THEN round(x / a, 6) END AS mean, CASE WHEN a > 0 THEN round(c / a, 6) END AS coverage FROM s",
    "tree_roots": f"WITH {_TREE}, s AS (SELECT DISTINCT w FROM tree WHERE v IS NOT NULL) SELECT w FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE starts_with(s.w, o.w || '.'))",
    "tree_closure": f"WITH {_TREE} SELECT DISTINCT t.id FROM tree t JOIN tree c ON c.id < 20 AND {_under('t.w', 'c.w')}",
    "tree_reach": f"WITH {_TREE} SELECT DISTINCT b.id FROM tree a JOIN tree b ON a.id < 20 AND {_up('a', 'b')}",
    "cv_folds": f"""WITH {_TREE}, s AS (SELECT lpad((id % 37)::VARCHAR, 4, '0') || id AS station, lpad((id % 37)::VARCHAR, 4, '0') AS fold, w, l, area FROM tree)
SELECT s.station, s.fold, CASE WHEN EXISTS (SELECT 1 FROM s b WHERE b.station <> s.station AND {_up('s', 'b')}) THEN 'nested' ELSE 'headwater' END AS nesting, coalesce((SELECT max(least(1, b.area / s.area)) FROM s b WHERE b.fold <> s.fold AND {_up('s', 'b')}), 0) AS leak_up, EXISTS (SELECT 1 FROM s a WHERE a.fold <> s.fold AND {_up('a', 's')}) AS leak_down FROM s""".replace("max(least(1, b.area / s.area))", "round(max(least(1, b.area / s.area)), 6)"),
    "snap_pick": """WITH st AS (SELECT s_suppkey AS station, CASE WHEN s_suppkey % 5 <> 0 THEN 10000 + s_acctbal END AS gross FROM supplier),
c AS (SELECT l_suppkey AS station, l_orderkey * 8 + l_linenumber AS segment, l_extendedprice::DOUBLE AS area, (l_tax * 100)::DOUBLE AS distance FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY CASE WHEN gross IS NULL THEN distance ELSE abs(ln(area / gross)) END, distance, segment) AS i FROM c JOIN st USING (station)),
b AS (SELECT station, segment, CASE WHEN gross IS NULL THEN 'no area' WHEN area / gross BETWEEN 0.9 AND 1.1 THEN 'ok' ELSE 'area differs' END AS reason FROM r WHERE i = 1)
SELECT station, segment, coalesce(reason = 'ok', false) AS accepted, coalesce(reason, 'no candidate') AS reason FROM st LEFT JOIN b USING (station)""",
    "knn_donor_mean": """WITH s AS (SELECT s_suppkey AS id, s_acctbal / 1000 AS a, s_nationkey / 10 AS b, (s_suppkey % 17)::DOUBLE AS value FROM supplier),
d AS (SELECT t.id, o.id AS donor, o.value, sqrt((t.a - o.a) * (t.a - o.a) + (t.b - o.b) * (t.b - o.b)) AS d FROM s t, s o WHERE t.id % 2 = 0 AND o.id % 2 = 1),
m AS (SELECT *, median(d) OVER (PARTITION BY id) AS m, row_number() OVER (PARTITION BY id ORDER BY d, donor) AS i FROM d), n AS (SELECT *, max((d <= 1e-9 * m)::INT) OVER (PARTITION BY id) AS same FROM m WHERE i <= 5)
SELECT id, round(sum(CASE WHEN same = 1 THEN (d <= 1e-9 * m)::INT ELSE 1 / (d + 1e-6 * m) END * value) / sum(CASE WHEN same = 1 THEN (d <= 1e-9 * m)::INT ELSE 1 / (d + 1e-6 * m) END), 6) AS value FROM n GROUP BY id""",
    "donor_correlations": f"WITH {_YEARLY} SELECT a.station AS target, b.station AS donor, CASE WHEN count(*) >= 5 THEN round(greatest(coalesce(corr(a.value, b.value), 0), 0), 6) ELSE 0 END AS r FROM yearly a JOIN yearly b ON a.year = b.year AND a.station <> b.station GROUP BY ALL",
    "departure_carry": f"""WITH {_YEARLY}, n AS (SELECT station, avg(value) AS base FROM yearly WHERE year BETWEEN 1995 AND 1999 AND value > 0 GROUP BY station HAVING count(*) >= 4),
r AS (SELECT station AS donor, year, ln(value / base) AS x FROM yearly JOIN n USING (station) WHERE value > 0),
w AS (SELECT t.station AS target, d.station AS donor, 1.0::DOUBLE / (1 + abs(t.station::INT - d.station::INT)) AS weight FROM (SELECT DISTINCT station FROM yearly) t, (SELECT DISTINCT station FROM yearly) d WHERE t.station <> d.station AND (t.station::INT + d.station::INT) % 4 = 0)
SELECT target, year, round(sum(weight * x) / sum(weight), 6) AS log_ratio, round(100 * exp(sum(weight * x) / sum(weight)), 6) AS pct_normal, string_agg(donor, ',' ORDER BY donor) AS donors FROM w JOIN r USING (donor) GROUP BY target, year""",
    "window_extend_ratio": _extend("ratio"),
    "window_extend_move1": _extend("move1"),
    "window_extend_ols": _extend("ols"),
    "flow_validate": _skill("grp", 140000.0),
    "skill_summary": _skill("", 0.0),
    "nse": f"WITH {_VALID}, m AS (SELECT *, avg(obs) OVER (PARTITION BY id) AS mean FROM val WHERE mod IS NOT NULL) SELECT id, count(*) AS n, round(1 - sum((mod - obs) ** 2) / sum((obs - mean) ** 2), 6) AS nse FROM m GROUP BY id",
    "baseline_anomaly": f"WITH {_YEARLY}, n AS (SELECT station, avg(value) AS normal FROM yearly WHERE year BETWEEN 1995 AND 1999 GROUP BY station HAVING count(*) >= 4) SELECT station, year, round(value, 6) AS value, round(normal, 6) AS normal, round(100 * value / normal, 6) AS pct_normal, round(value - normal, 6) AS anomaly FROM yearly JOIN n USING (station)",
    "trend": f"""WITH {_YEARLY}, p AS (SELECT a.station, median((b.value - a.value) / (b.year - a.year)) AS slope, sum(sign(b.value - a.value))::BIGINT AS s FROM yearly a JOIN yearly b ON a.station = b.station AND a.year < b.year GROUP BY a.station),
t AS (SELECT station, sum(t)::BIGINT AS n, sum(t * (t - 1) * (2 * t + 5)) AS c FROM (SELECT station, value, count(*) AS t FROM yearly GROUP BY ALL) GROUP BY station), v AS (SELECT *, (n * (n - 1) * (2 * n + 5) - c)::DOUBLE / 18 AS var_s FROM p JOIN t USING (station))
SELECT station, n, round(slope, 6) AS slope, s, round(var_s, 6) AS var_s, round(CASE WHEN s > 0 THEN (s - 1) / sqrt(var_s) WHEN s < 0 THEN (s + 1) / sqrt(var_s) ELSE 0 END, 6) AS z FROM v""",
    "share_predict": f"WITH {_MONTHLY}, f AS (SELECT id, month, greatest(q - 140000, 0) AS s FROM monthly) SELECT id, month, round(s / nullif(sum(s) OVER (PARTITION BY id), 0), 6) AS share FROM f",
    "shape_within": f"WITH {_DOY}, m AS (SELECT *, {_DOY_MONTH} AS month FROM doy) SELECT station, month, doy, round(CASE WHEN sum(q) OVER w = 0 THEN 1.0 / count(*) OVER w ELSE q / sum(q) OVER w END, 8) AS weight, sum(q) OVER w = 0 AS flat FROM m WINDOW w AS (PARTITION BY station, month)",
    "shape_daily": f"WITH {_DOY}, m AS (SELECT *, {_DOY_MONTH} AS month FROM doy), w AS (SELECT station, month, doy, q / sum(q) OVER k AS weight, count(*) OVER k AS n FROM m WINDOW k AS (PARTITION BY station, month)), q AS (SELECT station, month(date)::BIGINT AS month, avg(q) AS q FROM daily GROUP BY ALL) SELECT station, doy, round(q.q * n * weight, 6) AS q FROM w JOIN q USING (station, month)",
    "wb_pooled": """WITH z AS (SELECT p_partkey AS id, p_partkey % 7 / 7.0::DOUBLE AS za, p_size % 11 / 11.0::DOUBLE AS zb, p_partkey % 3 / 3.0::DOUBLE AS zc FROM part), k AS (SELECT id, CASE WHEN za >= zb AND za >= zc THEN 'za' WHEN zb >= zc THEN 'zb' ELSE 'zc' END AS zone FROM z)
SELECT id, CASE WHEN count(*) OVER (PARTITION BY zone) >= 500 THEN zone ELSE 'pooled' END AS zone FROM k""",
    "wb_adjust": "SELECT p_partkey AS id, round(greatest(p_size - 20.0::DOUBLE * (p_partkey % 3 / 3.0::DOUBLE) + 8.5::DOUBLE * CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 7 / 7.0::DOUBLE ELSE 0 END, 0), 6) AS adjusted FROM part",
    "area_mean_cover": "WITH c AS (SELECT p_brand AS polygon, (1 + p_partkey % 4) / 4.0::DOUBLE AS f, CASE WHEN p_partkey % 6 <> 0 THEN (p_partkey % 100)::DOUBLE END AS v FROM part) SELECT polygon, round(sum(f * v) / nullif(sum(f) FILTER (v IS NOT NULL), 0), 6) AS mean, round(coalesce(sum(f) FILTER (v IS NOT NULL), 0) / sum(f), 6) AS cover FROM c GROUP BY polygon",
    "majority_class": "WITH c AS (SELECT p_brand AS polygon, p_size % 6 AS class, sum((1 + p_partkey % 4) / 4.0::DOUBLE) AS f FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY polygon ORDER BY f DESC, class) AS i FROM c) SELECT polygon, class::BIGINT AS class FROM r WHERE i = 1",
    "snow_cap_each_year": f"WITH {_YEARLY} SELECT station, round(avg(least(value, 25.5)), 6) AS value FROM yearly GROUP BY station",
    "snow_cap_mean": f"WITH {_YEARLY} SELECT station, round(least(avg(value), 25.5), 6) AS value FROM yearly GROUP BY station",
    "aet_budyko": "WITH x AS (SELECT p_partkey AS id, (p_partkey % 1500)::DOUBLE AS p, p_size * 20.0::DOUBLE AS e FROM part) SELECT id, round(p + e - pow(pow(p, 2.6) + pow(e, 2.6), 1 / 2.6::DOUBLE), 6) AS aet FROM x",
    "pet_hargreaves": """WITH x AS (SELECT p_partkey AS id, p_size - 25.0::DOUBLE AS lo, p_size - 25.0::DOUBLE + p_partkey % 13 AS hi, radians(50.0::DOUBLE + p_partkey % 10) AS phi, (p_partkey % 365 + 1)::DOUBLE AS j FROM part),
y AS (SELECT *, 1 + 0.033 * cos(2 * pi() * j / 365) AS near, 0.409 * sin(2 * pi() * j / 365 - 1.39) AS tilt FROM x), z AS (SELECT *, acos(greatest(least(-tan(phi) * tan(tilt), 1), -1)) AS ws FROM y)
SELECT id, round(greatest(0.0023 * 0.408 * (24 * 60 / pi() * 0.0820 * near * (ws * sin(phi) * sin(tilt) + cos(phi) * cos(tilt) * sin(ws))) * ((lo + hi) / 2 + 17.8) * sqrt(greatest(hi - lo, 0)), 0), 6) + 0 AS et0 FROM z""",
    "mm_to_m3s": "SELECT p_partkey AS id, round(p_size * (p_partkey * 1e4) / 1000 / (CASE p_partkey % 12 + 1 WHEN 2 THEN 28.25 WHEN 4 THEN 30 WHEN 6 THEN 30 WHEN 9 THEN 30 WHEN 11 THEN 30 ELSE 31 END::DOUBLE * 86400), 6) AS q FROM part",
    "fingerprint": f"WITH {_DAILY} SELECT count(*) AS n_rows, count(DISTINCT station) AS n_ids, count(*) FILTER (q IS NULL) AS n_null, sum(round(q, 6)::DECIMAL(38, 6))::DOUBLE AS total FROM daily",
}
_KEYS = "keys AS (SELECT 'segment_monthly/scenario=historical/forcing=f' || n_regionkey % 2 || '/source=s' || n_nationkey % 3 || '/part-' || CASE WHEN n_nationkey % 4 = 0 THEN 'DRAIN1' ELSE upper(left(n_name || 'XXXX', 4)) END || '.parquet' AS key, md5(n_nationkey::VARCHAR) AS md5, CASE WHEN n_nationkey % 4 = 0 THEN 'DRAIN1' ELSE upper(left(n_name || 'XXXX', 4)) END AS code, 'f' || n_regionkey % 2 AS forcing, 's' || n_nationkey % 3 AS source FROM nation)"
ORACLES |= {
    "catalog_parts": f"WITH {_KEYS} SELECT key, 'segment_monthly' AS dataset, 'historical' AS scenario, forcing, source, code FROM keys",
    "part_pruned_scan": f"WITH {_KEYS} SELECT key, code FROM keys WHERE code IN ('DRAIN1', 'CANA', 'FRAN')",
    "catalog_digest": f"WITH {_KEYS} SELECT md5(string_agg(key || ' ' || md5 || chr(10), '' ORDER BY key || ' ' || md5)) AS digest FROM keys",
}
_ZONES = "zones AS (SELECT p_partkey AS id, p_brand AS fold, p_partkey % 12 + 1 AS month, p_partkey % 7 / 7.0::DOUBLE AS za, CASE WHEN p_size % 13 <> 0 THEN p_size % 11 / 11.0::DOUBLE END AS zb, p_size::DOUBLE AS raw, p_size + p_partkey * 37 % 101 / 10.0::DOUBLE AS obs FROM part)"
_CV = f"""{_ZONES}, folds AS (SELECT DISTINCT fold FROM zones), fit AS (SELECT folds.fold, regr_slope(obs, za) AS b, regr_intercept(obs, za) AS a FROM folds JOIN zones ON zones.fold <> folds.fold GROUP BY folds.fold),
cv AS (SELECT id, fold, obs, a + b * za AS mod FROM zones JOIN fit USING (fold))"""
ORACLES |= {
    "wb_fit": f"WITH {_ZONES}, s AS (SELECT count(*) AS n, sum(za * za) AS aa, sum(za * z) AS ab, sum(z * z) AS bb, sum(za * y) AS ay, sum(z * y) AS zy FROM (SELECT za, coalesce(zb, 0) AS z, obs - raw AS y FROM zones)) SELECT n, round((ay * bb - zy * ab) / (aa * bb - ab * ab), 6) AS b_za, round((zy * aa - ay * ab) / (aa * bb - ab * ab), 6) AS b_zb FROM s",
    "share_fit": f"""WITH {_ZONES}, s AS (SELECT month, count(*) AS n, avg(obs) AS y, avg(za) AS a, avg(zb) AS b, var_samp(za) AS aa, covar_samp(za, zb) AS ab, var_samp(zb) AS bb, covar_samp(obs, za) AS ya, covar_samp(obs, zb) AS yb FROM zones WHERE zb IS NOT NULL GROUP BY month HAVING count(*) > 3),
f AS (SELECT *, (ya * bb - yb * ab) / (aa * bb - ab * ab) AS ba, (yb * aa - ya * ab) / (aa * bb - ab * ab) AS bz FROM s) SELECT month, n, round(y - ba * a - bz * b, 6) AS intercept, round(ba, 6) AS b_za, round(bz, 6) AS b_zb FROM f""",
    "blocked_cv": f"WITH {_CV} SELECT id, fold, round(obs, 6) AS obs, round(mod, 6) AS mod FROM cv",
    "blocked_cv_skill": f"""WITH {_CV}, e AS (SELECT *, CASE WHEN obs >= 1 THEN 100 * (mod - obs) / obs END AS e, CASE WHEN obs >= 1 AND mod > 0 THEN ln(mod / obs) END AS g FROM cv)
SELECT fold, count(e) AS n, count(*) FILTER (obs < 1) AS left_out, 0 AS no_model, round(avg(e), 6) AS mean_error, round(median(e), 6) AS median_error, round(avg(abs(e)), 6) AS mae, round(avg(CASE WHEN e IS NOT NULL THEN (abs(e) <= 20)::INT END), 6) AS within_20, round(median(g), 6) AS median_log, round(stddev_samp(g), 6) AS sd_log FROM e GROUP BY fold""",
    "ratio_bootstrap": f"""WITH {_YEARLY}, part AS (SELECT station, CASE WHEN year <= 1997 THEN 'base' ELSE 'recent' END AS part, year, value FROM yearly WHERE year BETWEEN 1995 AND 2001),
held AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY station, part) AS n FROM part WINDOW w AS (PARTITION BY station, part ORDER BY year)),
slots AS (SELECT station, part, n, unnest(range(1, n + 1)) AS slot FROM (SELECT DISTINCT station, part, n FROM held WHERE n >= 2)),
drawn AS (SELECT station, part, draw, floor(('0x' || substr(md5(station || ':' || part || ':' || draw || ':' || slot), 1, 13))::BIGINT::DOUBLE / 4503599627370496 * n)::BIGINT + 1 AS i FROM slots, (SELECT unnest(range(1, 5001)) AS draw)),
means AS (SELECT d.station, draw, avg(value) FILTER (d.part = 'recent') / avg(value) FILTER (d.part = 'base') AS r FROM drawn d JOIN held USING (station, part, i) GROUP BY d.station, draw HAVING count(DISTINCT d.part) = 2),
whole AS (SELECT station, avg(value) FILTER (part = 'recent') / avg(value) FILTER (part = 'base') AS ratio FROM held GROUP BY station)
SELECT station, round(any_value(ratio), 6) AS ratio, round(quantile_cont(r, 0.05), 6) AS low, round(quantile_cont(r, 0.95), 6) AS high FROM means JOIN whole USING (station) GROUP BY station""",
    "score_set": f"""WITH {_VALID}, m AS (SELECT *, avg(obs) OVER (PARTITION BY id) AS mean FROM val WHERE mod IS NOT NULL)
SELECT id, count(*) AS n, count(*) FILTER (obs <= 0) AS dry, round(corr(obs, mod) ** 2, 6) AS r2, round(avg(abs(mod - obs)), 6) AS mae, round(avg(100 * abs(mod - obs) / obs), 6) AS mape, round(median(100 * abs(mod - obs) / obs), 6) AS median_ape, round(1 - sum((mod - obs) ** 2) / sum((obs - mean) ** 2), 6) AS nse, round(corr(ln(obs), ln(mod)) ** 2, 6) AS r2_log FROM m GROUP BY id""",
    "rank_correlation": f"WITH {_ZONES}, r AS (SELECT a.fold, a.id, (SELECT count(*) FILTER (b.raw < a.raw) + count(*) FILTER (b.raw = a.raw) / 2.0::DOUBLE FROM zones b WHERE b.fold = a.fold) AS x, (SELECT count(*) FILTER (b.obs < a.obs) + count(*) FILTER (b.obs = a.obs) / 2.0::DOUBLE FROM zones b WHERE b.fold = a.fold) AS y FROM zones a) SELECT fold, count(*) AS n, round(corr(x, y), 6) AS rho FROM r GROUP BY fold",
    "coverage_decades": f"WITH {_DAILY}, y AS (SELECT station, year(date) AS y FROM daily GROUP BY ALL HAVING count(*) >= 300), d AS (SELECT station, y // 10 * 10 AS decade FROM y GROUP BY ALL HAVING count(*) >= 3) SELECT decade, count(*) AS n_stations FROM d GROUP BY decade",
    "season_ratios": f"""WITH {_VALID}, p AS (SELECT id, CASE WHEN month IN (12, 1, 2) THEN 'djf' WHEN month <= 5 THEN 'mam' WHEN month <= 8 THEN 'jja' ELSE 'son' END AS season, 100 * sum(mod) / sum(obs) AS p FROM val WHERE mod IS NOT NULL GROUP BY ALL)
SELECT season, count(*) AS n, round(median(p), 6) AS median_pct, round(avg((abs(p - 100) <= 20)::INT), 6) AS share_within FROM p GROUP BY season""",
    "station_space": """WITH c AS (SELECT 6378137.0::DOUBLE AS a, sqrt(2 / 298.257222101::DOUBLE - 1 / 298.257222101::DOUBLE ** 2) AS e),
s AS (SELECT s_suppkey AS station, -139.0::DOUBLE + s_suppkey % 25 AS lon, 48.0::DOUBLE + s_nationkey % 12 AS lat, ln(10.0::DOUBLE + s_suppkey * 3) AS log_area FROM supplier),
k AS (SELECT *, sin(radians(v)) AS sv, cos(radians(v)) / sqrt(1 - e * e * sin(radians(v)) ** 2) AS m, (1 - e * e) * (sin(radians(v)) / (1 - e * e * sin(radians(v)) ** 2) - ln((1 - e * sin(radians(v))) / (1 + e * sin(radians(v)))) / (2 * e)) AS q FROM c, (VALUES ('1', 50.0::DOUBLE), ('2', 58.5), ('0', 45.0)) t(name, v)),
w AS (SELECT any_value(a) AS a, any_value(e) AS e, max(m) FILTER (name = '1') AS m1, max(m) FILTER (name = '2') AS m2, max(q) FILTER (name = '1') AS q1, max(q) FILTER (name = '2') AS q2, max(q) FILTER (name = '0') AS q0 FROM k),
n AS (SELECT *, (m1 * m1 - m2 * m2) / (q2 - q1) AS n FROM w),
x AS (SELECT station, log_area, n, a, radians(lon + 126) * n AS t, a * sqrt(m1 * m1 + n * q1 - n * q0) / n AS r0, a * sqrt(m1 * m1 + n * q1 - n * (1 - e * e) * (sin(radians(lat)) / (1 - e * e * sin(radians(lat)) ** 2) - ln((1 - e * sin(radians(lat))) / (1 + e * sin(radians(lat)))) / (2 * e))) / n AS r FROM s, n),
y AS (SELECT station, (1000000 + r * sin(t)) / 1000 AS e_km, (r0 - r * cos(t)) / 1000 AS n_km, log_area FROM x)
SELECT station, round(e_km / stddev_samp(e_km) OVER (), 6) AS e_km, round(n_km / stddev_samp(n_km) OVER (), 6) AS n_km, round(log_area / stddev_samp(log_area) OVER (), 6) AS log_area FROM y""",
}
