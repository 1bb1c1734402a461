"""Work that grows with the rows of a key: many rows of few codes, places and stations."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from freshet.operators import fits, models, network, transfer
from freshet.plans import queries


def _tree(spark, copies: int = 40):
    codes = [("100", "100"), ("100", "100.000002"), ("100.000001", "100.000001"), ("100.000003", "100.000003.000001"), ("100.000003", "100.000001.000002"), ("100.000003.000005", "100.000003.000005")]
    rows = [(i * len(codes) + j, w, l, float(1 + (i * 7 + j * 3) % 11)) for i in range(copies) for j, (w, l) in enumerate(codes)]
    return spark.createDataFrame(rows, "id long, w string, l string, area double")


def test_codes_meet_and_not_their_rows(spark):
    few, many = _tree(spark, 2), _tree(spark, 40)
    assert network.code_pairs(many, many).count() == network.code_pairs(few, few).count() < many.select("w", "l").distinct().count() ** 2


def test_counts_upstream_equal_the_pairs_and(spark):
    ws = _tree(spark)
    pairs = network.upstream_pairs(ws).groupBy("id").agg(F.count("*").alias("n_up"), F.sum("id_up").alias("sum_up"))
    got = network.upstream_counts(ws)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pairs.collect()))


def test_related_counts_equal_the_pairs_and(spark):
    ws = _tree(spark).withColumnRenamed("id", "station")
    pairs = transfer.related_gauges(ws).groupBy("station").agg(F.count("*").alias("n"), F.sum("other").alias("others"))
    got = transfer.related_counts(ws)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pairs.collect()))


def test_irregular_counts_equal_the_pairs_and(spark):
    ws = _tree(spark)
    pairs = network.irregular_pairs(ws).groupBy(F.col("id_up").alias("id")).agg(F.count("*").alias("n"))
    got = network.irregular_counts(ws)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pairs.collect()))


def test_folds_of_many_stations_of_a_code(spark):
    ws = _tree(spark, 20).selectExpr("concat(lpad(cast(id % 7 as string), 4, '0'), cast(id as string)) as station", "w", "l", "area")
    got = network.cv_folds(ws)
    up = network.upstream_pairs(ws.withColumnRenamed("station", "id")).where("id <> id_up").collect()
    area = {r["station"]: r["area"] for r in ws.collect()}
    nested = {r["id"] for r in up}
    other = [(r["id"], r["id_up"]) for r in up if r["id"][:4] != r["id_up"][:4]]
    leak = {s: max([min(1.0, area[b] / area[s]) for a, b in other if a == s], default=0.0) for s in area}
    down = {b for _, b in other}
    want = sorted((s, s[:4], "nested" if s in nested else "headwater", leak[s], s in down) for s in area)
    assert sorted(map(tuple, got.collect())) == want


def _years(spark, stations=(1, 3, 97, 205, 1001)):
    rows = [(str(s), 1990 + y, float((s * 7 + y * y * (s % 5)) % 13 + 1)) for s in stations for y in range(8) if (s + y) % 6]
    return spark.createDataFrame(rows + [("7", 1990 + y, 2.5) for y in range(8)], "station string, year int, value double")


def _no_pairs(df) -> bool:
    return "FlatMapGroupsInArrow" in df._jdf.queryExecution().toString()


def test_all_stations_correlate_without_a_row_per_pair_and_year(spark, monkeypatch):
    years = _years(spark)
    held = {}
    for r in years.collect():
        held.setdefault(r["station"], {})[r["year"]] = r["value"]
    want = []
    for a, x in held.items():
        for b, y in held.items():
            at = sorted(set(x) & set(y))
            flat = len(at) < 5 or "7" in (a, b) or "205" in (a, b)  # these two are constant
            want += [(a, b, 0.0 if flat else round(max(float(np.corrcoef([x[i] for i in at], [y[i] for i in at])[0, 1]), 0.0), 9))] if a != b else []
    want.sort()
    for size in (2_000, 2):
        monkeypatch.setattr(models.blocks.dealt, "__defaults__", (size,))
        got = models.donor_correlations(years, 5)
        assert sorted((r["target"], r["donor"], round(r["r"], 9)) for r in got.collect()) == want
        assert _no_pairs(got)


def test_stations_far_apart_carry_each_other(spark, monkeypatch):
    monkeypatch.setattr(models, "CARRIED", 2)
    years = _years(spark)
    one = years.select(F.col("station").alias("target")).distinct()
    weights = one.crossJoin(one.withColumnRenamed("target", "donor")).where("target <> donor and (int(target) + int(donor)) % 4 = 0").selectExpr("target", "donor", "1 / (1 + abs(int(target) - int(donor))) as weight")
    plain = lambda df: sorted((r["target"], r["year"], round(r["log_ratio"], 9), round(r["pct_normal"], 9), r["donors"]) for r in df.collect())
    got = plain(models.carry_from_all(years, queries._carry_weight, (1991, 1995), 3))
    assert got == plain(models.carry_departures(years, weights, (1991, 1995), 3))
    assert any("1001" in r[-1].split(",") for r in got if r[0] in ("3", "7"))


def test_stations_meet_in_a_few_blocks_by_the_years_they_have(spark, monkeypatch):
    sent, deal = [], models.blocks.dealt
    monkeypatch.setattr(models.blocks, "dealt", lambda *a, **k: sent.append(deal(*a, **k)) or sent[-1])
    monkeypatch.setattr(deal, "__defaults__", (2,))
    # groups with all years, with six, with four; some with years that no other has, and two without a value in one or any
    has = lambda s, y: s % 3 == 0 or y not in ((), (2, 5), (0, 1, 6, 7))[s % 3] if s < 225 else (s >> (y % 5)) & 1 or y == s % 8
    value = lambda s, y: None if s == 7 and y == 3 or s == 231 else 2.1 if s % 50 == 3 else 1e6 + (s * 7 + y * y * (s % 5 + 1)) % 13
    held = {str(s): {1990 + y: value(s, y) for y in range(8) if has(s, y)} for s in range(240)}
    years = spark.createDataFrame([(s, y, v) for s, x in held.items() for y, v in x.items()], "station string, year int, value double")
    want = {}
    for a, x in held.items():
        for b, y in held.items():
            at = set(x) & set(y)
            if a == b or not at:
                continue
            p, q = np.array([(x[i], y[i]) for i in sorted(at) if x[i] is not None and y[i] is not None]).reshape(-1, 2).T
            flat = len(at) < 5 or len(p) < 2 or p.max() == p.min() or q.max() == q.min()
            want[a, b] = 0.0 if flat else max(float(np.corrcoef(p, q)[0, 1]), 0.0)
    got = models.donor_correlations(years, 5, 6).collect()
    assert len(got) == len(want) and {(r["target"], r["donor"]) for r in got} == set(want)
    assert all(abs(r["r"] - want[r["target"], r["donor"]]) < 6e-7 and round(r["r"], 6) == r["r"] for r in got)
    assert sent[-1][1] ** 2 < 16 * spark.sparkContext.defaultParallelism


def test_lists_that_differ_in_one_place_are_joined_once(monkeypatch):
    names = sorted(str(i) for i in range(60))
    rng = np.random.default_rng(5)
    for most in (1 << 20, 100):
        monkeypatch.setattr(models, "LISTS", most)
        lists = models._Lists(names)
        for mask in (rng.random(60) < 0.5, np.ones(60, bool), np.arange(60) == 7):
            for own in [None, *range(60)]:
                m = mask.copy()
                if own is not None and own % 3:
                    m[own] = False
                want = ",".join(n for n, x in zip(names, m) if x)
                if want:
                    assert lists(m.copy(), own).decode() == want


def test_donors_are_sent_to_a_few_blocks_however_many_targets(spark, monkeypatch):
    sent, deal = [], models.blocks.dealt
    monkeypatch.setattr(models.blocks, "dealt", lambda *a, **k: sent.append(deal(*a, **k)) or sent[-1])
    monkeypatch.setattr(models, "CARRIED", 1)
    # some lack years, every seventh has no baseline and is a target only, values of 0 count for nothing
    rows = [(str(s), 1990 + y, float((s * 7 + y * y * (s % 5)) % 13)) for s in range(150) for y in range(8) if (s + y) % 6 and (s % 7 or y > 5)]
    years = spark.createDataFrame(rows, "station string, year int, value double")
    one = years.select(F.col("station").alias("target")).distinct()
    weights = one.crossJoin(one.withColumnRenamed("target", "donor")).where("target <> donor and (int(target) + int(donor)) % 4 = 0").selectExpr("target", "donor", "1 / (1 + abs(int(target) - int(donor))) as weight")
    plain = lambda df: sorted((r["target"], r["year"], round(r["log_ratio"], 9), round(r["pct_normal"], 9), r["donors"]) for r in df.collect())
    assert plain(models.carry_from_all(years, queries._carry_weight, (1991, 1995), 3)) == plain(models.carry_departures(years, weights, (1991, 1995), 3))
    assert sent[-1][1] == 4 * spark.sparkContext.defaultParallelism < 150


def test_many_donors_are_all_compared(spark):
    donors = spark.range(100_003).selectExpr("id", "cast(id as double) as a", "cast(id % 7 as double) as value")
    targets = spark.createDataFrame([(1, 100_002.0), (2, None)], "id long, a double")
    assert [tuple(r) for r in models.donor_mean(targets, donors, ["a"], "value").orderBy("id").collect()] == [(1, 100_002 % 7), (2, None)]


def test_places_of_one_point_meet_a_station_once(spark):
    stations = spark.createDataFrame([(i, float(i % 3), 0.0) for i in range(30)], "station long, x double, y double")
    places = spark.createDataFrame([(i, float(i % 4), 1.0) for i in range(400)], "place long, x double, y double")
    want = []
    for i in range(30):
        near = sorted((((i % 3 - j % 4) ** 2 + 1) ** 0.5, j) for j in range(400))
        want += [(i, j, d) for d, j in [n for n in near if n[0] <= 1.2][:3]]
    got = network.nearest_candidates(stations, places, 1.2, 3)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert network.nearest_points(stations, places, 1.2, 3).count() == 3 * 3


def test_ratio_draws_are_made_in_the_tasks(spark):
    years = _years(spark, (1, 2, 3, 4))
    got = fits.ratio_interval(years, (1990, 1993), (1994, 1997), 300)
    assert "Generate" not in got._jdf.queryExecution().toString()
    held = {}
    for r in years.orderBy("year").collect():
        held.setdefault(r["station"], ([], []))[r["year"] > 1993].append(r["value"])

    def mean(s, values, name, draw):
        u = [int(hashlib.md5(f"{s}:{name}:{draw}:{i}".encode()).hexdigest()[:13], 16) / 2**52 for i in range(1, len(values) + 1)]
        return sum(values[int(x * len(values))] for x in u) / len(values)

    want = []
    for s, (a, b) in held.items():
        r = [mean(s, b, "recent", d) / mean(s, a, "base", d) for d in range(1, 301)]
        want.append((s, *(round(float(x), 9) for x in (np.mean(b) / np.mean(a), np.quantile(r, 0.05), np.quantile(r, 0.95)))))
    assert sorted((r["station"], *(round(r[c], 9) for c in ("ratio", "low", "high"))) for r in got.collect()) == sorted(want)
