import math
import re

import numpy as np
import pytest

from freshet.operators import extension


def test_t_quantiles():
    # tables of Student's t
    for p, df, want in [(0.95, 1, 6.313752), (0.975, 2, 4.302653), (0.95, 10, 1.812461), (0.975, 30, 2.042272), (0.995, 5, 4.032143), (0.95, 200, 1.652508)]:
        assert abs(extension.t_quantile(p, df) - want) < 1e-6
    assert extension.t_quantile(0.05, 7) == -extension.t_quantile(0.95, 7)


def test_series_beyond_the_table(spark):
    got = spark.createDataFrame([(0,), (1,), (200,), (201,), (5000,)], "df long").select(extension.t_quantiles(0.95, extension.F.col("df")).alias("t")).collect()
    assert got[0]["t"] is None and abs(got[3]["t"] - extension.t_quantile(0.95, 201)) < 1e-9 and abs(got[4]["t"] - extension.t_quantile(0.95, 5000)) < 1e-9


def frames(spark, seed=1):
    draw = np.random.default_rng(seed)
    years = range(1960, 1990)
    rows = []
    for d, n in (("a", 30), ("b", 30), ("c", 12)):
        for v in ("q_mean", "q_cov_day"):
            for y in list(years)[:n]:
                rows.append((d, v, "spring", y, float(np.exp(draw.normal(3, 0.4))) if v == "q_mean" else float(draw.normal(120, 9))))
    rows = [r for r in rows if (r[0], r[3]) != ("a", 1985)]
    table = {(r[0], r[1], r[3]): r[4] for r in rows}
    own = [("t", v, "spring", y, (0.5 * table["a", v, y] ** 1.1 * math.exp(draw.normal(0, 0.05))) if v == "q_mean" else table["a", v, y] - 3 + draw.normal()) for v in ("q_mean", "q_cov_day") for y in range(1964, 1972)]
    own += [("t", "q_mean", "spring", 1950, 0.0), ("t", "q_mean", "spring", 1951, None), ("u", "q_mean", "spring", 1960, 1.0), ("u", "q_mean", "spring", 1961, 2.0), ("w", "q_mean", "spring", 1900, 1.0), ("w", "q_mean", "spring", 1901, 2.0), ("w", "q_mean", "spring", 1902, 4.0)]
    chain = [(t, d, x) for t in "tuw" for d, x in (("a", 2.0), ("b", 3.0), ("c", 1.0))]
    shape = "string, variable string, period string, year int, value double"
    return table, own, spark.createDataFrame(own, "target " + shape), spark.createDataFrame(rows, "donor " + shape), spark.createDataFrame(chain, "target string, donor string, distance double")


@pytest.mark.parametrize("method", extension.METHODS)
def test_extend_equals_fits_by_hand(spark, method):
    table, own, targets, donors, chain = frames(spark)
    got = extension.extend(targets, donors, chain, method, residuals=(-0.2, 0.3)).collect()
    by = {(r["target"], r["variable"], r["year"]): r for r in got}
    for v in ("q_mean", "q_cov_day"):
        ahead, back = (np.log, np.exp) if v == "q_mean" else (np.asarray, np.asarray)
        ys = {y: x for t, w, _, y, x in own if t == "t" and w == v and x}
        # the nearest donor c covers 1964 to 1971, but has years to 1971 only; a lacks 1985, which comes from b
        for y in range(1960, 1990):
            r = by["t", v, y]
            if y in ys:
                assert (r["source"], r["value"], r["lower"], r["donor"]) == ("observed", ys[y], ys[y], None)
                continue
            donor = "c" if y < 1972 else "b" if y == 1985 else "a"
            assert (r["source"], r["donor"]) == ("extended", donor)
            x0 = np.array([table[donor, v, z] for z in ys])
            y0 = np.array(list(ys.values()))
            x, z, new = ahead(x0), ahead(y0), float(ahead(table[donor, v, y]))
            sxx, sxy, syy = ((x - x.mean()) ** 2).sum(), ((x - x.mean()) * (z - z.mean())).sum(), ((z - z.mean()) ** 2).sum()
            if method == "ols":
                b = sxy / sxx
                guess = z.mean() + b * (new - x.mean())
                s = math.sqrt(((z - z.mean() - b * (x - x.mean())) ** 2).sum() / (len(x) - 2))
                half = extension.t_quantile(0.95, len(x) - 2) * s * math.sqrt(1 + 1 / len(x) + (new - x.mean()) ** 2 / sxx)
                low, high = guess - half, guess + half
            else:
                guess = z.mean() + np.sign(sxy) * math.sqrt(syy / sxx) * (new - x.mean()) if method == "move1" else float(ahead(table[donor, v, y] * y0.mean() / x0.mean()))
                low, high = guess - 0.2, guess + 0.3
            assert np.allclose([r["value"], r["lower"], r["upper"]], back(np.array([guess, low, high])))
    assert ("u", "q_mean", 1970) not in by and ("w", "q_mean", 1970) not in by and ("w", "q_mean", 1900) in by


def test_report_counts_what_is_dropped(spark):
    _, _, targets, donors, chain = frames(spark)
    got = {(r["target"], r["variable"]): tuple(r)[3:] for r in extension.report(targets, donors, chain).collect()}
    assert got == {("t", "q_mean"): (8, 1, 3, None), ("t", "q_cov_day"): (8, 0, 3, None), ("u", "q_mean"): (2, 0, 3, "too few years"), ("w", "q_mean"): (3, 0, 0, "no donor has every year")}


@pytest.mark.parametrize("groups", [1, 2, 7])
def test_quantiles_of_others_equal_numpy(spark, groups):
    draw = np.random.default_rng(groups)
    rows = [(p, int(g), float(round(draw.normal(), 1))) for p in ("x", "y") for g in draw.integers(0, groups, 90)] + [("x", 0, None)]
    got = extension.quantiles_of_others(spark.createDataFrame(rows, "p string, g int, v double"), "g", "v", (0.05, 0.5, 0.95), ["p"]).collect()
    assert len(got) == len({r[:2] for r in rows})
    for r in got:
        others = [v for p, g, v in rows if p == r["p"] and g != r["g"] and v is not None]
        want = np.quantile(others, (0.05, 0.5, 0.95)) if others else [None] * 3
        assert list(r[2:]) == pytest.approx(list(want))


def test_blocks_and_pseudo_records(spark):
    draw = np.random.default_rng(5)
    base = {y: draw.normal(3, 0.5) for y in range(1970, 1990)}
    rows = [(s, "q", "all", y, float(np.exp(base[y] + draw.normal(0, 0.1)))) for s in "abcd" for y in base if not (s == "b" and y == 1977)]
    values = spark.createDataFrame(rows, "station string, variable string, period string, year int, value double")
    got = {(r["station"], r["block"]) for r in extension.blocks(values).select("station", "block").distinct().collect()}
    assert got == {*((s, b) for s in "acd" for b in (1970, 1975, 1980, 1985)), ("b", 1970), ("b", 1978), ("b", 1983)}
    chain = spark.createDataFrame([(s, d, float(abs(ord(s) - ord(d)))) for s in "abcd" for d in "abcd" if s != d], "target string, donor string, distance double")
    pseudo = extension.pseudo_records(values, chain)
    held = pseudo.collect()
    assert len(held) == sum(1 for s, b in got for (t, _, _, y, _) in rows if t == s and not b <= y < b + 5)
    # a block's estimates are those of a record that has just its years
    one = values.where("station = 'b' and year between 1978 and 1982").withColumnRenamed("station", "target")
    want = {r["year"]: r["value"] for r in extension.extend(one, values.withColumnRenamed("station", "donor"), chain, "move1").where("source = 'extended'").collect()}
    assert {r["year"]: r["move1"] for r in held if (r["station"], r["block"]) == ("b", 1978)} == pytest.approx({y: v for y, v in want.items() if y != 1977})
    scores = extension.pseudo_scores(pseudo).collect()
    assert len(scores) == 4 and all(r["ols"] > 0.7 and r["move1"] > 0.7 for r in scores)
    cover = {r["method"]: r["coverage"] for r in extension.pseudo_coverage(pseudo).collect()}
    assert set(cover) == set(extension.METHODS) and all(0.7 < c <= 1 for c in cover.values())
    r = np.array([x["r_ratio"] for x in held])
    s = np.array([x["station"] for x in held])
    inside = [np.quantile(r[s != a], 0.05) <= x <= np.quantile(r[s != a], 0.95) for a, x in zip(s, r)]
    assert cover["ratio"] == pytest.approx(np.mean(inside))


def test_pseudo_records_send_a_donor_once_and_equal_extended_records(spark):
    draw = np.random.default_rng(8)
    rows = []
    for s in "abcdefg":
        for v in ("q_mean", "q_cov_day"):
            for y in range(1980, 1996):
                value = 5.0 if s == "c" and y < 1988 else float(draw.uniform(-1 if v == "q_cov_day" else 0.5, 9))
                rows += [(s, v, "all", y, None if draw.random() < 0.04 else 0.0 if v == "q_mean" and draw.random() < 0.02 else value)] if draw.random() < 0.95 else []
    values = spark.createDataFrame(rows, "station string, variable string, period string, year int, value double")
    chain = spark.createDataFrame([(s, d, float(abs(ord(s) - ord(d)))) for s in "abcdefg" for d in "abcdefg"], "target string, donor string, distance double")
    got = extension.pseudo_records(values, chain, 3, k=2, min_held=1)
    # a join of a record's years for each method took dozens of shuffles
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 12
    blocks = extension.blocks(values.where("value > 0 or (variable = 'q_cov_day' and value is not null)"), 3)
    short = blocks.join(values, ["station", "variable", "period", "year"]).selectExpr("concat(station, '@', block) as target", "variable", "period", "year", "value")
    each = blocks.select("station", "block").distinct().join(chain.where("target <> donor").withColumnRenamed("target", "station"), "station").selectExpr("concat(station, '@', block) as target", "donor", "distance")
    truth = {(s, v, y) for s, v, _, y, x in rows if x is not None and (x > 0 or v == "q_cov_day")}
    want = {}
    for m in extension.METHODS:
        for r in extension.extend(short, values.withColumnRenamed("station", "donor"), each, m, k=2).where("source = 'extended'").collect():
            s, b = r["target"].split("@")
            if (s, r["variable"], r["year"]) in truth:
                want.setdefault((s, int(b), r["variable"], r["year"]), {})[m] = (r["value"], r["lower"], r["upper"]) if m == "ols" else r["value"]
    want = {at: [w["ols"][0], w["move1"], w["ratio"], *w["ols"][1:]] for at, w in want.items() if len(w) == 3}
    held = {(r["station"], r["block"], r["variable"], r["year"]): [r[c] for c in ("ols", "move1", "ratio", "lower", "upper")] for r in got.collect()}
    assert held.keys() == want.keys() and len(held) > 100
    for at in held:
        assert held[at] == pytest.approx(want[at], rel=1e-6, abs=1e-9), at
    twice = values.unionByName(values.where("station = 'a' and year = 1985"))
    with pytest.raises(Exception, match="more than one value"):
        extension.pseudo_records(twice, chain, 3).count()


def test_ranks_do_not_deal_rows_by_group_alone(spark):
    rows = spark.range(2_000_000).selectExpr("id % 2 as p", "id % 1000 as g", "cast(hash(id) as double) as v")
    plan = extension.ordered_rank(rows, ["p"], "v", ["g"], "r")._jdf.queryExecution().executedPlan().toString()
    # two groups would be two tasks
    assert not re.search(r"SortMergeJoin \[p#\d+L?\],", plan)
    assert len(re.findall(r"SortMergeJoin \[p#\d+L?, _range#", plan)) == 1


def test_quantiles_of_others_beside_infinite_values(spark):
    inf = float("inf")
    rows = [("x", g, v) for g, v in [(0, 5.0), (1, 1.0), (1, inf), (2, inf), (2, 2.0), (None, 3.0)]] + [("y", 7, 1.0), ("y", 7, 2.0)]
    got = {(r["p"], r["g"]): r["q_1"] for r in extension.quantiles_of_others(spark.createDataFrame(rows, "p string, g int, v double"), "g", "v", (0.75,), ["p"]).collect()}
    # the median's neighbours are one place, the other has no share
    assert got == {("x", 0): inf, ("x", 1): inf, ("x", 2): inf, ("x", None): None, ("y", 7): None}


def test_coverage_of_all_methods_equals_numpy_and_ranks_once(spark, monkeypatch):
    draw = np.random.default_rng(3)
    rows = [(f"s{int(s)}", v, "all", 0.0, float(draw.normal()), 0.5, *map(float, draw.normal(size=2))) for v in ("a", "b") for s in draw.integers(0, 6, 120)]
    pseudo = spark.createDataFrame(rows, "station string, variable string, period string, lower double, value double, upper double, r_move1 double, r_ratio double")
    tables, write = [], extension.settled
    monkeypatch.setattr(extension, "settled", lambda df, name: tables.append(name) or write(df, name))
    got = {(r["variable"], r["method"]): (r["n"], r["coverage"]) for r in extension.pseudo_coverage(pseudo, level=0.8).collect()}
    assert tables.count("ranked") == 1
    for v in ("a", "b"):
        own = [r for r in rows if r[1] == v]
        hits = {"ols": [0 <= r[4] <= 0.5 for r in own]}
        for m, i in (("move1", 6), ("ratio", 7)):
            bounds = {s: np.quantile([r[i] for r in own if r[0] != s], (0.1, 0.9)) for s in {r[0] for r in own}}
            hits[m] = [bounds[r[0]][0] <= r[i] <= bounds[r[0]][1] for r in own]
        for m, h in hits.items():
            assert got[v, m] == (120, pytest.approx(np.mean(h))), (v, m)


def test_pseudo_records_deal_a_donor_before_it_is_many_blocks(spark):
    values = spark.range(400).selectExpr("cast(id % 20 as string) as station", "'q_mean' as variable", "'all' as period", "cast(id div 20 as int) as year", "1D + id % 7 as value")
    chain = spark.range(400).selectExpr("cast(id % 20 as string) as target", "cast(id div 20 as string) as donor", "1D * abs(id % 20 - id div 20) as distance")
    plan = extension.pseudo_records(values, chain, 3)._jdf.queryExecution().executedPlan().toString()
    # a row per donor and block, with the years asked of it, was dealt again
    assert not re.search(r"hashpartitioning\([^)]*block#", plan)
