import math

import pytest
from pyspark.sql import functions as F

from freshet.functions.columns import COMMON_DAYS, normal_tail
from freshet.operators import balance, extension, models, network


def bins(spark, change=lambda rows: rows):
    rows = [(s, m + 1, d + 1, 7 if (m, d) == (1, 28) else 30, 1.0, 2.0) for s in (1, 2) for m, n in enumerate(COMMON_DAYS) for d in range(n + (m == 1))]
    return spark.createDataFrame(change(rows), "subid int, month int, day int, n_days int, q_local double, q_acc double")


def test_whole_bins_pass_and_others_are_refused(spark):
    assert network.check_bins(bins(spark), ["q_local", "q_acc"]).count() == 732
    bad = {
        "366 calendar days": [lambda r: r[1:], lambda r: r + r[:1], lambda r: [(1, 2, 30, *r[0][3:])] + r[1:], lambda r: [(*r[0][:5], None)] + r[1:]],
        "differ": [lambda r: [(*r[0][:3], 31, *r[0][4:])] + r[1:], lambda r: [(*x[:3], 0 if x[1:3] == (1, 1) else x[3], *x[4:]) for x in r]],
    }
    for why, changes in bad.items():
        for change in changes:
            with pytest.raises(ValueError, match=why):
                network.check_bins(bins(spark, change), ["q_local", "q_acc"])


def test_a_bin_twice_or_null_is_refused_when_read(spark):
    assert network.fold_leap_day(bins(spark), ["q_local"]).count() == 730
    with pytest.raises(Exception, match="repeats"):
        network.fold_leap_day(bins(spark, lambda r: r + r[:1]), ["q_local"]).collect()
    with pytest.raises(Exception, match="null"):
        network.fold_leap_day(bins(spark, lambda r: [(*r[0][:4], None, 1.0)] + r[1:]), ["q_local"]).collect()


def test_a_sub_basin_without_days_is_refused(spark):
    days = spark.createDataFrame([(1, 1, 1.0, 2.0)], "subid int, day int, q_local double, q_acc double")
    weights = lambda up: spark.createDataFrame([(9, 1, 0.5, up)], "segment int, subid int, share double, upstream_subids array<int>")
    assert network.route(days, weights([]), ["day"]).first()["q"] == 0.5
    with pytest.raises(Exception, match="sub-basin 2"):
        network.route(days, weights([2]), ["day"]).collect()


def test_negative_flows_and_bad_bounds_are_refused(spark):
    rows = lambda r, b, own=True: spark.createDataFrame([(r, b, own)], "routed double, balance double, own_line boolean")
    assert network.pick_source(rows(0.0, None)).first()["pick"] == "routed"
    for bad in (rows(-1.0, 2.0), rows(1.0, -2.0), rows(1.0, 2.0, None)):
        with pytest.raises(Exception, match="negative|own_line"):
            network.pick_source(bad).collect()
    for low in (-0.1, 1.0):
        with pytest.raises(ValueError):
            network.pick_source(rows(1.0, 1.0), low)


def test_dense_grid_refuses_repeats_and_foreign_times(spark):
    values = lambda *months: spark.createDataFrame([("s", 1, m, 1.0) for m in months] + [("other", 1, 99, 1.0)], "source string, id int, month int, q double")
    grid = lambda v: network.dense_grid(v, ["s"], v.select("id"), range(1, 13)).collect()
    assert len(grid(values(3))) == 12
    for bad, why in ((values(3, 3), "more than one"), (values(13), "time base: 13")):
        with pytest.raises(Exception, match=why):
            grid(bad)


def test_a_year_twice_is_refused(spark):
    years = spark.createDataFrame([("a", 2000 + i, float(i + 1)) for i in range(6)] + [("a", 2000, 9.0)], "station string, year int, value double")
    weights = spark.createDataFrame([("t", "a", 1.0)], "target string, donor string, weight double")
    with pytest.raises(Exception, match="more than one value"):
        models.carry_departures(years, weights, (2000, 2005), 3).collect()
    with pytest.raises(Exception, match="more than one value"):
        models.trend_significance(years).collect()
    target, donor = years.selectExpr("station as target", "'q' as variable", "'p' as period", "year", "value"), years.where("value < 9").selectExpr("'d' as donor", "'q' as variable", "'p' as period", "year", "value")
    chain = spark.createDataFrame([("a", "d", 1.0)], "target string, donor string, distance double")
    with pytest.raises(Exception, match="more than one value"):
        extension.extend(target, donor, chain).collect()


def test_normal_tail(spark):
    got = spark.createDataFrame([(z / 4,) for z in range(-20, 21)], "z double").select("z", normal_tail(F.col("z")).alias("p")).collect()
    assert all(abs(r["p"] - math.erfc(abs(r["z"]) / math.sqrt(2))) < 2e-7 for r in got)


def test_implied_shape_at_its_ends(spark):
    rows = spark.createDataFrame([(a,) for a in (None, -1.0, 0.0, 0.001, 300.0, 599.999, 600.0, 700.0)], "aet double")
    got = [r[0] for r in rows.select(balance.implied_shape(F.lit(900.0), F.lit(600.0), F.col("aet"))).collect()]
    assert got[:3] == [None, None, None] and got[3] == 1.0 and 1 < got[4] < 2 and got[5] > 20 and got[6:] == [math.inf] * 2


def test_choice_without_groups_keeps_the_incumbent(spark):
    scores = spark.createDataFrame([("a", 10.0, 5.0), ("b", 7.0, 5.5), ("c", 7.5, 5.0)], "aet string, lead double, other double")
    pick = lambda limits: balance.choose_variant(scores, "a", limits, "lead").collect()
    assert [r["aet"] for r in pick({"lead": -2.0, "other": 0.0})] == ["c"]
    assert [r["aet"] for r in pick({"lead": -2.0, "other": 1.0})] == ["b"]
    assert [r["aet"] for r in pick({"lead": -9.0})] == ["a"]
