import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from freshet.operators import balance, network, series, windows


def days(spark, rows, schema="station string, date date, t double"):
    return spark.createDataFrame(rows, schema)


def year_of(f, year=2021, station="a", skip=()):
    first = dt.date(year, 1, 1)
    return [(station, first + dt.timedelta(i), float(f(i + 1))) for i in range(365) if i + 1 not in skip]


def warm(doy):
    return max(0.0, 13 - abs(doy - 205) / 8)


def season(values, first=60, last=334, start=5.0, end=4.0):
    """Sum from the first warm week to the first cold one after it."""
    week = {d: sum(values[d + k] for k in range(7)) / 7 for d in range(first, last - 5)}
    begin = next((d for d in week if week[d] > start), None)
    if begin is None:
        return 0.0
    stop = next((d for d in week if d > begin and week[d] < end), last + 1)
    return sum(values[d] for d in range(begin, stop))


def test_degree_days_equal_a_plain_loop(spark):
    rows = year_of(warm) + year_of(lambda d: 3.0, station="cold") + year_of(lambda d: 10.0, station="always")
    got = {r["station"]: r for r in series.degree_days(days(spark, rows)).collect()}
    assert got["a"]["value"] == pytest.approx(season({i: warm(i) for i in range(1, 366)})) and got["a"]["n_days"] == 275
    assert got["cold"]["value"] == 0 and got["always"]["value"] == pytest.approx(10.0 * 275)


def test_a_season_cut_by_a_missing_day_has_no_degree_days(spark):
    rows = year_of(warm, skip=(200,)) + year_of(warm, station="before", skip=(20, 62)) + year_of(warm, station="edge", skip=(140,))
    got = {r["station"]: r["value"] for r in series.degree_days(days(spark, rows)).collect()}
    assert got["a"] is None and got["before"] is not None and got["edge"] is None
    assert series.degree_days(days(spark, [])).count() == 0


def test_a_repeated_day_of_a_series_is_refused(spark):
    rows = year_of(warm) + [("a", dt.date(2021, 7, 5), 3.0)]
    with pytest.raises(Exception, match="repeats"):
        windows.window_stats(days(spark, rows), [("jul", "07-01", "07-31")], value="t").collect()


def test_units_of_long_statistics(spark):
    stats = windows.window_stats(days(spark, year_of(warm)), [("jul", "07-01", "07-31")], value="t", threshold=14.0)
    got = {r["variable"]: r["unit"] for r in windows.as_long(stats, unit="degC").collect()}
    assert got["mean"] == got["min7"] == "degC" and got["cov_day"] == "day" and got["frac_below"] == ""


def routed(spark, change):
    rows = change([(1, r[1], 1.0, 2.0) for r in year_of(warm)])
    weights = spark.createDataFrame([(7, 1, 0.5, [1])], "segment int, subid int, share double, upstream_subids array<int>")
    return network.routed_years(spark.createDataFrame(rows, "subid int, date date, q_local double, q_acc double"), weights, 2021, 2021)


def test_routed_years_want_complete_sub_basins(spark):
    assert {r["q"] for r in routed(spark, lambda r: r).collect()} == {2.5} and routed(spark, lambda r: r).count() == 365
    for change, why in ((lambda r: r[1:], "lacking|missing"), (lambda r: r + r[:1], "repeats"), (lambda r: r[1:] + [(1, None, 1.0, 2.0)], "missing"), (lambda r: r[1:] + [(1, r[0][1], None, 2.0)], "missing")):
        with pytest.raises(Exception, match=why):
            routed(spark, change).collect()


def test_a_gate_without_four_errors_refuses(spark):
    rows = spark.createDataFrame([(1.0, 2.0, 3.0, None)], "a double, b double, c double, d double")
    with pytest.raises(Exception, match="not finite"):
        rows.select(balance.gate((F.col("a"), F.col("b")), (F.col("c"), F.col("d")))).collect()


def test_a_covered_row_without_a_value_is_refused(spark):
    ws = spark.createDataFrame([(1, "100", "100", 5.0, 0.5, None)], "id int, w string, l string, area double, cover double, v double")
    with pytest.raises(Exception, match="no v"):
        network.upstream_means(ws, ["v"]).collect()


def test_years_that_are_missing_or_implausible_are_refused(spark):
    with pytest.raises(Exception, match="years are missing"):
        balance.anomaly_means(spark.createDataFrame([("t", 2000, 1.0)], "variable string, year int, value double"), (2000, 2001)).collect()
    with pytest.raises(Exception, match="implausible"):
        balance.masked_mean(spark.createDataFrame([(1, 4000.0)], "pixel int, value double"), 1).collect()
