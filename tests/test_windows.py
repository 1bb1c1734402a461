from datetime import date, timedelta

import pytest

from freshet.operators import windows

JAN = [("w", "01-01", "01-10")]


def series(spark, values, first=date(2001, 1, 1)):
    rows = [("a", first + timedelta(i), v) for i, v in enumerate(values) if v is not None]
    return spark.createDataFrame(rows, "station string, date date, q double")


#: Twelve days that add up to 64.
TWELVE = [4.0, 9.0, 2.0, 7.0, 7.0, 1.0, 8.0, 3.0, 6.0, 5.0, 10.0, 2.0]
FIRST_TWELVE = [("start", "01-01", "01-12")]


def test_statistics_of_twelve_days(spark):
    r = windows.window_stats(series(spark, TWELVE), FIRST_TWELVE, threshold=4.0).first()
    # seven days add up to 38, 37, 34, 37, 40 and 35; half of 64 is passed on the seventh day
    assert (r["min"], r["max"], r["cov_day"], r["n_days"]) == (1, 10, 7, 12)
    assert (r["mean"], r["min7"], r["frac_below"]) == pytest.approx((64 / 12, 34 / 7, 4 / 12))


def test_a_gap_leaves_one_run_of_seven_days_and_no_cov_day(spark):
    r = windows.window_stats(series(spark, [*TWELVE[:4], None, *TWELVE[5:]]), FIRST_TWELVE, threshold=4.0).first()
    assert (r["min7"], r["n_days"], r["cov_day"]) == (5, 11, None) and r["frac_below"] == pytest.approx(4 / 11)


def test_a_window_over_new_year_has_the_year_of_its_start(spark):
    daily = series(spark, [1.0] * 800, date(1999, 12, 1))
    rows = {(r["period"], r["year"]): r["n_days"] for r in windows.window_stats(daily, [("djf", "12-01", "02-29")]).collect()}
    assert rows == {("djf", 1999): 91, ("djf", 2000): 90}


def test_windows_are_checked():
    for bad in ([("a", "02-29", "03-01")], [("a", "13-01", "03-01")], [("a", "01-01", "01-02"), ("a", "02-01", "02-02")]):
        with pytest.raises(ValueError):
            windows.check_windows(bad)


def test_empty_input_keeps_columns(spark):
    out = windows.window_stats(series(spark, []), JAN)
    assert out.count() == 0 and "cov_day" in out.columns
