import numpy as np

from freshet.operators import resampling

BASE, RECENT = (1950, 1979), (1990, 2019)


def frames(spark, change=0.0, noise=0.0):
    draw = np.random.default_rng(3)
    years = [(s, y, float(draw.normal(0, 1) + change * (y >= 1990)), y < 1960) for s in ("a", "b") for y in (*range(1950, 1980), *range(1990, 2020))]
    errors = [(s, float(e)) for s in ("a", "b") for e in noise * draw.normal(size=40)]
    return spark.createDataFrame(years, "station string, year int, value double, extended boolean"), spark.createDataFrame(errors, "station string, r double")


def test_intervals_are_repeatable_and_as_wide_as_theory_says(spark):
    years, errors = frames(spark, change=5.0)
    first = sorted(map(tuple, resampling.change_interval(years, errors, BASE, RECENT, 300).collect()))
    assert first == sorted(map(tuple, resampling.change_interval(years.repartition(3), errors.repartition(2), BASE, RECENT, 300).collect()))
    for _, change, low, high in first:
        assert low < change < high and abs(change - 5) < 1
        # 1.645 standard errors of a difference of two means of thirty on either side
        assert 0.7 < (high - low) / (2 * 1.645 * np.sqrt(2 / 30)) < 1.3
    wide = {r["station"]: r["high"] - r["low"] for r in resampling.change_interval(*frames(spark, 5.0, noise=4.0), BASE, RECENT, 300).collect()}
    assert all(wide[s] > 1.15 * (high - low) for s, _, low, high in first)


def test_coverage_is_near_the_level(spark):
    got = resampling.change_coverage(*frames(spark), BASE, RECENT, simulations=40, draws=60).collect()
    assert len(got) == 2 and all(r["n"] == 40 and 0.7 < r["coverage"] <= 1 for r in got)
    years, errors = frames(spark)
    assert resampling.change_coverage(years, errors.where("station = 'a'"), BASE, RECENT, 3, 5).count() == 1
