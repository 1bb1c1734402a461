import numpy as np
import pytest

from freshet.functions.columns import COMMON_DAYS
from freshet.operators import shapes

MONTH = np.repeat(np.arange(12), COMMON_DAYS)
LENGTHS = np.asarray(COMMON_DAYS, float)[MONTH]


def within(q):
    total = np.zeros(12)
    np.add.at(total, MONTH, q)
    return q / total[MONTH]


def test_spline_is_smooth_periodic_and_passes_the_middles():
    b = shapes.spline_matrix()
    assert np.allclose(b.sum(1), 1)
    q = np.random.default_rng(2).uniform(1, 9, 12)
    y = np.tile(b @ q, 3)
    # third differences of a cubic piece are constant, so they change at most near the twelve knots
    third = np.diff(y, 3)
    assert (np.abs(np.diff(third)) > 1e-6).sum() <= 3 * 12 * 4
    # slopes and curvatures do not jump, over the turn of the year neither
    assert np.abs(np.diff(y, 2)).max() < 0.05 and np.abs(third).max() < 0.01
    # the middle of April is a day, so the spline takes the month's mean there
    assert np.isclose((b @ q)[int(sum(COMMON_DAYS[:3]) + 15.5) - 1 : int(sum(COMMON_DAYS[:3]) + 15.5) + 1].mean(), q[3], atol=0.05)
    middles = np.cumsum(COMMON_DAYS) - np.asarray(COMMON_DAYS) / 2 + 0.5
    for m in range(12):
        if middles[m] == int(middles[m]):
            assert np.isclose((b @ q)[int(middles[m]) - 1], q[m])


def test_spline_shape_on_rows(spark):
    q = np.random.default_rng(3).uniform(0, 9, (2, 12))
    q[1] = [0, 0, 0, 0, 0, 9, 0, 0, 0, 0, 0, 0]
    rows = [(i, m + 1, float(q[i, m])) for i in range(2) for m in range(12)] + [(2, 1, 5.0), (0, 0, 99.0)]
    got = {(r["id"], r["doy"]): r for r in shapes.spline_shape(spark.createDataFrame(rows, "id long, month int, q double")).collect()}
    assert len(got) == 730
    for i in range(2):
        y = np.maximum(shapes.spline_matrix() @ q[i], 0)
        total = np.zeros(12)
        np.add.at(total, MONTH, y)
        want = np.where(total[MONTH] > 0, y / np.where(total == 0, 1, total)[MONTH], 1 / LENGTHS)
        assert np.allclose([got[i, d + 1]["weight"] for d in range(365)], want)
    even = shapes.flat_shape(spark.range(1)).collect()
    assert len(even) == 365 and np.isclose(sum(r["weight"] for r in even), 12)


def gauges(n=60, seed=4):
    draw = np.random.default_rng(seed)
    elev, east = draw.uniform(200, 2000, n), draw.uniform(0, 300, n)
    days = np.arange(1, 366)
    q = np.exp(-0.5 * ((days - 120 - elev[:, None] / 30) / (25 + east[:, None] / 20)) ** 2) + 0.05 + 0.02 * draw.uniform(size=(n, 365))
    return elev, east, np.array([within(x) for x in q])


def test_basis_equals_svd_and_least_squares(spark):
    elev, east, w = gauges()
    frame = spark.createDataFrame([(i, float(elev[i]), float(east[i]), w[i].tolist()) for i in range(len(w))], "id long, elev double, east double, weights array<double>").repartition(5)
    fit = shapes.fit_basis(frame, ["elev", "east"], 4)
    y = w * LENGTHS
    _, s, vt = np.linalg.svd(y - y.mean(0), full_matrices=False)
    assert np.allclose(fit.singular, s[:4], rtol=1e-8) and np.allclose(fit.centre, y.mean(0))
    v = vt[:4].T
    v = v * np.sign(v[np.abs(v).argmax(0), np.arange(4)])
    assert np.allclose(fit.components, v, atol=1e-7)
    x = np.column_stack([np.ones(len(w)), elev, east])
    assert np.allclose(fit.coefficients, np.linalg.lstsq(x, (y - y.mean(0)) @ v, rcond=None)[0], atol=1e-7)
    new = spark.createDataFrame([(7, 900.0, 120.0), (8, None, 1.0)], "id long, elev double, east double")
    got = {r["doy"]: r["weight"] for r in shapes.predict_basis(fit, new).collect()}
    q = np.maximum(y.mean(0) + v @ (np.array([1, 900.0, 120.0]) @ fit.coefficients), 0) / LENGTHS
    assert len(got) == 365 and np.allclose([got[d + 1] for d in range(365)], within(q))
    assert "Exchange" not in shapes.scores(fit, new, ["id"])._jdf.queryExecution().executedPlan().toString()


def test_basis_refuses_what_it_cannot_fit(spark):
    elev, east, w = gauges(8)
    rows = [(i, float(elev[i]), 1.0, w[i].tolist()) for i in range(8)]
    frame = spark.createDataFrame(rows, "id long, elev double, east double, weights array<double>")
    with pytest.raises(ValueError, match="constant"):
        shapes.fit_basis(frame, ["elev", "east"])
    with pytest.raises(ValueError, match="lack"):
        shapes.fit_basis(frame.unionByName(spark.createDataFrame([(9, None, 1.0, w[0].tolist())], frame.schema)), ["elev"])
    with pytest.raises(ValueError, match="no more gauges"):
        shapes.fit_basis(frame.limit(2), ["elev"])
    # three gauges span two components only
    assert shapes.fit_basis(frame.limit(3), ["elev"]).components.shape == (365, 2)
