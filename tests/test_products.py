import numpy as np
import pytest

from freshet.functions.columns import COMMON_DAYS
from freshet.operators import grids, products, selection

MONTH = np.repeat(np.arange(12), COMMON_DAYS)


def test_neighbour_fill_equals_a_loop(spark):
    draw = np.random.default_rng(3)
    grid = draw.normal(size=(2, 14, 11))
    grid[draw.uniform(size=grid.shape) < 0.5] = np.nan
    grid[:, 3:10, 2:9] = np.nan
    inside = draw.uniform(size=grid.shape) < 0.97
    rows = [(int(k), int(x), int(y), float(grid[k, x, y])) for k, x, y in np.argwhere(inside)]
    want, passes = np.where(inside, grid, np.nan), np.zeros(grid.shape, int)
    for turn in range(1, 50):
        gaps = np.isnan(want) & inside
        if not gaps.any():
            break
        now = want.copy()
        for k, x, y in np.argwhere(gaps):
            near = want[k, max(0, x - 1) : x + 2, max(0, y - 1) : y + 2]
            if not np.isnan(near).all():
                now[k, x, y], passes[k, x, y] = np.nanmean(near), turn
        want = now
    got = grids.fill_from_neighbours(spark.createDataFrame(rows, "layer int, x int, y int, value double"), ("layer",)).collect()
    assert len(got) == len(rows) and max(r["fill_pass"] for r in got) == passes.max() > 2
    for r in got:
        at = r["layer"], r["x"], r["y"]
        assert np.isclose(r["value"], want[at]) and r["fill_pass"] == passes[at]


def test_cells_out_of_reach_are_refused(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (1, 0, None), (5, 5, None)], "x int, y int, value double")
    with pytest.raises(ValueError, match="no way"):
        grids.fill_from_neighbours(cells)
    assert grids.fill_from_neighbours(cells.where("x = 0")).collect()[0]["fill_pass"] == 0


def test_nested_choice_equals_fits_per_pair_of_folds(spark):
    draw = np.random.default_rng(8)
    n, folds = 90, ["a", "b", "c", "d", "e"]
    x1, x2, x3 = draw.normal(size=(3, n))
    f = draw.choice(folds, n)
    y = 50 + 5 * x1 + np.where(f == "a", 25, 1) * x2 + draw.normal(0, 2, n)
    variants = {"one": ["x1"], "two": ["x1", "x2"], "three": ["x1", "x2", "x3"]}
    cols = {"x1": x1, "x2": x2, "x3": x3}
    rows = spark.createDataFrame([(i, f[i], float(x1[i]), float(x2[i]), float(x3[i]), float(y[i])) for i in range(n)] + [(n, "a", None, 1.0, 1.0, 1.0)], "id long, fold string, x1 double, x2 double, x3 double, y double")
    predicted, errors = selection.nested_predictions(rows, "y", variants)
    got = {r["id"]: r for r in predicted.collect()}
    inner = {(r["fold"], r["variant"]): r["mae"] for r in errors.collect()}

    def fit(train, test, xs):
        design = np.column_stack([np.ones(n), *[cols[c] for c in xs]])
        return design[test] @ np.linalg.lstsq(design[train], y[train], rcond=None)[0]

    assert len(got) == n
    for out in folds:
        maes = []
        for name, xs in variants.items():
            e = [np.abs(100 * (fit((f != out) & (f != g), f == g, xs) - y[f == g]) / y[f == g]) for g in folds if g != out]
            maes.append(np.concatenate(e).mean())
            assert np.isclose(inner[out, name], maes[-1])
        best = list(variants)[int(np.argmin(maes))]
        want = fit(f != out, f == out, variants[best])
        for i, w in zip(np.flatnonzero(f == out), want):
            assert got[i]["chosen"] == best and np.isclose(got[i]["mod"], w)


def test_a_fold_without_a_fit_keeps_its_rows(spark):
    rows = spark.createDataFrame([(i, "a" if i < 4 else "b", float(i), float(i)) for i in range(6)], "id long, fold string, x double, y double")
    got = {r["id"]: r["mod"] for r in selection.nested_predictions(rows, "y", {"v": ["x"]})[0].collect()}
    assert len(got) == 6 and all(v is None for v in got.values())


def product_tables(spark):
    draw = np.random.default_rng(1)
    weights = draw.uniform(size=(3, 365))
    for w in weights:
        total = np.zeros(12)
        np.add.at(total, MONTH, w)
        w /= total[MONTH]
    months = draw.uniform(1, 9, (3, 12))
    ws = spark.createDataFrame([(i, months[i].tolist(), 1e6 * (i + 1)) for i in range(3)], "id long, months array<double>, area double")
    days = spark.createDataFrame([(i, d + 1, float(weights[i, d])) for i in range(3) for d in range(365)], "id long, doy int, weight double")
    segments = spark.createDataFrame([(10 * i + j, i, 0.5 + j / 10, "1981-2010", j == 0) for i in range(3) for j in range(2)], "segment long, id long, coverage double, period string, pick boolean")
    return weights, months, ws.join(products.day_weights(days), "id"), segments


def test_daily_product_from_bucketed_tables_has_no_shuffle(spark):
    weights, months, ws, segments = product_tables(spark)
    spark.sql("create database if not exists product_test")
    try:
        a = products.bucketed(segments, "product_test.segments", "id", 4)
        b = products.bucketed(ws, "product_test.watersheds", "id", 4)
        limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            out = products.balance_days(a, b)
            plan = out._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        got = {(r["segment"], r["doy"]): r for r in out.collect()}
        assert len(got) == 6 * 365 and out.columns == list(products.SCHEMA)
        for i in range(3):
            q = months[i][MONTH] * np.asarray(COMMON_DAYS)[MONTH] * weights[i]
            assert np.allclose([got[10 * i + 1, d + 1]["q_m3s"] for d in range(365)], q)
            assert np.allclose([got[10 * i + 1, d + 1]["runoff_mm"] for d in range(365)], q * 86.4 / (i + 1))
        want = spark.createDataFrame([(10 * i + j, "balance", m + 1, float(months[i, m])) for i in range(3) for j in range(2) for m in range(12)], "segment long, source string, month int, q double")
        check = products.month_check(out, want).collect()
        assert check[0]["n"] == 72 and check[0]["max_relative"] < 1e-12
    finally:
        spark.sql("drop database product_test cascade")


def test_daily_product_refuses_what_is_not_whole(spark):
    _, _, ws, segments = product_tables(spark)
    lone = segments.unionByName(spark.createDataFrame([(99, 9, 0.1, "p", True)], segments.schema))
    with pytest.raises(Exception, match="segment 99"):
        products.balance_days(lone, ws).collect()
    routed = spark.createDataFrame([(1, d, float(d)) for d in range(1, 366)] + [(2, 1, 1.0)], "segment long, doy int, q double")
    own = spark.createDataFrame([(1, None, "p", True)], "segment long, area double, period string, pick boolean")
    got = products.routed_days(own, routed).collect()
    assert len(got) == 365 and got[0]["runoff_mm"] is None
    with pytest.raises(Exception, match="segment 2"):
        products.routed_days(own.unionByName(spark.createDataFrame([(2, 1.0, "p", True)], own.schema)), routed).collect()
