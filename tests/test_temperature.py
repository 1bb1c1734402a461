from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from freshet.operators import temperature

BEGUN = date(2011, 1, 1)


def simulated(seed, loadings=(1, 1, 1, 0), years=3):
    """Stations under one air temperature with a shared signal that air does not carry: a1 0.5, a2 0.15, a3 0.2."""
    draw = np.random.default_rng(seed)
    n = 365 * years
    days = [BEGUN + timedelta(i) for i in range(n)]
    weather, noise = np.zeros(n), draw.normal(0, 2, n)
    for i in range(1, n):
        weather[i] = 0.6 * weather[i - 1] + noise[i]
    air = 5 - 12 * np.cos(2 * np.pi * (np.arange(n) - 20) / 365) + weather
    shared = draw.normal(0, 0.6, n)
    rows = []
    for k, load in enumerate(loadings):
        own, t = draw.normal(0, 0.25, n), max(0, (0.5 + 0.15 * air[0]) / 0.2)
        for i in range(n):
            if i:
                t = max(0, 0.8 * t + 0.5 + 0.15 * air[i] + load * shared[i] + own[i])
            rows.append((f"s{k}", days[i], t))
    temp = pd.DataFrame(rows, columns=["station", "date", "t_mean_c"])
    airs = pd.DataFrame([(f"s{k}", d, "tmean", a) for k in range(len(loadings)) for d, a in zip(days, air)], columns=["id", "date", "variable", "value"])
    return temp, airs


def hidden(temp, station, low, high):
    return (temp["station"] == station) & (temp["date"] >= low) & (temp["date"] <= high)


def test_parameters_are_recovered_and_gaps_filled(spark):
    temp, air = simulated(1)
    temp = temp.assign(n_hours=24, source="logger", status="final", t_min_c=temp["t_mean_c"] - 1)
    gap = hidden(temp, "s0", date(2012, 6, 1), date(2012, 8, 31))
    known, airs = spark.createDataFrame(temp[~gap]), spark.createDataFrame(pd.concat([air, air.assign(variable="tmax", value=99.0)]))
    fit = {r["station"]: r for r in temperature.fits(temperature.estimates(known, airs)).collect()}
    assert sorted(fit) == ["s0", "s1", "s2", "s3"]
    for r in fit.values():
        assert abs(r["a3"] - 0.2) < 0.05 and abs(r["a2"] - 0.15) < 0.04
        assert abs((r["a1"] + r["a2"] * 15) / r["a3"] - (0.5 + 0.15 * 15) / 0.2) < 0.03 * 13.75
    assert all(1 < fit[f"s{k}"]["b"] < 2 for k in range(3)) and abs(fit["s3"]["b"]) < 0.1
    out = temperature.fill(known, airs).toPandas().sort_values(["station", "date"])
    assert len(out) == len(temp) and out["filled"].sum() == gap.sum()
    seen = out[~out["filled"]].drop(columns=["filled", "t_lo_c", "t_hi_c"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(seen[temp.columns], temp[~gap].reset_index(drop=True), check_dtype=False)
    made = out[out["filled"]]
    assert set(made["station"]) == {"s0"} and (made["n_hours"] == 0).all() and (made["source"] == "air2stream").all() and (made["status"] == "provisional").all() and made["t_min_c"].isna().all()
    assert ((made["t_lo_c"] <= made["t_mean_c"]) & (made["t_mean_c"] <= made["t_hi_c"])).all()
    # the fill meets both ends of the gap, and is least sure in its middle
    own = out[out["station"] == "s0"].reset_index(drop=True)
    at = own.index[own["filled"]]
    usual = np.quantile(np.abs(np.diff(temp[temp["station"] == "s0"]["t_mean_c"])), 0.95)
    assert abs(own["t_mean_c"][at[0]] - own["t_mean_c"][at[0] - 1]) < usual and abs(own["t_mean_c"][at[-1] + 1] - own["t_mean_c"][at[-1]]) < usual
    wide = (own["t_hi_c"] - own["t_lo_c"])[at].to_numpy()
    assert wide[0] < wide[len(wide) // 2] > wide[-1]
    # peers help, and a fill can be filled again
    truth = temp[gap]["t_mean_c"].to_numpy()
    lone = temperature.fill(known.where("station = 's0'"), airs).where("filled").toPandas().sort_values("date")
    error = lambda x: np.sqrt(np.mean((x["t_mean_c"].to_numpy() - truth) ** 2))
    assert error(made) < 0.8 * error(lone)
    again = temperature.fill(spark.createDataFrame(out), airs).where("filled").toPandas().sort_values("date")
    np.testing.assert_allclose(again["t_mean_c"], made["t_mean_c"], atol=1e-6)


def test_intervals_cover_their_level(spark):
    temps, airs, pools = [], [], []
    for seed in range(3, 11):
        temp, air = simulated(seed)
        temps.append(temp.assign(station=f"{seed}-" + temp["station"]))
        airs.append(air.assign(id=f"{seed}-" + air["id"]))
        pools += [(f"{seed}-s{k}", seed) for k in range(4)]
    temp = pd.concat(temps)
    summer = temp["station"].str.endswith("s0") & (temp["date"] >= date(2012, 4, 1)) & (temp["date"] <= date(2012, 10, 31))
    spring = temp["station"].str.endswith("s3") & (temp["date"] >= date(2013, 3, 1)) & (temp["date"] <= date(2013, 6, 30))
    gap = summer | spring
    out = temperature.fill(spark.createDataFrame(temp[~gap]), spark.createDataFrame(pd.concat(airs)), spark.createDataFrame(pools, "station string, pool long")).where("filled").toPandas()
    both = temp[gap].merge(out, on=["station", "date"], suffixes=("", "_made"))
    assert len(both) == gap.sum()
    hit = (both["t_mean_c"] >= both["t_lo_c"]) & (both["t_mean_c"] <= both["t_hi_c"])
    assert 0.85 < hit.mean() < 0.995


def test_short_stations_holes_in_air_and_edges(spark):
    temp, air = simulated(5, (1, 1, 1))
    short = temp[(temp["station"] != "s1") | (temp["date"] < date(2011, 3, 1))]
    gap = hidden(short, "s0", date(2012, 6, 1), date(2012, 6, 30))
    # three days of air are interpolated, a longer hole stops its station; air ends before the record
    cut = air[~((air["date"] >= date(2012, 6, 10)) & (air["date"] <= date(2012, 6, 12))) & (air["date"] <= date(2013, 11, 30))]
    cut = cut[~((cut["id"] == "s2") & (cut["date"] >= date(2013, 2, 1)) & (cut["date"] <= date(2013, 2, 4)))]
    pool = spark.createDataFrame([("s0", "x"), ("s1", "y"), ("s2", "x")], "station string, pool string")
    frame, airs = spark.createDataFrame(short[~gap]), spark.createDataFrame(cut)
    out = temperature.fill(frame, airs, pool).toPandas()
    assert len(out) == len(short) and set(out[out["filled"]]["station"]) == {"s0"} and out["t_mean_c"].notna().all()
    fit = temperature.fits(temperature.estimates(frame, airs, pool)).collect()
    assert [(r["station"], r["b"]) for r in fit] == [("s0", 0.0)]
    # days before the record, and winters at the floor
    late = frame.where("station = 's0' and date >= '2011-06-01'")
    early = temperature.fill(late, airs, first=date(2011, 1, 10), last=date(2012, 12, 31)).where("filled").toPandas()
    assert early["date"].min() == date(2011, 1, 10) and (early["t_lo_c"] >= 0).all() and len(early) == 142 + 30
    assert temperature.fill(frame.where("1 = 0"), airs).collect() == []
    with pytest.raises(Exception, match="more than one row"):
        temperature.fill(frame.unionByName(frame.limit(1)), airs).collect()
    with pytest.raises(Exception, match="no pool for"):
        temperature.fill(frame, airs, pool.where("station <> 's0'")).collect()
    for bad in ({"min_days": 5}, {"level": 1.0}, {"obs_sd": 0.0}, {"first": date(2012, 1, 1), "last": date(2011, 1, 1)}):
        with pytest.raises(ValueError):
            temperature.fill(frame, airs, **bad)


def test_a_stuck_sensor_fills(spark):
    temp, air = simulated(6, (1,))
    temp["t_mean_c"] = 4.0
    gap = hidden(temp, "s0", date(2012, 7, 10), date(2012, 7, 16))
    out = temperature.fill(spark.createDataFrame(temp[~gap]), spark.createDataFrame(air)).where(F.col("filled")).toPandas()
    assert len(out) == 7 and np.allclose(out["t_mean_c"], 4, atol=0.05) and out[["t_lo_c", "t_hi_c"]].notna().all().all()
