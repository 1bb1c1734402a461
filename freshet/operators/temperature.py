"""Water temperature filled from air temperature, one state-space model per station.

A station's temperature is an equilibrium part that air drives, S = max(0, (1 - a3) S' + a1 + a2 A), and a departure from it that
persists from day to day and shares the weather of the station's peers. Calendars, air between readings and the peers' mean
errors are DataFrame work; a station's days (some ten thousand in a long record) then go through the model in one grouped map, twice:
alone, which gives the errors that peers share, and with the peers' mean error.
"""

from __future__ import annotations

import math
from datetime import date as Day
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Air readings up to so many days apart are joined by a line.
AIR_STEP = 4
#: Days with a peer error that a loading on peers takes, and standard deviations at which peers' errors are clipped.
PEER_DAYS, CLIP = 180, 4.0
MAX_RHO, LEAST_SIGMA = 0.999, 0.01
_FIT = "a1 double, a2 double, a3 double, rmse_open double, rho double, b double, sigma double, n_obs long, loglik double"


def open_loop(a1: float, a2: float, a3: float, air: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Temperature from air alone, starting in equilibrium, and its derivatives by a1, a2 and a3 (days x 3)."""
    keep, n = 1 - a3, len(air)
    states, slopes = np.empty(n), np.zeros((n, 3))
    s = (a1 + a2 * air[0]) / a3
    d1, d2, d3 = (1 / a3, air[0] / a3, -s / a3) if s > 0 else (0.0, 0.0, 0.0)
    s = max(s, 0.0)
    states[0], slopes[0] = s, (d1, d2, d3)
    rows, values = [], []
    for a in air[1:].tolist():
        t = keep * s + a1 + a2 * a
        if t > 0:
            d1, d2, d3, s = keep * d1 + 1, keep * d2 + a, keep * d3 - s, t
        else:
            d1 = d2 = d3 = s = 0.0
        values.append(s)
        rows.append((d1, d2, d3))
    if rows:
        states[1:], slopes[1:] = values, rows
    return states, slopes


def fit_open_loop(y: np.ndarray, air: np.ndarray) -> tuple[tuple[float, float, float], np.ndarray, float]:
    """(a1, a2, a3), the fitted temperature of every day, and its error on observed days: damped least squares from two time
    constants; a3 stays between 0 and 1 as a logistic."""
    seen = np.isfinite(y)

    def at(p: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, float]:
        a3 = 1 / (1 + math.exp(-min(max(p[2], -30.0), 30.0)))
        states, slopes = open_loop(p[0], p[1], a3, air)
        slopes = slopes[seen] * (1, 1, a3 * (1 - a3))
        miss = y[seen] - states[seen]
        cost = float(miss @ miss)
        return (cost if math.isfinite(cost) else math.inf), miss, slopes, a3

    best = None
    for start in (0.05, 0.15):
        p, damp = np.array([0.5, 0.1, math.log(start / (1 - start))]), 1e-3
        cost, miss, slopes, a3 = at(p)
        for _ in range(80):
            gram, pull = slopes.T @ slopes, slopes.T @ miss
            step = np.linalg.lstsq(gram + damp * np.diag(np.diag(gram) + 1e-9), pull, rcond=None)[0]
            new = at(p + step)
            if new[0] < cost:
                done = cost - new[0] <= 1e-10 * (1 + cost)
                p, damp, (cost, miss, slopes, a3) = p + step, damp / 5, new
                if done:
                    break
            elif damp > 1e8:
                break
            else:
                damp *= 5
        if best is None or cost < best[0]:
            best = (cost, (float(p[0]), float(p[1]), a3))
    a1, a2, a3 = best[1]
    return best[1], open_loop(a1, a2, a3, air)[0], math.sqrt(best[0] / max(1, seen.sum()))


def departures(r: np.ndarray, drive: np.ndarray, rho: float, sigma: float, noise: float, smooth: bool = False):
    """Log likelihood of the departures ``r`` (NaN where not observed) under u = rho u' + drive + a daily step of ``sigma``, read with
    variance ``noise``. With ``smooth`` also the mean and variance of u on every day, given all observations."""
    q, n, log2pi = sigma * sigma, len(r), math.log(2 * math.pi)
    mean, var, total = 0.0, q / (1 - rho * rho), 0.0
    before, after = [], []
    for i, (x, push) in enumerate(zip(r.tolist(), drive.tolist())):
        if i:
            mean, var = rho * mean + push, rho * rho * var + q
        before.append((mean, var))
        if x == x:
            spread, miss = var + noise, x - mean
            gain = var / spread
            total -= (log2pi + math.log(spread) + miss * miss / spread) / 2
            mean, var = mean + gain * miss, noise * gain
        after.append((mean, var))
    if not smooth:
        return total
    out = np.empty((n, 2))
    out[-1] = m, v = after[-1]
    for i in range(n - 2, -1, -1):
        (own, spread), (ahead, wide) = after[i], before[i + 1]
        back = rho * spread / wide
        m, v = own + back * (m - ahead), max(0.0, spread + back * back * (v - wide))
        out[i] = m, v
    return total, out[:, 0], out[:, 1]


def minimise(f, x: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float]:
    """A local minimum of a smooth function of few variables: quasi-Newton steps on central differences."""

    def slope(x: np.ndarray) -> np.ndarray:
        h = 1e-5 * (1 + np.abs(x))
        return np.array([(f(x + e) - f(x - e)) / (2 * e.sum()) for e in np.diag(h)])

    value, g, inverse = f(x), slope(x), np.eye(len(x))
    inverse /= max(1.0, float(np.abs(g).max()))
    for _ in range(rounds):
        step = -inverse @ g
        if step @ g >= 0:
            inverse, step = np.eye(len(x)) / max(1.0, float(np.abs(g).max())), -g / max(1.0, float(np.abs(g).max()))
        length = 1.0
        while length > 1e-10 and not f(x + length * step) < value + 1e-4 * length * float(step @ g):
            length /= 2
        if length <= 1e-10:
            break
        new = x + length * step
        fresh, h = f(new), slope(new)
        s, y = new - x, h - g
        settled = value - fresh <= 1e-9 * (1 + abs(fresh))
        x, value, g = new, fresh, h
        if settled:
            break
        if s @ y > 1e-12:
            left = np.eye(len(x)) - np.outer(s, y) / (s @ y)
            inverse = left @ inverse @ left.T + np.outer(s, s) / (s @ y)
    return x, float(value)


def fit_departures(r: np.ndarray, peers: np.ndarray | None, noise: float, start: tuple[float, float] = (0.8, 0.3)) -> tuple[float, float, float, float]:
    """rho, b, sigma and log likelihood of greatest likelihood; b is 0 without peers."""
    zero = np.zeros(len(r))

    def unpack(x: np.ndarray) -> tuple[float, float, float]:
        rho = min(1 / (1 + math.exp(-min(max(x[0], -30.0), 30.0))), MAX_RHO)
        return rho, float(x[2]) if peers is not None else 0.0, max(math.exp(min(x[1], 30.0)), LEAST_SIGMA)

    def cost(x: np.ndarray) -> float:
        rho, b, sigma = unpack(x)
        value = -departures(r, zero if peers is None else b * peers, rho, sigma, noise)
        return value if math.isfinite(value) else 1e10

    rho, sigma = min(max(start[0], 0.01), 0.99), max(start[1], LEAST_SIGMA)
    x, value = minimise(cost, np.array([math.log(rho / (1 - rho)), math.log(sigma), 0.0][: 2 if peers is None else 3]))
    return (*unpack(x), -value)


def _refuse(bad: Column, message: str) -> Column:
    return F.when(bad, F.raise_error(F.lit(message)))


def calendar(temp: DataFrame, air: DataFrame, first: Day | None = None, last: Day | None = None) -> DataFrame:
    """station, date, air, y, wanted for every day of a station's record and of the days to fill, as far as air goes; ``gap``
    where the air of that span has a hole of more than ``AIR_STEP`` - 1 days."""
    seen = temp.groupBy("station", "date").agg(F.avg("t_mean_c").alias("y"), F.count("*").alias("n"))
    seen = seen.select("station", "date", F.coalesce(_refuse(F.col("n") > 1, "more than one row for a station and day"), F.col("y")).alias("y"))
    span = seen.groupBy("station").agg(F.min("date").alias("begun"), F.max("date").alias("ended"))
    span = span.select("station", "begun", "ended", F.lit(first).cast("date").alias("given"), F.lit(last).cast("date").alias("until")).select(
        "station", F.coalesce("given", "begun").alias("fill_from"), F.coalesce("until", "ended").alias("fill_to"), "begun", "ended"
    )
    order = Window.partitionBy("id").orderBy("date")
    read = air.where("variable = 'tmean' and value is not null and date is not null").select("id", "date", F.col("value").cast("double").alias("value"))
    read = read.select("*", F.lead("date").over(order).alias("next"), F.lead("value").over(order).alias("then"))
    read = read.withColumn("value", F.coalesce(_refuse(F.col("next") == F.col("date"), "more than one tmean row for a station and day"), F.col("value")))
    reach = read.groupBy("id").agg(F.min("date").alias("air_from"), F.max("date").alias("air_to"), F.count("*").alias("n_air"))
    known = span.join(reach, span["station"] == reach["id"]).where("n_air >= 2").select(
        "station", "fill_from", "fill_to", F.greatest(F.least("begun", "fill_from"), "air_from").alias("low"), F.least(F.greatest("ended", "fill_to"), "air_to").alias("high")
    ).where("low <= high")
    step = F.datediff("next", "date")
    holed = read.join(known, read["id"] == known["station"]).where((step > AIR_STEP) & (F.col("date") < F.col("high")) & (F.col("next") > F.col("low"))).select(F.col("id").alias("holed")).distinct()
    known = known.join(holed, known["station"] == holed["holed"], "left").select("station", "fill_from", "fill_to", "low", "high", F.col("holed").isNotNull().alias("gap"))
    within = F.explode(F.sequence(F.lit(0), F.when((step >= 1) & (step <= AIR_STEP), step - 1).otherwise(0))).alias("k")
    daily = read.select("*", within).select("id", F.date_add("date", F.col("k")).alias("date"), F.when(F.col("k") == 0, F.col("value")).otherwise(F.col("value") + (F.col("then") - F.col("value")) * F.col("k") / step).alias("air"))
    days = known.select("*", F.explode(F.sequence("low", "high")).alias("date"))
    days = days.join(daily, (days["station"] == daily["id"]) & (days["date"] == daily["date"]), "left").select(days["station"], days["date"], "air", "gap", days["date"].between(F.col("fill_from"), F.col("fill_to")).alias("wanted"))
    return days.join(seen, ["station", "date"], "left").select("station", "date", "air", "y", "wanted", "gap")


def estimates(temp: DataFrame, air: DataFrame, pool: DataFrame | None = None, first: Day | None = None, last: Day | None = None, min_days: int = 365, obs_sd: float = 0.1) -> DataFrame:
    """station, date, y, wanted, estimate, sd and the station's fit (a struct) for every day of the stations that can be fitted.

    ``pool``: station, pool; peers share a pool, all stations one without it. Stations with fewer than ``min_days`` observed days with
    air, or with a hole in the air over their span, have no rows.
    """
    noise = obs_sd * obs_sd

    def alone(days: pd.DataFrame) -> pd.DataFrame:
        days = days.sort_values("date")
        y = days["y"].to_numpy(float)
        if np.isfinite(y).sum() < min_days:
            return pd.DataFrame({c: pd.Series(dtype=object) for c in columns})
        (a1, a2, a3), states, rmse = fit_open_loop(y, days["air"].to_numpy(float))
        r = y - states
        rho, _, sigma, ll = fit_departures(r, None, noise)
        error = np.concatenate([[np.nan], r[1:] - rho * r[:-1]]).clip(-CLIP * sigma, CLIP * sigma)
        error = pd.Series(error, dtype=object).where(np.isfinite(error), None)
        return pd.DataFrame({"station": days["station"].to_numpy(), "date": days["date"].to_numpy(), "y": pd.Series(y, dtype=object).where(np.isfinite(y), None), "wanted": days["wanted"].to_numpy(), "s": states, "error": error, "a1": a1, "a2": a2, "a3": a3, "rmse_open": rmse, "rho": rho, "sigma": sigma, "loglik": ll})[columns]

    def joint(days: pd.DataFrame) -> pd.DataFrame:
        days = days.sort_values("date")
        y, states, count = days["y"].to_numpy(float), days["s"].to_numpy(float), days["peers"].to_numpy(int)
        r, own = y - states, days.iloc[0]
        rho, b, sigma, ll = own["rho"], 0.0, own["sigma"], own["loglik"]
        drive = np.zeros(len(r))
        if ((count > 0) & np.isfinite(y)).sum() >= PEER_DAYS:
            mean = np.where(count > 0, np.nan_to_num(days["peer_sum"].to_numpy(float)) / np.maximum(count, 1), 0.0)
            rho, b, sigma, ll = fit_departures(r, mean, noise, (rho, sigma))
            drive = b * mean
        _, u, var = departures(r, drive, rho, sigma, noise, smooth=True)
        fit = [own["a1"], own["a2"], own["a3"], own["rmse_open"], rho, b, sigma, int(np.isfinite(y).sum()), ll]
        out = pd.DataFrame({"station": days["station"].to_numpy(), "date": days["date"].to_numpy(), "y": pd.Series(y, dtype=object).where(np.isfinite(y), None), "wanted": days["wanted"].to_numpy(), "estimate": states + u, "sd": np.sqrt(var)})
        for name, value in zip([c.split()[0] for c in _FIT.split(", ")], fit):
            out[name] = value
        return out

    kind = temp.schema["station"].dataType.simpleString()
    shape = f"station {kind}, date date, y double, wanted boolean, s double, error double, a1 double, a2 double, a3 double, rmse_open double, rho double, sigma double, loglik double"
    columns = [c.strip().split()[0] for c in shape.split(",")]
    fitted = calendar(temp, air, first, last).where("not gap").drop("gap").groupBy("station").applyInPandas(alone, shape)
    if pool is None:
        fitted = fitted.withColumn("pool", F.lit("all"))
    else:
        fitted = fitted.join(pool.select(F.col("station").alias("of"), "pool"), F.col("station") == F.col("of"), "left").drop("of")
        fitted = fitted.withColumn("pool", F.coalesce("pool", F.raise_error(F.concat(F.lit("no pool for "), F.col("station").cast("string")))))
    # the peers' sum is that of the pool without one's own: no pairs of stations are made
    together = Window.partitionBy("pool", "date")
    others = F.sum("error").over(together) - F.coalesce("error", F.lit(0.0))
    fitted = fitted.select("*", others.alias("peer_sum"), (F.count("error").over(together) - F.col("error").isNotNull().cast("int")).alias("peers"))
    names = [c.split()[0] for c in _FIT.split(", ")]
    out = fitted.drop("pool", "error").groupBy("station").applyInPandas(joint, f"station {kind}, date date, y double, wanted boolean, estimate double, sd double, {_FIT}")
    return out.select("station", "date", "y", "wanted", "estimate", "sd", F.struct(*names).alias("fit"))


def fits(estimated: DataFrame) -> DataFrame:
    """A row per fitted station: a1, a2, a3, rmse_open, rho, b, sigma, n_obs, loglik."""
    return estimated.groupBy("station").agg(F.first("fit").alias("fit")).select("station", "fit.*")


def fill(temp: DataFrame, air: DataFrame, pool: DataFrame | None = None, first: Day | None = None, last: Day | None = None, min_days: int = 365, obs_sd: float = 0.1, level: float = 0.95) -> DataFrame:
    """The observed days as they are and the days filled between them (or from ``first`` to ``last``).

    ``temp``: station, date, t_mean_c and any other columns; rows that lack one of these or are filled already are left out. ``air``:
    id, date, variable, value. New columns: filled, t_lo_c, t_hi_c (the interval of ``level``; the value itself where observed). Of
    filled days source is air2stream, status provisional, n_hours 0, and other columns null. Stations that cannot be fitted keep their
    observed days only. Nothing falls below 0.
    """
    if min_days < 10 or not 0 < level < 1 or not 0 < obs_sd < math.inf:
        raise ValueError("min_days is 10 or more, level between 0 and 1, obs_sd above 0")
    if first is not None and last is not None and first > last:
        raise ValueError("first is after last")
    lacking = [c for c in ("station", "date", "t_mean_c") if c not in temp.columns] + [c for c in ("id", "date", "variable", "value") if c not in air.columns]
    if lacking:
        raise ValueError(f"no column {lacking}")
    seen = temp.where(~F.coalesce("filled", F.lit(False))).drop("filled", "t_lo_c", "t_hi_c") if "filled" in temp.columns else temp
    seen = seen.where("station is not null and date is not null and t_mean_c is not null")
    made = estimates(seen.select("station", "date", "t_mean_c"), air, pool, first, last, min_days, obs_sd).where("y is null and wanted")
    half = NormalDist().inv_cdf(1 - (1 - level) / 2) * F.col("sd")
    floored = lambda c: F.greatest(c, F.lit(0.0))
    given = {"station": F.col("station"), "date": F.col("date"), "t_mean_c": floored(F.col("estimate")), "n_hours": F.lit(0), "source": F.lit("air2stream"), "status": F.lit("provisional")}
    filled = made.select(
        *[(given.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in seen.schema],
        F.lit(True).alias("filled"), floored(F.col("estimate") - half).alias("t_lo_c"), floored(F.col("estimate") + half).alias("t_hi_c"),
    )
    return seen.select("*", F.lit(False).alias("filled"), F.col("t_mean_c").alias("t_lo_c"), F.col("t_mean_c").alias("t_hi_c")).unionByName(filled)
