"""Daily shapes of the year: principal components of many gauges, and splines through months."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.functions.columns import COMMON_DAYS, month_of_common_day
from freshet.operators.models import within_month

DAYS = 365
_MONTH = np.repeat(np.arange(12), COMMON_DAYS)
#: Components whose share of the largest singular value is smaller count as none: sums of squares hold no more digits.
LEAST_SHARE = 1e-6


def spline_matrix() -> np.ndarray:
    """365 x 12: what each month's mean weighs on each day, in the cubic spline of period 365 through the middles of the months."""
    n = np.asarray(COMMON_DAYS, float)
    knots = np.cumsum(n) - n / 2 + 0.5
    h = np.append(np.diff(knots), knots[0] + DAYS - knots[-1])
    before, i = np.roll(h, 1), np.arange(12)
    # curvatures at the knots: continuity of the slope, a cyclic tridiagonal system with a constant right side
    bend, pull = np.zeros((12, 12)), np.zeros((12, 12))
    bend[i, i], bend[i, i - 1], bend[i, (i + 1) % 12] = 2 * (before + h), before, h
    pull[i, i], pull[i, i - 1], pull[i, (i + 1) % 12] = -6 / h - 6 / before, 6 / before, 6 / h
    curve = np.linalg.solve(bend, pull)
    out = np.empty((DAYS, 12))
    for day in range(1, DAYS + 1):
        k = int(np.searchsorted(knots, day, side="right")) - 1
        at = day - knots[k] if k >= 0 else day + DAYS - knots[-1]
        k %= 12
        ahead, width = (k + 1) % 12, h[k]
        left = width - at
        line = (np.eye(12)[k] * left + np.eye(12)[ahead] * at) / width
        out[day - 1] = line + curve[k] * (left**3 / width - width * left) / 6 + curve[ahead] * (at**3 / width - width * at) / 6
    return out


def _each_day(rows: DataFrame, keep: list[str], values: Column, matrix: np.ndarray) -> DataFrame:
    """keep, doy, month, q: for each day the product of its row of a constant matrix with the array ``values``, 0 at least. The matrix
    is one literal of the plan, so rows are spread without a join or a shuffle."""
    dot = F.aggregate(F.zip_with("_row", "_v", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    spread = rows.select(*keep, values.alias("_v"), F.posexplode(F.lit(matrix.tolist())).alias("_at", "_row"))
    day = (F.col("_at") + 1).alias("doy")
    return spread.select(*keep, day, month_of_common_day(F.col("_at") + 1).alias("month"), F.greatest(dot, F.lit(0.0)).alias("q"))


def _months(monthly: DataFrame, by: str) -> DataFrame:
    """by and the twelve means as an array, of those with all twelve."""
    held = monthly.where("month between 1 and 12").groupBy(by).agg(F.array(*[F.max(F.when(F.col("month") == m, F.col("q").cast("double"))) for m in range(1, 13)]).alias("_months"))
    return held.where(~F.exists("_months", lambda q: q.isNull()))


def spline_shape(monthly: DataFrame, by: str = "id") -> DataFrame:
    """by, month, doy, weight, flat: the days' weights in their month from a periodic spline through the monthly means, floored at
    0. ``monthly``: by, month, q; those without twelve months are left out."""
    return within_month(_each_day(_months(monthly, by), [by], F.col("_months"), spline_matrix()), (by, "month"))


def flat_shape(ids: DataFrame, by: str = "id") -> DataFrame:
    """by, month, doy, weight: every day of a month alike."""
    days = ids.select(by, F.explode(F.sequence(F.lit(1), F.lit(DAYS))).alias("doy")).withColumn("month", month_of_common_day(F.col("doy")))
    return days.select(by, "month", "doy", (1.0 / F.element_at(F.lit(list(COMMON_DAYS)), F.col("month"))).alias("weight"))


@dataclass(frozen=True)
class Basis:
    """A fit of daily shapes: what predicts them, the mean shape, components (365 x k), their singular values, and the coefficients of
    a constant and the predictors (1 + p by k)."""

    predictors: tuple[str, ...]
    centre: np.ndarray
    components: np.ndarray
    singular: np.ndarray
    coefficients: np.ndarray
    n: int


def fit_basis(shapes: DataFrame, predictors: list[str], n_components: int = 6) -> Basis:
    """Principal components of daily shapes and the least squares of their scores on the predictors.

    ``shapes``: a row per gauge with the predictors and weights, an array of 365 within-month weights. One pass makes the sums of
    products of all columns, task by task; a matrix of 366 + p rows and columns is all that reaches the driver, for any number of
    gauges. Components have their largest entry positive. Gauges with a null predictor or day are an error.
    """
    bad = F.col("weights").isNull() | (F.size("weights") != DAYS) | F.exists("weights", lambda w: w.isNull())
    for p in predictors:
        bad = bad | F.col(p).isNull()
    moments = shapes.agg(F.count("*").alias("n"), F.count_if(F.coalesce(bad, F.lit(True))).alias("bad"), *[f(F.col(p).cast("double")).alias(f"{name}_{p}") for p in predictors for name, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    if moments["bad"] or moments["n"] <= len(predictors) + 1:
        raise ValueError(f"{moments['bad']} gauges lack a predictor or day" if moments["bad"] else "no more gauges than predictors")
    mean, spread = np.array([moments[f"m_{p}"] for p in predictors], float), np.array([moments[f"s_{p}"] for p in predictors], float)
    if not (spread > 0).all():
        raise ValueError(f"constant predictors: {[p for p, s in zip(predictors, spread) if not s > 0]}")
    lengths, p = np.asarray(COMMON_DAYS, float)[_MONTH], len(predictors)

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((1 + p + DAYS, 1 + p + DAYS))
        for batch in batches:
            if len(batch):
                x = (batch[predictors].to_numpy(float) - mean) / spread
                y = np.stack(batch["weights"].to_numpy()) * lengths - 1  # an even month is 0, which keeps digits
                z = np.column_stack([np.ones(len(batch)), x, y])
                total += z.T @ z
        yield pd.DataFrame({"i": np.arange(len(total)), "sums": list(total)})

    parts = shapes.select(*[F.col(c).cast("double").alias(c) for c in predictors], "weights").mapInPandas(gram, "i int, sums array<double>")
    size = 1 + p + DAYS
    added = parts.select("i", F.posexplode("sums").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    products = np.zeros((size, size))
    for r in added.collect():  # (366 + p) squared numbers
        products[r["i"], r["j"]] = r["v"]
    n = products[0, 0]
    middle = products[0, 1 + p :] / n
    spread_y = products[1 + p :, 1 + p :] - n * np.outer(middle, middle)
    values, vectors = np.linalg.eigh((spread_y + spread_y.T) / 2)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    kept = min(n_components, int((np.sqrt(values) > LEAST_SHARE * np.sqrt(values[0])).sum()))
    components = vectors[:, :kept]
    components = components * np.sign(components[np.abs(components).argmax(0), np.arange(kept)])
    design = products[: 1 + p, : 1 + p]
    against = (products[: 1 + p, 1 + p :] - np.outer(products[: 1 + p, 0], middle)) @ components
    slopes = np.linalg.lstsq(design, against, rcond=None)[0]
    slopes[1:] /= spread[:, None]
    slopes[0] -= mean @ slopes[1:]
    return Basis(tuple(predictors), middle + 1, components, np.sqrt(values[:kept]), slopes, int(n))


def scores(fit: Basis, rows: DataFrame, keep: list[str]) -> DataFrame:
    """keep and score_1 to score_k, as the predictors give them."""
    out = []
    for k in range(fit.components.shape[1]):
        value = F.lit(float(fit.coefficients[0, k]))
        for p, b in zip(fit.predictors, fit.coefficients[1:, k]):
            value = value + F.col(p) * float(b)
        out.append(value.alias(f"score_{k + 1}"))
    return rows.select(*keep, *out)


def predict_basis(fit: Basis, rows: DataFrame, by: str = "id") -> DataFrame:
    """by, month, doy, weight, flat of each row with all predictors: the mean shape and its components at the predicted scores, floored
    at 0 and made weights within each month; a month of zeros is even and flagged."""
    made = scores(fit, rows.dropna(subset=list(fit.predictors)), [by])
    values = F.array(F.lit(1.0), *[F.col(f"score_{k + 1}") for k in range(fit.components.shape[1])])
    matrix = np.column_stack([fit.centre, fit.components]) / np.asarray(COMMON_DAYS, float)[_MONTH][:, None]
    return within_month(_each_day(made, [by], values, matrix), (by, "month"))
