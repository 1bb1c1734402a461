"""Intervals of a change between two spans of years by resampling, with the noise of estimated years, and how often they hold."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.operators.fits import _uniform


def _spans(years: DataFrame, residuals: DataFrame, base: tuple[int, int], recent: tuple[int, int]) -> DataFrame:
    """station, _a, _b (the years of each span as arrays of value and whether it is estimated, in order), _sa, _sb (their standard
    deviations), _r (errors, in order), of the stations with two years in each and an error. A station's years are short arrays; errors should be too."""
    at = lambda s: F.array_sort(F.collect_list(F.when(F.col("year").between(*s) & F.col("value").isNotNull(), F.struct("year", F.col("value").cast("double").alias("value"), F.coalesce("extended", F.lit(False)).alias("extended")))))
    spread = lambda s: F.stddev_samp(F.when(F.col("year").between(*s), F.col("value").cast("double")))
    held = years.groupBy("station").agg(at(base).alias("_a"), at(recent).alias("_b"), spread(base).alias("_sa"), spread(recent).alias("_sb")).where("size(_a) >= 2 and size(_b) >= 2")
    errors = residuals.where("r is not null").groupBy("station").agg(F.array_sort(F.collect_list(F.col("r").cast("double"))).alias("_r"))
    return held.join(errors, "station")


def _mean_of_draw(span: Column, name: str, key: list[Column]) -> Column:
    """The mean of years drawn with replacement from ``span``; each estimated year has one error added, the same each time that the draw
    takes it."""
    n = F.size(span)
    index = lambda *k: F.floor(_uniform(*key, F.lit(name), *k) * n).cast("int")
    error = lambda i: F.get("_r", F.floor(_uniform(*key, F.lit(f"{name} error"), i) * F.size("_r")).cast("int"))
    noisy = F.transform(span, lambda y, i: y["value"] + F.when(y["extended"], error(i)).otherwise(0.0))
    picked = lambda z: F.aggregate(F.transform(F.sequence(F.lit(1), n), lambda k: F.get(z, index(k))), F.lit(0.0), lambda s, v: s + v) / n
    return F.get(F.transform(F.array(noisy), picked), F.lit(0))


def change_interval(years: DataFrame, residuals: DataFrame, base: tuple[int, int], recent: tuple[int, int], draws: int = 2_000, level: float = 0.9) -> DataFrame:
    """station, change, low, high: the mean of the recent years less that of the base years, and the middle ``level`` of its draws.

    ``years``: station, year, value, extended (an estimate, whose error a draw adds); ``residuals``: station, r. Draws are hashes of
    station, span, draw and place, so every run and every engine draws alike. Each draw is a row.
    """
    whole = _spans(years, residuals, base, recent)
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, y: s + y["value"]) / F.size(c)
    drawn = whole.select("station", (mean(F.col("_b")) - mean(F.col("_a"))).alias("change"), "_a", "_b", "_r", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("_draw"))
    key = [F.col("station"), F.col("_draw")]
    drawn = drawn.select("station", "change", (_mean_of_draw(F.col("_b"), "recent", key) - _mean_of_draw(F.col("_a"), "base", key)).alias("_d"))
    tail = (1 - level) / 2
    return drawn.groupBy("station", "change").agg(F.percentile("_d", F.lit(tail)).alias("low"), F.percentile("_d", F.lit(1 - tail)).alias("high"))


def change_coverage(years: DataFrame, residuals: DataFrame, base: tuple[int, int], recent: tuple[int, int], simulations: int = 200, draws: int = 200, level: float = 0.9) -> DataFrame:
    """station, n, coverage: the share of simulated records without a change whose interval, made as by ``change_interval``, holds 0.

    A simulated record has normal values in each span with the standard deviation that the station has there, and the same estimated
    years. Draws are nested in simulations, each a row for as long as it takes to draw it: sums per simulation are all that is shuffled.
    """
    whole = _spans(years, residuals, base, recent)
    sims = whole.select("station", "_a", "_b", "_sa", "_sb", "_r", F.explode(F.sequence(F.lit(1), F.lit(simulations))).alias("_sim"))

    def simulated(span: str) -> Column:
        u = lambda part, i: 1 - _uniform(F.col("station"), F.col("_sim"), F.lit(span + part), i)
        normal = lambda i: F.sqrt(-2 * F.ln(u("1", i))) * F.cos(2 * math.pi * u("2", i))
        return F.transform(span, lambda y, i: F.named_struct(F.lit("value"), normal(i) * F.col(f"_s{span[1:]}"), F.lit("extended"), y["extended"]))

    made = sims.select("station", "_sim", "_r", simulated("_a").alias("_a"), simulated("_b").alias("_b"))
    made = made.select("*", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("_draw"))  # records are made before they are drawn from
    key = [F.col("station"), F.col("_sim"), F.col("_draw")]
    drawn = made.select("station", "_sim", (_mean_of_draw(F.col("_b"), "recent", key) - _mean_of_draw(F.col("_a"), "base", key)).alias("_d"))
    tail = (1 - level) / 2
    per = drawn.groupBy("station", "_sim").agg(F.percentile("_d", F.array(F.lit(tail), F.lit(1 - tail))).alias("q"))
    return per.groupBy("station").agg(F.count("*").alias("n"), F.avg(((F.col("q")[0] <= 0) & (F.col("q")[1] >= 0)).cast("double")).alias("coverage"))
