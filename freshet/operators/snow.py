"""Snow of watersheds by year, from cells of a grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.functions.columns import no_nan


def snow_years(cells: DataFrame, values: DataFrame, variables: list[str], years: list[int] | None = None, caps: dict[str, float] | None = None, by: tuple[str, ...] = ("watershed",)) -> DataFrame:
    """The watershed, year, the area mean of each variable and ``cover``, the share of the watershed's area whose cells have the first
    variable's value that year.

    ``cells``: watershed, cell, fraction. A watershed may be given as several polygons without overlap: the fractions of a cell add up, to 1 at most.
    ``values``: variable, year, cell, value; each value is capped on its own (``caps``) before the mean. Without ``years``, all of the
    first variable. A watershed off the grid has null means and a cover of 0. A variable without any value in an asked year is an error.
    """
    caps = caps or {}
    if not variables or len(set(variables)) < len(variables):
        raise ValueError("variables are named once each")
    if set(caps) - set(variables):
        raise ValueError(f"caps of variables that are not asked for: {sorted(set(caps) - set(variables))}")
    if years is not None and (not years or len(set(years)) < len(years)):
        raise ValueError("years are given once each")
    asked = values.where(F.col("variable").isin(list(variables)))
    there = {(r["variable"], r["year"]) for r in asked.select("variable", "year").distinct().collect()}  # a row a band
    years = sorted(y for v, y in there if v == variables[0]) if years is None else sorted(years)
    lacking = [(v, y) for v in variables for y in years if (v, y) not in there]
    if lacking:
        raise ValueError(f"{lacking[0][0]} has no values in {len(lacking)} of the years, as in {lacking[0][1]}")
    union = cells.groupBy(*by, "cell").agg(F.least(F.sum("fraction"), F.lit(1.0)).alias("_f"))
    area = union.groupBy(*by).agg(F.sum("_f").alias("_area"))
    # one row a cell and year, so that all variables come from one join
    kept = asked.where(F.col("year").isin(years))
    x = no_nan(F.col("value").cast("double"))
    wide = kept.groupBy("cell", "year").agg(*[F.max(F.when(F.col("variable") == v, F.when(x.isNotNull(), F.least(x, F.lit(float(caps[v])))) if v in caps else x)).alias(f"_v{i}") for i, v in enumerate(variables)])
    have = lambda i: F.when(F.col(f"_v{i}").isNotNull(), F.col("_f"))
    sums = union.join(wide, "cell").groupBy(*by, "year").agg(*[F.try_divide(F.sum(F.col("_f") * F.col(f"_v{i}")), F.sum(have(i))).alias(v) for i, v in enumerate(variables)], F.sum(have(0)).alias("_have"))
    grid = area.select("*", F.explode(F.array(*map(F.lit, years)) if years else F.array().cast("array<int>")).alias("year"))
    return grid.join(sums, [*by, "year"], "left").select(*by, "year", *variables, (F.coalesce("_have", F.lit(0.0)) / F.col("_area")).alias("cover"))
