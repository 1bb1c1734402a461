"""Water balance arithmetic on grids and gauges: evaporation variants, land cover, masks, licences and decision rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from freshet.functions.columns import no_nan, refuse

def raw_balance(variant: str, precipitation: Column, evaporation: dict[str, Column], stored: dict[str, Column] | None = None) -> Column:
    """Yearly balance before adjustment under a variant of evaporation: the one that is stored for it, if any, or what evaporation leaves
    of precipitation. The caller says which Column each variant is."""
    if variant in (stored or {}):
        return stored[variant]
    if variant not in evaporation:
        raise LookupError(f"{variant} is neither stored nor among {sorted(evaporation)}")
    return precipitation - evaporation[variant]


def class_ratios(fractions: DataFrame, aet: DataFrame, measured: dict[str, float], min_cells: int = 1, clamp: tuple[float, float] = (0.25, 4.0)) -> DataFrame:
    """class, et_mm, aet_mean, n_cells, ratio of every measured class: measured evaporation over the mean of ``aet`` on the cells
    whose cover is over a half and mostly of that class (the first class of tied ones); 1 with too few cells, clamped.
    ``fractions``: cell, class, fraction. ``aet``: cell, aet."""
    order = F.array_position(F.array(*map(F.lit, measured)), F.col("class"))
    known = fractions.select("cell", refuse(order == 0, "a class has no measured evaporation", F.col("class")).alias("class"), F.coalesce("fraction", F.lit(0.0)).alias("fraction"), order.alias("_o"))
    top = known.groupBy("cell").agg(F.sum("fraction").alias("_covered"), F.max(F.struct("fraction", (-F.col("_o")).alias("o"), "class"))["class"].alias("class")).where("_covered > 0.5")
    mean = top.join(aet, "cell").groupBy("class").agg(F.avg("aet").alias("aet_mean"), F.count("aet").alias("n_cells"))
    every = fractions.sparkSession.createDataFrame(list(measured.items()), "class string, et_mm double")
    ratio = F.try_divide("et_mm", "aet_mean")
    ratio = F.when((F.col("n_cells") < max(min_cells, 1)) | ratio.isNull(), 1.0).otherwise(ratio)
    return every.join(mean, "class", "left").withColumn("n_cells", F.coalesce("n_cells", F.lit(0))).select("class", "et_mm", "aet_mean", "n_cells", F.greatest(F.least(ratio, F.lit(clamp[1])), F.lit(clamp[0])).alias("ratio"))


def land_cover_aet(fractions: DataFrame, aet: DataFrame, ratios: DataFrame) -> DataFrame:
    """cell, aet: times the classes' ratios by their fractions and 1 over the rest. ``ratios`` has a row per class."""
    mult = fractions.join(F.broadcast(ratios.select("class", "ratio")), "class").groupBy("cell").agg((F.sum(F.col("fraction") * F.col("ratio")) + 1 - F.sum("fraction")).alias("_m"))
    return aet.join(mult, "cell", "left").select("cell", (F.col("aet") * F.coalesce("_m", F.lit(1.0))).alias("aet"))


def anomaly_means(values: DataFrame, years: tuple[int, int]) -> DataFrame:
    """variable, mean over all years from the first to the last; a missing one is an error. ``values``: variable, year, value."""
    n = years[1] - years[0] + 1
    kept = values.where(F.col("year").between(*years)).groupBy("variable").agg(F.countDistinct("year").alias("_n"), F.avg("value").alias("_v"))
    return kept.select("variable", refuse(F.col("_n") < n, "years are missing", F.col("_v")).alias("value"))


def yearly_sum(months: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Sum of the twelve months; null unless all are there."""
    return months.groupBy(*by).agg(F.when(F.count(F.when(F.col("value").isNotNull(), F.col("month"))) == 12, F.sum("value")).alias("value"))


def masked_mean(pixels: DataFrame, min_years: int, most: float = 6551.0, implausible: float = 3000.0) -> DataFrame:
    """pixel, value: mean of the valid years; raw values beyond ``most`` are gap codes, and a pixel with fewer than ``min_years``
    valid ones has none. A valid value beyond ``implausible`` is an error: the scale was read wrongly."""
    v = F.when(F.col("value") <= most, F.col("value"))
    per = pixels.groupBy("pixel").agg(F.count(v).alias("_n"), F.avg(v).alias("_v"), F.max(v).alias("_max"))
    return per.select("pixel", F.when(refuse(F.coalesce(F.col("_max") > implausible, F.lit(False)), "implausible evaporation after masking", F.col("_n")) >= min_years, F.col("_v")).alias("value"))


def class_fractions(cells: DataFrame, classes: dict[str, list[int]], factor: int) -> DataFrame:
    """x, y, and the share of each class among the ``factor`` x ``factor`` fine cells (x, y, code) of a coarse cell."""
    coarse = cells.select(F.floor(F.col("x") / factor).alias("x"), F.floor(F.col("y") / factor).alias("y"), "code")
    return coarse.groupBy("x", "y").agg(*[F.avg(F.col("code").isin(codes).cast("double")).alias(name) for name, codes in classes.items()])


def grid_index(at: Column, first: float, step: float, n: int) -> Column:
    """Cell of a coordinate on a grid whose first cell has its centre at ``first``, clamped to the grid."""
    return F.least(F.greatest(F.floor((at - (first - step / 2)) / step), F.lit(0)), F.lit(n - 1)).cast("int")


def tile_name(lon: Column, lat: Column) -> Column:
    """Name of the degree tile of a point, by its south-west corner."""
    part = lambda x, plus, minus, digits: F.concat(F.when(x >= 0, plus).otherwise(minus), F.lpad(F.abs(F.floor(x)).cast("string"), digits, "0"))
    return F.concat(F.lit("Copernicus_DSM_COG_30_"), part(F.floor(lat), "N", "S", 2), F.lit("_00_"), part(F.floor(lon), "E", "W", 3), F.lit("_00_DEM"))


def mixed_aet(fraction: Column, inside: Column, outside: Column) -> Column:
    """``inside`` on the valid part of a cell (null: none) and ``outside`` on the rest."""
    f = F.coalesce(fraction, F.lit(0.0))
    return F.when(f > 0, f * inside + (1 - f) * outside).otherwise(outside)


def licence_depth(uses: DataFrame, gauges: DataFrame, straddling: str = "split", use_class: str = "consumptive") -> DataFrame:
    """station, depth: licensed volume of a gauge's upstream licences in mm a year over its area.

    ``uses``: station, point, grp, class, weight (share of years in force), volume, straddles, group_volume. A group that
    straddles a gauge counts by its points (``split``), not at all (``zero``), or once in full on its first point (``full``).
    ``gauges``: station, area_km2; one without licences has 0.
    """
    if straddling not in ("split", "zero", "full"):
        raise ValueError("straddling is split, zero or full")
    u = uses.where(F.col("class") == use_class)
    first = F.row_number().over(Window.partitionBy("station", "grp", "straddles").orderBy("point")) == 1
    volume = {"split": F.col("volume"), "zero": F.when(F.col("straddles"), 0.0).otherwise(F.col("volume")), "full": F.when(~F.col("straddles"), F.col("volume")).when(first, F.col("group_volume")).otherwise(0.0)}
    total = u.select("station", (F.col("weight") * volume[straddling]).alias("_v")).groupBy("station").agg(F.sum("_v").alias("_v"))
    return gauges.join(total, "station", "left").select("station", (F.coalesce("_v", F.lit(0.0)) / (F.col("area_km2") * 1e6) * 1000).alias("depth"))


def gate(headwater: tuple[Column, Column], nested: tuple[Column, Column], allowance: float = 1.0) -> Column:
    """By which rule an adjustment ships, from pairs of errors (with it, without it) on headwater and on nested gauges: headwater (it helps
    there), margin (it harms there by the allowance at most), nested (it helps there), else dropped. Errors that are no finite
    numbers are refused when read."""
    harm, gain = headwater[0] - headwater[1], nested[1] - nested[0]
    out = F.lit("dropped")
    for name, holds in reversed((("headwater", harm < 0), ("margin", harm <= allowance), ("nested", gain > 0))):
        out = F.when(holds, name).otherwise(out)
    finite = F.forall(F.array(*headwater, *nested), lambda x: no_nan(x).isNotNull() & (F.abs(x) < float("inf")))
    return refuse(~F.coalesce(finite, F.lit(False)), "an error of the gate is not finite", out)


def choose_variant(scores: DataFrame, incumbent: str, limits: dict[str, float], lead: str, by: tuple[str, ...] = (), name: str = "aet") -> DataFrame:
    """by and the variant that ships: of the variants whose scores all exceed the incumbent's by their limit at most (a negative limit asks
    for a lead; scores for which more is better are given negated), the one with the least ``lead``; without one the incumbent stays. Groups without the incumbent have no row."""
    reference = scores.where(F.col(name) == incumbent).select(*by, F.struct(*limits).alias("_held"))
    met = scores.join(reference, list(by)) if by else scores.crossJoin(F.broadcast(reference))  # one row: the incumbent's
    within = F.forall(F.array(*[F.col(c) - F.col("_held")[c] <= most for c, most in limits.items()]), lambda x: x)
    ranked = met.where(F.coalesce(within, F.lit(False))).groupBy(*by).agg(F.min_by(name, F.struct(lead, name)).alias("_best"))
    here = reference.select(*by)
    out = here.join(ranked, list(by), "left") if by else here.crossJoin(ranked)  # without ``by`` both are one row
    return out.select(*by, F.coalesce("_best", F.lit(incumbent)).alias(name))


def implied_shape(p: Column, e: Column, aet: Column, low: float = 1.0001, high: float = 50.0, steps: int = 60) -> Column:
    """The shape at which the formula of precipitation and potential evaporation gives ``aet``, by bisection. Evaporation of 0 or
    less has none (null). At or above the smaller supply, or beyond what ``high`` gives, it is infinite; at or below what ``low`` gives, 1."""
    formula = lambda w: p + e - F.pow(F.pow(p, w) + F.pow(e, w), 1 / w)
    middle = lambda s: (s["a"] + s["b"]) / 2
    start = F.struct(F.lit(low).alias("a"), F.lit(high).alias("b"))
    halved = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda s, _: F.struct(F.when(formula(middle(s)) < aet, middle(s)).otherwise(s["a"]).alias("a"), F.when(formula(middle(s)) < aet, s["b"]).otherwise(middle(s)).alias("b")), middle)
    supply = F.least(p, e)
    known = aet.isNotNull() & ~F.isnan(aet) & supply.isNotNull()
    return F.when(known & (aet > 0), F.when((aet >= supply) | (aet > formula(F.lit(high))), F.lit(float("inf"))).when(aet <= formula(F.lit(low)), F.lit(1.0)).otherwise(halved))


def ratio_classes(sites: DataFrame, min_years: int = 3, low: float = 0.9, high: float = 1.1) -> DataFrame:
    """site, grp, n, ratio of summed model to summed observation over its years (``min_years`` at least), class against the
    bounds, and ratio_of_medians of its group. ``sites``: site, grp, year, obs, mod."""
    kept = sites.where("obs is not null and mod is not null")
    per = kept.groupBy("site", "grp").agg(F.count("*").alias("n"), F.try_divide(F.sum("mod"), F.sum("obs")).alias("ratio"), F.avg("obs").alias("_o"), F.avg("mod").alias("_m")).where(F.col("n") >= min_years)
    group = Window.partitionBy("grp")
    half = lambda c: F.percentile(c, F.lit(0.5)).over(group)
    return per.select("site", "grp", "n", "ratio", F.when(F.col("ratio") < low, "low").when(F.col("ratio") > high, "high").otherwise("near").alias("class"), F.try_divide(half("_m"), half("_o")).alias("ratio_of_medians"))
