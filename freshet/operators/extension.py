"""Short yearly records extended from donors, with intervals, and what that is worth on records cut short on purpose."""

from __future__ import annotations

import math
from functools import lru_cache, reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from freshet.functions.columns import refuse
from freshet.sources.shared import settled

METHODS = ("ols", "move1", "ratio")
#: Degrees of freedom up to which quantiles of Student's t are looked up; beyond, a series in 1 / df holds nine digits.
TABLED = 200
#: Buckets of values that are ranked apart.
CUTS = 64


def _beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, out = 1.0, 0.0, 1.0
    for i in range(400):
        m = i // 2
        top = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + top * d or 1e-300)
        c = 1 + top / c or 1e-300
        out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * (out - 1)


@lru_cache(None)
def t_quantile(p: float, df: int) -> float:
    """The value that Student's t with ``df`` degrees of freedom stays below with probability ``p``."""
    if p < 0.5:
        return -t_quantile(1 - p, df)
    low, high = 0.0, 1.0
    below = lambda t: 1 - _beta_share(df / 2, 0.5, df / (df + t * t)) / 2
    while below(high) < p:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return (low + high) / 2


def t_quantiles(p: float, df: Column) -> Column:
    """Quantiles of Student's t as a Column; null below one degree of freedom."""
    z = NormalDist().inv_cdf(p)
    terms = [z, (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384]
    series = reduce(lambda a, b: a + b, [F.lit(t) / F.pow(df.cast("double"), F.lit(float(i))) for i, t in enumerate(terms)])
    table = F.array(*[F.lit(t_quantile(p, i)) for i in range(1, TABLED + 1)])
    return F.when(df > TABLED, series).when(df >= 1, F.get(table, df.cast("int") - 1))


def _is_days(by: tuple[str, ...]) -> Column:
    return F.endswith("variable", F.lit("_cov_day")) if "variable" in by else F.lit(False)


def _usable(values: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Values that a fit can take, with ``_v`` on its scale: logs, but days of the year as they are."""
    days = _is_days(by)
    kept = values.where(F.col("value").isNotNull() & (days | (F.col("value") > 0)))
    return kept.withColumn("_v", F.when(days, F.col("value")).otherwise(F.ln("value")))


def _once(values: DataFrame, key: list[str]) -> DataFrame:
    """``values``; a year of a record given twice is an error when read."""
    n = F.count("*").over(Window.partitionBy(*key))
    return values.select("*", n.alias("_n")).withColumn("_v", refuse(F.col("_n") > 1, "more than one value of a station and year", F.col("_v"))).drop("_n")


def extend(targets: DataFrame, donors: DataFrame, chain: DataFrame, method: str = "ols", by: tuple[str, ...] = ("variable", "period"), k: int = 5, level: float = 0.9, residuals: tuple[float, float] | None = None, min_years: int = 3) -> DataFrame:
    """target, by, year, value, lower, upper, donor, source: a target's own years ("observed") and those it gets from donors ("extended").

    ``targets``: target, by, year, value; ``donors``: donor, by, year, value; ``chain``: target, donor, distance, only pairs that may
    serve. A donor serves if it has every usable year of the target, and varies over them; the ``k`` nearest do, and each further
    year comes from the nearest that has it. ``ols`` has the interval of a prediction, the others that of ``residuals`` (two
    quantiles on the scale of the fit), if given. Fits are on logs; of variables named ``*_cov_day``, on days. Values of 0 or less
    serve no fit on logs (see ``report``), a year given twice is an error. Targets under ``min_years`` or without donors keep their own years.
    """
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}")
    if not (0 < level < 1 and k >= 1 and min_years >= 3):
        raise ValueError("level is between 0 and 1, k 1 or more, min_years 3 or more")
    t = _once(_usable(targets, by), ["target", *by, "year"]).select("target", *by, "year", F.col("value").alias("_y0"), F.col("_v").alias("_y"))
    d = _once(_usable(donors, by), ["donor", *by, "year"]).select("donor", *by, "year", F.col("value").alias("_x0"), F.col("_v").alias("_x"))
    own = t.groupBy("target", *by).agg(F.count("*").alias("_own"))
    shared = chain.select("target", "donor", "distance").where("target <> donor").join(t, "target").join(d, ["donor", *by, "year"])
    x, y = F.col("_x"), F.col("_y")
    fit = shared.groupBy("target", "donor", *by).agg(
        F.first("distance").alias("distance"), F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"),
        F.avg("_x0").alias("mx0"), F.avg("_y0").alias("my0"),
    ).join(own, ["target", *by]).where((F.col("n") == F.col("_own")) & (F.col("n") >= min_years))
    if method != "ratio":
        fit = fit.where("sxx > 0")
    nearest = Window.partitionBy("target", *by).orderBy("distance", "donor")
    fit = fit.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    served = fit.join(d, ["donor", *by]).join(t.select("target", *by, "year"), ["target", *by, "year"], "left_anti")
    # the nearest donor of a year, without a sort of its donors
    first = served.groupBy("target", *by, "year").agg(F.min(F.struct("rank", "donor", "n", "mx", "my", "sxx", "syy", "sxy", "mx0", "my0", "_x", "_x0")).alias("f")).select("target", *by, "year", "f.*")
    days = _is_days(by)
    slope = {"ols": F.col("sxy") / F.col("sxx"), "move1": F.when(F.col("sxy") < 0, -1.0).otherwise(1.0) * F.sqrt(F.col("syy") / F.col("sxx")), "ratio": F.lit(None).cast("double")}[method]
    ratio = F.col("_x0") * F.col("my0") / F.col("mx0")
    off = F.col("_x") - F.col("mx")
    guess = F.when(days, ratio).otherwise(F.ln(ratio)) if method == "ratio" else F.col("my") + slope * off
    if method == "ols":
        s = F.sqrt(F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), F.lit(0.0)) / (F.col("n") - 2))
        half = t_quantiles((1 + level) / 2, F.col("n") - 2) * s * F.sqrt(1 + 1 / F.col("n") + off * off / F.col("sxx"))
        low, high = -half, half
    else:
        low, high = [F.lit(r).cast("double") for r in (residuals or (None, None))]
    back = lambda c: F.when(days, c).otherwise(F.exp(c))
    made = first.select("target", *by, "year", guess.alias("_g"), low.alias("_l"), high.alias("_h"), "donor")
    made = made.select("target", *by, "year", back(F.col("_g")).alias("value"), back(F.col("_g") + F.col("_l")).alias("lower"), back(F.col("_g") + F.col("_h")).alias("upper"), "donor", F.lit("extended").alias("source"))
    kept = t.select("target", *by, "year", F.col("_y0").cast("double").alias("value"), F.col("_y0").cast("double").alias("lower"), F.col("_y0").cast("double").alias("upper"), F.lit(None).cast(donors.schema["donor"].dataType).alias("donor"), F.lit("observed").alias("source"))
    return kept.unionByName(made)


def report(targets: DataFrame, donors: DataFrame, chain: DataFrame, by: tuple[str, ...] = ("variable", "period"), min_years: int = 3) -> DataFrame:
    """target, by, n_years, dropped (values of 0 or less that no fit on logs takes), n_donors that cover every year, and reason: why a
    record is not extended, or null."""
    t = _usable(targets, by)
    bad = F.col("value").isNotNull() & ~_is_days(by) & (F.col("value") <= 0)
    counts = targets.groupBy("target", *by).agg(F.count_if(F.col("value").isNotNull() & ~bad).alias("n_years"), F.count_if(bad).alias("dropped"))
    shared = chain.select("target", "donor").where("target <> donor").join(t.select("target", *by, "year"), "target").join(_usable(donors, by).select("donor", *by, "year"), ["donor", *by, "year"])
    per = shared.groupBy("target", "donor", *by).agg(F.count("*").alias("_n")).join(counts, ["target", *by]).where("_n = n_years").groupBy("target", *by).agg(F.count("*").alias("n_donors"))
    reason = F.when(F.col("n_years") < min_years, "too few years").when(F.col("n_donors").isNull(), "no donor has every year")
    return counts.join(per, ["target", *by], "left").select("target", *by, "n_years", "dropped", F.coalesce("n_donors", F.lit(0)).alias("n_donors"), reason.alias("reason"))


def _blocked(values: DataFrame, length: int, by: tuple[str, ...]) -> DataFrame:
    """station, by, year, value, and block (its first year) of the years in whole blocks of ``length`` consecutive years, else null."""
    own = Window.partitionBy("station", *by).orderBy("year")
    runs = values.select("station", *by, "year", "value", (F.col("year") - F.row_number().over(own)).alias("_run"))
    run = Window.partitionBy("station", *by, "_run").orderBy("year")
    whole = Window.partitionBy("station", *by, "_run", "_part")
    parts = runs.withColumn("_part", F.floor((F.row_number().over(run) - 1) / length)).select("*", F.count("*").over(whole).alias("_n"), F.min("year").over(whole).alias("_first"))
    return parts.select("station", *by, "year", "value", F.when(F.col("_n") == length, F.col("_first")).alias("block"))


def blocks(values: DataFrame, length: int = 5, by: tuple[str, ...] = ("variable", "period")) -> DataFrame:
    """station, by, year, block (its first year) of the years in whole blocks of ``length`` consecutive years with a value."""
    return _blocked(values.where("value is not null"), length, by).where("block is not null").select("station", *by, "year", "block")


def _fits(met: DataFrame, key: list[str], length: int, by: tuple[str, ...]) -> DataFrame:
    """key, block, donor, distance, the sums of the donor's fit to the block's years, all of which it has, and ``_x``: its values in the
    record's years. ``met`` has a row per record (``_own``) and donor (``_theirs``, values by year), so all of it stays in the row."""
    scale = lambda c: F.when(_is_days(by), c).otherwise(F.ln(c))
    met = met.select(*key, "donor", "distance", "_own", F.transform("_own", lambda o: F.col("_theirs")[o["year"]].cast("double")).alias("_x"))
    each = met.select("*", F.explode(F.array_distinct(F.filter("_own.block", lambda b: b.isNotNull()))).alias("block"))
    both = F.transform(
        F.filter(F.arrays_zip("_own", "_x"), lambda p: (p["_own"]["block"] == F.col("block")) & p["_x"].isNotNull()),
        lambda p: F.struct(p["_x"].alias("x0"), p["_own"]["value"].cast("double").alias("y0"), scale(p["_x"]).alias("x"), scale(p["_own"]["value"].cast("double")).alias("y")),
    )
    each = each.select(*key, "block", "donor", "distance", "_x", both.alias("_both")).where((F.size("_both") == length) & F.lit(length >= 3))
    total = lambda of: F.aggregate("_both", F.lit(0.0), lambda s, p: s + of(p))
    # from the first year's value on, so that equal values have just that mean and no squares
    mean = lambda c: F.col("_both")[0][c] + total(lambda p: p[c] - F.col("_both")[0][c]) / length
    each = each.select("*", mean("x").alias("mx"), mean("y").alias("my"), mean("x0").alias("mx0"), mean("y0").alias("my0"))
    product = lambda a, b: total(lambda p: (p[a] - F.col(f"m{a}")) * (p[b] - F.col(f"m{b}")))
    return each.select("*", product("x", "x").alias("sxx"), product("y", "y").alias("syy"), product("x", "y").alias("sxy")).drop("_both")


def pseudo_records(values: DataFrame, chain: DataFrame, length: int = 5, by: tuple[str, ...] = ("variable", "period"), k: int = 5, level: float = 0.9, min_held: int = 3) -> DataFrame:
    """station, block, by, year, value, and per method its estimate, and the error on the scale of the fit (r_ols, r_move1, r_ratio),
    lower, upper (of ols): each block of a station's years plays a short record, and the station's other years are held out.

    ``values``: station, by, year, value; ``chain``: target, donor, distance. Years that some method cannot estimate are left out, and
    blocks with fewer than ``min_held`` others. A block is one target as in ``extend``: no station is paired beyond its chain. A donor's
    record is sent to a station once, as one row; its blocks, fits and estimates of all methods are made where it arrives.
    """
    if not (0 < level < 1 and k >= 1):
        raise ValueError("level is between 0 and 1, k 1 or more")
    key = ["station", *by]
    records = _blocked(_usable(values, by).where("year is not null"), length, by).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("year", "block", "value"))).alias("_own"))
    again = F.size(F.array_distinct("_own.year")) < F.size("_own")
    records = settled(records.withColumn("_own", refuse(again, "more than one value of a station and year", F.col("_own"))), "records")  # read three times below
    donors = records.select(F.col("station").alias("donor"), *by, F.map_from_arrays("_own.year", "_own.value").alias("_theirs"))
    # dealt once, before a row is many blocks; what follows is by station as well
    sent = chain.where("target <> donor").select(F.col("target").alias("station"), "donor", "distance").join(donors, "donor").repartition(*key)
    records = records.where(F.exists("_own.block", lambda b: b.isNotNull()))
    fits = _fits(sent.join(records, key), key, length, by)
    # ranks of all donors (ratio) and of those that vary (ols, move1), in one order
    near, varies = Window.partitionBy(*key, "block").orderBy("distance", "donor"), F.col("sxx") > 0
    upto = near.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = fits.select("*", F.row_number().over(near).alias("_any"), F.sum(varies.cast("int")).over(upto).alias("_fit"))
    ranked = ranked.withColumn("_any", F.when(F.col("_any") <= k, F.col("_any"))).withColumn("_fit", F.when(varies & (F.col("_fit") <= k), F.col("_fit")))
    # the record's other years meet only donors that are asked
    asked = ranked.where("_any is not null or _fit is not null").join(records, key)
    others = F.filter(F.arrays_zip("_own", "_x"), lambda p: ~p["_own"]["block"].eqNullSafe(F.col("block")) & p["_x"].isNotNull())
    asked = asked.withColumn("_at", F.explode(others)).select("*", "_at._own.year", "_at._own.value", F.col("_at._x").alias("x0")).drop("_own", "_x", "_at")
    days, n = _is_days(by), length
    x = F.when(days, F.col("x0")).otherwise(F.ln("x0"))
    off, ratio = x - F.col("mx"), F.try_divide(F.col("x0") * F.col("my0"), F.col("mx0"))
    slope, steep = F.try_divide("sxy", "sxx"), F.when(F.col("sxy") < 0, -1.0).otherwise(1.0) * F.sqrt(F.try_divide("syy", "sxx"))
    freedom = max(1, n - 2)
    half = t_quantile((1 + level) / 2, freedom) * F.sqrt(F.greatest(F.col("syy") - slope * F.col("sxy"), F.lit(0.0)) / freedom) * F.sqrt(1 + 1 / n + F.try_divide(off * off, F.col("sxx")))
    guesses = {"ols": F.col("my") + slope * off, "move1": F.col("my") + steep * off, "ratio": F.when(days, ratio).otherwise(F.ln(ratio))}
    guesses |= {"lower": guesses["ols"] - half, "upper": guesses["ols"] + half}
    back = lambda c: F.when(days, c).otherwise(F.exp(c))
    # the nearest donor of a year, without a sort of its donors
    made = asked.select(*key, "block", "year", "value", "_any", "_fit", *[back(g).alias(m) for m, g in guesses.items()])
    made = made.groupBy(*key, "block", "year", "value").agg(*[F.min_by(m, "_any" if m == "ratio" else "_fit").alias(m) for m in guesses]).where("ols is not null and move1 is not null and ratio is not null")
    scale = lambda c: F.when(days, F.col(c)).otherwise(F.ln(c))
    both = made.select("station", "block", *by, "year", "value", *METHODS, "lower", "upper", *[(scale("value") - scale(m)).alias(f"r_{m}") for m in METHODS])
    return both.withColumn("_n", F.count("*").over(Window.partitionBy("station", "block", *by))).where(F.col("_n") >= min_held).drop("_n")


def pseudo_scores(pseudo: DataFrame, by: tuple[str, ...] = ("variable", "period")) -> DataFrame:
    """station, by, n_blocks and per method the median over blocks of the efficiency on held-out years, on the scale of the fit."""
    v = F.when(_is_days(by), F.col("value")).otherwise(F.ln("value"))
    per = pseudo.withColumn("_v", v).groupBy("station", "block", *by).agg(*[(1 - F.try_divide(F.sum(F.col(f"r_{m}") * F.col(f"r_{m}")), F.var_pop("_v") * F.count("*"))).alias(m) for m in METHODS])
    return per.groupBy("station", *by).agg(F.count("*").alias("n_blocks"), *[F.percentile(m, F.lit(0.5)).alias(m) for m in METHODS])


def ordered_rank(rows: DataFrame, by: list[str], value: str, tie: list[str], out: str) -> DataFrame:
    """Rank from 0 of ``value`` within ``by``, without a task per group: rows are cut into ranges of values at approximate quantiles, ranked
    within, and the ranges before are added up. Nulls are left out."""
    kept = rows.where(F.col(value).isNotNull())
    # settled, so that its size is known: a small one is broadcast, and no row is dealt by ``by`` alone
    cuts = settled(kept.groupBy(*by).agg(F.percentile_approx(value, F.lit([i / CUTS for i in range(1, CUTS)]), F.lit(1000)).alias("_cuts")), "cuts")
    dealt = kept.join(cuts, by) if by else kept.crossJoin(F.broadcast(cuts))
    dealt = dealt.withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy(*by, "_range").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*by, "_range").orderBy(value, *tie)
    return dealt.withColumn("_i", F.row_number().over(inside)).join(base, [*by, "_range"]).withColumn(out, (F.col("_base") + F.col("_i") - 1).cast("long")).drop("_base", "_i", "_range")


def quantiles_of_others(rows: DataFrame, group: str, value: str, probabilities: tuple[float, ...], by: list[str] | None = None) -> DataFrame:
    """by, group, q_1, q_2, ...: for each group the quantiles (linear between neighbours) of the values of all other groups.

    Values are ranked once. Of a group's own ranks r_0 < r_1 < ..., r_i - i others lie below the i-th, so the j-th other has rank j
    plus the number of own values with r_i - i <= j: no group is set against the others' rows, and a group's ranks are counted where they
    are once. Null where there are no others.
    """
    by = by or []
    same = [*by, group]
    ranked = settled(ordered_rank(rows.select(*same, F.col(value).alias("_v")), by, "_v", [group], "_rank"), "ranked")  # read three times below
    total = settled(ranked.groupBy(*by).agg(F.count("*").alias("_all")), "totals")  # as the cuts above
    own = Window.partitionBy(*same)
    each = ranked.select(*same, (F.col("_rank") - F.row_number().over(own.orderBy("_rank")) + 1).alias("_below"), F.count("*").over(own).alias("_own"))
    each = each.join(total, by) if by else each.crossJoin(F.broadcast(total))
    # the places of a quantile's two neighbours among the others
    at = [(i, (F.col("_all") - F.col("_own") - 1) * p, end) for i, p in enumerate(probabilities) for end in ("floor", "ceil")]
    place = lambda h, end: getattr(F, end)(h)
    met = each.groupBy(*same).agg(F.max("_all").alias("_all"), F.max("_own").alias("_own"), *[F.count_if(F.col("_below") <= place(h, end)).alias(f"_{end}_{i}") for i, h, end in at])
    part = lambda h, end: 1 - (h - F.floor(h)) if end == "floor" else h - F.floor(h)
    wanted = F.array(*[F.struct(F.lit(i).alias("_i"), (place(h, end) + F.col(f"_{end}_{i}")).alias("_rank"), part(h, end).alias("_share")) for i, h, end in at])
    # a share of 0 asks for nothing; a group without others, or without a name, has no place, but a row
    wanted = met.select(*same, F.explode_outer(F.when(F.col(group).isNotNull() & (F.col("_all") > F.col("_own")), F.filter(wanted, lambda w: w["_share"] > 0))).alias("w")).select(*same, "w.*")
    return wanted.join(ranked.select(*by, "_rank", "_v"), [*by, "_rank"], "left").groupBy(*same).agg(*[F.sum(F.when(F.col("_i") == i, F.col("_share") * F.col("_v"))).alias(f"q_{i + 1}") for i in range(len(probabilities))])


def pseudo_coverage(pseudo: DataFrame, by: tuple[str, ...] = ("variable", "period"), level: float = 0.9) -> DataFrame:
    """by, method, n, coverage: the share of held-out years inside each method's interval: of ols its own, of the others that of the
    other stations' errors. Errors of all methods are ranked in one pass."""
    tails = ((1 - level) / 2, (1 + level) / 2)
    pseudo = settled(pseudo.select(*by, "station", F.col("value").between(F.col("lower"), F.col("upper")).alias("_in"), *[f"r_{m}" for m in METHODS[1:]]), "pseudo")  # read four times below
    errors = pseudo.select(*by, "station", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"r_{m}").alias("_r")) for m in METHODS[1:]])).alias("e")).select(*by, "station", "e.*")
    quantiles = quantiles_of_others(errors, "station", "_r", tails, [*by, "method"])
    inside = errors.join(quantiles, [*by, "method", "station"]).select(*by, "method", F.col("_r").between(F.col("q_1"), F.col("q_2")).alias("_in"))
    covered = [F.count("*").alias("n"), F.avg(F.col("_in").cast("double")).alias("coverage")]
    return pseudo.groupBy(*by).agg(F.lit("ols").alias("method"), *covered).unionByName(inside.groupBy(*by, "method").agg(*covered))
