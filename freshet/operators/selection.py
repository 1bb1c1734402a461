"""Choice of a model inside cross-validation: each outer fold chooses by an inner one, from sums alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.operators.fits import _centred, _solved, _sums, _uncentred

#: Folds there may be: every pair of them is fitted.
MAX_FOLDS = 2_000


def _fits(sums: DataFrame, y: str, xs: list[str], by: list[str], middle: dict[str, float]) -> DataFrame:
    """by and ``beta``: intercept and slopes as an array. Groups with no more rows than coefficients have none."""
    cols = ["_one", *[f"_c_{x}" for x in xs]]
    solved = _uncentred(_solved(sums.where(F.col("n") > len(cols)), cols, by), y, xs, by, middle)
    return solved.select(*by, F.array("intercept", *[f"b_{x}" for x in xs]).alias("beta"))


def _predicted(xs: list[str]):
    return reduce(lambda a, b: a + b, [F.col(x) * F.get("beta", F.lit(i + 1)) for i, x in enumerate(xs)], F.get("beta", F.lit(0)))


def nested_predictions(rows: DataFrame, y: str, variants: dict[str, list[str]], fold: str = "fold") -> tuple[DataFrame, DataFrame]:
    """(id, fold, chosen, obs, mod; fold, variant, mae of the inner choice).

    For each fold the variant (a name and its predictors) is chosen on the rows of the other folds, by blocked cross-validation among
    these, as that of the smallest mean absolute error in percent (ties: the first given); it is then fitted on them and
    predicts the fold. What a fit without two folds needs is all folds' sums less theirs, so one pass over the rows per variant
    serves the fits of every pair of folds. Rows lacking y or a predictor of any variant are left out; a fold without a usable fit keeps its
    rows with a null ``mod``. Observations of 0 count for no error.
    """
    every = sorted({x for xs in variants.values() for x in xs})
    kept = rows.dropna(subset=[*every, y, fold])
    if kept.select(fold).distinct().limit(MAX_FOLDS + 1).count() > MAX_FOLDS:
        raise ValueError(f"over {MAX_FOLDS} folds")
    outer, errors = None, None
    for turn, (name, xs) in enumerate(variants.items()):
        centred, middle = _centred(kept, y, xs)
        cols = ["_one", *[f"_c_{x}" for x in xs]]
        size = (len(cols) + 1) * (len(cols) + 2) // 2
        per = _sums(centred, f"_c_{y}", cols, [fold])
        total = per.agg(F.sum("n").alias("_n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(size)]).alias("_all"))
        less = lambda a, b: F.zip_with(a, b, lambda p, q: p - q)
        one = per.crossJoin(F.broadcast(total)).select(fold, (F.col("_n") - F.col("n")).alias("n"), less("_all", "sums").alias("sums"))
        # pairs of folds: a row of sums each, MAX_FOLDS squared at most
        a, b = one.select(F.col(fold).alias("_out"), F.col("n").alias("_m"), F.col("sums").alias("_rest")), per.select(F.col(fold).alias("_in"), "n", "sums")
        two = a.join(b, F.col("_out") != F.col("_in")).select("_out", "_in", (F.col("_m") - F.col("n")).alias("n"), less("_rest", "sums").alias("sums"))
        inner = _fits(two, y, xs, ["_out", "_in"], middle)
        tried = kept.join(inner, kept[fold] == inner["_in"]).select("_out", F.abs(100 * F.try_divide(_predicted(xs) - F.col(y), F.col(y))).alias("_e"))
        scored = tried.groupBy("_out").agg(F.avg("_e").alias("mae")).select(F.col("_out").alias(fold), F.lit(name).alias("variant"), F.lit(turn).alias("_turn"), "mae")
        found = _fits(one, y, xs, [fold], middle).select(fold, F.lit(name).alias("variant"), "beta")
        errors = scored if errors is None else errors.unionByName(scored)
        outer = found if outer is None else outer.unionByName(found)
    chosen = errors.where("mae is not null").groupBy(fold).agg(F.min(F.struct("mae", "_turn", "variant"))["variant"].alias("chosen"))
    fits = chosen.join(outer, (chosen[fold] == outer[fold]) & (chosen["chosen"] == outer["variant"])).select(chosen[fold], "chosen", "beta")
    value = None
    for name, xs in variants.items():
        value = F.when(F.col("chosen") == name, _predicted(xs)) if value is None else value.when(F.col("chosen") == name, _predicted(xs))
    predicted = kept.join(fits, fold, "left").select("id", fold, "chosen", F.col(y).alias("obs"), value.alias("mod"))
    return predicted, errors.drop("_turn")
