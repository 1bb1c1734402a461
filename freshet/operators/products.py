"""The daily product: monthly flows of segments laid on their watersheds' days, beside routed days, from bucketed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.functions.columns import COMMON_DAYS, month_of_common_day

SECONDS = 86_400
SCHEMA = ("segment", "doy", "runoff_mm", "q_m3s", "coverage", "source", "period", "pick")


def bucketed(df: DataFrame, table: str, key: str, buckets: int) -> DataFrame:
    """``df`` as a table of ``buckets`` buckets by ``key``, sorted within: tables bucketed alike join by that key without a shuffle, each
    time they are read."""
    df.write.bucketBy(buckets, key).sortBy(key).mode("overwrite").format("parquet").saveAsTable(table)
    return df.sparkSession.table(table)


def day_weights(weights: DataFrame, by: str = "id") -> DataFrame:
    """by and its 365 weights as an array. Of ``weights`` (by, doy, weight) with a day missing, twice or null, the array is null."""
    held = weights.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("doy", "weight"))).alias("_d"))
    whole = (F.size("_d") == 365) & (F.transform("_d", lambda d: d["doy"].cast("int")) == F.sequence(F.lit(1), F.lit(365))) & ~F.exists("_d", lambda d: d["weight"].isNull())
    return held.select(by, F.when(whole, F.transform("_d", lambda d: d["weight"])).alias("weights"))


def balance_days(segments: DataFrame, watersheds: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """segment, doy, runoff_mm, q_m3s, coverage, source, period, pick: the monthly means of a segment's watershed on its days.

    ``segments``: segment, id (its watershed), coverage, period, pick; ``watersheds``: id, months (twelve means in m3/s), weights (365, that
    sum to 1 in each month), area (upstream, m2). Nothing but the join by watershed moves rows, and bucketed tables (see ``bucketed``)
    spare that too: the 365 rows a segment are made where its row is. A segment without a watershed, and weights that do not sum to
    1, are errors.
    """
    first, checks = 1, []
    for n in COMMON_DAYS:
        total = F.aggregate(F.slice("weights", first, n), F.lit(0.0), lambda a, w: a + w)
        checks.append(F.abs(total - 1) <= tolerance)
        first += n
    sound = F.coalesce(F.forall(F.array(*checks), lambda c: c), F.lit(False))
    both = segments.join(watersheds, "id", "left")
    guard = F.when(~sound, F.raise_error(F.concat(F.lit("no weights that sum to 1 in each month, for segment "), F.col("segment").cast("string")))).otherwise(F.col("weights"))
    days = both.select("segment", "months", "area", "coverage", "period", "pick", F.posexplode(guard).alias("_at", "_w"))
    month = month_of_common_day(F.col("_at") + 1)
    q = F.element_at("months", month) * F.element_at(F.lit(list(COMMON_DAYS)), month) * F.col("_w")
    return days.select("segment", (F.col("_at") + 1).alias("doy"), (q * SECONDS / F.col("area") * 1000).alias("runoff_mm"), q.alias("q_m3s"), "coverage", F.lit("balance").alias("source"), "period", "pick")


def routed_days(segments: DataFrame, routed: DataFrame) -> DataFrame:
    """The same columns of segments with routed days. ``segments``: segment, area (null off the watershed's own line, so no depth), period,
    pick; ``routed``: segment, doy, q, rounded and clamped already. A segment without all 365 days is an error."""
    held = routed.groupBy("segment").agg(F.array_sort(F.collect_list(F.struct("doy", "q"))).alias("_d"))
    both = segments.join(held, "segment", "left")
    whole = F.coalesce(F.transform("_d", lambda d: d["doy"].cast("int")) == F.sequence(F.lit(1), F.lit(365)), F.lit(False))
    guard = F.when(~whole, F.raise_error(F.concat(F.lit("not all 365 days of segment "), F.col("segment").cast("string")))).otherwise(F.col("_d"))
    days = both.select("segment", "area", "period", "pick", F.explode(guard).alias("_d"))
    q = F.col("_d.q")
    return days.select("segment", F.col("_d.doy").cast("int").alias("doy"), (q * SECONDS / F.col("area") * 1000).alias("runoff_mm"), q.alias("q_m3s"), F.lit(None).cast("double").alias("coverage"), F.lit("routed").alias("source"), "period", "pick")


def month_check(days: DataFrame, months: DataFrame) -> DataFrame:
    """source, n, max_relative: how far the mean of a segment's days of a month lies from the month's value (relative to it). ``months``:
    segment, source, month, q."""
    mean = days.groupBy("segment", "source", month_of_common_day(F.col("doy")).alias("month")).agg(F.avg("q_m3s").alias("_mean"))
    off = F.when((F.col("q") == 0) & (F.col("_mean") == 0), 0.0).otherwise(F.abs(F.col("_mean") - F.col("q")) / F.greatest(F.abs("q"), F.lit(1e-12)))
    return mean.join(months, ["segment", "source", "month"]).groupBy("source").agg(F.count("*").alias("n"), F.max(off).alias("max_relative"))
