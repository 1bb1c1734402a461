"""Departures of stations from their normal, composed of the library's operators."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.operators import series, windows
from freshet.operators.models import trend_significance

#: Months whose provisional flow is not corrected for ice.
ICE_MONTHS = (11, 12, 1, 2, 3, 4)


def touches_ice(start: str, end: str) -> bool:
    """Whether a window of month-days (both ends in it, over New Year if it ends before it starts) has a day of an ice month."""
    at = date.fromisoformat(f"2001-{start}")
    last = date.fromisoformat(f"{2002 if end < start else 2001}-{'02-28' if end == '02-29' else end}")
    days = (last - at).days
    return any((at + timedelta(i)).month in ICE_MONTHS for i in range(days + 1))


def mean_discharge(daily: DataFrame, base: tuple[int, int], min_years: int = 5) -> DataFrame:
    """station, q, n_years, from_base: mean annual discharge over the complete years of ``base``, if there are ``min_years``, otherwise over
    all complete years, if these are; stations with fewer are left out."""
    years = series.complete_years(daily)
    counted = years.groupBy("station").agg(F.count("*").alias("_all"), F.count_if(F.col("year").between(*base)).alias("_base")).where(F.col("_all") >= min_years)
    counted = counted.withColumn("from_base", F.col("_base") >= min_years)
    used = years.join(counted, "station").where(~F.col("from_base") | F.col("year").between(*base)).select("station", "year")
    annual = series.monthly_climatology(daily, used).where("month = 0").select("station", "q")
    return annual.join(counted.select("station", F.when(F.col("from_base"), F.col("_base")).otherwise(F.col("_all")).alias("n_years"), "from_base"), "station")


def departures(daily: DataFrame, spans: list[tuple[str, str, str]], base: tuple[int, int], variables: tuple[str, ...] = ("mean", "min7", "frac_below"), min_baseline: int = 10, min_years: int = 5, share: float = 0.2, trend_start: int | None = None, min_frac: float = 0.8) -> DataFrame:
    """station, variable, period, year, value, normal, n_base, anomaly, n_days, frac_ice, frac_provisional, slope, p, n_trend.

    Statistics of each window and year (``frac_below``: of ``share`` of the station's mean annual discharge; none for stations without
    it). A window that touches November to April keeps no year with a provisional day. A series takes part with ``min_baseline`` baseline
    years: its anomaly is the percentage above or below the mean of these, of shares and days the difference. slope and p are those
    of its anomalies since ``trend_start``. ``daily``: station, date, q, and symbol and status if known. One plan: days are
    scanned for the statistics and for the complete years, all else works on a row per window and year.
    """
    level = mean_discharge(daily, base, min_years).select("station", (F.col("q") * share).alias("threshold"))
    stats = windows.window_stats(daily, spans, threshold=level, min_frac=min_frac)
    icy = [name for name, start, end in spans if touches_ice(start, end)]
    kept = stats.where(~(F.col("period").isin(icy) & (F.coalesce("frac_provisional", F.lit(0.0)) > 0)))
    each = F.explode(F.array(*[F.struct(F.lit(f"q_{v}").alias("variable"), F.col(v).cast("double").alias("value"), F.lit(v in ("frac_below", "cov_day")).alias("absolute")) for v in variables])).alias("v")
    rows = kept.select("station", "period", "year", "n_days", "frac_ice", "frac_provisional", each).select("station", "period", "year", "n_days", "frac_ice", "frac_provisional", "v.*").where("value is not null")
    key = ["station", "variable", "period"]
    in_base = F.col("year").between(*base)
    normal = rows.groupBy(*key).agg(F.avg(F.when(in_base, F.col("value"))).alias("normal"), F.count_if(in_base).alias("n_base")).where(F.col("n_base") >= min_baseline)
    change = F.when(F.col("absolute"), F.col("value") - F.col("normal")).otherwise(100 * F.try_divide(F.col("value") - F.col("normal"), F.col("normal")))
    moved = rows.join(normal, key).select(*key, "year", "value", "normal", "n_base", change.alias("anomaly"), "n_days", "frac_ice", "frac_provisional")
    since = moved if trend_start is None else moved.where(F.col("year") >= trend_start)
    found = trend_significance(since.select(F.struct(*key).alias("station"), "year", F.col("anomaly").alias("value"))).select(*[F.col("station")[k].alias(k) for k in key], "slope", "p", F.col("n").alias("n_trend"))
    return moved.join(found, key, "left")
