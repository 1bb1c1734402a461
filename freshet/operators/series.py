"""Station series: readings to days, wide archives, joined records, complete years and monthly climatologies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from freshet.functions.columns import volume_days


def readings_to_days(readings: DataFrame, low: float = -1.0, high: float = 35.0, min_hours: int = 20, default_offset: int = -8 * 3600, first=None, last=None) -> DataFrame:
    """Daily means of hourly means in local standard time: station, date, t_mean, t_min, t_max, n_hours, status.

    ``readings``: station, ts, value, final[, offset_s]. Values outside low..high (both kept) are sentinels; an unknown offset is
    eight hours west. ``first`` and ``last`` bound the local day. A day needs ``min_hours`` hours; it is approved only if every reading is final. Both levels pre-aggregate
    before the shuffle.
    """
    offset = F.coalesce(F.col("offset_s"), F.lit(default_offset)) if "offset_s" in readings.columns else F.lit(default_offset)
    local = F.unix_seconds(F.col("ts").cast("timestamp")) + offset
    kept = readings.where(F.col("value").between(low, high)).select("station", F.floor(local / 3600).alias("_hour"), "value", F.coalesce("final", F.lit(False)).alias("_final"))
    hours = kept.groupBy("station", "_hour").agg(F.avg("value").alias("_m"), F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.min(F.col("_final").cast("int")).alias("_f"))
    days = hours.groupBy("station", F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("_hour") / 24).cast("int")).alias("date")).agg(
        F.avg("_m").alias("t_mean"), F.min("_lo").alias("t_min"), F.max("_hi").alias("t_max"), F.count("*").cast("int").alias("n_hours"), F.min("_f").alias("_f")
    )
    days = days if first is None else days.where(F.col("date") >= F.lit(first).cast("date"))
    days = days if last is None else days.where(F.col("date") <= F.lit(last).cast("date"))
    return days.where(F.col("n_hours") >= min_hours).select("station", "date", "t_mean", "t_min", "t_max", "n_hours", F.when(F.col("_f") == 1, "approved").otherwise("provisional").alias("status"))


def unpivot_days(wide: DataFrame, prefix: str = "f") -> DataFrame:
    """station, date, q from one row per station and month with a column per day; nulls and impossible dates go."""
    stacked = ", ".join(f"{d}, {prefix}{d}" for d in range(1, 32))
    rows = wide.selectExpr("station", "year", "month", f"stack(31, {stacked}) as (day, q)").where("q is not null")
    date = F.expr("try_to_date(format_string('%04d-%02d-%02d', year, month, day))")
    return rows.select("station", date.alias("date"), "q").where("date is not null")


def complete_years(daily: DataFrame, min_days: int = 20, value: str = "q") -> DataFrame:
    """station, year of the years whose twelve months all have at least ``min_days`` values."""
    months = daily.where(F.col(value).isNotNull()).groupBy("station", F.year("date").alias("year"), F.month("date").alias("_m")).agg(F.count("*").alias("_n"))
    return months.where(F.col("_n") >= min_days).groupBy("station", "year").agg(F.count("*").alias("_k")).where("_k = 12").select("station", "year")


def select_stations(stations: DataFrame, years: DataFrame, region: str, min_years: int = 10) -> DataFrame:
    """Unregulated stations of a region with enough complete years: station, n_years."""
    counted = years.groupBy("station").agg(F.count("*").cast("int").alias("n_years")).where(F.col("n_years") >= min_years)
    return stations.where((F.col("regulated") == 0) & (F.col("region") == region)).join(counted, "station").select("station", "n_years")


def monthly_climatology(daily: DataFrame, years: DataFrame, value: str = "q") -> DataFrame:
    """station, month 0..12, q, share from complete years: month means per year, then over years; month 0 is the volume mean."""
    kept = daily.withColumn("year", F.year("date")).join(years, ["station", "year"], "left_semi")
    per_year = kept.groupBy("station", "year", F.month("date").alias("month")).agg(F.avg(value).alias("_q"))
    mean = per_year.groupBy("station", "month").agg(F.avg("_q").alias("q")).withColumn("_vol", F.col("q") * volume_days(F.col("month")))
    months = mean.select("station", "month", "q", F.try_divide(F.col("_vol"), F.sum("_vol").over(Window.partitionBy("station"))).alias("share"))
    annual = mean.groupBy("station").agg((F.sum("_vol") / 365.25).alias("q")).select("station", F.lit(0).alias("month"), "q", F.lit(1.0).alias("share"))
    return months.unionByName(annual)


def annual_from_months(monthly: DataFrame, by: tuple[str, ...] = ("id",), value: str = "q") -> DataFrame:
    """Month 0: the mean of the twelve months, null unless all are there."""
    return monthly.where("month between 1 and 12").groupBy(*by).agg(F.when(F.count(value) == 12, F.avg(value)).alias(value)).select(*by, F.lit(0).alias("month"), value)


def annual_mean_total(daily: DataFrame, by: tuple[str, ...] = ("station",), value: str = "q") -> DataFrame:
    """Mean over complete calendar years of the year's sum, and how many there are."""
    year = F.year("date")
    per = daily.where(F.col(value).isNotNull()).groupBy(*by, year.alias("_y")).agg(F.count("*").alias("_n"), F.sum(value).alias("_t"))
    days = F.datediff(F.make_date(F.col("_y") + 1, F.lit(1), F.lit(1)), F.make_date(F.col("_y"), F.lit(1), F.lit(1)))
    return per.where(F.col("_n") == days).groupBy(*by).agg(F.avg("_t").alias("mean_total"), F.count("*").cast("int").alias("n_years"))


def joined_record(archive: DataFrame, provisional: DataFrame, realtime: DataFrame, first=None, last=None) -> DataFrame:
    """station, date, q, source: the archive, then provisional days after its last one, then real-time days after both.

    Cut-offs come from whole records; ``first`` and ``last`` trim the result only. A later source never fills a hole.
    """
    tagged = [(d.select("station", "date", "q"), s) for d, s in ((archive, "archive"), (provisional, "provisional"), (realtime, "realtime"))]
    record = tagged[0][0].withColumn("source", F.lit(tagged[0][1]))
    for days, source in tagged[1:]:
        end = record.groupBy("station").agg(F.max("date").alias("_end"))
        new = days.join(end, "station", "left").where(F.col("_end").isNull() | (F.col("date") > F.col("_end")))
        record = record.unionByName(new.select("station", "date", "q", F.lit(source).alias("source")))
    if first is not None:
        record = record.where(F.col("date") >= F.lit(first).cast("date"))
    return record if last is None else record.where(F.col("date") <= F.lit(last).cast("date"))


def record_gaps(record: DataFrame) -> DataFrame:
    """station, last_day, next_day, source: seams where a source starts more than a day after the one before ended."""
    order = Window.partitionBy("station").orderBy("date")
    seen = record.select("station", "date", "source", F.lag("date").over(order).alias("_d"), F.lag("source").over(order).alias("_s"))
    return seen.where((F.col("source") != F.col("_s")) & (F.datediff("date", "_d") > 1)).select("station", F.col("_d").alias("last_day"), F.col("date").alias("next_day"), "source")


def year_runs(years: DataFrame, block: int | None = None) -> DataFrame:
    """station, first_year, last_year, n of runs of consecutive years; with ``block``, of whole blocks of so many years."""
    order = Window.partitionBy("station").orderBy("year")
    runs = years.select("station", "year", (F.col("year") - F.row_number().over(order)).alias("_run"))
    if block:
        inside = F.row_number().over(Window.partitionBy("station", "_run").orderBy("year")) - 1
        runs = runs.withColumn("_block", F.floor(inside / block))
    out = runs.groupBy("station", "_run", *(["_block"] if block else [])).agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count("*").cast("int").alias("n"))
    return (out.where(F.col("n") == block) if block else out).select("station", "first_year", "last_year", "n")


def hour_of_extreme(readings: DataFrame) -> DataFrame:
    """station, day, hour_max, hour_min: the earliest hours of the day's largest and smallest value."""
    day = F.to_date("ts")
    rows = readings.select("station", day.alias("day"), F.hour("ts").alias("_h"), "value")
    return rows.groupBy("station", "day").agg((-F.max(F.struct("value", (-F.col("_h")).alias("_h")))["_h"]).alias("hour_max"), F.min(F.struct("value", "_h"))["_h"].alias("hour_min"))


def first_of_files(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, from the first file that has it."""
    return rows.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_i = 1").drop("_i")


def latest_attributes(rows: DataFrame) -> DataFrame:
    """station, last_type, types: the attribute at the latest time and the distinct ones in order."""
    return rows.groupBy("station").agg(F.max_by("kind", "ts").alias("last_kind"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


def value_histogram(rows: DataFrame, top: int = 8) -> DataFrame:
    """value, n of the most frequent values, ties by value."""
    return rows.groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(top)


def approval_status(approval: Column) -> Column:
    """'approved' where the text says final or approved at its start, else 'provisional'; null is provisional."""
    return F.when(F.coalesce(F.regexp_like(approval, F.lit("^(Final|Approved)")), F.lit(False)), "approved").otherwise("provisional")


def feed_days(feed: DataFrame, source: str) -> DataFrame:
    """station, date, q, symbol, source, status of a feed's rows (station, ts, q, symbol, approval): the date is that of UTC."""
    return feed.select(F.col("station").cast("string").alias("station"), F.to_date("ts").alias("date"), F.col("q").cast("double").alias("q"), "symbol", F.lit(source).alias("source"), approval_status(F.col("approval")).alias("status"))


def lag_one(years: DataFrame, min_pairs: int = 3) -> DataFrame:
    """station, n_pairs, r: correlation of a year's value with the next year's, over consecutive years; null with too few pairs."""
    order = Window.partitionBy("station").orderBy("year")
    pairs = years.where("value is not null").select("station", "value", F.lag("value").over(order).alias("_b"), (F.col("year") - F.lag("year").over(order)).alias("_gap"))
    got = pairs.groupBy("station").agg(F.count_if(F.col("_gap") == 1).alias("n_pairs"), F.corr(F.when(F.col("_gap") == 1, F.col("value")), F.when(F.col("_gap") == 1, F.col("_b"))).alias("_r"))
    return got.select("station", "n_pairs", F.when(F.col("n_pairs") >= min_pairs, F.when(~F.isnan("_r"), F.col("_r"))).alias("r"))


def season_flow(months: DataFrame, season: list[int]) -> DataFrame:
    """station, n_years, mean, least of the yearly season flows, each its months' mean weighted by their lengths (28.25 days in
    February). ``months``: station, year, month, q."""
    kept = months.where(F.col("month").isin(season) & F.col("q").isNotNull()).withColumn("_d", volume_days(F.col("month")))
    per = kept.groupBy("station", "year").agg((F.sum(F.col("q") * F.col("_d")) / F.sum("_d")).alias("_q"))
    return per.groupBy("station").agg(F.count("*").alias("n_years"), F.avg("_q").alias("mean"), F.min("_q").alias("least"))


def truth_years(daily: DataFrame, most: int = 2, value: str = "q") -> DataFrame:
    """station, year, n of the years whose first and last day are there and that lack no more than ``most`` days in a row."""
    year = F.year("date")
    d = daily.where(F.col(value).isNotNull()).select("station", "date", year.alias("year"))
    gap = F.datediff("date", F.lag("date").over(Window.partitionBy("station", "year").orderBy("date"))) - 1
    per = d.withColumn("_g", gap).groupBy("station", "year").agg(F.count("*").alias("n"), F.max("_g").alias("_g"), F.min("date").alias("_a"), F.max("date").alias("_b"))
    ends = (F.month("_a") == 1) & (F.dayofmonth("_a") == 1) & (F.month("_b") == 12) & (F.dayofmonth("_b") == 31)
    return per.where(ends & (F.coalesce("_g", F.lit(0)) <= most)).select("station", "year", "n")


def degree_days(daily: DataFrame, value: str = "t", start: float = 5.0, end: float = 4.0, first: str = "03-01", last: str = "11-30") -> DataFrame:
    """station, year, value, n_days: sum of daily means over the growing season, in degree days.

    The season starts with the first day of the first week (seven days from it, all there) whose mean is above ``start``; it ends
    before the first later week whose mean is below ``end``, or with the year's part from ``first`` to ``last``. A day missing inside the season, or before a start that
    another week could have made, leaves the value null; a year without a warm week has 0.
    """
    md = F.date_format("date", "MM-dd")
    kept = daily.where(F.col(value).isNotNull() & md.between(first, last)).select("station", F.year("date").alias("year"), "date", F.col(value).alias("_t"))
    years = kept.groupBy("station", "year").agg(F.count("*").alias("n_days"))
    bound = lambda d: F.to_date(F.concat(F.col("year").cast("string"), F.lit("-"), F.lit(d)))
    grid = years.select("station", "year", F.explode(F.sequence(bound(first), bound(last))).alias("date")).join(kept, ["station", "year", "date"], "left")
    own = Window.partitionBy("station", "year").orderBy("date")
    week = own.rowsBetween(0, 6)
    grid = grid.withColumn("_m", F.when(F.count("_t").over(week) == 7, F.avg("_t").over(week)))
    every = Window.partitionBy("station", "year")
    warm = F.min(F.when(F.col("_m") > start, F.col("date"))).over(every)
    grid = grid.withColumn("_from", warm)
    cold = F.min(F.when((F.col("date") > F.col("_from")) & (F.col("_m") < end), F.col("date"))).over(every)
    grid = grid.withColumn("_to", F.coalesce(cold, F.date_add(bound(last), 1)))
    inside = (F.col("date") >= F.col("_from")) & (F.col("date") < F.col("_to"))
    unsure = (F.col("date") < F.col("_from")) & F.col("_t").isNull() & (F.datediff("_from", "date") <= 7)
    per = grid.groupBy("station", "year").agg(F.sum(F.when(inside, F.col("_t"))).alias("_s"), F.max(F.coalesce((inside & F.col("_t").isNull()) | unsure, F.lit(False))).alias("_cut"), F.max("_from").alias("_from"))
    return years.join(per, ["station", "year"]).select("station", "year", F.when(F.col("_from").isNull(), 0.0).when(~F.col("_cut"), F.col("_s")).alias("value"), "n_days")
