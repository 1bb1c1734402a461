"""Statistics and climatologies over month-day windows of the calendar."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from freshet.functions.columns import COMMON_DAYS, common_day, month_day, month_of_common_day, no_nan

WINDOW_SCHEMA = "period string, start string, end string"
STATS = ("mean", "min", "max", "min7", "frac_below", "cov_day")


def check_windows(windows: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """Names are unique, month-days valid, and none starts on 29 February."""
    names = [w[0] for w in windows]
    if len(set(names)) < len(names):
        raise ValueError("window names repeat")
    for name, start, end in windows:
        for md in (start, end):
            if not re.fullmatch(r"\d\d-\d\d", md) or not 1 <= int(md[:2]) <= 12 or not 1 <= int(md[3:]) <= COMMON_DAYS[int(md[:2]) - 1] + (md[:2] == "02"):
                raise ValueError(f"window {name}: {md} is no month and day")
        if start == "02-29":
            raise ValueError(f"window {name} starts on 29 February")
    return windows


def calendar() -> list[tuple[str, str, str]]:
    """The twelve months and the four seasons; an end of 02-29 is the last day of February."""
    months = "jan feb mar apr may jun jul aug sep oct nov dec".split()
    ends = [f"{m:02d}-{n + (m == 2):02d}" for m, n in enumerate(COMMON_DAYS, 1)]
    rows = [(name, f"{m:02d}-01", ends[m - 1]) for m, name in enumerate(months, 1)]
    return rows + [("djf", "12-01", "02-29"), ("mam", "03-01", "05-31"), ("jja", "06-01", "08-31"), ("son", "09-01", "11-30")]


def calendar_windows(spark: SparkSession) -> DataFrame:
    """``calendar`` as a table."""
    return spark.createDataFrame(calendar(), WINDOW_SCHEMA)


def windows_of_record(daily: DataFrame, windows: list[tuple[str, str, str]], by: tuple[str, ...] = ("station",), value: str = "q") -> DataFrame:
    """Per series and window, its month-days, in how many of its years the record has a day, how many of these have every day, and the days
    that are there and that are lacking. A day given twice counts once."""
    by = list(by)
    days = in_windows(daily, windows, by, value).groupBy(*by, "period", "_s", "_e", "year", "_from", "_to").agg(F.countDistinct("date").alias("_n"))
    length = F.datediff("_to", "_from") + 1
    return days.groupBy(*by, "period", F.col("_s").alias("start"), F.col("_e").alias("end")).agg(
        F.count("*").alias("years"), F.count_if(F.col("_n") == length).alias("complete"), F.sum("_n").alias("days"), F.sum(length - F.col("_n")).alias("lacking"),
    )


def _day(year: Column, md: Column) -> Column:
    """The date of a month-day; 02-29 is the last day of February."""
    first = F.make_date(year, F.substr(md, F.lit(1), F.lit(2)).cast("int"), F.lit(1))
    return F.when(md == "02-29", F.last_day(first)).otherwise(F.date_add(first, F.substr(md, F.lit(4), F.lit(2)).cast("int") - 1))


def in_windows(daily: DataFrame, windows: list[tuple[str, str, str]], by: list[str], value: str) -> DataFrame:
    """Each day once per window that holds it, with the window's year (that of its start), first and last day. Windows are
    constants in the plan: no join. Window-years that leave the series' first to last day with a value are dropped."""
    days = daily.withColumn(value, no_nan(F.col(value).cast("double"))).where(F.col(value).isNotNull())
    span = days.groupBy(*by).agg(F.min("date").alias("_first"), F.max("date").alias("_last"))
    listed = F.array(*[F.struct(F.lit(n).alias("period"), F.lit(s).alias("_s"), F.lit(e).alias("_e")) for n, s, e in check_windows(windows)])
    md, crosses = month_day(F.col("date")), F.col("_e") < F.col("_s")
    inside = F.when(crosses, (md >= F.col("_s")) | (md <= F.col("_e"))).otherwise((md >= F.col("_s")) & (md <= F.col("_e")))
    out = days.select("*", F.inline(listed)).where(inside)
    out = out.withColumn("year", F.year("date") - F.when(crosses & (md <= F.col("_e")), 1).otherwise(0))
    out = out.withColumn("_from", _day(F.col("year"), F.col("_s"))).withColumn("_to", _day(F.col("year") + crosses.cast("int"), F.col("_e")))
    return out.join(span, by).where((F.col("_from") >= F.col("_first")) & (F.col("_to") <= F.col("_last")))


def window_stats(daily: DataFrame, windows: list[tuple[str, str, str]], by: tuple[str, ...] = ("station",), value: str = "q", threshold: float | DataFrame | None = None, min_frac: float = 0.8) -> DataFrame:
    """One row per series, window and year: n_days, mean, min, max, min7, frac_below, cov_day, frac_ice, frac_provisional.

    A window-year needs values on at least ``min_frac`` of its days. min7: least mean of seven consecutive days, all present
    and inside the window. frac_below: share of days strictly below ``threshold``, a number or a row per series (by, threshold). cov_day: first day (from 1) by which half of
    the total has passed, of complete windows with a positive total. frac_ice and frac_provisional are null without a symbol or
    status column. NULL and NaN values are no data; a repeated day of a series is an error.
    """
    by = list(by)
    days = in_windows(daily, windows, by, value)
    keys = [*by, "period", "year"]
    if isinstance(threshold, DataFrame):
        days = days.join(threshold.select(*by, F.col("threshold").alias("_thr")), by, "left")
    else:
        days = days.withColumn("_thr", F.lit(threshold).cast("double"))
    n = F.datediff("date", "_from") + 1
    seven = Window.partitionBy(*keys).orderBy("_n").rangeBetween(-6, 0)
    upto = Window.partitionBy(*keys).orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*keys)
    days = days.withColumn("_n", n.cast("int")).select(
        "*", F.when(F.count(value).over(seven) == 7, F.avg(value).over(seven)).alias("_m7"), F.sum(value).over(upto).alias("_run"), F.sum(value).over(every).alias("_total"),
        (F.lag("_n").over(Window.partitionBy(*keys).orderBy("_n")) == F.col("_n")).alias("_twice"),
    )
    length = (F.datediff("_to", "_from") + 1).cast("int")
    flag = lambda column, is_: F.avg((F.coalesce(F.col(column) == is_, F.lit(False))).cast("double")) if column in daily.columns else F.lit(None).cast("double")
    out = days.groupBy(*keys).agg(
        F.when(F.max("_twice"), F.raise_error(F.lit("a day of a series repeats"))).otherwise(F.count(value).cast("int")).alias("n_days"), F.max(length).alias("_length"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.min("_m7").alias("min7"),
        F.avg((F.col(value) < F.col("_thr")).cast("double")).alias("frac_below"),
        F.min(F.when((F.col("_total") > 0) & (F.col("_run") >= F.col("_total") / 2), F.col("_n"))).alias("_half"),
        flag("symbol", "B").alias("frac_ice"), flag("status", "provisional").alias("frac_provisional"),
    )
    return out.where(F.col("n_days") >= min_frac * F.col("_length")).select(
        *keys, "n_days", "mean", "min", "max", "min7", "frac_below", F.when(F.col("n_days") == F.col("_length"), F.col("_half")).alias("cov_day"), "frac_ice", "frac_provisional"
    )


def as_long(stats: DataFrame, prefix: str = "", by: tuple[str, ...] = ("station",), unit: str | None = None) -> DataFrame:
    """One row per statistic that is there: variable, value, what kind of anomaly it has and, where ``unit`` names that of the
    values, its unit (shares have none, cov_day counts days)."""
    kind = F.when(F.col("stat") == "cov_day", "absolute").when(F.col("stat") == "frac_below", "absolute").otherwise("percent")
    stacked = ", ".join(f"'{s}', cast({s} as double)" for s in STATS)
    rows = stats.selectExpr(*by, "period", "year", "n_days", f"stack({len(STATS)}, {stacked}) as (stat, value)").where("value is not null")
    own = F.when(F.col("stat") == "cov_day", "day").when(F.col("stat") == "frac_below", "").otherwise(unit or "")
    return rows.select(*by, F.concat(F.lit(prefix), "stat").alias("variable"), "period", "year", "value", kind.alias("anomaly_type"), "n_days", *([own.alias("unit")] if unit else []))


def climatology_windows(values: DataFrame, windows: list[tuple[str, str, str]], by: tuple[str, ...] = ("id",), value: str = "q") -> DataFrame:
    """Mean over each window of a common year from a monthly (month; 0, the annual value, is ignored) or day-of-year climatology (doy).

    A day takes its month's value. The value is null if that of any day is missing. ``basis`` says which input it was.
    """
    by, monthly = list(by), "month" in values.columns
    days = []
    starts = [sum(COMMON_DAYS[:m]) for m in range(12)]
    for name, start, end in check_windows(windows):
        a = starts[int(start[:2]) - 1] + int(start[3:])
        b = starts[int(end[:2]) - 1] + min(int(end[3:]), COMMON_DAYS[int(end[:2]) - 1])
        days += [(name, d) for d in (range(a, b + 1) if a <= b else [*range(a, 366), *range(1, b + 1)])]
    spark = values.sparkSession
    wanted = spark.createDataFrame(days, "period string, doy int")
    if monthly:
        wanted = wanted.withColumn("month", month_of_common_day(F.col("doy"))).groupBy("period", "month").agg(F.count("*").alias("_days"))
        key = "month"
    else:
        wanted, key = wanted.withColumn("_days", F.lit(1)), "doy"
    need = wanted.groupBy("period").agg(F.sum("_days").alias("_need"))
    v = no_nan(F.col(value).cast("double"))
    got = values.join(F.broadcast(wanted), key).groupBy(*by, "period").agg(F.sum(F.when(v.isNotNull(), F.col("_days"))).alias("_have"), F.sum(v * F.col("_days")).alias("_sum"))
    every = values.select(*by).distinct().crossJoin(F.broadcast(need))  # a handful of windows
    return every.join(got, [*by, "period"], "left").select(
        *by, "period", F.when(F.col("_have") == F.col("_need"), F.col("_sum") / F.col("_need")).alias("value"), F.lit("monthly" if monthly else "daily").alias("basis")
    )


def day_climatology(daily: DataFrame, by: tuple[str, ...] = ("station",), value: str = "q") -> DataFrame:
    """Mean per day 1..365 of a common year; 29 February is folded into the 28th within its year first; share of the year's
    sum. A missing day is interpolated on the circle between its neighbours."""
    by = list(by)
    per_year = daily.where(F.col(value).isNotNull()).groupBy(*by, F.year("date").alias("_y"), common_day(F.col("date")).cast("int").alias("doy")).agg(F.avg(value).alias("_v"))
    mean = per_year.groupBy(*by, "doy").agg(F.avg("_v").alias("_v"))
    grid = mean.select(*by).distinct().select("*", F.explode(F.sequence(F.lit(1), F.lit(365))).alias("doy"))
    full = grid.join(mean, [*by, "doy"], "left")
    round_ = full.select(*by, "_v", F.explode(F.array(F.col("doy") - 365, F.col("doy"), F.col("doy") + 365)).alias("_at"))
    order = Window.partitionBy(*by).orderBy("_at")
    back, on = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("_v").isNotNull(), F.struct(F.col("_at").alias("at"), F.col("_v").alias("v")))
    round_ = round_.select(*by, "_at", F.last(known, True).over(back).alias("_a"), F.first(known, True).over(on).alias("_b")).where("_at between 1 and 365")
    width = F.col("_b.at") - F.col("_a.at")
    v = F.when(width == 0, F.col("_a.v")).otherwise(F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col("_at") - F.col("_a.at")) / F.nullif(width, F.lit(0)))
    return round_.select(*by, F.col("_at").alias("doy"), v.alias("q")).withColumn("share", F.try_divide(F.col("q"), F.sum("q").over(Window.partitionBy(*by))))
