"""Column helpers: NULL-safe arithmetic, calendar pieces, units and closed formulas of hydrology."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days of the months with a February of 28.25 days, used for volumes (fixed values).
VOLUME_DAYS = (31, 28.25, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
#: Days of the months of a common year (fixed values).
COMMON_DAYS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)


def no_nan(x: Column) -> Column:
    """NaN counts as no data."""
    return F.when(~F.isnan(x), x)


def at_least(x: Column, low: float) -> Column:
    """max(x, low) that keeps NULL."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(low)))


def month_day(date: Column) -> Column:
    return F.date_format(date, "MM-dd")


def common_day(date: Column) -> Column:
    """Day 1..365 of a common year; 29 February is 28 February."""
    day = F.dayofyear(date)
    leap = F.dayofyear(F.make_date(F.year(date), F.lit(12), F.lit(31))) == 366
    return F.when(leap & (day >= 60), day - 1).otherwise(day)


def month_of_common_day(day: Column) -> Column:
    out, first = F.lit(1), 1
    for month, n in enumerate(COMMON_DAYS, 1):
        out = F.when(day >= first, month).otherwise(out)
        first += n
    return out.cast("int")


def volume_days(month: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(d)) for d in VOLUME_DAYS]), month.cast("int"))


def depth_to_flow(mm: Column, area_m2: Column, days: Column) -> Column:
    """Depth over an area in a number of days, as cubic metres a second."""
    return mm * area_m2 / 1000 / (days * 86400)


def flow_to_depth(flow: Column, area_m2: Column, days: Column) -> Column:
    return F.try_divide(flow * days * 86400 * 1000, area_m2)


def fu_evaporation(p: Column, e: Column, w: float) -> Column:
    """Actual evaporation of precipitation p and potential evaporation e, p + e - (p^w + e^w)^(1/w); negatives count as 0."""
    if w <= 1:
        raise ValueError("the shape is over 1")
    p, e = at_least(p, 0.0), at_least(e, 0.0)
    return p + e - F.pow(F.pow(p, F.lit(w)) + F.pow(e, F.lit(w)), F.lit(1 / w))


def extraterrestrial_radiation(latitude: Column, day: Column) -> Column:
    """MJ per square metre and day (FAO paper 56)."""
    phi = F.radians(latitude)
    near = 1 + 0.033 * F.cos(2 * math.pi * day / 365)
    tilt = 0.409 * F.sin(2 * math.pi * day / 365 - 1.39)
    sunset = F.acos(F.greatest(F.least(-F.tan(phi) * F.tan(tilt), F.lit(1.0)), F.lit(-1.0)))
    return 24 * 60 / math.pi * 0.0820 * near * (sunset * F.sin(phi) * F.sin(tilt) + F.cos(phi) * F.cos(tilt) * F.sin(sunset))


def hargreaves(t_min: Column, t_max: Column, latitude: Column, day: Column) -> Column:
    """Reference evaporation in mm a day, never negative."""
    mean, spread = (t_min + t_max) / 2, at_least(t_max - t_min, 0.0)
    return at_least(0.0023 * 0.408 * extraterrestrial_radiation(latitude, day) * (mean + 17.8) * F.sqrt(spread), 0.0)


def under(code: Column, root: Column) -> Column:
    """``code`` is ``root`` or lies below it: a prefix that ends at a label."""
    return (code == root) | F.startswith(code, F.concat(root, F.lit(".")))


def upstream_of(w: Column, lo: Column, w2: Column, lo2: Column) -> Column:
    """(w2, lo2) lies upstream of (w, lo), codes compared by bytes. On a stream's own code everything under both codes does;
    above a point of a stream, what joins it farther up (w2 beyond lo, not under it) and the stream's own rows from lo on."""
    beyond = (w2 > lo) & ~under(w2, lo) & under(lo2, w) & (lo2 > lo)
    own = (w2 == w) & (lo2 >= lo)
    return F.when(w == lo, under(w2, w) & under(lo2, w)).otherwise(under(w2, w) & (beyond | own))


def ancestors(code: Column) -> Column:
    """The code's prefixes at label ends, itself included: three digits, then seven characters a level."""
    levels = F.sequence(F.lit(0), F.floor((F.length(code) - 3) / 7).cast("int"))
    return F.transform(levels, lambda k: F.substr(code, F.lit(1), 3 + 7 * k))


def refuse(bad: Column, message: str | Column, otherwise: Column) -> Column:
    """``otherwise``; where ``bad`` holds, an error when the row is read."""
    return F.when(bad, F.raise_error(F.lit(message) if isinstance(message, str) else message)).otherwise(otherwise)


def normal_tail(z: Column) -> Column:
    """Probability that a standard normal value lies beyond |z| on either side: the five-term polynomial in 1 / (1 + 0.2316419 |z|), error
    under 2e-7 (its coefficients are fixed values)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return 2 * F.exp(-z * z / 2) * 0.3989422804014327 * poly
