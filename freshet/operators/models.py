"""Donor searches, carried and extended records, validation, trends and simple fitted models over station statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from freshet.functions.columns import normal_tail, refuse
from freshet.operators import blocks
from freshet.sources.shared import settled

#: Targets that meet all donors in one task at least, where each result is a list of its donors.
CARRIED = 50
#: Stations of the same years from which on they are a group, and of one side that are set against another group at once.
ALIKE, WIDTH = 64, 4_096
#: Targets whose weights a task has at once.
TARGETS = 32
#: Bytes of lists that a task keeps, and that it hands on together.
LISTS, LISTED = 1 << 26, 1 << 22


def donor_mean(targets: DataFrame, donors: DataFrame, features: list[str], value: str, k: int = 5) -> DataFrame:
    """id, value: inverse-distance mean over the k nearest donors. Weights 1 / (d + 1e-6 m), m the median distance to all donors;
    donors within 1e-9 m share all weight. A null feature gives null. Targets are dealt in blocks, each of which meets the numbers of
    all donors in a task, as the median is over all distances: no row per pair is made."""
    numbers = lambda df, v: df.select("id", *[F.col(f).cast("double").alias(f) for f in features], v.cast("double").alias("_v"))
    d, t = numbers(donors, F.col(value)).dropna(), numbers(targets, F.lit(0.0)).dropna().dropDuplicates(["id"])

    def run(x: pa.Table, y: pa.Table) -> Iterator[pa.RecordBatch]:
        a, b = ([t.column(f).to_numpy() for f in features] for t in (x, y))
        v, out = y.column("_v").to_numpy(), np.empty(x.num_rows)
        few = min(k, len(v))
        for i in range(x.num_rows):
            far = np.sqrt(sum((p[i] - q) * (p[i] - q) for p, q in zip(a, b)))
            middle = np.median(far)
            # donors come by id, so of those as far as the last of the k the first ones are taken
            last = np.partition(far, few - 1)[few - 1]
            near = np.flatnonzero(far < last)
            near = np.concatenate([near, np.flatnonzero(far == last)[: few - len(near)]])
            same = far[near] <= 1e-9 * middle
            w = same.astype(float) if same.any() else 1 / (far[near] + 1e-6 * middle)
            out[i] = (w * v[near]).sum() / w.sum()
        yield pa.RecordBatch.from_arrays([x.column("id").combine_chunks(), pa.array(out)], ["id", "value"])

    got = blocks.against_all(t, d, F.col("id"), run, f"id {targets.schema['id'].dataType.simpleString()}, value double", blocks.BLOCK)
    return targets.select("id").join(got, "id", "left")


def donor_correlations(years: DataFrame, min_years: int = 30, digits: int | None = None) -> DataFrame:
    """target, donor, r: correlation of yearly values over the shared years, 0 with fewer than ``min_years`` of them, never
    negative; rounded to ``digits`` in the tasks, where they are given. ``years``: station, year, value. Every station is set against every
    other, block by block in the tasks: what is sent grows with the stations, not with the pairs."""
    held, told = _records(years.where("year is not null"), F.lit(True))
    dealt, n = blocks.dealt(held, "station", most=blocks.across(held))

    def run(x: pa.Table, y: pa.Table) -> Iterator[pa.RecordBatch]:
        right = [part for rows in _alike(y, told) for part in rows.parts(WIDTH)]
        for a in _alike(x, told):
            for b in right:
                shared = (a.had & b.had).sum() if a.same and b.same else None
                if shared == 0:
                    continue
                if shared is not None and shared >= min_years:
                    both = a.have & b.have
                    p, q = blocks.standard(a.value[:, both]), blocks.standard(b.value[:, both]).T
                own = pc.index_in(a.name, value_set=b.name).fill_null(-1).to_numpy()
                size = max(1, blocks.TILE // len(b.name))
                donor = pa.concat_arrays([b.name] * min(size, len(a.name)))
                for at in range(0, len(a.name), size):
                    rows = slice(at, at + size)
                    if shared is None:
                        _, r = blocks.correlations(a.value[rows], b.value)
                        years_of_both = a.each()[rows] @ b.each().T
                        r, keep = np.where(years_of_both >= min_years, r, 0.0), years_of_both > 0
                    else:
                        r, keep = p[rows] @ q if shared >= min_years else np.zeros((len(own[rows]), len(b.name))), None
                    np.maximum(r, 0.0, out=r)
                    if digits is not None:
                        r *= 10**digits
                        r += 0.5
                        np.floor(r, out=r)
                        r /= 10**digits
                    me = np.flatnonzero(own[rows] >= 0)
                    if len(me):
                        keep = np.ones(r.shape, bool) if keep is None else keep
                        keep[me, own[rows][me]] = False
                    target = pa.concat_arrays([pa.repeat(name, len(b.name)) for name in a.name[rows]])
                    got = pa.RecordBatch.from_arrays([target, donor[: r.size], pa.array(r.ravel())], ["target", "donor", "r"])
                    yield got if keep is None or keep.all() else got.filter(pa.array(keep.ravel()))

    kind = years.schema["station"].dataType.simpleString()
    return blocks.met(dealt, dealt, run, f"target {kind}, donor {kind}, r double", n)


class _Rows(NamedTuple):
    """Stations: their values (NaN: none), and the years that they have, with a value or not; as one row for all of them if ``same``."""

    name: pa.Array
    value: np.ndarray
    had: np.ndarray
    have: np.ndarray
    same: bool

    def each(self) -> np.ndarray:
        return np.broadcast_to(self.had, self.value.shape).astype(float)

    def parts(self, size: int) -> list:
        cut = lambda of, i: of if self.same else of[i : i + size]
        return [_Rows(self.name[i : i + size], self.value[i : i + size], cut(self.had, i), cut(self.have, i), self.same) for i in range(0, len(self.name), size)]


def _alike(table: pa.Table, told: list) -> list[_Rows]:
    """Stations of the same years together, and those whose years few others have."""
    value, name = blocks.matrix(table.column("_year"), table.column("_v"), told), table.column("station").combine_chunks()
    # a station without a value in a year has that year all the same
    had, have = np.zeros(value.shape, bool), ~np.isnan(value)
    had[blocks.places(table.column("_year"), told)] = True
    _, first, kind, count = np.unique(np.packbits(np.hstack([had, have]), axis=1), axis=0, return_index=True, return_inverse=True, return_counts=True)
    kind = kind.ravel()
    out = [_Rows(name.take(pa.array(at)), value[at], had[first[k]], have[first[k]], True) for k in np.flatnonzero(count >= ALIKE) for at in [np.flatnonzero(kind == k)]]
    rest = np.flatnonzero(count[kind] < ALIKE)
    return out + ([_Rows(name.take(pa.array(rest)), value[rest], had[rest], have[rest], False)] if len(rest) else [])


def _records(years: DataFrame, has: Column) -> tuple[DataFrame, list]:
    """station, _year, _v: a row per station with its years that have ``has`` and their values (NaN: none), and all such years in order. A
    station without any stays, with empty lists. ``years`` is read once."""
    held = years.where("station is not null").groupBy("station").agg(F.collect_list(F.when(has, F.struct("year", F.col("value").cast("double").alias("value")))).alias("_r"))
    again = F.size(F.array_distinct("_r.year")) < F.size("_r")
    held = held.select("station", refuse(again, "more than one value of a station and year", F.col("_r")).alias("_r"))
    held = settled(held.select("station", F.col("_r.year").alias("_year"), F.transform("_r", lambda r: F.coalesce(r["value"], F.lit(float("nan")))).alias("_v")), "records")
    told = [r[0] for r in held.select(F.explode("_year")).distinct().collect()]
    return held, sorted(told, key=lambda year: (year is not None, year))


class _Lists:
    """The names at the places of a mask, joined by commas. Lists that differ in one place only, as those of targets that are no donors of their own
    do, are joined once and cut: the last ones are kept, up to ``LISTS`` bytes."""

    def __init__(self, names: list[str]):
        self.names, self.kept, self.bytes = np.array([n.encode() for n in names] + [None], object)[:-1], {}, 0

    def _get(self, mask: np.ndarray) -> tuple[bytes, bytes | None]:
        key = np.packbits(mask).tobytes()
        text = self.kept.pop(key, None)
        if text is not None:
            self.kept[key] = text
        return key, text

    def _keep(self, key: bytes, text: bytes) -> None:
        self.kept[key] = text
        self.bytes += len(key) + len(text)
        while self.bytes > LISTS and len(self.kept) > 2:
            old = next(iter(self.kept))
            self.bytes -= len(old) + len(self.kept.pop(old))

    def _cut(self, text: bytes, own: int) -> bytes:
        at = text.index(b"," + self.names[own] + b",")
        return text[:at] + text[at + len(self.names[own]) + 1 :]

    def __call__(self, mask: np.ndarray, own: int | None) -> bytes:
        """Of ``mask``; ``own`` is a place that may be the one in which it differs."""
        key, text = self._get(mask)
        if text is None and (own is None or mask[own]):
            text = b"," + b",".join(self.names[mask]) + b","
            self._keep(key, text)
        elif text is None:
            mask[own] = True
            wide, text = self._get(mask)
            known = text is not None
            text = text if known else b"," + b",".join(self.names[mask]) + b","
            mask[own] = False
            if not known:
                self._keep(wide, text)
            text = self._cut(text, own)
            if not known:
                self._keep(key, text)
        return text[1:-1]


def carry_from_all(years: DataFrame, weight: Callable, base: tuple[int, int], min_years: int = 10) -> DataFrame:
    """What ``carry_departures`` gives if every station takes every station that ``weight`` gives it: a function of the numbers of targets
    (a column) and donors (a row) that gives a matrix, 0 for those that are none. Stations are numbers as text. Targets are dealt in
    blocks that meet the yearly ratios of all donors in a task, as each result names all its donors."""
    own = Window.partitionBy("station")
    kept = F.when(F.col("value") > 0, F.col("value"))
    at_base = F.when(F.col("year").between(*base), kept)
    seen = years.select("station", "year", kept.alias("value"), F.avg(at_base).over(own).alias("_base"), F.count(at_base).over(own).alias("_n"))
    log = F.when(F.col("_n") >= min_years, F.ln(F.col("value") / F.col("_base")))
    held, told = _records(seen.select("station", "year", log.alias("value"), F.col("value").isNotNull().alias("_has")), F.col("_has"))
    donors = held.where(F.exists("_v", lambda v: ~F.isnan(v)))
    targets = held.select("station", *[F.array().cast(held.schema[c].dataType).alias(c) for c in ("_year", "_v")])

    def run(x: pa.Table, y: pa.Table) -> Iterator[pa.RecordBatch]:
        value = blocks.matrix(y.column("_year"), y.column("_v"), told)
        have, far = ~np.isnan(value), np.isposinf(value)
        figures = np.hstack([np.where(have & ~far, value, 0.0), have])
        mine, theirs = (t.column("station").cast(pa.int64()).to_numpy() for t in (x, y))
        named, place = x.column("station").to_pylist(), pc.index_in(x.column("station"), value_set=y.column("station").combine_chunks()).to_pylist()
        # years that the same donors have share their lists
        first = {}
        kind = [first.setdefault(np.packbits(h).tobytes(), k) for k, h in enumerate(have.T)]
        lists = _Lists(y.column("station").to_pylist())
        rows, size, step = [], 0, blocks.TILE // TARGETS
        for at in range(0, len(mine), TARGETS):
            t = mine[at : at + TARGETS, None]
            chosen, total, beyond = np.zeros((len(t), len(theirs)), bool), np.zeros((len(t), 2 * len(told))), np.zeros((len(t), len(told)), bool)
            for i in range(0, len(theirs), step):
                w = weight(t, theirs[None, i : i + step])
                chosen[:, i : i + step] = take = w > 0
                total += np.where(take, w, 0.0) @ figures[i : i + step]
                if far[i : i + step].any():
                    beyond |= (take.astype(float) @ far[i : i + step]) > 0
            for j, c in enumerate(chosen):
                texts = {}
                for k in np.flatnonzero(total[j, len(told) :] > 0):
                    if kind[k] not in texts:
                        texts[kind[k]] = lists(c & have[:, kind[k]], place[at + j])
                    text = texts[kind[k]]
                    rows.append((named[at + j], told[k], np.inf if beyond[j, k] else total[j, k] / total[j, len(told) + k], text))
                    size += len(text)
                if rows and (size > LISTED or len(rows) >= blocks.BLOCK):
                    yield _carried(rows)
                    rows, size = [], 0
        if rows:
            yield _carried(rows)

    got = blocks.against_all(targets, donors, F.col("station"), run, "target string, year int, log_ratio double, donors string", CARRIED)
    return got.select("target", "year", "log_ratio", (100 * F.exp("log_ratio")).alias("pct_normal"), "donors")


def _carried(rows: list[tuple]) -> pa.RecordBatch:
    target, year, log, donors = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(target, pa.string()), pa.array(year, pa.int32()), pa.array(log, pa.float64()), pa.array(donors, pa.string())], ["target", "year", "log_ratio", "donors"])


def carry_departures(years: DataFrame, weights: DataFrame, base: tuple[int, int], min_years: int = 10) -> DataFrame:
    """target, year, log_ratio, pct_normal, donors: the weighted mean of the donors' log ratios to their own baseline mean, the
    weights renormalised over the donors present. Values of 0 or less are dropped, and donors with a short baseline."""
    twice = F.count("*").over(Window.partitionBy("station", "year"))
    kept = years.where("value > 0").select("station", "year", "value", twice.alias("_n")).select("station", "year", refuse(F.col("_n") > 1, "more than one value of a station and year", F.col("value")).alias("value"))
    normal = kept.where(F.col("year").between(*base)).groupBy("station").agg(F.avg("value").alias("_base"), F.count("*").alias("_n")).where(F.col("_n") >= min_years)
    ratio = kept.join(normal, "station").select(F.col("station").alias("donor"), "year", F.ln(F.col("value") / F.col("_base")).alias("_x"))
    got = weights.where("weight > 0").join(ratio, "donor").groupBy("target", "year").agg((F.sum(F.col("weight") * F.col("_x")) / F.sum("weight")).alias("log_ratio"), F.array_join(F.array_sort(F.collect_set("donor")), ",").alias("donors"))
    return got.select("target", "year", "log_ratio", (100 * F.exp("log_ratio")).alias("pct_normal"), "donors")


def _fit(years: DataFrame, method: str) -> tuple[DataFrame, Column]:
    x, y = F.col("_x"), F.col("_y")
    aggregates = {
        "ratio": [(F.avg("_y") / F.avg("_x")).alias("b"), F.lit(0.0).alias("a")],
        "move1": [(F.when(F.coalesce(F.corr("_x", "_y"), F.lit(0.0)) < 0, -1.0).otherwise(1.0) * F.try_divide(F.stddev_samp("_y"), F.stddev_samp("_x"))).alias("b"), F.lit(None).cast("double").alias("a")],
        "ols": [F.regr_slope("_y", "_x").alias("b"), F.regr_intercept("_y", "_x").alias("a")],
    }
    fit = years.groupBy("target", "donor").agg(*aggregates[method], F.avg("_x").alias("_mx"), F.avg("_y").alias("_my"), F.count("*").alias("_n"))
    return fit.withColumn("a", F.coalesce("a", F.col("_my") - F.col("b") * F.col("_mx"))), x


def extend_records(years: DataFrame, chain: DataFrame, method: str = "move1", min_years: int = 3) -> DataFrame:
    """target, year, value, donor: years the target lacks, each from the first donor of its chain that has it. Fits are on logs
    (ratio: on values) of shared years. ``chain``: target, donor, rank; a donor must have every year of the target. Values of 0 or
    less are dropped."""
    if method not in ("ratio", "move1", "ols"):
        raise ValueError("method is ratio, move1 or ols")
    logs = method != "ratio"
    v = years.where("value > 0").select("station", "year", (F.ln("value") if logs else F.col("value")).alias("v"))
    t, d = v.selectExpr("station as target", "year", "v as _y"), v.selectExpr("station as donor", "year", "v as _x")
    own = t.groupBy("target").agg(F.count("*").alias("_own"))
    shared = chain.select("target", "donor").join(t, "target").join(d, ["donor", "year"])
    fit, x = _fit(shared, method)
    fit = fit.join(own, "target").where((F.col("_n") == F.col("_own")) & (F.col("_n") >= min_years))
    missing = chain.join(fit.select("target", "donor", "a", "b"), ["target", "donor"]).join(d, "donor").join(t.select("target", "year"), ["target", "year"], "left_anti")
    first = missing.withColumn("_i", F.row_number().over(Window.partitionBy("target", "year").orderBy("rank"))).where("_i = 1")
    value = F.col("a") + F.col("b") * x
    return first.select("target", "year", (F.exp(value) if logs else value).alias("value"), "donor")


def skill(rows: DataFrame, by: tuple[str, ...] = (), min_obs: float = 0.0) -> DataFrame:
    """n, left_out, no_model, mean, median and mean absolute error in %, share within 20 %, median log bias and its sd, per group.
    ``rows``: obs, mod; observations under ``min_obs`` are left out and counted, as are missing models."""
    good = (F.col("obs") >= min_obs) & F.col("mod").isNotNull()
    e = F.when(good, 100 * F.try_divide(F.col("mod") - F.col("obs"), F.col("obs")))
    g = F.when(good & (F.col("mod") > 0) & (F.col("obs") > 0), F.ln(F.col("mod") / F.col("obs")))
    return rows.groupBy(*by).agg(
        F.count(e).alias("n"), F.count_if(F.coalesce(F.col("obs") < min_obs, F.lit(False))).alias("left_out"), F.count_if(F.col("mod").isNull()).alias("no_model"), F.avg(e).alias("mean_error"),
        F.percentile(e, F.lit(0.5)).alias("median_error"), F.avg(F.abs(e)).alias("mae"), F.avg((F.abs(e) <= 20).cast("double")).alias("within_20"), F.percentile(g, F.lit(0.5)).alias("median_log"), F.stddev_samp(g).alias("sd_log"),
    )


def efficiency(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Nash and Sutcliffe's efficiency per group, in two passes for stability."""
    kept = rows.where("obs is not null and mod is not null").withColumn("_m", F.avg("obs").over(Window.partitionBy(*by)))
    square = lambda x: F.sum(x * x)
    return kept.groupBy(*by).agg(F.count("*").alias("n"), (1 - F.try_divide(square(F.col("mod") - F.col("obs")), square(F.col("obs") - F.col("_m")))).alias("nse"))


def baseline_anomaly(years: DataFrame, base: tuple[int, int], min_years: int = 10) -> DataFrame:
    """station, year, value, normal, pct_normal, anomaly; series with a short baseline go."""
    normal = years.where(F.col("year").between(*base)).groupBy("station").agg(F.avg("value").alias("normal"), F.count("value").alias("_n")).where(F.col("_n") >= min_years)
    return years.join(normal, "station").select("station", "year", "value", "normal", (100 * F.try_divide(F.col("value"), F.col("normal"))).alias("pct_normal"), (F.col("value") - F.col("normal")).alias("anomaly"))


def trend(years: DataFrame) -> DataFrame:
    """station, n, slope (Theil and Sen: median of all pairwise slopes), s and var_s (Mann and Kendall, ties corrected), z.
    Pairs are those of one station's years."""
    a, b = years.selectExpr("station", "year as _y1", "value as _v1"), years.selectExpr("station", "year as _y2", "value as _v2")
    pairs = a.join(b, "station").where("_y1 < _y2").groupBy("station").agg(F.percentile((F.col("_v2") - F.col("_v1")) / (F.col("_y2") - F.col("_y1")), F.lit(0.5)).alias("slope"), F.sum(F.signum(F.col("_v2") - F.col("_v1"))).cast("long").alias("s"))
    ties = years.groupBy("station", "value").agg(F.count("*").alias("_t"))
    ties = ties.groupBy("station").agg(F.sum("_t").alias("n"), F.sum(F.col("_t") * (F.col("_t") - 1) * (2 * F.col("_t") + 5)).alias("_c"))
    out = pairs.join(ties, "station").withColumn("var_s", (F.col("n") * (F.col("n") - 1) * (2 * F.col("n") + 5) - F.col("_c")) / 18)
    z = F.when(F.col("s") > 0, (F.col("s") - 1) / F.sqrt("var_s")).when(F.col("s") < 0, (F.col("s") + 1) / F.sqrt("var_s")).otherwise(0.0)
    return out.select("station", "n", "slope", "s", "var_s", z.alias("z"))


def trend_significance(years: DataFrame, least: int = 4) -> DataFrame:
    """What ``trend`` gives, and p, the two-sided probability of as large a rank statistic without a trend (normal, continuity and ties
    corrected); null with fewer than ``least`` years. A year given twice is an error when read."""
    n = F.count("*").over(Window.partitionBy("station", "year"))
    kept = years.where(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double"))).select("station", "year", "value", n.alias("_n"))
    kept = kept.select("station", "year", refuse(F.col("_n") > 1, "more than one value of a station and year", F.col("value")).alias("value"))
    return trend(kept).withColumn("p", F.when(F.col("n") >= least, F.when(F.col("var_s") > 0, F.least(F.lit(1.0), normal_tail(F.col("z")))).otherwise(1.0)))


def validation_table(rows: DataFrame, groups: tuple[str, ...], min_obs: float = 10.0) -> DataFrame:
    """grouping ("all" or a column of ``groups``), level, the figures of ``skill`` over the annual rows (month 0), and nse_months, the
    median over stations of the efficiency of their twelve months. ``rows``: station, month, obs, mod and the groups; every grouping
    comes from one pass over the rows. A station and month given twice is an error when read."""
    n = F.count("*").over(Window.partitionBy("station", "month"))
    once = rows.select("*", n.alias("_n")).withColumn("obs", refuse(F.col("_n") > 1, "more than one row of a station and month", F.col("obs"))).drop("_n")
    levels = F.explode(F.array(F.struct(F.lit("all").alias("grouping"), F.lit("all").alias("level")), *[F.struct(F.lit(g).alias("grouping"), F.col(g).cast("string").alias("level")) for g in groups])).alias("_g")
    each = once.select("station", "month", "obs", "mod", levels).select("station", "month", "obs", "mod", "_g.*")
    annual = skill(each.where("month = 0"), ("grouping", "level"), min_obs)
    months = efficiency(each.where("month between 1 and 12"), ("grouping", "level", "station")).where("n = 12").groupBy("grouping", "level").agg(F.percentile("nse", F.lit(0.5)).alias("nse_months"))
    same = (annual["grouping"] == months["grouping"]) & annual["level"].eqNullSafe(months["level"])
    return annual.join(months, same, "left").select(*[annual[c] for c in annual.columns], "nse_months")


def predict_shares(raw: DataFrame, by: tuple[str, ...] = ("id",), value: str = "share") -> DataFrame:
    """Monthly shares floored at 0 and brought to a sum of 1; null where all are 0."""
    low = F.when(F.col(value).isNotNull(), F.greatest(F.col(value), F.lit(0.0)))
    return raw.withColumn("_s", low).select(*by, "month", F.try_divide(F.col("_s"), F.nullif(F.sum("_s").over(Window.partitionBy(*by)), F.lit(0.0))).alias("share"))


def within_month(days: DataFrame, by: tuple[str, ...] = ("station", "month"), value: str = "q") -> DataFrame:
    """Each day's weight in its month; a month of zero is even and flagged."""
    month = Window.partitionBy(*by)
    total = F.sum(value).over(month)
    return days.select(*by, "doy", F.when(total == 0, 1 / F.count("*").over(month)).otherwise(F.try_divide(F.col(value), F.nullif(total, F.lit(0.0)))).alias("weight"), (total == 0).alias("flat"))


def lay_down(monthly: DataFrame, weights: DataFrame, by: tuple[str, ...] = ("station",)) -> DataFrame:
    """Monthly means on days: q of the month x days of the month x the day's weight."""
    n = weights.groupBy(*by, "month").agg(F.count("*").alias("_n"))
    return monthly.join(n, [*by, "month"]).join(weights, [*by, "month"]).select(*by, "doy", (F.col("q") * F.col("_n") * F.col("weight")).alias("q"))


def pooled_zones(rows: DataFrame, zones: list[str], least: int) -> DataFrame:
    """id, zone: the zone with the largest share of each row (first of tied ones), 'pooled' where fewer than ``least`` rows have it."""
    top = F.greatest(*zones)
    zone = F.coalesce(*[F.when(F.col(z) == top, F.lit(z)) for z in zones])
    picked = rows.select("id", zone.alias("zone"))
    return picked.select("id", F.when(F.count("*").over(Window.partitionBy("zone")) >= least, F.col("zone")).otherwise("pooled").alias("zone"))


def adjust(rows: DataFrame, coefficients: dict[str, float], raw: str = "raw") -> DataFrame:
    """Raw plus the sum of zone coefficients x columns (missing columns count as 0), never below 0."""
    total = F.col(raw)
    for name, c in coefficients.items():
        total = total + c * F.coalesce(F.col(name), F.lit(0.0))
    return rows.select("id", F.when(total.isNotNull(), F.greatest(total, F.lit(0.0))).alias("adjusted"))


def zonal(cells: DataFrame) -> DataFrame:
    """polygon, mean, cover from (polygon, fraction, value): the mean over cells with a value and their share of the polygon."""
    have = F.when(F.col("value").isNotNull(), F.col("fraction"))
    return cells.groupBy("polygon").agg(F.try_divide(F.sum(F.col("fraction") * F.col("value")), F.sum(have)).alias("mean"), (F.coalesce(F.sum(have), F.lit(0.0)) / F.sum("fraction")).alias("cover"))


def majority(cells: DataFrame) -> DataFrame:
    """polygon, class: the class with the largest fraction, the smallest class of tied ones."""
    per = cells.groupBy("polygon", "class").agg(F.sum("fraction").alias("_f"))
    return per.withColumn("_i", F.row_number().over(Window.partitionBy("polygon").orderBy(F.desc("_f"), "class"))).where("_i = 1").select("polygon", "class")


def capped_mean(years: DataFrame, cap: float, first: bool) -> DataFrame:
    """Mean over years with a cap: on each year (``first``) or on the mean. A null value is no year; a station of nulls has a null."""
    low = lambda x: F.when(x.isNotNull(), F.least(x, F.lit(cap)))
    return years.groupBy("station").agg((F.avg(low(F.col("value"))) if first else low(F.avg("value"))).alias("value"))
