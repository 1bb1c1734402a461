"""Approximate nearest neighbours with balanced posting lists.

Equal vectors are one class. Largest inner product becomes nearest point by one more coordinate, within levels of length so
that a few very long vectors do not hide the differences of the others. In each level centroids of a bounded
sample, balanced in size, are linked to a neighbour graph that is broadcast. Every class vector is written to the list of its
nearest centroid and, near a boundary, of several; a query walks the graph to its nearest centroids and reads the lists whose
distance ratio to the nearest is small enough. Lists meet queries in a join by list and block, and scores are exact. A query whose
lists hold too few answers is held against all rows, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from freshet.llm.common import cut, let

#: Rows of the sample the centroids are fitted on, and members aimed at per list.
SAMPLE, LIST = 20_000, 96
MAX_LISTS = 8_192
#: Lists a vector may be copied to, and how much farther than its nearest centroid they may be (squared-distance ratio).
COPIES, BOUNDARY = 4, 1.15
#: Lists a query may read, and the same ratio for them.
PROBES, PRUNE = 96, 2.0
DEGREE, BEAM = 24, 128
#: A level ends at so many times the length that 99 of 100 vectors of it do not exceed; longer ones are the next level's.
LEVEL = 4.0
#: Vectors of a list that are compared in one group.
BLOCK = 512


def _balanced(points: np.ndarray, lists: int, rng: np.random.Generator, passes: int = 6) -> np.ndarray:
    """Centroids by halving: the two means of a set, cut at the median difference of distances, so that halves are equal."""
    out, todo = [], [(np.arange(len(points)), lists)]
    while todo:
        rows, n = todo.pop()
        if n <= 1 or len(rows) < 2:
            out.append(points[rows].mean(0))
            continue
        some = points[rows]
        a, b = some[rng.choice(len(rows), 2, replace=False)]
        for _ in range(passes):
            order = np.argsort(((some - a) ** 2).sum(1) - ((some - b) ** 2).sum(1), kind="stable")
            half = len(rows) * (n // 2) // n
            half = min(max(1, half), len(rows) - 1)
            a, b = some[order[:half]].mean(0), some[order[half:]].mean(0)
        todo += [(rows[order[:half]], n // 2), (rows[order[half:]], n - n // 2)]
    return np.array(out)


class Graph:
    """Centroids with links to their nearest and a few random ones, searched best first, a batch of points at a time."""

    def __init__(self, centroids: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.points = centroids.astype(np.float32)
        n = len(centroids)
        near = min(DEGREE, n - 1)
        links = np.zeros((n, near), np.int32)
        for at in range(0, n, 1024):
            apart = self._apart(self.points[at : at + 1024])
            apart[np.arange(len(apart)), np.arange(at, at + len(apart))] = np.inf
            links[at : at + 1024] = np.argsort(apart, axis=1)[:, :near]
        self.links = np.hstack([links, rng.integers(0, n, (n, 4), dtype=np.int32)])
        self.entries = rng.choice(n, min(n, 4 * int(np.ceil(np.sqrt(n)))), replace=False).astype(np.int32)

    def _apart(self, x: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        p = self.points if at is None else self.points[at]
        return np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * x @ p.T, 0)

    def search(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, squared distances), nearest first; missing places have centroid -1."""
        x = x.astype(np.float32)
        beam = max(BEAM, k)
        m = min(beam, len(self.entries))
        d = self._apart(x, self.entries)
        first = np.argsort(d, axis=1)[:, :m]
        ids = np.full((len(x), beam), -1, np.int32)
        dist = np.full((len(x), beam), np.inf, np.float32)
        done = np.ones((len(x), beam), bool)
        ids[:, :m], dist[:, :m], done[:, :m] = self.entries[first], np.take_along_axis(d, first, 1), False
        seen = np.zeros((len(x), len(self.points)), bool)
        seen[:, self.entries] = True
        rows = np.arange(len(x))
        while True:
            open_ = np.where(done, np.inf, dist)
            pick = open_.argmin(1)
            live = np.isfinite(open_[rows, pick])
            if not live.any():
                break
            r = rows[live]
            node = ids[r, pick[live]]
            done[r, pick[live]] = True
            step = self.links[node]
            fresh = ~seen[r[:, None], step]
            seen[r[:, None], step] = True
            gap = self.points[step] - x[r][:, None]
            new = np.where(fresh, (gap * gap).sum(2), np.inf)
            # a link may name a centroid twice: only its first place counts
            order = np.argsort(step, axis=1, kind="stable")
            twice = np.zeros_like(fresh)
            np.put_along_axis(twice, order[:, 1:], np.diff(np.take_along_axis(step, order, 1), axis=1) == 0, 1)
            new = np.where(twice, np.inf, new)
            all_d, all_i = np.hstack([dist[r], new]), np.hstack([ids[r], step])
            all_f = np.hstack([done[r], np.zeros_like(fresh)])
            best = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            dist[r], ids[r], done[r] = np.take_along_axis(all_d, best, 1), np.take_along_axis(all_i, best, 1), np.take_along_axis(all_f, best, 1)
            done[r] |= ~np.isfinite(dist[r])
        ids[~np.isfinite(dist)] = -1
        return ids[:, :k], dist[:, :k]


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<double>) of the rows that take part: not null, not zero, no null or non-finite component, and of the
    commonest dimension (of tied ones the largest)."""
    v = F.col("embedding").cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select("vec_id", v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0))
    dims = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1)
    return rows.join(F.broadcast(dims), F.size("v") == F.col("d"), "left_semi")


def _first_members(rows: DataFrame, keep: int) -> DataFrame:
    """rep, vec_id of the ``keep`` smallest ids of each class, salted first so that a huge class is no single task."""
    salted = Window.partitionBy("rep", F.pmod(F.xxhash64("vec_id"), F.lit(32))).orderBy("vec_id")
    some = rows.select("rep", "vec_id", F.row_number().over(salted).alias("i")).where(F.col("i") <= keep)
    return some.withColumn("i", F.row_number().over(Window.partitionBy("rep").orderBy("vec_id"))).where(F.col("i") <= keep).drop("i")


def _levels(rep: DataFrame) -> list[tuple[float, float, int]]:
    """(length above which, up to which, number of classes) of each level; each has less than a hundredth of those before it."""
    levels, low = [], 0.0
    while True:
        rest = rep.where(F.col("norm") > low)
        n, most, usual = rest.agg(F.count("*"), F.max("norm"), F.percentile_approx("norm", 0.99, 1000)).first()
        if not n:
            return levels
        high = most if most / usual <= LEVEL else usual * LEVEL
        levels.append((low, high, rest.where(F.col("norm") <= high).count()))
        low = high


def _meet(k: int):
    """The k + 1 best of a block for each query that comes to it; a score that is no number counts as the least."""

    def meet(key, ask: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        if ask.empty or have.empty:
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "rep": pd.Series(dtype="int64"), "score": pd.Series(dtype=float)})
        v, ids = np.stack(have["v"].to_numpy()), have["rep"].to_numpy()
        found = []
        for at in range(0, len(ask), 2048):
            some = ask.iloc[at : at + 2048]
            with np.errstate(all="ignore"):
                score = np.stack(some["v"].to_numpy()) @ v.T
            score[np.isnan(score)] = -np.inf
            m = min(k + 1, len(ids))
            order = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :m]
            found.append(pd.DataFrame({"q": np.repeat(some["rep"].to_numpy(), m), "rep": ids[order].ravel(), "score": np.take_along_axis(score, order, 1).ravel()}))
        return pd.concat(found)

    return meet


def _scored(rep: DataFrame, asking: DataFrame, level: tuple[float, float, int], k: int, lists: int | None) -> DataFrame:
    """q, rep, score of what the queries find in one level."""
    low, high, n = level
    rep = rep.where((F.col("norm") > low) & (F.col("norm") <= high)).select("rep", "v")
    rate = min(1.0, SAMPLE / n)
    fit = rep.where(F.pmod(F.xxhash64("rep"), F.lit(1_000_000)) < rate * 1_000_000).select("rep", "v").orderBy("rep").toPandas()
    if fit.empty:
        fit = rep.limit(1).toPandas()

    def lifted(x: np.ndarray) -> np.ndarray:
        x = x / high
        return np.hstack([x, np.sqrt(np.maximum(1 - (x * x).sum(1), 0))[:, None]])

    points = lifted(np.stack(fit["v"].to_numpy()))
    count = max(1, min(MAX_LISTS, len(points) // 4, lists or -(-n // LIST)))
    graph = rep.sparkSession.sparkContext.broadcast(Graph(_balanced(points, count, np.random.default_rng(7))))

    def place(batches: Iterator[pd.DataFrame], asks: bool) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                some = batch.iloc[at : at + 1024]
                x = np.stack(some["v"].to_numpy())
                if asks:  # a query's direction decides: bring it to the sphere the points lie on
                    x = x / np.abs(x).max(1, keepdims=True)
                    x = np.hstack([x / np.sqrt((x * x).sum(1))[:, None], np.zeros((len(x), 1))])
                else:
                    x = lifted(x)
                ids, far = graph.value.search(x, PROBES if asks else COPIES)
                keep = (ids >= 0) & (far <= far[:, :1] * (PRUNE if asks else BOUNDARY) + 1e-12)
                r, c = np.nonzero(keep)
                yield pd.DataFrame({"rep": some["rep"].to_numpy()[r], "list": ids[r, c], "v": some["v"].to_numpy()[r]})

    shape = "rep long, list int, v array<double>"
    posted = cut(rep.mapInPandas(lambda b: place(b, False), shape))
    parts = posted.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    probes = asking.mapInPandas(lambda b: place(b, True), shape)
    small = F.broadcast(parts)  # a row per list, MAX_LISTS at most
    held = posted.join(small, "list").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).select("list", "part", "rep", "v")
    sent = probes.join(small, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "rep", "v")
    return sent.groupBy("list", "part").cogroup(held.groupBy("list", "part")).applyInPandas(_meet(k), "q long, rep long, score double")


def search(vectors: DataFrame, every: int = 20, k: int = 20, lists: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by ``every`` the k nearest others found.

    Vectors are classed by value, so ties by id and repeats are exact: of a class only the k + 1 smallest ids can be answers.
    Rows that take no part neither ask nor answer. Fewer than k candidates: all of them. Rows of equal vec_id and
    vector count once; those of equal vec_id and other vectors ask and answer each for itself, and a query leaves out every row
    with its id. The sample bounds the fit; every vector is indexed. Components may be
    as large as a double holds; an overflowing score is infinite.
    """
    rows = cut(valid(vectors))
    rep = rows.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    largest = F.array_max(F.transform("v", F.abs))
    rep = rep.withColumn("norm", let(largest, lambda m: m * F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / m) * (x / m)))))
    rep = cut(rep.withColumn("norm", F.least("norm", F.lit(1.7e308))))
    levels = _levels(rep)
    out = "query_id long, rank int, vec_id long, score double"
    if not levels:
        return vectors.sparkSession.createDataFrame([], out)
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    asking = cut(asked.select("v").distinct().join(rep.select("v", "rep"), "v").select("rep", "v"))
    scored = [_scored(rep, asking, level, k, lists) for level in levels]
    scored = cut(reduce(DataFrame.unionByName, scored).groupBy("q", "rep").agg(F.max("score").alias("score")))
    # a query needs k answers or as many as there are: rows of other ids than its own, each id and vector once
    ids = cut(rows.join(rep.select("v", "rep"), "v").select("rep", "vec_id").distinct())
    members = cut(_first_members(ids, k + 1))
    queries = cut(asked.join(rep.select("v", "rep"), "v").select(F.col("vec_id").alias("query_id"), F.col("rep").alias("q")).distinct())
    answering = scored.join(members, "rep").join(queries, "q").where("vec_id <> query_id").groupBy("query_id", "q").agg(F.count("*").alias("found"))
    short = queries.join(answering, ["query_id", "q"], "left").where(F.coalesce("found", F.lit(0)) < min(ids.count() - 1, k))
    few = asking.join(short.select(F.col("q").alias("rep")).distinct(), "rep", "left_semi").select("rep", "v")
    few = cut(few)
    if not few.isEmpty():
        n = sum(size for _, _, size in levels)
        parts = -(-n // (8 * BLOCK))
        held = rep.select("rep", "v", F.pmod(F.xxhash64("rep"), F.lit(parts)).alias("part"))
        sent = few.select("rep", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
        more = sent.groupBy("part").cogroup(held.groupBy("part")).applyInPandas(_meet(k), "q long, rep long, score double")
        scored = scored.unionByName(more).groupBy("q", "rep").agg(F.max("score").alias("score"))
    top = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    best = scored.withColumn("i", F.row_number().over(top)).where(F.col("i") <= k + 1).drop("i")
    each = best.join(members, "rep")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    answers = each.withColumn("i", F.row_number().over(order)).where(F.col("i") <= 2 * k + 2).select("q", "vec_id", "score")
    final = queries.join(answers, "q").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id"))
    return final.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
