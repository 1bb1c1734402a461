"""Near copies by the overlap of word shingles.

Texts are near copies if the Jaccard similarity of their sets of five-word shingles is ``least`` or more. Candidates share all
``ROWS`` minimum hashes of one of ``BANDS`` bands (a pair of similarity 0.8 misses all bands in three of a million cases, a
closer one less often). A band's texts are first held against the one with the most company, then all of them in pairs across
the groups that this left, so that a large group of near copies costs a comparison a text and still no candidate goes unseen.
A candidate is discarded if its sizes or its parities (each shingle flips one of ``BITS`` bits, so the sets differ in at least
as many shingles as the bits do) rule the similarity out; the others are verified by the exact similarity of their sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.llm.common import cut
from freshet.llm.components import components

BANDS, ROWS = 24, 4
BITS = 1024
SEED = 42
#: Texts of a band that one task holds against as many others: a band's texts meet in blocks of so many.
MEET_ROWS = 2048
#: Rows whose shingles a worker holds together.
SLICE = 128
_BLOCK = 1 << 12
_draw = np.random.default_rng(SEED)
_FACTORS = _draw.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
_SHIFTS = _draw.integers(0, 1 << 64, BANDS * ROWS, np.uint64)


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 values of the word shingles; a text of fewer words is one shingle."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    line = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([digest(line, SEED)], np.uint64)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(tokens) - words + 1]
    return np.unique(np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist())), np.uint64, len(starts)))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One key a band, of the minimum hashes of a shingle set."""
    import xxhash

    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), _BLOCK):
        least = np.minimum(least, (hashes[at : at + _BLOCK, None] * _FACTORS + _SHIFTS).min(0))
    return np.array([xxhash.xxh64_intdigest(part.tobytes(), i) for i, part in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def parities(hashes: np.ndarray) -> np.ndarray:
    """Whether an odd number of shingles fell on each of ``BITS`` bits."""
    odd = np.bincount((hashes & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _possible(least: float) -> Column:
    """Whether rows x and y, of size and parities, can be as similar as ``least``."""
    total = F.col("x.size") + F.col("y.size")
    apart = sum((F.bit_count(F.col("x.odd")[i].bitwiseXOR(F.col("y.odd")[i])) for i in range(BITS // 64)), F.lit(0))
    sizes = F.least("x.size", "y.size") >= least * F.greatest("x.size", "y.size")
    return sizes & (apart * (1 + least) <= (1 - least) * total + 1e-6)


def _name(hashes: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def _named(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, the text's hash, the name, size, parities and bands of its shingle set, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            sets = [shingles(t.as_py(), words) for t in part.column("text")]
            found = [pa.array([_name(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), _lists([parities(s) for s in sets]), _lists([bands(s) for s in sets])]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("t"), *found], ["doc_id", "t", "node", "size", "odd", "keys"])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("t"))
    longs = T.ArrayType(T.LongType())
    shape = T.StructType([rows.schema["doc_id"], T.StructField("t", T.LongType()), T.StructField("node", T.LongType()), T.StructField("size", T.LongType()), T.StructField("odd", longs), T.StructField("keys", longs)])
    return rows.mapInArrow(run, shape)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ``SLICE`` rows at most: what is made of them is larger than they are."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _lists(values: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(np.concatenate(values)))


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node and its shingle set, of the texts whose hash is in ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            sets = [shingles(t.as_py(), words) for t in part.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([_name(s) for s in sets], pa.int64()), _lists([s.view(np.int64) for s in sets])], ["node", "hashes"])

    texts = docs.select(F.xxhash64("text").alias("t"), "text").join(wanted, "t", "left_semi").groupBy("t").agg(F.first("text").alias("text"))
    return texts.select("text").mapInArrow(run, "node long, hashes array<long>")


def _verified(pairs: DataFrame, docs: DataFrame, distinct: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are as similar as ``least``."""
    pairs = cut(pairs.distinct())
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = cut(_sets(docs, distinct.join(nodes, "node", "left_semi").select("t"), words))
    x, y = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    both, common = F.size("x") + F.size("y"), F.size(F.array_intersect("x", "y"))
    return cut(pairs.join(x, "a").join(y, "b").where(common >= least * (both - common)).select("a", "b"))


def links(named: DataFrame, docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """Edges (a, b), a > b, whose components are those of all candidates that are as similar as ``least``."""
    distinct = cut(named.groupBy("node").agg(F.min("t").alias("t"), *[F.first(c).alias(c) for c in ("size", "odd", "keys")]))
    drawn = distinct.select("node", "size", "odd")
    keyed = distinct.select("node", F.explode("keys").alias("key"))
    shared = cut(keyed.join(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"))
    company = shared.groupBy("node").agg(F.sum("n").alias("company"))
    heads = shared.join(company, "node").groupBy("key").agg(F.max(F.struct("company", "node"))["node"].alias("head"))
    shared = cut(shared.join(heads, "key").select("key", "node", "head"))
    stars = shared.where("node <> head").select(F.greatest("node", "head").alias("a"), F.least("node", "head").alias("b")).distinct()
    stars = stars.join(drawn.alias("x"), F.expr("a = x.node")).join(drawn.alias("y"), F.expr("b = y.node")).where(_possible(least)).select("a", "b")
    near = _verified(stars, docs, distinct, words, least)
    roots = components(near).withColumnRenamed("node", "own")
    grouped = shared.join(roots, shared["node"] == roots["own"], "left").select("key", "head", "node", F.coalesce("root", "node").alias("root"))
    mixed = grouped.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    # texts that met their head already need not meet it again
    left = grouped.where("node <> head").join(mixed, "key", "left_semi")
    blocks = left.groupBy("key").agg(F.ceil(F.count("*") / MEET_ROWS).cast("int").alias("blocks"))
    left = cut(left.join(blocks, "key").join(drawn, "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    # blocks of a band meet each other apart, the lower block of a pair of blocks first
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    met = left.select("*", each).select("*", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    x, y = met.where("block = low").alias("x"), met.where("block = high").alias("y")
    apart = F.expr("x.key = y.key and x.low = y.low and x.high = y.high and x.root <> y.root and (x.block < y.block or x.node > y.node)")
    across = x.join(y, apart & _possible(least)).select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b"))
    return near.unionByName(_verified(across, docs, distinct, words, least))


def _rooted(docs: DataFrame, words: int, least: float, found: DataFrame | None = None) -> DataFrame:
    """doc_id, t (the text's hash) and root (the component) of every row. ``found``: t and grp, texts that another method groups; of
    these the links that the exact similarity bears out count."""
    named = cut(_named(docs, words))
    edges = links(named, docs, words, least)
    if found is not None:
        grouped = cut(named.select("t", "node").distinct().join(found.select("t", "grp").distinct(), "t").select("grp", "node").distinct())
        heads = grouped.groupBy("grp").agg(F.min("node").alias("head"))
        stars = grouped.join(heads, "grp").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
        edges = edges.unionByName(_verified(stars, docs, named.groupBy("node").agg(F.min("t").alias("t")), words, least))
    roots = components(edges).withColumnRenamed("node", "own")
    return named.select("doc_id", "t", "node").join(roots, named["node"] == roots["own"], "left").select("doc_id", "t", F.coalesce("root", "node").alias("root"))


def classes(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """doc_id and component_id, the smallest doc_id reachable over near copies, for every row of ``docs``.

    Only doc_id and text are used. Texts of the same shingles, and those without a word, are copies of each other; a null
    doc_id links but names no component unless its whole component has no other (then null)."""
    rows = _rooted(docs, words, least)
    names = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(names, "root").select("doc_id", "component_id")


def keepers(docs: DataFrame, words: int = 5, least: float = 0.8, found: DataFrame | None = None) -> DataFrame:
    """doc_id and t, the hash of the text, of the row that stands for each component: the one of the smallest doc_id (nulls
    last), then of the smallest hash; and how many rows of ``docs`` are that row's equals in both. Components are also over links
    within the groups of ``found`` (t, grp)."""
    rows = _rooted(docs, words, least, found).groupBy("root", "doc_id", "t").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "t", "n")).alias("first")
    return rows.groupBy("root").agg(first).select("first.doc_id", "first.t", "first.n")
