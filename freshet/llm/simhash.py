"""SimHash near-duplicates found with pivot distance tables.

Every distinct fingerprint carries its Hamming distances to ``PIVOTS`` reference fingerprints. Two fingerprints that differ
in at most ``max_bits`` bits differ by at most that in every coordinate, so a candidate pair is discarded on its largest
coordinate difference and only survivors are compared bit by bit. The coordinates of fingerprints lie too close together to
find candidates by (a cell of three distances holds a third of all), so candidates share an exact key: the bits are cut into
max_bits + 3 blocks and at least three of them must agree in a linked pair, so one key per choice of three blocks finds
every link. A key with more than ``BUCKET`` distinct fingerprints is not paired; its fingerprints go to an exact meeting
join instead (two fingerprints are within 2 bits when they share a point one bit from each), whose groups never exceed 65.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from freshet.llm import overlap
from freshet.llm.common import cut
from freshet.llm.components import components

PIVOTS = 16
BUCKET = 64
SEED = 42
_BLOCK = 1 << 16


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash: bit set if set in over half of the XXH64 values of the word shingles; 0 without a word."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    if len(tokens) < words:
        return digest(line, SEED)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(tokens) - words + 1]
    ends = ends[words - 1 :]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), _BLOCK):
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts[at : at + _BLOCK].tolist(), ends[at : at + _BLOCK].tolist())], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp (signed long) of every row; null and empty texts get 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(t, words) for t in batch.column("text").to_pylist()), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("fp", T.LongType())]))


def _pivots(n: int = PIVOTS) -> list[int]:
    draw = random.Random(SEED)
    return [draw.getrandbits(64) - (1 << 63) for _ in range(n)]


def pivot_table(fp: Column) -> Column:
    """Hamming distances of ``fp`` to the reference fingerprints."""
    return F.array(*[F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("byte") for p in _pivots()])


def _keys(fp: Column, max_bits: int) -> Column:
    """One (table, bits of three blocks) for each choice of three of max_bits + 3 blocks."""
    n = max_bits + 3
    cuts = [round(64 * i / n) for i in range(n + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    tables = [signed(sum(masks[i] for i in chosen)) for chosen in itertools.combinations(range(n), n - max_bits)]
    return F.array(*[F.struct(F.lit(j).cast("int").alias("table"), fp.bitwiseAND(F.lit(m)).alias("bits")) for j, m in enumerate(tables)])


def links(distinct: DataFrame, max_bits: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b), a > b, whose components are those of all pairs of distinct ``fp`` within ``max_bits`` (at most 2)."""
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits is 0, 1 or 2")
    keyed = distinct.select("fp", pivot_table(F.col("fp")).alias("pd"), F.explode(_keys(F.col("fp"), max_bits)).alias("k")).select("fp", "pd", "k.*")
    sizes = keyed.groupBy("table", "bits").agg(F.count("*").alias("n"))
    near = keyed.join(sizes.where(F.col("n").between(2, bucket)), ["table", "bits"])
    x, y = near.alias("x"), near.alias("y")
    apart = F.greatest(*[F.abs(F.col("x.pd")[i] - F.col("y.pd")[i]) for i in range(PIVOTS)])
    paired = (
        x.join(y, (F.col("x.table") == F.col("y.table")) & (F.col("x.bits") == F.col("y.bits")) & (F.col("x.fp") > F.col("y.fp")) & (apart <= max_bits))
        .where(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= max_bits)
        .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    )
    crowded = keyed.select("table", "bits", "fp").join(sizes.where(F.col("n") > bucket), ["table", "bits"], "left_semi").select("fp").distinct()
    flips = [0] + [(1 << i) if i < 63 else -(1 << 63) for i in range(64)]
    spread = crowded.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(f)) for f in flips])).alias("z"))
    met = spread.select(F.col("fp").alias("a"), F.min("fp").over(Window.partitionBy("z")).alias("b")).where("a > b")
    far = F.array_max(F.zip_with(pivot_table(F.col("a")), pivot_table(F.col("b")), lambda p, q: F.abs(p - q)))
    met = met.where(far <= max_bits).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits) if max_bits == 2 else _exact_small(crowded, max_bits)
    return paired.unionByName(met).distinct()


def _exact_small(crowded: DataFrame, max_bits: int) -> DataFrame:
    """Links of 0 or 1 bits: probe each single flip."""
    if max_bits == 0:
        return crowded.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("1 = 0")
    flips = [(1 << i) if i < 63 else -(1 << 63) for i in range(64)]
    probe = crowded.select(F.col("fp").alias("a"), F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(f)) for f in flips])).alias("b")).where("a > b")
    return probe.join(crowded.select(F.col("fp").alias("b")), "b", "left_semi").select("a", "b")


def classes(docs: DataFrame, words: int = 3, max_bits: int = 2) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over links, for every row of ``docs``.

    Only doc_id and text are used. Texts without a word share fingerprint 0 and link like any other; a null doc_id is
    kept but names no component unless its whole component has no other (then null). Repeated rows get a row each.
    """
    rows = cut(fingerprints(docs, words))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(distinct, max_bits))
    owned = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = owned.groupBy("root").agg(F.min("first_id").alias("component_id"))
    lookup = owned.join(named, "root").select(F.col("fp").alias("own_fp"), "component_id")
    return rows.join(lookup, rows["fp"] == F.col("own_fp")).select("doc_id", "fp", "component_id")


def near_copies(docs: DataFrame, words: int = 3, max_bits: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return classes(docs, words, max_bits).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def groups(docs: DataFrame, words: int = 3, max_bits: int = 2) -> DataFrame:
    """t (the text's hash) and grp of every distinct text: those of one grp are near copies by SimHash and its pivots (see ``classes``)."""
    texts = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    return classes(texts, words, max_bits).select(F.col("doc_id").alias("t"), F.col("component_id").alias("grp")).distinct()


def keep_one(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """The documents without near copies (texts whose sets of ``words``-word shingles have a Jaccard similarity of ``least`` or
    more). SimHash finds them with its pivots, as ``classes`` does, and their exact similarity is checked; pairs that differ in too
    many bits for it come from minimum hashes (see overlap.py). Of each component one row stays, with all its columns: that of the
    smallest doc_id (nulls last), then of the smallest hash of its text. Of rows that repeat its id and text the one of the smallest other columns stays.
    Rows of equal ids and other texts are documents of their own."""
    keep = cut(overlap.keepers(docs, words, least, cut(groups(docs)))).select(F.col("doc_id").alias("__id"), F.col("t").alias("__t"), F.col("n").alias("__n"))
    rows = docs.withColumn("__h", F.xxhash64("text"))
    same = rows["doc_id"].eqNullSafe(keep["__id"]) & (rows["__h"] == keep["__t"])
    lone = rows.join(keep.where("__n = 1"), same, "left_semi").drop("__h")
    # repeated rows meet in partial aggregates, not in one task
    many = rows.join(keep.where("__n > 1"), same, "left_semi").groupBy("doc_id", "__h").agg(F.min(F.struct(*docs.columns)).alias("__row")).select("__row.*")
    return lone.unionByName(many)
