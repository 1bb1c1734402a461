"""Similarity join of word shingle sets by vertical partitioning.

Texts with equal sets are one node. Shingles have a global order, rare ones first (by the size of a hash bucket over all texts, then by hash);
sets as similar as ``least`` share a shingle among the first of each, so candidates meet on these prefixes. The order is cut
into fragments; a set has a segment in each. Overlaps are counted for each fragment apart and summed per pair, so no task holds
a whole set, however long the text.

Not all candidates are compared. In rounds, each node is held against one head of its prefix groups (first the node with the most
company, then drawn ones) and linked nodes become one component; groups that lie within one component are done. In the groups that are left, all pairs across components whose
sizes and parities allow the similarity are counted, in blocks, so every link that matters for components is found.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from freshet.llm.common import written
from freshet.llm.components import components

SEED = 42
#: Hash buckets whose sizes order the shingles, and the buckets of one row of counts.
BUCKET_BITS, ROW_BITS = 20, 12
#: Fragments of the order at least; more where the longest set has over ``SEGMENT`` shingles a fragment.
FRAGMENTS, SEGMENT = 8, 4096
#: Nodes of a prefix group that meet in one task, rounds of heads, bits of parities, bytes hashed at once, rows a worker holds at once.
MEET_ROWS, ROUNDS, BITS, CHUNK, SLICE = 2048, 1, 1024, 1 << 20, 128
#: Occurrences of a hash bucket for which its prefix groups get another salt.
SALT_ROWS = 100_000
#: Bits a wanted node has in the filter of the second reading, and the most bits of that filter.
FILTER_BITS, MAX_FILTER_BITS = 16, 1 << 27
#: Bits of the parities that candidates show before their sets are sent, and the size of a set from which on they are asked for.
SHARP_BITS, SHARP_SIZE = 4096, 256
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_LOW = np.uint64((1 << BUCKET_BITS) - 1)


_draw = np.random.default_rng(SEED)
#: A drawn number for each byte, 0 for white space; an odd base and its inverse modulo 2^64.
_BYTES = _draw.integers(1, 1 << 64, 256, np.uint64)
_SOLID = np.ones(256, bool)
_SOLID[[32, *range(9, 14)]] = False
_BYTES[~_SOLID] = 0
_BASE = int(_draw.integers(0, 1 << 64, dtype=np.uint64)) | 1
_UP = np.multiply.accumulate(np.array([1] + [_BASE] * CHUNK, np.uint64))
_DOWN = np.multiply.accumulate(np.array([1] + [pow(_BASE, -1, 1 << 64)] * CHUNK, np.uint64))
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word: its bytes' numbers times powers of the base, summed over whole chunks of text at once. A word that
    fills a chunk is hashed by itself."""
    import xxhash

    hashes, starts, at = [], [], 0
    while at < len(data):
        part = np.frombuffer(data, np.uint8, min(CHUNK, len(data) - at), at)
        solid = _SOLID[part]
        if len(part) == CHUNK and at + CHUNK < len(data):
            gaps = np.flatnonzero(~solid)
            if not len(gaps):
                found = _SPACE.search(data, at + CHUNK)
                end = found.start() if found else len(data)
                hashes.append(np.array([xxhash.xxh64_intdigest(data[at:end], SEED)], np.uint64))
                starts.append(np.array([at]))
                at = end
                continue
            part, solid = part[: gaps[-1] + 1], solid[: gaps[-1] + 1]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]])))
        first, last = edges[::2], edges[1::2]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTES[part] * _UP[: len(part)], out=sums[1:])
        h = (sums[last] - sums[first]) * _DOWN[first]
        h ^= (last - first).astype(np.uint64) * _FACTORS[0]
        h ^= h >> np.uint64(31)
        h *= _FACTORS[1]
        h ^= h >> np.uint64(29)
        hashes.append(h)
        starts.append(first + at)
        at += len(part)
    return (np.concatenate(hashes), np.concatenate(starts)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _mixed(each: np.ndarray, length: int) -> np.ndarray:
    """A hash of each ``length`` words in a row."""
    out = np.full(max(0, len(each) - length + 1), length, np.uint64)
    for i in range(length):
        out ^= each[i : i + len(out)]
        out *= _FACTORS[i % 5]
        out ^= out >> np.uint64(29)
    return out


def shingle_sets(texts: list[str | None], words: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its word shingles: of all ``words`` words in a row (A-Z lower-cased), or of
    the whole text if it has fewer. Empty without a word. Texts are hashed together."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    begun = np.cumsum([0, *[len(r) + 1 for r in raw]])
    each, starts = _word_hashes(b"\n".join(raw))
    cuts = np.searchsorted(starts, begun).tolist()
    whole, out = _mixed(each, words), []
    for a, b in zip(cuts, cuts[1:]):
        found = whole[a : b - words + 1] if b - a >= words else _mixed(each[a:b], b - a) if b > a else each[:0]
        found = np.sort(found)
        out.append(found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found)
    return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _lists(values: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(np.concatenate(values)))


def bucket_sizes(docs: DataFrame, words: int = 5) -> np.ndarray:
    """Over all texts, how many shingles fell into each of 2^BUCKET_BITS hash buckets. The table has that size however many
    texts there are; a task adds up its own texts and sends compressed rows of counts."""
    each = 1 << ROW_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, n = np.zeros(1 << BUCKET_BITS, np.int64), [np.zeros(0, np.uint64)], 0
        for part in _slices(batches):
            for found in shingle_sets(part.column("text").to_pylist(), words):
                held.append(found)
                n += len(found)
                if n > len(counts):
                    counts += np.bincount((np.concatenate(held) & _LOW).astype(np.int64), minlength=len(counts))
                    held, n = held[:1], 0
        counts += np.bincount((np.concatenate(held) & _LOW).astype(np.int64), minlength=len(counts))
        rows = [i for i in range(len(counts) // each) if counts[i * each : (i + 1) * each].any()]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array([zlib.compress(counts[i * each : (i + 1) * each].tobytes(), 1) for i in rows], pa.binary())], ["row", "counts"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(each, np.int64)
        for batch in batches:
            for value in batch.column("counts"):
                total += np.frombuffer(zlib.decompress(value.as_py()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["row", "counts"])

    shape = "row int, counts binary"
    sums = docs.select("text").mapInArrow(count, shape).groupBy("row").applyInArrow(add, shape)
    out = np.zeros(1 << BUCKET_BITS, np.int64)
    for r in sums.collect():
        out[r["row"] * each : (r["row"] + 1) * each] = np.frombuffer(r["counts"], np.int64)
    return out


def bounds(sizes: np.ndarray, fragments: int) -> np.ndarray:
    """Of each bucket, its fragment: fragments are ranges of the global order that hold about as many shingles each."""
    order = np.argsort(sizes, kind="stable")
    mass = np.cumsum(sizes[order]) - sizes[order] / 2
    out = np.empty(len(sizes), np.int32)
    out[order] = np.minimum(mass * fragments // max(1, sizes.sum()), fragments - 1)
    return out


def _parities(hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Whether an odd number of shingles fell on each of ``bits`` bits."""
    odd = np.bincount((hashes >> np.uint64(32) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _name(hashes: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def _salt(node: int, hashes: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """0 for hashes of buckets with one salt, else one of the bucket's salts, from 1."""
    drawn = (hashes ^ np.uint64(node & 0xFFFFFFFF)) % salts.astype(np.uint64)
    return np.where(salts > 1, drawn + np.uint64(1), np.uint64(0)).astype(np.int32)


def _named(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, node (null without a word), size and parities of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            sets = shingle_sets(part.column("text").to_pylist(), words)
            nodes = pa.array([_name(s) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), nodes, pa.array([len(s) for s in sets], pa.int64()), _lists([_parities(s) for s in sets])], ["doc_id", "node", "size", "odd"])

    rows = docs.select("doc_id", "text")
    fields = {"node": T.LongType(), "size": T.LongType(), "odd": T.ArrayType(T.LongType())}
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], *[T.StructField(k, v) for k, v in fields.items()]]))


def _prefixes(docs: DataFrame, order: object, words: int, least: int) -> DataFrame:
    """node, key, salt: the first shingles of each set in the global order. A task sends a set once; equal texts in other tasks send it again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, salts = order.value
        seen = set()
        for part in _slices(batches):
            nodes, keys, salted = [], [], []
            for found in shingle_sets(part.column("text").to_pylist(), words):
                n = len(found)
                node = _name(found) if n else None
                if node is None or node in seen:
                    continue
                seen.add(node)
                bucket = (found & _LOW).astype(np.int64)
                first = np.argsort(ranks[bucket], kind="stable")[: n - -(-n * least // 100) + 1]
                nodes.append(np.full(len(first), node))
                keys.append(found[first].view(np.int64))
                salted.append(_salt(node, found[first], salts[bucket[first]]))
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (nodes, keys, salted)], ["node", "key", "salt"])

    return docs.select("text").mapInArrow(run, "node long, key long, salt int")


def _possible(least: int) -> Column:
    """Whether rows x and y can be as similar as ``least`` percent: by sizes, and as their sets differ in at least as many
    shingles as their parities do."""
    total = F.col("x.size") + F.col("y.size")
    apart = sum((F.bit_count(F.col("x.odd")[i].bitwiseXOR(F.col("y.odd")[i])) for i in range(BITS // 64)), F.lit(0))
    return (100 * F.least("x.size", "y.size") >= least * F.greatest("x.size", "y.size")) & (apart * (100 + least) <= (100 - least) * total)


def _bitmap(nodes: DataFrame, bits: int) -> np.ndarray:
    """Which values of node modulo ``bits`` occur, as packed bits: at most MAX_FILTER_BITS, however many nodes there are."""
    each = 1 << 13

    def pack(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(each, np.uint8)
        for batch in batches:
            on[batch.column("bit").to_numpy()] = 1
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(on).tobytes()], pa.binary())], ["row", "on"])

    at = F.pmod("node", F.lit(bits))
    rows = nodes.select(F.shiftright(at, 13).cast("int").alias("row"), at.bitwiseAND(F.lit(each - 1)).cast("int").alias("bit")).distinct()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows.groupBy("row").applyInArrow(pack, "row int, on binary").collect():
        out[r["row"] * each // 8 : (r["row"] + 1) * each // 8] = np.frombuffer(r["on"], np.uint8)
    return out


def _wanted(nodes: DataFrame) -> tuple[object, int]:
    """The filter of the nodes given, broadcast, and its bits."""
    bits = 1 << 13
    while bits < min(MAX_FILTER_BITS, FILTER_BITS * nodes.count()):
        bits *= 2
    return nodes.sparkSession.sparkContext.broadcast(_bitmap(nodes, bits)), bits


def _sets(batches: Iterator[pa.RecordBatch], filter_: np.ndarray, bits: int, words: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Nodes and sets of the texts that the filter lets through. A task tells a set once; equal texts in other tasks tell it again."""
    seen = set()
    for part in _slices(batches):
        out = []
        for found in shingle_sets(part.column("text").to_pylist(), words):
            node = _name(found) if len(found) else None
            if node is None or node in seen or not filter_[node % bits >> 3] >> (7 - (node % bits & 7)) & 1:
                continue
            seen.add(node)
            out.append((node, found))
        if out:
            yield out


def _sharp(docs: DataFrame, wanted: tuple[object, int], words: int) -> DataFrame:
    """node, size and ``SHARP_BITS`` parities, of at least the nodes wanted whose sets have ``SHARP_SIZE`` shingles or more."""
    filter_, bits = wanted
    width, least = SHARP_BITS, SHARP_SIZE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets in _sets(batches, filter_.value, bits, words):
            if sets := [(node, found) for node, found in sets if len(found) >= least]:
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in sets], pa.int64()), pa.array([len(s) for _, s in sets], pa.int64()), _lists([_parities(s, width) for _, s in sets])], ["node", "size", "odd"])

    return docs.select("text").mapInArrow(run, "node long, size long, odd array<long>").dropDuplicates(["node"])


def _sharpened(pairs: DataFrame, sharp: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) that may still be as similar as ``least`` percent by the sharper parities of both; exact, as ``_possible``."""
    own = lambda c: sharp.select(F.col("node").alias(c), F.struct("size", "odd").alias(f"{c}_own"))
    both = pairs.join(own("a"), "a", "left").join(own("b"), "b", "left")
    apart = F.aggregate(F.zip_with("a_own.odd", "b_own.odd", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
    fits = apart * (100 + least) <= (100 - least) * (F.col("a_own.size") + F.col("b_own.size"))
    return both.where(F.coalesce(fits, F.lit(True))).select("a", "b")


def _segments(docs: DataFrame, wanted: tuple[object, int], fragment_of: object, words: int) -> DataFrame:
    """node, fragment and the shingles of the node's set in that fragment, of at least the nodes wanted."""
    filter_, bits = wanted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fragments = fragment_of.value
        for sets in _sets(batches, filter_.value, bits, words):
            out = ([], [], [])
            for node, found in sets:
                own = fragments[(found & _LOW).astype(np.int64)]
                turn = np.argsort(own, kind="stable")
                cuts = np.flatnonzero(np.diff(own[turn])) + 1
                for segment in np.split(turn, cuts):
                    out[0].append(node), out[1].append(int(own[segment[0]])), out[2].append(found[segment].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), _lists(out[2])], ["node", "fragment", "hashes"])

    return docs.select("text").mapInArrow(run, "node long, fragment int, hashes array<long>")


def _linked(pairs: DataFrame, segments: DataFrame, sizes: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) of at least ``least`` percent: overlaps are counted for each fragment apart, then summed per pair. Segments go to
    the pairs of their node, where the two of a fragment meet."""
    ends = pairs.select(F.col("a").alias("node"), "a", "b").unionByName(pairs.select(F.col("b").alias("node"), "a", "b"))
    sent = segments.join(ends, "node")
    side = lambda c: F.first(F.when(F.col("node") == F.col(c), F.col("hashes")), ignorenulls=True)
    met = sent.groupBy("a", "b", "fragment").agg(side("a").alias("x"), side("b").alias("y")).where("x is not null and y is not null")
    overlap = met.select("a", "b", F.size(F.array_intersect("x", "y")).alias("n")).groupBy("a", "b").agg(F.sum("n").alias("n"))
    own = lambda c: sizes.select(F.col("node").alias(c), F.col("size").alias(f"{c}_size"))
    whole = overlap.join(own("a"), "a").join(own("b"), "b")
    return written(whole.where(100 * F.col("n") >= least * (F.col("a_size") + F.col("b_size") - F.col("n"))).select("a", "b"))


def _ordered(a: str, b: str) -> list[Column]:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def links(docs: DataFrame, named: DataFrame, order: object, fragment_of: object, words: int = 5, least: int = 80) -> DataFrame:
    """Edges (a, b), a > b, between nodes, whose components are those of all pairs of at least ``least`` percent."""
    traits = written(named.where("node is not null").select("node", "size", "odd").dropDuplicates(["node"]))
    group = Window.partitionBy("key", "salt")
    keyed = _prefixes(docs, order, words, least).select("*", F.min("node").over(group).alias("low"), F.max("node").over(group).alias("high"), F.count("*").over(group).alias("n"))
    shared = written(keyed.where("low < high or salt > 0").select("node", "key", "salt", "n").distinct())
    # the more company a node has, the more of its group it is likely to be similar to: such nodes head their groups first
    company = shared.groupBy("node").agg(F.sum("n").alias("company"))
    # the shingles of a shared passage have the same nodes each: one of them stands for all, told by 128 bits of the nodes' hashes
    alike = shared.groupBy("key", "salt").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("node")).alias("s"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("t"))
    kept = alike.where("salt = 0").groupBy("k", "s", "t").agg(F.min("key").alias("key"), F.count("*").alias("weight")).select("key", F.lit(0).alias("salt"), "weight")
    kept = kept.unionByName(alike.where("salt > 0").select("key", "salt", F.lit(1).cast("long").alias("weight")))
    shared = written(shared.join(kept, ["key", "salt"]).join(company, "node").select("node", "key", "salt", "weight", "company", F.col("node").alias("root")))
    edges = None

    def count(pairs: DataFrame) -> DataFrame:
        ends = lambda p: _wanted(written(p.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
        pairs = written(pairs)
        # whole sets are sent for few pairs only: near copies just under the limit are told by a twentieth of that
        pairs = written(_sharpened(pairs, written(_sharp(docs, ends(pairs), words)), least))
        return _linked(pairs, _segments(docs, ends(pairs), fragment_of, words), traits, least)

    for turn in range(ROUNDS):
        # after the first round a drawn order of nodes; its first node heads the group, but for the nodes of its own component
        place = F.xxhash64(F.lit(turn), "node") if turn else -F.col("company")
        drawn = F.min(F.struct(place.alias("draw"), F.col("node").alias("head"), F.col("root").alias("head_root")))
        heads = shared.groupBy("key", "salt").agg(drawn.alias("h"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
        met = shared.join(heads.select("key", "salt", "h.head", "h.head_root"), ["key", "salt"]).where("root <> head_root")
        # of the heads that a node meets, the one that it shares most of its prefix with
        votes = met.groupBy("node", "head").agg(F.sum("weight").alias("n"))
        stars = votes.groupBy("node").agg(F.max(F.struct("n", "head"))["head"].alias("head")).alias("s")
        x, y = traits.alias("x"), traits.alias("y")
        stars = stars.join(x, F.expr("s.node = x.node")).join(y, F.expr("s.head = y.node")).where(_possible(least)).select(*_ordered("s.node", "s.head")).distinct()
        found = count(stars)
        if found.isEmpty():
            break
        edges = found if edges is None else edges.unionByName(found)
        roots = components(edges).withColumnRenamed("node", "own").withColumnRenamed("root", "now")
        shared = written(shared.join(roots, shared["node"] == roots["own"], "left").select("node", "key", "salt", "weight", "company", F.coalesce("now", "root").alias("root")))
    # all pairs across components, of groups as a whole, in blocks
    mixed = shared.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.count("*") / MEET_ROWS).cast("int").alias("blocks")).where("low < high").select("key", "blocks")
    left = shared.join(mixed, "key").join(traits, "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = written(left.select("node", "key", "root", "size", "odd", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")))
    met = met.select("*", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    x, y = met.where("block = low").alias("x"), met.where("block = high").alias("y")
    apart = F.expr("x.key = y.key and x.low = y.low and x.high = y.high and x.root <> y.root and (x.block < y.block or x.node > y.node)")
    rest = count(x.join(y, apart & _possible(least)).select(*_ordered("x.node", "y.node")).distinct())
    return rest if edges is None else edges.unionByName(rest)


def classes(docs: DataFrame, words: int = 5, least: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable over links, its own included) of every row.

    Two texts link if 100 x intersection >= ``least`` x union of their sets of ``words``-word shingles (A-Z lower-cased; of fewer
    words, the whole sequence). Texts without a word (or null) have an empty set and no link. Only doc_id and text are used. Rows of
    equal id and text get a row each; a null id links, but names no component unless it has no other (then null). Shingles and sets are told
    apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    sizes = bucket_sizes(docs, words)
    ranks = np.empty(len(sizes), np.int32)
    ranks[np.argsort(sizes, kind="stable")] = np.arange(len(sizes), dtype=np.int32)
    order = spark.sparkContext.broadcast((ranks, (sizes // SALT_ROWS + 1).astype(np.uint32)))
    named = written(_named(docs, words))
    longest = named.agg(F.max("size")).first()[0] or 0
    fragment_of = spark.sparkContext.broadcast(bounds(sizes, max(FRAGMENTS, -(-longest // SEGMENT))))
    roots = components(links(docs, named, order, fragment_of, words, least)).withColumnRenamed("node", "own")
    ids = named.groupBy("node").agg(F.min("doc_id").alias("first")).where("node is not null")
    owned = ids.join(roots, ids["node"] == roots["own"], "left").select(F.col("node").alias("own"), "first", F.coalesce("root", "node").alias("root"))
    names = owned.groupBy("root").agg(F.min("first").alias("component"))
    lookup = owned.join(names, "root").select("own", "component")
    rows = named.select("doc_id", "node", "size")
    # texts without a set are linked with nothing, and need no lookup
    full = rows.where("node is not null").join(lookup, rows["node"] == lookup["own"]).select("doc_id", F.col("size").alias("n_shingles"), F.col("component").alias("component_id"))
    return full.unionByName(rows.where("node is null").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id")))
