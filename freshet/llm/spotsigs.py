"""SpotSigs fingerprints with Spark's own functions.

A signature is a common word (the anchor) with the chain of content words that follows it; of anchors in a row each has one. A
text's fingerprint is the set of its signatures' hashes. Fingerprints are partitioned by set length into classes and compared by
Jaccard where it can reach the wanted likeness: sets of classes that are no neighbours, and sets whose sizes differ by more than
that likeness allows, are never intersected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from freshet.llm.common import cut, let

#: Common words of English, German, French and Spanish (fixed values).
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was were will with "
    "als am auf aus das dem den der des die ein eine einer es für im ist mit nicht sich sie und von war zu "
    "au aux avec ce dans de du en est et il la le les par pas pour que qui se sur un une "
    "con del el era las lo los más no para por se su una y"
).split()
CHAIN = 2
#: Rows whose neighbours are looked up together, and the most cells that the range of ids is cut into: beyond their product a
#: cell has more rows, so that tables with a row per cell stay small.
RANGE_ROWS, MAX_CELLS = 512, 65_536
_OPEN, _CLOSE = "\x01", "\x02"


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """Sorted distinct signature hashes (array<int>). The text's start counts as an anchor and its first word is a
    signature by itself, so that any text with a word has one; a text without one (or null) has none. A chain that the text's end cuts is kept short."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    anchored = F.regexp_replace(F.concat(F.lit(" "), F.trim(plain), F.lit(" ")), f"(?<= )({'|'.join(dict.fromkeys(ANCHORS))}) ", f"{_OPEN}$1{_CLOSE}")
    words = F.split(F.concat(F.lit(f"{_OPEN}^{_CLOSE}"), F.trim(anchored)), " ")

    def signed(x: Column, i: Column, every: Column) -> Column:
        follow = [F.substring_index(F.get(every, i + k), _CLOSE, -1) for k in range(1, chain)]
        own = F.filter(F.split(x, _CLOSE), lambda a: F.startswith(a, F.lit(_OPEN)))
        hashes = F.transform(own, lambda a: F.shiftright(F.xxhash64(a, F.substring_index(x, _CLOSE, -1), *follow), 32).cast("int"))
        return F.when(F.startswith(x, F.lit(_OPEN)), hashes)

    found = let(words, lambda every: F.flatten(F.filter(F.transform(every, lambda x, i: signed(x, i, every)), lambda h: h.isNotNull())))
    return F.when(F.regexp_like(text, F.lit(r"[\p{L}\p{N}]")), F.array_sort(F.array_distinct(F.concat(found, F.array(F.shiftright(F.xxhash64(F.split_part(F.trim(plain), F.lit(" "), F.lit(1))), 32).cast("int")))))).otherwise(F.array().cast("array<int>"))


def as_text(fingerprint: Column) -> Column:
    """Eight hexadecimal digits a signature, in the set's order."""
    return F.array_join(F.transform(fingerprint, lambda h: F.lpad(F.hex(h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def size_class(fingerprint: Column, least: float) -> Column:
    """Partition by set size: sets at least ``least`` alike are in the same or a neighbouring class."""
    return F.floor(F.log(F.greatest(F.size(fingerprint), F.lit(1)).cast("double")) / F.lit(math.log(1 / least))).cast("int")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard of two fingerprints if it is at least ``least``, else 0; two empty ones are alike (1). Sets whose lengths rule
    ``least`` out, first by their classes, are not intersected."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b))
    pruned = (small == 0) | (small < large * F.lit(least))
    if least > 0:
        pruned = (F.abs(size_class(a, least) - size_class(b, least)) > 1) | pruned
    value = shared / (F.size(a) + F.size(b) - shared)
    return F.when(large == 0, 1.0).when(pruned, 0.0).otherwise(F.when(value >= least, value).otherwise(0.0))


def pairs(docs: DataFrame, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(class pairs a, b, likeness of at least ``least``; membership doc_id, a) over equal fingerprints.

    Candidates share a size class (or are neighbours) and one of the signatures that come first by hash: sets that much alike
    share one within their first size - ceil(least x size) + 1. Documents with equal fingerprints are one class, named by the
    smallest id, so copies are not paired; empty fingerprints are a class of their own, alike to nothing else.
    """
    each = cut(docs.select("doc_id", signatures(F.col("text")).alias("fp")))
    classes = each.groupBy("fp").agg(F.min("doc_id").alias("a"))
    prefix = F.slice("fp", 1, F.size("fp") - F.ceil(F.size("fp") * F.lit(least)).cast("int") + 1)
    keyed = classes.where(F.size("fp") > 0).select("a", "fp", F.explode(prefix).alias("sig"), size_class(F.col("fp"), least).alias("k"))
    left = keyed.select(F.col("a"), F.col("fp"), "sig", F.explode(F.array(F.col("k"), F.col("k") + 1)).alias("k"))
    right = keyed.select(F.col("a").alias("b"), F.col("fp").alias("fq"), "sig", "k")
    order = (F.size("fp") < F.size("fq")) | ((F.size("fp") == F.size("fq")) & (F.col("a") < F.col("b")))
    near = left.join(right, ["sig", "k"]).where(order).withColumn("likeness", likeness(F.col("fp"), F.col("fq"), least)).where(F.col("likeness") >= least)
    return near.select("a", "b", "likeness").distinct(), each.join(classes, "fp").select("doc_id", "a")


def _ranges(docs: DataFrame) -> tuple[DataFrame, Column]:
    """lo, step, base, alone per cell of the id range: a row's bucket is base + floor((doc_id - lo) / step), in the order of ids.

    Cells are equally wide; one with far more rows than others is cut again by its own bounds, one of a single id by the texts'
    hashes. One row for some hundred documents, ``MAX_CELLS`` at most.
    """
    ids = docs.where("doc_id is not null").select("doc_id")
    low, high, n = ids.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    low, high = (low or 0), (high or 0)
    cells = max(1, min(MAX_CELLS, n // RANGE_ROWS))
    usual = max(RANGE_ROWS, -(-n // cells))
    width = max(1, -(-(high - low + 1) // cells))
    cell = F.floor((F.col("doc_id") - low) / width)
    found = ids.groupBy(cell.alias("cell")).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n"))
    parts = F.greatest(F.lit(1), F.floor(F.col("n") / (4 * usual)) * 4)
    found = found.withColumn("step", F.ceil((F.col("hi") - F.col("lo") + 1) / parts)).withColumn("alone", (F.col("lo") == F.col("hi")) & (F.col("n") > 4 * usual))
    found = found.withColumn("slots", F.when(F.col("alone"), F.lit(256)).otherwise(F.floor((F.col("hi") - F.col("lo")) / F.col("step")) + 1))
    before = Window.partitionBy().orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # MAX_CELLS rows at most
    return found.select("cell", "lo", "step", "alone", F.coalesce(F.sum("slots").over(before), F.lit(0)).alias("base")), cell


def with_next(docs: DataFrame, fingerprint: Column) -> DataFrame:
    """doc_id, text, fp and the next row's next_text, next_fp in descending doc_id order (nulls last); after the last comes
    the first. Ties of doc_id follow the text's hash.

    Rows are dealt to buckets by id range. Each bucket's first row is handed on to the bucket before it (the first of all to
    the last), so that the neighbour of every row is found inside its bucket and the texts are shuffled once.
    """
    ranges, cell = _ranges(docs)
    ranges = cut(ranges)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).withColumn("cell", cell)
    rows = rows.join(F.broadcast(ranges), "cell", "left")  # MAX_CELLS rows at most, 40 bytes each
    by_hash = F.shiftright("h", 56) + 128  # 0 to 255, in the order of hashes
    own = F.col("base") + F.when(F.col("alone"), by_hash).otherwise(F.floor((F.col("doc_id") - F.col("lo")) / F.col("step")))
    rows = rows.withColumn("bucket", F.coalesce(own, by_hash - 256)).select("bucket", "doc_id", "h", "text")
    firsts = rows.groupBy("bucket").agg(F.max(F.struct("doc_id", "h")).alias("first"))
    turn = Window.partitionBy().orderBy("bucket")
    # a row per bucket: at most some three times MAX_CELLS
    firsts = cut(firsts.select(F.col("first.doc_id").alias("fid"), F.col("first.h").alias("fh"), F.col("bucket").alias("own"), F.lead("bucket").over(turn).alias("to"), F.min("bucket").over(Window.partitionBy()).alias("lowest"), F.max("bucket").over(Window.partitionBy()).alias("highest")))
    # the first row of a bucket follows the last of the bucket above; the first of all follows the last of the lowest
    to = firsts.select("own", "fid", "fh", F.when(F.col("own") == F.col("highest"), F.col("lowest")).otherwise(F.col("to")).alias("to"))
    both = rows.join(F.broadcast(to), (rows["bucket"] == to["own"]) & rows["doc_id"].eqNullSafe(to["fid"]) & (rows["h"] == to["fh"]), "left")
    targets = F.filter(F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("guest")), F.when(F.col("own").isNotNull(), F.struct(F.col("to").alias("bucket"), F.lit(1).alias("guest")))), lambda x: x.isNotNull())
    dealt = both.select("doc_id", "h", "text", fingerprint.alias("fp"), F.explode(targets).alias("at")).select("doc_id", "h", "text", "fp", "at.*")
    order = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.col("h").desc())
    seen = dealt.select("doc_id", "text", "fp", "guest", F.lead("text").over(order).alias("next_text"), F.lead("fp").over(order).alias("next_fp"))
    return seen.where("guest = 0").drop("guest")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text is the text with its last floor(n_chars / 3) code points replaced by the first as many (or all) of the
    next row's. Both likenesses are exact: of two given fingerprints nothing is left to search, so the partition by set
    length, which rules out candidates, has its place in ``pairs`` only. Null texts count as empty; a lone row's next is itself; repeated rows get a row each; null ids come last.
    """
    near = with_next(docs, signatures(F.col("text")))
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = near.select("doc_id", n.cast("long").alias("n_chars"), "fp", "next_fp", F.concat(F.substr("text", F.lit(1), n - third), F.substr("next_text", F.lit(1), third)).alias("edited"))
    edited = edited.select("*", signatures(F.col("edited")).alias("edited_fp"))
    return edited.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
