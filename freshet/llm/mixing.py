"""Mixing sources to target weights with Spark's own functions.

Words are summed per source, targets are shares by weight that stop at ``most`` times a source's words, and a source's rate
is its target over its words. A document is emitted floor(rate) times, plus once more if a hash of its id, as a number in
[0, 1), is below the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from freshet.llm.common import WORD, cut

WEIGHTS = (5, 2, 1)
#: Sources up to this number are broadcast; beyond it they are joined by key.
BROADCAST_SOURCES = 50_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: int) -> Column:
    """52 bits of an md5 of seed and id, over 2**52; a null id counts as empty."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """source, source_size, weight, target from one row per source (source, source_size).

    Sources in code-point order, null last, take the weights in turn. Shares of ``share`` x all words, those above ``most``
    x a source's words stopped there and the excess shared again until none is above: ordered by cap over weight, a source
    is stopped if its cap is below its share of what the ones before it leave. All sums are of whole numbers.
    """
    everything, before = Window.partitionBy(), Window.partitionBy().orderBy("_ratio", "_at").rowsBetween(Window.unboundedPreceding, -1)
    turn = F.array(*[F.lit(w) for w in weights])
    ranked = sizes.withColumn("_at", F.row_number().over(Window.partitionBy().orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", F.get(turn, F.pmod(F.col("_at") - 1, F.lit(len(weights)))))
    ranked = ranked.withColumn("_ratio", F.col("source_size") * most / F.col("weight"))
    ranked = ranked.select(
        "*", F.sum("source_size").over(everything).alias("_all"), F.sum("weight").over(everything).alias("_weights"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("_size_before"), F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("_weight_before"),
    )
    left = F.col("_all") * F.lit(share) - F.col("_size_before") * most
    ranked = ranked.withColumn("_stop", F.col("source_size") * most * (F.col("_weights") - F.col("_weight_before")) < left * F.col("weight"))
    stopped = ranked.select(
        "*", F.coalesce(F.sum(F.when(F.col("_stop"), F.col("source_size"))).over(everything), F.lit(0)).alias("_stopped_size"),
        F.coalesce(F.sum(F.when(F.col("_stop"), F.col("weight"))).over(everything), F.lit(0)).alias("_stopped_weight"),
    )
    shared = F.col("weight") * ((F.col("_all") * F.lit(share) - F.col("_stopped_size") * most) / F.nullif(F.col("_weights") - F.col("_stopped_weight"), F.lit(0)))
    return stopped.select("source", "source_size", "weight", F.when(F.col("_stop"), (F.col("source_size") * most).cast("double")).otherwise(shared).alias("target"))


def _with_rate(rows: DataFrame, sizes: DataFrame, seed: int, **options) -> DataFrame:
    """The rows with source_size, target and copies; ``sizes`` has a row per source, counted before it is broadcast."""
    rate = cut(targets(sizes, **options))
    small = F.broadcast(rate) if rate.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else rate
    small = small.select(F.col("source").alias("_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    per_word = F.coalesce(F.try_divide("_target", "_source_size"), F.lit(0.0))
    once = F.when(draw(F.col("doc_id"), seed) < per_word - F.floor(per_word), 1).otherwise(0)
    return rows.join(small, rows["source"].eqNullSafe(small["_source"]), "left").withColumn("_copies", (F.floor(per_word) + once).cast("int"))


def mix_sizes(docs: DataFrame, seed: int = 9, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row.

    Size: words of the text (null: 0). taken: copies x size. A source without words has target 0 and no copy. Null sources
    are a source of their own, the last. Repeated rows count and are drawn alike. No random state: reruns agree.
    """
    sized = cut(docs.select("doc_id", "source", words(F.col("text")).alias("size")))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    return _with_rate(sized, sizes, seed, **options).select(
        "doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("size")).cast("long").alias("taken")
    )


def mix(docs: DataFrame, seed: int = 9, **options) -> DataFrame:
    """The documents themselves, each emitted as many times as the mix takes it, with their columns."""
    names = docs.columns
    sizes = docs.groupBy("source").agg(F.sum(words(F.col("text"))).alias("source_size"))
    taken = _with_rate(docs, sizes, seed, **options).where("_copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*[docs[c] for c in names])
