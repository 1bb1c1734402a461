"""How filters of documents interact, for every order of applying them.

A document's failures make a mask of one bit a filter. All that the audit needs of a part of the documents are three
histograms over masks: of all its documents, of those labelled good and of those labelled toxic. They are stacked as rows of
an incidence matrix and multiplied by integer matrices with a row a mask and a column for each step of each order, one matrix
for each outcome, so the documents are read once, however many orders there are.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.llm.common import written

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
MASKS = 1 << len(FILTERS)
_COPY = 1 << FILTERS.index("E")
_UPPER, _MARKS = bytes(range(65, 91)), b"#$%&*|"


def failures(text: str | None) -> int:
    """Mask of the filters A to D that the text fails (E needs the other texts)."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    points = len(text or "")
    upper = len(data) - len(data.translate(None, _UPPER))
    marked = len(data) != len(data.translate(None, _MARKS))
    failed = (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * upper > 5 * points, marked)
    return sum(1 << i for i, f in enumerate(failed) if f)


def outcome_matrices() -> dict[str, np.ndarray]:
    """For each outcome a matrix of whole numbers, masks x (orders x steps): 1 if documents of that mask have the outcome there."""
    steps = len(FILTERS)
    out = {name: np.zeros((MASKS, len(ORDERS) * steps), np.int64) for name in ("kept", "removed", "redundant", "unique_fails")}
    masks = np.arange(MASKS)
    for o, order in enumerate(ORDERS):
        bits = [1 << FILTERS.index(f) for f in order]
        earlier = 0
        for s, bit in enumerate(bits):
            fails, before, at = (masks & bit) > 0, (masks & earlier) > 0, o * steps + s
            out["removed"][:, at] = fails & ~before
            out["redundant"][:, at] = fails & before
            out["kept"][:, at] = ~fails & ~before
            out["unique_fails"][:, at] = masks == bit
            earlier |= bit
    return out


def masked(docs: DataFrame) -> DataFrame:
    """doc_id, part and mask of every row.

    E: the text equals that of a row of smaller doc_id, wherever that is, compared by 128 bits of hashes. Rows of the same id
    are not smaller than each other; a null id is neither smaller nor larger than another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array((failures(t.as_py()) for t in batch.column("text")), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "part", "t", "u")] + [found], ["doc_id", "part", "t", "u", "mask"])

    whole = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.xxhash64(whole).alias("t"), F.xxhash64(F.lit(1), whole).alias("u"), whole.alias("text"))
    shape = T.StructType([f for f in rows.schema if f.name != "text"] + [T.StructField("mask", T.IntegerType())])
    slim = written(rows.mapInArrow(run, shape))
    # only texts that more than one id has; partial sums spare their rows a common task
    copies = slim.groupBy("t", "u").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("t", "u", "first")
    joined = slim.join(copies, ["t", "u"], "left")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return joined.select("doc_id", "part", (F.col("mask") + F.when(copy, _COPY).otherwise(0)).alias("mask"))


def histograms(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """part and its documents by mask: all (documents), those labelled good and toxic (arrays of 32)."""
    marks = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    each = rows.join(marks, "doc_id", "left")
    counts = each.groupBy("part", "mask").agg(F.count("*").alias("documents"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    slots = lambda c: F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)).cast("long") for m in range(MASKS)]).alias(c)
    return counts.groupBy("part").agg(slots("documents"), slots("good"), slots("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of documents kept, removed, redundant, unique_fails, good_lost, toxic_lost and
    shapley, a row for each part, order and step.

    Null texts count as empty, a null source as the part of empty name. A document is good or toxic if any of its labels says so;
    labels of no document count nowhere. Repeated rows count as often as they occur. An empty table has no parts and no rows. Only
    doc_id, text and source, and doc_id, quality and toxic, are used.
    """
    steps = len(FILTERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrices = outcome_matrices()
        own = np.array([FILTERS.index(f) for order in ORDERS for f in order])
        for batch in batches:
            stacked = {c: np.stack(batch[c].to_numpy()) for c in ("documents", "good", "toxic")}
            n = len(batch)
            found = {name: stacked["documents"] @ m for name, m in matrices.items()}
            found["good_lost"], found["toxic_lost"] = stacked["good"] @ matrices["removed"], stacked["toxic"] @ matrices["removed"]
            # each filter's removals over all orders, wherever it stands
            per_filter = np.stack([found["removed"][:, own == i].sum(1) for i in range(steps)], 1)
            found["shapley"] = per_filter[:, own]
            yield pd.DataFrame({
                "part": np.repeat(batch["part"].to_numpy(), len(own)), "filter_order": np.tile(np.repeat(ORDERS, steps), n),
                "step": np.tile(np.arange(1, steps + 1, dtype=np.int32), n * len(ORDERS)), **{k: v.reshape(-1) for k, v in found.items()},
            })

    shape = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return histograms(masked(docs), labels).mapInPandas(run, shape).select(*[c.strip().split(" ")[0] for c in shape.split(",")])
