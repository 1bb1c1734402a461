"""Language ID by multinomial naive Bayes over hashed character n-grams.

Each text is reduced to its letters (anything else is a word break), hashed n-grams of 1 to ``MAX_N`` code points index a
log-probability matrix that is broadcast, and a batch is scored as a sparse matrix (row starts + bucket indices) in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.llm.common import fold

MAX_N = 3
BUCKET_BITS = 16
#: A piece of work holds about so many code points, whatever the batch or the text is.
PIECE_CHARS = 400_000
#: The matrix has 2**BUCKET_BITS x languages floats; beyond this many languages it is no longer broadcast material.
MAX_LANGUAGES = 400
#: The posterior counts at most so many n-grams of a text: neighbouring n-grams are not independent evidence.
EVIDENCE = 200.0
UNKNOWN = "und"
_ALPHA: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Is the code point a letter, for the whole Unicode range; made once per worker."""
    if not _ALPHA:
        _ALPHA.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _ALPHA[0]


def _pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[str], list[int]]]:
    """(row numbers, strings, known): whole texts together, very long ones in slices. A slice begins with the MAX_N - 1 code
    points before it; ``known`` of its code points were in the slice before."""
    rows: list[int] = []
    parts: list[str] = []
    known: list[int] = []
    size = 0
    for row, text in enumerate(texts):
        if not text:
            continue
        text = text.lower() + "\0"  # every text ends its last word, wherever it stands in a batch
        for start in range(0, len(text), PIECE_CHARS):
            before = min(start, MAX_N - 1)
            part = text[start - before : start + PIECE_CHARS]
            if parts and size + len(part) > PIECE_CHARS:
                yield np.array(rows), parts, known
                rows, parts, known, size = [], [], [], 0
            rows.append(row)
            parts.append(part)
            known.append(before)
            size += len(part)
    if parts:
        yield np.array(rows), parts, known


def _grams(parts: list[str], known: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram, which part it is of), those left out that touch no letter or end among the known code points."""
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(p) for p in parts])
    part = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
    fresh = np.arange(len(codes)) >= np.repeat(np.cumsum(sizes) - sizes + known, sizes)
    letter = _letters()[codes]
    codes = np.where(letter, codes, 32).astype(np.uint32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes, part, letter, fresh = codes[keep], part[keep], letter[keep], fresh[keep]
    buckets, owners = [], []
    mixed = np.zeros(len(codes), np.uint32)
    for n in range(1, MAX_N + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        mixed = (mixed[:m] * np.uint32(0x01000193)) ^ (codes[n - 1 : n - 1 + m] * np.uint32(0x9E3779B1))
        good = (part[:m] == part[n - 1 : n - 1 + m]) & (letter[:m] | letter[n - 1 : n - 1 + m]) & fresh[n - 1 : n - 1 + m]
        spread = (mixed + np.uint32(n)) * np.uint32(0x85EBCA6B)
        buckets.append((spread >> np.uint32(32 - BUCKET_BITS))[good])
        owners.append(part[:m][good])
    if not buckets:
        return np.zeros(0, np.uint32), np.zeros(0, np.int32)
    return np.concatenate(buckets), np.concatenate(owners)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, group in batch.groupby("lang"):
            total = sums.setdefault(lang, np.zeros(1 << BUCKET_BITS, np.int64))
            for _, parts, known in _pieces(group["text"].tolist()):
                total += np.bincount(_grams(parts, known)[0], minlength=1 << BUCKET_BITS)
    for lang, total in sums.items():
        hit = np.flatnonzero(total)
        yield pd.DataFrame({"lang": lang, "bucket": hit.astype(np.int32), "n": total[hit]})


def fit(labelled: DataFrame, sample_per_language: int = 20_000, alpha: float = 0.5) -> dict | None:
    """Count n-grams of labelled (doc_id, text, lang) rows and return languages, priors and the log-probability matrix.

    Languages are counted over all rows. Texts: where a language has over ``sample_per_language`` rows, those whose id
    hashes below sample/rows of the hash range (about that many). Rows with null text or lang are left out. None if no
    row is left.
    """
    rows = labelled.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if not sizes:
        return None
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages: the matrix would be too large to broadcast")
    rate = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample_per_language / n))])
    taken = rows.where(F.pmod(F.xxhash64(F.lit("language sample"), "doc_id"), F.lit(1_000_000)) < rate[F.col("lang")] * 1_000_000)
    counts = (
        taken.select("lang", "text").mapInPandas(_count, "lang string, bucket int, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    )
    langs = sorted(sizes)
    table = np.full((1 << BUCKET_BITS, len(langs)), alpha)
    at = {k: i for i, k in enumerate(langs)}
    table[counts["bucket"].to_numpy(int), counts["lang"].map(at).to_numpy(int)] += counts["n"].to_numpy(float)
    logs = (np.log(table) - np.log(table.sum(0))).astype(np.float32)
    total = sum(sizes.values())
    return {"langs": langs, "prior": np.log([sizes[k] / total for k in langs]), "logs": logs}


def score(texts: list[str | None], model: dict) -> tuple[list[str], np.ndarray]:
    """Predicted language and tempered posterior of each text."""
    sums = np.zeros((len(texts), len(model["langs"])))
    grams = np.zeros(len(texts))
    logs = model["logs"]
    for rows, parts, known in _pieces(texts):
        buckets, owners = _grams(parts, known)
        if not len(buckets):
            continue
        # one ordered run per n: reduceat over each run adds a part's rows without building a dense count matrix
        edges = np.flatnonzero(np.diff(owners, prepend=owners[0] - 1))
        np.add.at(sums, rows[owners[edges]], np.add.reduceat(logs[buckets], edges, axis=0))
        np.add.at(grams, rows[owners[edges]], np.diff(np.append(edges, len(owners))))
    scaled = sums * np.minimum(1.0, EVIDENCE / np.maximum(grams, 1.0))[:, None] + model["prior"]
    scaled = np.exp(scaled - scaled.max(1, keepdims=True))
    posterior = scaled / scaled.sum(1, keepdims=True)
    best = posterior.argmax(1)
    known = grams > 0
    return [model["langs"][b] if k else UNKNOWN for b, k in zip(best, known)], np.where(known, posterior.max(1), 0.0)


def identify(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, lang_pred, score for every row of ``docs`` (columns doc_id and text are used, any other is ignored).

    Null texts and texts without a letter: ``und`` with score 0; so does everything if there is no model. Repeated rows get
    a row each. No limit on the text's length.
    """
    rows = docs.select("doc_id", "text")
    if model is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, value = score(batch.column("text").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(value, pa.float64())], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def held_out_language(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """Learn from the rows outside fold ``held`` and predict all: doc_id, held_out, lang_pred, score."""
    model = fit(docs.where(fold(F.col("doc_id"), folds) != held))
    return identify(docs, model).select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose language is recognised with a score of at least ``least``, with all their columns. Learns from the
    labelled documents themselves; without any, documents are kept as they are."""
    model = fit(docs)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, value = score(batch.column("text").to_pylist(), shared.value)
            good = (np.array(lang, object) != UNKNOWN) & (value >= least)
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
