"""Toxicity by compression distance.

Pairs of zstandard dictionaries are trained, one of each on windows of toxic texts and one on windows of ordinary texts. A window
is a word between spaces, without the marks around it; all windows of the whole text
count, each time that they occur. A window's distance is its length under the ordinary dictionary less its length under the toxic
one, on average over the pairs. A text's score is a logistic of its largest distances, of the numbers and shares of its windows
beyond calibrated thresholds and of their mean distance, fitted on labelled texts that the dictionaries have not seen.

Most of a toxic text is ordinary as well. So both dictionaries have a common part, trained on ordinary windows, and a part of
their own. The toxic one is trained again in rounds: each half of the toxic texts is held against the dictionary trained on
the other half, and the windows that are farther than all but few windows of unseen ordinary texts train the next one.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.llm.common import fold

#: Bytes at which a longer word is cut.
WORD_BYTES = 64
#: Pairs of dictionaries, each trained on another division of the texts: one pair's lengths are whole bytes.
PAIRS = 3
#: Bytes of the dictionaries' common part and of the part of their own.
COMMON_BYTES, OWN_BYTES = 32_768, 16_384
#: Rounds of training, and the share of ordinary windows within the distance beyond which a window trains the next round.
ROUNDS, USUAL = 3, 0.99
#: Windows of each set that dictionaries are trained on: a random choice where the sampled texts have more.
TRAIN_WINDOWS = 300_000
#: Shares of ordinary texts' windows within each threshold.
WITHIN = (0.5, 0.8, 0.9, 0.96, 0.985, 0.995, 0.998, 0.9993, 0.9999)
#: Windows that are compressed together, and whose distances a worker remembers before it starts anew.
PIECE, CACHE = 1 << 16, 800_000
#: Both dictionaries end with it and every window is followed by it; else zstandard would store so short a window as it is.
_TAIL = b"\x00~|0123456789|~\x01"
_WORD = re.compile(rb"[\w\x80-\xff]{1,%d}" % WORD_BYTES)


def windows(text: str | None) -> list[bytes]:
    """The windows of the whole lower-cased text, in order; none without a word. Whatever lies between words is one space."""
    return [b" %b " % word for word in _WORD.findall((text or "").lower().encode("utf-8", "surrogatepass"))]


class Lengths:
    """Lengths of windows compressed with a dictionary."""

    def __init__(self, content: bytes):
        raw = zstandard.ZstdCompressionDict(content + _TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        # the optimal parser: a greedy one's lengths differ by chance about as much as by what a window says
        how = zstandard.ZstdCompressionParameters.from_level(5, min_match=3, strategy=zstandard.STRATEGY_BTOPT, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.compressor = zstandard.ZstdCompressor(dict_data=raw, compression_params=how)

    def __call__(self, some: list[bytes]) -> np.ndarray:
        known = {}
        distinct = list(dict.fromkeys(some))
        for at in range(0, len(distinct), PIECE):
            part = distinct[at : at + PIECE]
            known.update(zip(part, map(len, self.compressor.multi_compress_to_buffer([w + _TAIL for w in part]))))
        return np.fromiter(map(known.__getitem__, some), np.int64, len(some))


class Distance:
    """Distances of a text's windows; ``pairs`` have a toxic and an ordinary dictionary as bytes."""

    def __init__(self, pairs: list[tuple[bytes, bytes]]):
        self.pairs = [(Lengths(toxic), Lengths(ordinary)) for toxic, ordinary in pairs]
        self.known: dict[bytes, float] = {}

    def __call__(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The distances of each text. Texts are taken together, as a call of the compressor costs as much as many windows."""
        held, size = [], 0
        for text in texts:
            held.append(windows(text))
            size += len(held[-1])
            if size >= PIECE:
                yield from self._looked_up(held)
                held, size = [], 0
        yield from self._looked_up(held)

    def _looked_up(self, held: list[list[bytes]]) -> Iterator[np.ndarray]:
        known = self.known
        new = list({w for some in held for w in some if w not in known})
        if len(known) + len(new) > CACHE:
            known.clear()
            new = list({w for some in held for w in some})
        if new:
            far = sum(ordinary(new) - toxic(new) for toxic, ordinary in self.pairs) / len(self.pairs)
            known.update(zip(new, far.tolist()))
        for some in held:
            yield np.fromiter(map(known.__getitem__, some), float, len(some))


def _train(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the samples themselves where there are too few to train on."""
    whole = b"".join(dict.fromkeys(samples))
    if len(whole) <= size:
        return whole
    try:
        return zstandard.train_dictionary(size, samples, k=16, d=6).as_bytes()
    except zstandard.ZstdError:
        return whole[-size:]


def train_pair(toxic: list[str], ordinary: list[str], unseen: list[str], seed: int = 1) -> tuple[bytes, bytes]:
    """(toxic, ordinary) dictionaries. ``unseen`` are ordinary texts that neither is trained on; ``seed`` divides the others."""
    draw = np.random.default_rng(seed)
    toxic, ordinary = ([texts[i] for i in draw.permutation(len(texts)).tolist()] for texts in (toxic, ordinary))

    def stacked(texts: list[str]) -> list[bytes]:
        some = [w for t in texts for w in windows(t)]
        return some if len(some) <= TRAIN_WINDOWS else [some[i] for i in draw.permutation(len(some))[:TRAIN_WINDOWS].tolist()]

    common = _train(stacked(ordinary[::2]), COMMON_BYTES)
    ordinary_pair = _train(stacked(ordinary[1::2]), OWN_BYTES) + common
    usual = Lengths(ordinary_pair)
    halves, others = [stacked(toxic[::2]), stacked(toxic[1::2])], stacked(unseen)
    lengths, other_lengths = list(map(usual, halves)), usual(others)
    chosen = halves
    for _ in range(ROUNDS):
        trained = [Lengths(_train(part, OWN_BYTES) + common) for part in chosen]
        chosen = []
        for half, length, across in zip(halves, lengths, reversed(trained)):
            limit = np.quantile(other_lengths - across(others), USUAL) if others else 0
            chosen.append([half[i] for i in np.flatnonzero(length - across(half) > limit).tolist()])
    return _train(chosen[0] + chosen[1], OWN_BYTES) + common, ordinary_pair


def features(far: np.ndarray, thresholds: np.ndarray) -> list[float]:
    """Of a text's distances: the three largest, log(1 + number) and share beyond each threshold, mean, log(1 + windows)."""
    top = np.sort(np.concatenate((np.full(3, -9.0), far)))[-3:]
    beyond = (far[:, None] > thresholds).sum(0)
    return [*top, *np.log1p(beyond), *(beyond / max(1, len(far))), far.mean() if len(far) else 0.0, np.log1p(len(far))]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-1, steps: int = 60) -> np.ndarray:
    """Newton's method with a ridge on all but the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def calibrate(toxic: list[str], ordinary: list[str]) -> dict | None:
    """Dictionaries from three fifths of the texts, thresholds and logistic weights from the others. Equal texts count once."""
    toxic, ordinary = list(dict.fromkeys(toxic)), list(dict.fromkeys(ordinary))
    if not toxic or not ordinary:
        return None
    part = lambda rows, own: [t for i, t in enumerate(rows) if (i % 5 < 3) == own] or rows
    bad, good = part(toxic, False), part(ordinary, False)
    pairs = [train_pair(part(toxic, True), part(ordinary, True), good[::2], seed) for seed in range(PAIRS)]
    distance = Distance(pairs)
    bad_far, good_far = list(distance(bad)), list(distance(good))
    thresholds = np.unique(np.quantile(np.concatenate([np.zeros(1), *good_far]), WITHIN))
    x = np.array([features(far, thresholds) for far in bad_far + good_far])
    y = np.r_[np.ones(len(bad)), np.zeros(len(good))]
    middle, spread = x.mean(0), x.std(0) + 1e-9
    return {"pairs": pairs, "thresholds": thresholds, "middle": middle, "spread": spread, "weights": _logistic((x - middle) / spread, y)}


def fit(docs: DataFrame, labels: DataFrame, toxic_docs: int = 6_000, ordinary_docs: int = 6_000, label_chars: int = 24_000_000) -> dict | None:
    """Fit on a bounded sample of labelled rows: ids whose hash is among the lowest fraction that gives about so many of each
    label, and fewer where their whole texts hold more than about ``label_chars`` code points. Repeated labels of an id count as toxic if any is;
    null labels and texts are left out. None if a label has no row."""
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = {r["toxic"]: r["n"] for r in marked.where("toxic in (0, 1)").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return None
    draw = F.pmod(F.xxhash64(F.lit("toxic sample"), "doc_id"), F.lit(1_000_000)) / 1_000_000
    chosen = marked.where((F.col("toxic") == 1) & (draw < toxic_docs / n[1]) | (F.col("toxic") == 0) & (draw < ordinary_docs / n[0]))
    # about toxic_docs + ordinary_docs ids: a bounded side, whatever the corpus size
    sample = lambda ids: docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id")
    chars = {r["toxic"]: r["n"] for r in sample(chosen).groupBy("toxic").agg(F.sum(F.char_length("text")).alias("n")).collect()}
    part = {y: min(1, most / n[y]) * min(1, label_chars / max(1, chars.get(y) or 0)) for y, most in ((0, ordinary_docs), (1, toxic_docs))}
    rows = sample(chosen.where((F.col("toxic") == 1) & (draw < part[1]) | (F.col("toxic") == 0) & (draw < part[0]))).select("doc_id", "toxic", "text").collect()
    rows = sorted((r["doc_id"], r["text"], r["toxic"]) for r in rows)
    return calibrate([t for _, t, toxic in rows if toxic == 1], [t for _, t, toxic in rows if toxic == 0])


def predict(texts: list[str | None], model: dict, distance: Distance) -> np.ndarray:
    x = (np.array([features(far, model["thresholds"]) for far in distance(texts)]).reshape(len(texts), -1) - model["middle"]) / model["spread"]
    return 1 / (1 + np.exp(-np.clip(x @ model["weights"][:-1] + model["weights"][-1], -30, 30)))


def score(docs: DataFrame, model: dict | None, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted of every row (only doc_id and text are used; ids of any type pass through untouched). Null and
    empty texts have no window and get the score of a text without any; without a model all scores are 0. Texts are read whole."""
    rows = docs.select("doc_id", "text")
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(shared.value["pairs"])
        for batch in batches:
            value = predict(batch.column("text").to_pylist(), shared.value, distance) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(value, pa.float64()), pa.array((value >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def held_out_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """Learn from labels outside fold ``held`` and score all: doc_id, held_out, score, predicted."""
    model = fit(docs, labels.where(fold(F.col("doc_id"), folds) != held))
    return score(docs, model).select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", "predicted")
