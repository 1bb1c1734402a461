"""Packing, language ID and sharding against plain versions."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from freshet.llm import language_id, packing, sharding


def plain_pack(sizes, lengths):
    """Best fit by looking through all bins: of those that leave least room the one that came to that room last."""
    best = None
    for least in lengths:
        bins, turn = [], 0
        for n in sorted(sizes, reverse=True):
            turn += 1
            fits = [b for b in bins if b["cap"] - b["fill"] >= n]
            if fits:
                b = min(fits, key=lambda b: (b["cap"] - b["fill"], -b["turn"]))
            else:
                cap = min((c for c in lengths if c >= max(n, least)), key=lambda c: (packing.cost(c) / c, c))
                b = {"cap": cap, "fill": 0}
                bins.append(b)
            b["fill"] += n
            b["turn"] = turn
        final = [min(c for c in lengths if c >= b["fill"]) for b in bins]
        total = sum(map(packing.cost, final))
        if best is None or total < best[0]:
            best = total, sorted((f, b["fill"]) for f, b in zip(final, bins))
    return best


@pytest.mark.parametrize("seed", range(6))
def test_packing_equals_best_fit_over_all_bins(seed):
    draw = np.random.default_rng(seed)
    lengths = [[8, 16, 32], [5, 40], [64], [7, 19, 33, 64]][seed % 4]
    sizes = np.minimum(draw.geometric(0.12, 400), lengths[-1])
    bins, starts, final = packing.pack(sizes, lengths)
    fill = np.bincount(bins, sizes).astype(int)
    length = {b: f for b, f in zip(bins.tolist(), final.tolist())}
    total, want = plain_pack(sizes.tolist(), lengths)
    assert sorted((length[b], int(n)) for b, n in enumerate(fill)) == want
    assert math.isclose(sum(packing.cost(f) for f in length.values()), total)
    for b in range(len(fill)):
        held = sorted((int(s), int(n)) for s, n, o in zip(starts, sizes, bins) if o == b)
        assert [s for s, _ in held] == [sum(n for _, n in held[:i]) for i in range(len(held))]


def plain_grams(text):
    """Buckets of the n-grams of a text's letters, runs of others one blank each, a blank at the end."""
    kept = []
    for c in text.lower() + "\0":
        if c.isalpha() or (kept and kept[-1].isalpha()):
            kept.append(c if c.isalpha() else " ")
    out = Counter()
    for n in range(1, language_id.MAX_N + 1):
        for i in range(len(kept) - n + 1):
            if not (kept[i].isalpha() or kept[i + n - 1].isalpha()):
                continue
            h = 0
            for c in kept[i : i + n]:
                h = (h * 0x01000193 & 0xFFFFFFFF) ^ (ord(c) * 0x9E3779B1 & 0xFFFFFFFF)
            out[((h + n) * 0x85EBCA6B & 0xFFFFFFFF) >> (32 - language_id.BUCKET_BITS)] += 1
    return out


TRAIN = [("en", "The river runs to the sea."), ("en", "a day of rain, and then"), ("de", "Der Fluss läuft zum Meer"), ("de", "ein Tag voll Regen; und dann"), ("fr", "La rivière court vers la mer"), ("fr", "un jour de pluie")]
ASKED = ["the rain", "Regen am Meer", "", None, "123 ... !", "x", "la pluie et la mer", "ein Tag", "the rain"]


def test_naive_bayes_equals_a_plain_one(spark):
    rows = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(TRAIN)], "doc_id long, text string, lang string")
    model = language_id.fit(rows)
    langs = sorted({k for k, _ in TRAIN})
    size = 1 << language_id.BUCKET_BITS
    counts = {k: sum((plain_grams(t) for own, t in TRAIN if own == k), Counter()) for k in langs}
    got = language_id.identify(spark.createDataFrame(list(enumerate(ASKED)), "doc_id long, text string"), model).collect()
    for r in got:
        grams = plain_grams(ASKED[r["doc_id"]] or "")
        n = sum(grams.values())
        if not n:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        logs = [sum(c * math.log((counts[k][g] + 0.5) / (sum(counts[k].values()) + 0.5 * size)) for g, c in grams.items()) * min(1, language_id.EVIDENCE / n) + math.log(sum(own == k for own, _ in TRAIN) / len(TRAIN)) for k in langs]
        odds = [math.exp(x - max(logs)) for x in logs]
        assert r["lang_pred"] == langs[int(np.argmax(odds))] and r["score"] == pytest.approx(max(odds) / sum(odds), abs=1e-4)


def test_scores_do_not_depend_on_the_batch_nor_on_slices(spark, monkeypatch):
    model = language_id.fit(spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(TRAIN)], "doc_id long, text string, lang string"))
    long = "Der Regen fällt, the river rises. " * 40
    asked = [*ASKED, long, "ein Tag"]
    alone = [language_id.score([t], model) for t in asked]
    for chars in (language_id.PIECE_CHARS, 50, 7):
        monkeypatch.setattr(language_id, "PIECE_CHARS", chars)
        langs, scores = language_id.score(asked, model)
        assert langs == [a[0][0] for a in alone] and np.allclose(scores, [a[1][0] for a in alone], atol=1e-5)


def test_sharding_moves_groups_together_as_a_plain_reading_of_its_law_says(spark):
    texts = [f"group {i}" for i in range(12) for _ in range(2 + i % 5)] + [f"alone {i}" for i in range(83)] + ["hot"] * 70 + [None, None, ""]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), 6).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(rows)))
    held = Counter(r["shard"] for r in got)
    assert set(held) == set(range(6)) and max(held.values()) - min(held.values()) <= 1
    for s in range(6):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(held[s]))
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
    where = {}
    for r in got:
        where.setdefault(texts[r["doc_id"]], Counter())[r["shard"]] += 1
    pairs = lambda n: n * (n - 1) // 2
    cut = sum(pairs(sum(c.values())) - sum(map(pairs, c.values())) for t, c in where.items() if t != "hot")
    # dealt by rank, nearly all pairs would be cut; the hot group alone is split, into pieces of half a quota at most
    assert cut <= 0.2 * sum(pairs(sum(c.values())) for t, c in where.items() if t != "hot")
    report = sharding.cut_share(spark.createDataFrame(got, "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int")).first()
    assert report["pairs"] == sum(pairs(sum(c.values())) for c in where.values()) + 2  # a null and an empty text are alike in size and crc32
