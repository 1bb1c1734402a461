import random
import re

import numpy as np
import pytest

from freshet.llm import jaccard_join as jj

TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(TO_LOWER))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def texts(draw, families=16):
    """Texts of 10 to 200 words with a passage that half of the families share, each with copies in which some words are replaced."""
    passage = [f"p{i}" for i in range(60)]
    for family in range(families):
        words = [f"w{draw.randrange(3000)}" for _ in range(draw.randrange(10, 200))]
        words[5:5] = passage if family % 2 else []
        for changes in (0, 0, 1, 2, 3, 4, 5, 7):
            copy = list(words)
            for i in draw.sample(range(len(copy)), min(changes, len(copy))):
                copy[i] = f"x{draw.randrange(3000)}"
            yield " ".join(copy)


@pytest.mark.parametrize("small", [False, True])
def test_classes_equal_brute_force(spark, monkeypatch, small):
    if small:  # blocks, salts, fragments and the filter's false hits come into play
        for name, value in {"MEET_ROWS": 3, "SALT_ROWS": 20, "SEGMENT": 8, "FRAGMENTS": 3, "ROUNDS": 1, "FILTER_BITS": 0, "SLICE": 7}.items():
            monkeypatch.setattr(jj, name, value)
    draw = random.Random(3)
    rows = [*enumerate(texts(draw)), (900, "one two"), (901, "ONE  two"), (902, ""), (903, None), (904, " \n\t"), (905, "É a b c d"), (906, "é a b c d"), (907, "a b c d e"), (908, "A b\tc d e"), (None, "a b c d e"), (None, "lone words"), (None, None), (903, "a b"), (903, "a b"), (7, "seven again")]
    # a chain: each text has 95 % of the one before
    base = [f"c{i}" for i in range(204)]
    rows += [(2000 - i, " ".join(base[i * 10 : i * 10 + 104])) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    docs = docs.withColumn("node", docs["doc_id"]).withColumn("size", docs["text"]).withColumn("key", docs["text"])  # clashing names
    got = sorted(map(tuple, jj.classes(docs).collect()), key=str)
    assert got == brute(rows)


def test_empty_tables(spark):
    assert jj.classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert [tuple(r) for r in jj.classes(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [(1, 0, 1)]


def test_fragments_are_ranges_of_the_order():
    sizes = np.random.default_rng(1).integers(0, 50, 1000)
    fragments = jj.bounds(sizes, 8)
    order = np.argsort(sizes, kind="stable")
    assert (np.diff(fragments[order]) >= 0).all()
    mass = np.bincount(fragments, weights=sizes, minlength=8)
    assert mass.min() > 0.8 * sizes.sum() / 8


def test_a_pair_at_the_threshold_links(spark):
    # 84 shared shingles of 105: exactly 80 %
    a = [f"a{i}" for i in range(88)]
    rows = [(1, " ".join(a)), (2, " ".join(a + [f"b{i}" for i in range(21)])), (3, " ".join(a + [f"c{i}" for i in range(22)]))]
    got = {r["doc_id"]: r["component_id"] for r in jj.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_near_copies_under_the_limit_are_not_sent(spark, monkeypatch):
    sent, linked = [], jj._linked
    monkeypatch.setattr(jj, "_linked", lambda pairs, *rest: sent.extend(map(tuple, pairs.collect())) or linked(pairs, *rest))
    # eight texts, each two of 76 %, and four copies of the first, of 93 %
    base = [f"a{i}" for i in range(780)]
    rows = [(t, " ".join(base + [f"b{t}x{i}" for i in range(120)])) for t in range(8)]
    rows += [(100 + t, rows[0][1] + " " + " ".join(f"c{t}x{i}" for i in range(66))) for t in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, jj.classes(docs).collect()), key=str) == brute(rows)
    # only the copies of the first are counted, each pair at most once a round
    assert 4 <= len(sent) <= 10, len(sent)
    assert len({node for pair in sent for node in pair}) == 5
