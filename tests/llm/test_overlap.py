import random

from freshet.llm import overlap, simhash


def similarity(a, b):
    sets = []
    for text in (a, b):
        w = (text or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 5 else {tuple(w)})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def planted(seed=5, families=25):
    """Texts of 60 to 300 words, each with copies in which up to six words are replaced."""
    draw, rows = random.Random(seed), []
    for _ in range(families):
        words = [f"w{draw.randrange(5000)}" for _ in range(draw.randrange(60, 300))]
        for changes in (0, 1, 1, 2, 3, 4, 6):
            copy = list(words)
            for i in draw.sample(range(len(copy)), changes):
                copy[i] = f"x{draw.randrange(5000)}"
            rows.append(" ".join(copy))
    draw.shuffle(rows)
    return rows


def kept(rows, least=0.8):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if similarity(rows[i], rows[j]) >= least:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i for i in range(len(rows)) if find(i) == i}


def test_keep_one_equals_brute_force_on_planted_copies(spark):
    rows = [*planted(), "", None, "one two", "ONE  two", "a b c d e", "a b c d f"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    want = kept(rows)
    assert len(want) < 100
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == want


def test_pairs_across_groups_of_a_band_are_seen(spark, monkeypatch):
    # one band for all texts: heads alone would leave the pairs of other groups
    monkeypatch.setattr(overlap, "bands", lambda hashes: overlap.np.zeros(1, "int64"))
    rows = planted(6, 8)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == kept(rows)


def test_repeated_ids_keep_unique_texts(spark):
    rows = [(3, "A"), (5, "A"), (5, "B"), (5, "B"), (None, "A"), (None, "C"), (None, "C"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, simhash.keep_one(docs).collect()), key=str) == sorted([(3, "A"), (5, "B"), (None, "C"), (None, None)], key=str)


def test_blocks_of_a_band_see_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(overlap, "bands", lambda hashes: overlap.np.zeros(1, "int64"))
    monkeypatch.setattr(overlap, "MEET_ROWS", 7)
    rows = planted(8, 8)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == kept(rows)
