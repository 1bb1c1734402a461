import numpy as np

from freshet.llm import toxicity


def test_fit_reads_whole_texts(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(toxicity, "calibrate", lambda toxic, ordinary: seen.update(toxic=toxic, ordinary=ordinary))
    long = "plain " * 3_000 + "vileword" + " plain" * 3_000
    docs = spark.createDataFrame([(1, long), (2, "nice text"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    toxicity.fit(docs, labels)
    assert seen == {"toxic": [long], "ordinary": ["nice text"]}


def test_fit_draws_fewer_whole_texts_where_they_are_long(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(toxicity, "calibrate", lambda toxic, ordinary: seen.update(toxic=toxic))
    docs = spark.range(400).selectExpr("id as doc_id", "repeat('abcd ', 100) as text")
    toxicity.fit(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic"), label_chars=25_000)
    assert 20 < len(seen["toxic"]) < 80 and {len(t) for t in seen["toxic"]} == {500}


def test_windows_are_all_words_of_a_text_in_order():
    text = "One, two-three FOUR! a " + "x" * 150 + " end " + "word " * 5_000
    words = [w.strip() for w in toxicity.windows(text)]
    assert words[:5] == [b"one", b"two", b"three", b"four", b"a"] and b"".join(words[5:8]) == b"x" * 150 and words[8:] == [b"end"] + [b"word"] * 5_000
    assert toxicity.windows(None) == toxicity.windows("") == toxicity.windows("... !") == []


def test_distances_equal_windows_compressed_one_by_one(monkeypatch):
    pairs = [(b" vileword other ", b" nice words only "), (b" vile words ", b" some nicer words ")]
    texts = ["a vileword here and nice words there", "", None, "words " * 100]
    distance = toxicity.Distance(pairs)
    for cache in (400_000, 1):
        monkeypatch.setattr(toxicity, "CACHE", cache)
        for text, got in zip(texts, distance(texts), strict=True):
            want = []
            for w in toxicity.windows(text):
                gaps = [np.subtract(*(len(toxicity.Lengths(raw).compressor.compress(w + toxicity._TAIL)) for raw in (ordinary, toxic))) for toxic, ordinary in pairs]
                want.append(sum(gaps) / 2)
            assert got.tolist() == want
    assert next(distance(["vileword"])).max() > 0 > next(distance(["nice"])).min()


def test_edge_rows_with_a_fitted_model(spark):
    rng = np.random.default_rng(3)
    plain = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(300)]
    text = lambda i: " ".join(rng.choice(plain, 60)) + (" grimvoc blastrag" * 6 if i % 2 else "")
    model = toxicity.calibrate([text(1) for _ in range(60)], [text(0) for _ in range(120)])
    rows = [(1, text(1)), (1, text(1)), (2, text(0)), (2**60 + 1, ""), (2**60 + 3, None), (None, text(0)), (4, text(0) * 400)]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert [r["doc_id"] for r in got] == [i for i, _ in rows] and all(0 <= r["score"] <= 1 for r in got)
    assert [r["predicted"] for r in got[:3]] == [1, 1, 0] and got[3]["score"] == got[4]["score"]
