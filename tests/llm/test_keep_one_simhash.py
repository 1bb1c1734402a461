from freshet.llm import overlap, simhash


def test_simhash_finds_near_copies_without_the_bands(spark, monkeypatch):
    monkeypatch.setattr(overlap, "links", lambda *_: spark.createDataFrame([], "a long, b long"))
    line = " ".join(f"word{i}" for i in range(101)) + " "
    # repeated lines decide a fingerprint; where rare words make the sets differ, the exact check keeps both texts
    short = "the river rose over the lower road at night " * 60
    rare = [short + " ".join(f"{c}{i}" for i in range(9)) for c in "ab"]
    docs = spark.createDataFrame([(1, line * 5 + "a"), (2, line * 5 + "b"), (3, rare[0]), (4, rare[1])], "doc_id long, text string")
    fp = [simhash.fingerprint(r["text"]) for r in docs.collect()]
    assert (fp[0] ^ fp[1]).bit_count() <= 2 and (fp[2] ^ fp[3]).bit_count() <= 2
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == {1, 3, 4}
