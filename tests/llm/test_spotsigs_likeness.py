from freshet.llm import spotsigs


def test_likenesses_equal_brute_force_on_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r for r in spotsigs.fingerprint_edits(docs).collect()}
    ids = sorted(got, reverse=True)
    cut = lambda f: {f[i : i + 8] for i in range(0, len(f), 8)}
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    small = 0
    for own, after in zip(ids, ids[1:] + ids[:1]):
        r = got[own]
        a, e, n = cut(r["fingerprint"]), cut(r["edited_fingerprint"]), cut(got[after]["fingerprint"])
        assert abs(r["near_edited"] - jaccard(a, e)) < 1e-12 and abs(r["near_next"] - jaccard(a, n)) < 1e-12
        small += 0 < r["near_next"] < 0.2
    assert small > 10
