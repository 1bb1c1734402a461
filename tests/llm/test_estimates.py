from freshet.llm import sharding


def test_rounds_of_propagation_keep_size_estimates_short(spark, monkeypatch):
    seen = []
    plain = sharding.written
    monkeypatch.setattr(sharding, "written", lambda df: seen.append(len(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))) or plain(df))
    # a grant of one move a pair and round, so that all rounds are run
    monkeypatch.setattr(sharding, "_grants", lambda wanted, room: {k: 1 for k in sorted(wanted)[:1]})
    linked = spark.range(2000).selectExpr("id as uid", "id div 10 as node", "false as hot", "cast(id % 4 as int) as shard")
    moved = sharding.propagate(linked, [500] * 4, rounds=6)
    assert moved.count() == 2000
    assert len(seen) == 6 and max(seen) < 100
