import numpy as np
import pytest

from freshet.llm import neighbours

SCHEMA = "vec_id long, embedding array<double>, rep string, list int"


def nearest(vectors, k, every):
    """Brute force over (id, vector) pairs."""
    out = {}
    for i, x in vectors:
        if i % every == 0:
            with np.errstate(all="ignore"):
                ranked = sorted((-float(np.dot(x, y)), j) for j, y in vectors if j != i)
            out[i] = [(j, -s) for s, j in ranked[:k]]
    return out


@pytest.mark.parametrize("huge", [1e20, 1e200])
def test_one_huge_vector_hides_no_answer(spark, huge):
    rng = np.random.default_rng(4)
    vectors = [(i, rng.normal(size=8)) for i in range(401)]
    vectors[400] = (400, np.array([huge] + [0.0] * 7))
    rows = [(i, x.tolist(), "r", 1) for i, x in vectors]
    got = neighbours.search(spark.createDataFrame(rows, SCHEMA), k=20).toPandas()
    want = nearest(vectors, 20, 20)
    assert len(got) == 20 * len(want)
    hit = sum(len(set(g["vec_id"]) & {j for j, _ in want[q]}) for q, g in got.groupby("query_id"))
    assert hit / len(got) >= 0.9 and (got.loc[got["rank"] == 1, "score"] >= 0).all()


def test_ties_repeats_and_repeated_ids(spark):
    base = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.5, 0.0]), (40, [0.0, 1.0]), (40, [0.0, 2.0]), (5, [-1.0, 0.0])]
    rows = [(i, x, None, None) for i, x in base] + [(None, [1.0, 1.0], None, None)]
    got = {}
    for r in neighbours.search(spark.createDataFrame(rows, SCHEMA), k=3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got[20] == [(1, 1.0), (2, 1.0), (3, 0.5)]
    assert {j for j, _ in got[40]} <= {1, 2, 3, 5, 20} and 40 not in {j for j, _ in got[40]}


def test_repeated_rows_do_not_crowd_out_others(spark):
    rows = [(20, [1.0, 0.0], None, None)] * 5 + [(1, [0.9, 0.0], None, None)] * 30 + [(i, [0.5 / i, 0.1], None, None) for i in range(2, 9)]
    got = neighbours.search(spark.createDataFrame(rows, SCHEMA), k=4).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(20, 1, 1), (20, 2, 2), (20, 3, 3), (20, 4, 4)]


def test_queries_whose_lists_are_too_short_are_held_against_all(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PROBES", 1)
    rng = np.random.default_rng(6)
    vectors = [(i, rng.normal(size=4)) for i in range(300)]
    got = neighbours.search(spark.createDataFrame([(i, x.tolist(), "", 0) for i, x in vectors], SCHEMA), k=20, lists=60).toPandas()
    want = nearest(vectors, 20, 20)
    assert {q: list(g.sort_values("rank")["vec_id"]) for q, g in got.groupby("query_id")} == {q: [j for j, _ in v] for q, v in want.items()}


@pytest.mark.parametrize("times", [1, 10])
def test_repeated_rows_leave_no_query_short_of_answers(spark, monkeypatch, times):
    monkeypatch.setattr(neighbours, "PROBES", 1)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist(), "r", 1) for i in range(300)] * times
    got = neighbours.search(spark.createDataFrame(rows, SCHEMA), k=20, lists=60).toPandas()
    assert got.groupby("query_id").size().to_dict() == {q: 20 for q in range(0, 300, 20)}
    assert not got.duplicated(["query_id", "vec_id"]).any()
