import duckdb
import pytest

from freshet.plans import more, oracles, queries, studies, upkeep
from freshet.plans.views import Tables

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(v):
    try:
        return round(float(v), 5) + 0.0
    except (TypeError, ValueError):
        return str(v)


QUERIES, ORACLES = queries.QUERIES | more.QUERIES | studies.QUERIES | upkeep.QUERIES, oracles.ORACLES | more.ORACLES | studies.ORACLES | upkeep.ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    relation = con.sql(ORACLES[name])
    order = sorted(relation.columns)
    want = sorted([[plain(dict(zip(relation.columns, r))[c]) for c in order] for r in relation.fetchall()], key=str)
    df = QUERIES[name](Tables(spark, SF))
    assert sorted(df.columns) == order
    got = sorted([[plain(r[c]) for c in order] for r in df.collect()], key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5 * max(1, abs(x))) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_query_without_sql_runs_over_its_tables(spark, name):
    assert QUERIES[name](Tables(spark, SF)).count() > 0
