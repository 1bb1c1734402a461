import json
import math

import pytest
from pyspark.sql import functions as F

from freshet.sources import catalog

COLUMNS = "linear_feature_id long, month int, q_m3s double, watershed_group_code string, scenario string, forcing string, source string, code string"


@pytest.fixture
def published(spark, tmp_path):
    rows = [(i, m, i + m / 100, g, "historical", "f1", s, g) for i in range(40) for m in range(3) for g, s in (("CANA", "balance"), ("FRAN", "routed"))]
    df = spark.createDataFrame(rows, COLUMNS)
    catalog.publish(df, str(tmp_path), "segment_monthly", ["linear_feature_id", "month"], file_rows=50)
    return str(tmp_path), df


def test_publish_splits_a_partition_and_keeps_every_row(spark, published):
    root, df = published
    back = spark.read.parquet(f"{root}/segment_monthly")
    assert catalog.set_difference(df, back.select(df.columns)).isEmpty()
    assert {(r["source"], r["n"]) for r in catalog.part_counts(back).collect()} == {("balance", 120), ("routed", 120)}
    assert back.groupBy(F.col("_metadata.file_path")).count().agg(F.max("count")).first()[0] <= 50


def test_manifest_round_trip_and_verification(spark, published, tmp_path):
    root, _ = published
    manifest = catalog.write_manifest(spark, root, "flow/net/v1", [{"source": "balance"}, {"source": "routed"}], {"recipe": "r", "rows": 240})
    assert sum(p["rows"] for p in manifest["parts"]) == 240 and manifest["receipt"]["rows"] == 240
    parts = spark.createDataFrame([(p["key"], p["bytes"], p["md5"]) for p in manifest["parts"]], "key string, bytes long, md5 string")
    assert {r["reason"] for r in catalog.verify(spark, root, parts).collect()} == {""}
    wrong = parts.withColumn("md5", F.lit("0" * 32)).unionByName(spark.createDataFrame([("gone.parquet", 1, "")], parts.schema))
    assert {r["reason"] for r in catalog.verify(spark, root, wrong).collect()} == {"md5 differs", "missing"}


def entry(key, md5="a" * 32):
    return {"key": key, "rows": 1, "bytes": 2, "md5": md5}


KEY = "segment_monthly/scenario=historical/forcing=f1/source=balance/part-CANA.parquet"


def test_read_manifest(spark, tmp_path):
    def read(parts, version=1):
        path = tmp_path / "manifest.json"
        path.write_text(json.dumps({"manifest_version": version, "sources": [{"source": "balance"}], "parts": parts}))
        return catalog.read_manifest(spark, str(path)).collect()

    assert read([entry(KEY)])[0]["code"] == "CANA"
    for parts, version in (([entry(KEY), entry(KEY)], 1), ([entry(KEY, "xyz")], 1), ([entry(KEY.replace("balance", "other"))], 1), ([entry(KEY)], 2)):
        with pytest.raises(ValueError):
            read(parts, version)
    with pytest.raises(Exception, match="bad part key"):
        read([entry("no/part.parquet")])


def test_entries_ledger_and_conform(spark):
    assert catalog.check_entries(["fit/a.json", "receipt/x/y.json"])
    for key in ("../x", "fit/../x", "other/x", "fit/"):
        with pytest.raises(ValueError):
            catalog.check_entries([key])
    schema = "dataset string, scenario string, key string"
    loads = spark.createDataFrame([("d", "h", "a"), ("d", "h", "b"), ("d", "f", "c")], schema)
    assert {r["key"] for r in catalog.ledger(loads, spark.createDataFrame([("d", "h", "z")], schema)).collect()} == {"z", "c"}
    rows = spark.createDataFrame([(1, 2.0, "1981-2010")], "id int, q_m3s double, period string")
    assert catalog.conform(rows, ["id", "period", "q_m3s"], ["id"]).columns == ["id", "period", "q_m3s"]
    with pytest.raises(ValueError):
        catalog.conform(rows, ["id", "q_m3s"], ["id"])
    for bad in ((1, -2.0, "1981-2010"), (1, 2.0, "1981")):
        with pytest.raises(Exception, match="negative"):
            catalog.conform(spark.createDataFrame([bad], rows.schema), rows.columns, ["id"]).collect()


def test_observations_and_content_keys(spark, tmp_path):
    (tmp_path / "a.csv").write_text("station,ts,value,unit\n X1 ,2020-01-01 00:00:00,1500,l/s\nX2,2020-01-01 00:00:00,2.5,m3/s\nX3,2020-01-01 00:00:00,NaN,m3/s\n")
    got = {r["station"]: r["q"] for r in catalog.read_observations(spark, str(tmp_path)).collect()}
    assert got == {"X1": 1.5, "X2": 2.5}
    rows = spark.createDataFrame([(1, math.nan), (1, None), (2, 1.0)], "a int, b double").select(catalog.content_key("a", "b").alias("k")).collect()
    assert rows[0]["k"] == rows[1]["k"] != rows[2]["k"]
