from datetime import datetime, timedelta

from freshet.streaming import readings


def test_hours_of_a_stream_equal_the_batch(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [("a", start + timedelta(minutes=20 * i), float(i % 7), i % 5 > 0) for i in range(60)] + [("a", start + timedelta(hours=3), 999.0, True)]
    spark.createDataFrame(rows, "station string, ts timestamp, value double, final boolean").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("station string, ts timestamp, value double, final boolean").parquet(str(tmp_path / "in"))
    readings.start(readings.hourly(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    got = {r["hour"]: (r["value"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[start] == (1.0, 3) and all(n == 3 for _, n in got.values()) and len(got) >= 16
