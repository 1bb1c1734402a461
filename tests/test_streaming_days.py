from datetime import datetime, timedelta

import pytest

from freshet.operators import series
from freshet.streaming import days


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(key, old)


def test_late_readings_change_days_as_the_batch_says(rocks, tmp_path):
    spark, begun = rocks, datetime(2024, 1, 1, 8)
    shape = "station string, ts timestamp, value double, final boolean"
    hour = lambda s, h, v, f=True, m=0: (s, begun + timedelta(hours=h, minutes=m), v, f)
    batches = [
        [hour(s, h, float(h % 24)) for s in "ab" for h in range(48)] + [hour("a", 3, 999.0), hour("c", 0, 1.0)],
        # late: a provisional reading in a's first day, hours that make c's day whole, and one that only moves a mean
        [hour("a", 5, 6.5, False, 20)] + [hour("c", h, 2.0, h != 7) for h in range(1, 24)] + [hour("b", 30, 9.0, True, 40), hour("b", 60, 3.0)],
        [hour("a", 26, 1.0, None, 10)],
    ]
    source = str(tmp_path / "in")
    stream = days.days(spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(source + "/*"), keep_days=30)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, shape).coalesce(1).write.parquet(f"{source}/{i}")
        days.start(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
        so_far = spark.createDataFrame([r for b in batches[: i + 1] for r in b], shape)
        want = sorted(map(tuple, series.readings_to_days(so_far).collect()))
        got = sorted(map(tuple, days.latest(spark, str(tmp_path / "out")).collect()))
        assert [g[:2] + g[5:] for g in got] == [w[:2] + w[5:] for w in want]
        for g, w in zip(got, want):
            assert g[2:5] == pytest.approx(w[2:5])
    status = {(r["station"], r["date"].day): r["status"] for r in days.latest(spark, str(tmp_path / "out")).collect()}
    assert status == {("a", 1): "provisional", ("a", 2): "provisional", ("b", 1): "approved", ("b", 2): "approved", ("c", 1): "provisional"}


def test_days_beyond_the_state_are_closed(rocks, tmp_path):
    spark, begun = rocks, datetime(2024, 1, 1, 8)
    shape = "station string, ts timestamp, value double, final boolean"
    source = str(tmp_path / "in")
    stream = days.days(spark.readStream.schema(shape).parquet(source + "/*"), keep_days=5)
    for i, rows in enumerate(([("a", begun + timedelta(hours=h), 1.0, True) for h in range(24)] + [("a", begun + timedelta(days=9), 1.0, True)], [("a", begun, 30.0, False)])):
        spark.createDataFrame(rows, shape).coalesce(1).write.parquet(f"{source}/{i}")
        days.start(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert days.latest(spark, str(tmp_path / "out")).count() == 0
