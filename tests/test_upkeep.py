import hashlib
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from freshet.operators import models, network, rebuild, snow
from freshet.sources import catalog
from freshet.sources.registry import Entry, Registry
from test_network import random_tree, upstream

WS = "id long, w string, l string, area double, v double, grp string"


def network_rows(rng):
    return [(i, w, lo, a, float(i % 7), "G" + w[4:8].replace("0", "A").ljust(3, "B")[:3].upper()) for i, w, lo, a in random_tree(rng)]


def build(ws):
    return network.upstream_mean(ws, "v").withColumn("month", F.lit(1)).withColumn("q_m3s", F.coalesce("mean", F.lit(0.0)))


def digests(root):
    return {str(p.relative_to(root)): hashlib.md5(p.read_bytes()).hexdigest() for p in Path(root).rglob("part-*.parquet")}


def test_a_rebuild_of_the_touched_groups_equals_a_full_one(spark, tmp_path):
    rows = network_rows(random.Random(11))
    groups = sorted({r[5] for r in rows})
    assert len(groups) > 2
    place = max((r for r in rows if r[1] == r[2]), key=lambda r: len(r[1]))
    new = [(*r[:4], r[4] + 10, r[5]) if r[0] == place[0] else r for r in rows]
    old_ws, new_ws = spark.createDataFrame(rows, WS), spark.createDataFrame(new, WS)
    run = {"scenario": "historical", "forcing": "f1", "source": "balance"}
    whole = lambda ws: build(ws).join(ws.select("id", "grp"), "id")
    tag = lambda df: df.withColumn("code", F.col("grp")).withColumns({k: F.lit(v) for k, v in run.items()})
    catalog.publish(tag(whole(old_ws)), str(tmp_path), "segment_monthly", ["id"])
    before = digests(tmp_path)
    changed = rebuild.changed_rows(old_ws, new_ws, ["area", "v"])
    hit = {r[5] for r in rows if upstream(r[1], r[2], place[1], place[2])}
    report = rebuild.republish(new_ws, changed, build, str(tmp_path), "segment_monthly", "grp", run, ["id"], {"q_m3s": 1e-9, "coverage": 1e-9})
    told = {r["value"]: r for r in report.collect()}
    assert told["q_m3s"]["differing"] > 0 and not told["q_m3s"]["same"] and told["coverage"]["same"]
    now = spark.read.parquet(f"{tmp_path}/segment_monthly")
    compared = network.compare_values(whole(new_ws), now, ["id"], "q_m3s", 1e-12).first()
    assert (compared["only_a"], compared["only_b"], compared["differing"]) == (0, 0, 0)
    after = digests(tmp_path)
    kept = {k for k in before if not any(f"code={g}/" in k for g in hit)}
    assert kept and all(after.get(k) == before[k] for k in kept)


def test_changes_are_those_that_came_went_moved_or_differ(spark):
    a = spark.createDataFrame([(1, "100", "100", 1.0, None, "A"), (2, "100", "100.000001", 1.0, 2.0, "A"), (3, "100", "100.000002", 1.0, 2.0, "A")], WS)
    b = spark.createDataFrame([(1, "100", "100", 1.0, None, "A"), (2, "100", "100.000005", 1.0, 2.0, "A"), (4, "100", "100.000003", 1.0, None, "A")], WS)
    assert {(r["id"], r["l"]) for r in rebuild.changed_rows(a, b, ["area", "v"]).collect()} == {(2, "100.000001"), (2, "100.000005"), (3, "100.000002"), (4, "100.000003")}
    assert rebuild.changed_rows(a, a, ["area", "v"]).isEmpty() and rebuild.affected(a, rebuild.changed_rows(a, a, ["v"])).isEmpty()


def test_closures_of_all_groups_equal_each_group_alone(spark):
    rows = network_rows(random.Random(5))
    ws = spark.createDataFrame([*rows, (900, None, "100", 1.0, 1.0, "LOST")], WS)
    held = {(r["grp"], r["id"]) for r in network.group_closures(ws).collect()}
    below = lambda a, b: a == b or a.startswith(b + ".")
    assert held == {(c[5], r[0]) for c in rows for r in rows if below(r[1], c[1])}
    assert network.group_closures(ws).count() == len(held)


def test_folds_say_what_is_nested_and_refuse_bad_stations(spark):
    shape = "station string, w string, l string, area double"
    rows = [("AAAA1", "100", "100", 10.0), ("AAAA2", "100.000001", "100.000001", 4.0), ("BBBB1", "100.000002", "100.000002", 5.0)]
    got = {r["station"]: r for r in network.cv_folds(spark.createDataFrame(rows, shape)).collect()}
    assert [got[s]["nesting"] for s in ("AAAA1", "AAAA2", "BBBB1")] == ["nested", "headwater", "headwater"]
    assert got["AAAA1"]["leak_up"] == 0.5 and got["BBBB1"]["leak_down"] and not got["AAAA2"]["leak_down"]
    alone = {r["station"]: r for r in network.cv_folds(spark.createDataFrame(rows, shape), None).collect()}
    assert alone["AAAA2"]["leak_down"] and alone["AAAA2"]["fold"] == "AAAA2"
    for bad, why in (([*rows, rows[0]], "repeats"), ([*rows, ("CCCC1", "100", None, 1.0)], "null")):
        with pytest.raises(Exception, match=why):
            network.cv_folds(spark.createDataFrame(bad, shape)).collect()


def test_snow_years_of_a_union_of_polygons(spark):
    cells = spark.createDataFrame([("s", 1, 0.5), ("s", 1, 0.5), ("s", 2, 0.5), ("s", 3, 0.5), ("off", 99, 1.0)], "watershed string, cell int, fraction double")
    values = spark.createDataFrame([("swe", 2001, 1, 100.0), ("swe", 2001, 2, 5000.0), ("swe", 2001, 3, float("nan")), ("swe", 2002, 1, 7.0), ("doy", 2001, 1, 150.0), ("doy", 2002, 2, 160.0)], "variable string, year int, cell int, value double")
    got = {(r["watershed"], r["year"]): r for r in snow.snow_years(cells, values, ["swe", "doy"], caps={"swe": 400.0}).collect()}
    assert got["s", 2001]["swe"] == pytest.approx((100 + 0.5 * 400) / 1.5) and got["s", 2001]["cover"] == pytest.approx(0.75) and got["s", 2001]["doy"] == 150
    assert got["s", 2002]["swe"] == 7 and got["s", 2002]["doy"] == 160 and got["s", 2002]["cover"] == 0.5
    assert got["off", 2001]["swe"] is None and got["off", 2001]["cover"] == 0
    for wrong in ({"variables": ["swe", "swe"]}, {"variables": ["swe"], "caps": {"doy": 1.0}}, {"variables": ["swe"], "years": [2001, 2001]}, {"variables": ["swe"], "years": [1999]}):
        with pytest.raises(ValueError):
            snow.snow_years(cells, values, **wrong)


def test_a_null_year_is_not_the_cap(spark):
    years = spark.createDataFrame([("a", 1, 4.0), ("a", 2, None), ("a", 3, 50.0), ("b", 1, None)], "station string, year int, value double")
    for first, want in ((True, 7.0), (False, 10.0)):
        assert {r["station"]: r["value"] for r in models.capped_mean(years, 10.0, first).collect()} == {"a": want, "b": None}


def test_registry_reads_each_source_from_its_place_and_run(spark, tmp_path):
    spark.createDataFrame([(1, 5.0, "a"), (2, 6.0, "b"), (1, 7.0, "b")], "segment int, q double, scenario string").createOrReplaceTempView("runs_here")
    spark.createDataFrame([(1, 9.0)], "segment int, q double").write.parquet(f"{tmp_path}/out")
    registry = Registry([Entry("db", "routed", "runs_here", (("scenario", "b"),)), Entry("files", "balance", f"file://{tmp_path}/out"), Entry("db", "gone", "no_such_table", made_by="load it first")])
    assert {tuple(r) for r in registry.read(spark, "db", ["routed"], [1]).collect()} == {(1, 7.0, "routed")}
    assert registry.read(spark, "files").collect()[0]["source"] == "balance"
    with pytest.raises(ValueError, match="load it first"):
        registry.read(spark, "db")
    with pytest.raises(ValueError, match="no source"):
        registry.find("files", "routed")
    with pytest.raises(ValueError, match="twice"):
        Registry([Entry("db", "x", "a"), Entry("db", "x", "b")])


def test_pairs_of_stations_meet_on_a_grid(spark):
    from freshet.plans import queries
    from freshet.plans.views import Tables

    for name in ("departure_carry", "window_extend_ols"):
        plan = queries.QUERIES[name](Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
