import random

from freshet.operators import network
from freshet.sources import catalog


def under(a, b):
    return a == b or a.startswith(b + ".")


def upstream(w, lo, w2, l2):
    if not under(w2, w):
        return False
    if w == lo:
        return under(l2, w)
    return (w2 > lo and not under(w2, lo) and under(l2, w) and l2 > lo) or (w2 == w and l2 >= lo)


def random_tree(rng):
    rows = []

    def stream(code, depth):
        places = sorted(rng.sample(range(1, 999999), rng.randint(0, 4)))
        if rng.random() > 0.1:
            rows.append((code, code))
            rows.extend((code, f"{code}.{p:06d}") for p in places if rng.random() < 0.8)
            if places and rng.random() < 0.3:
                rows.append((code, f"{code}.{places[0]:06d}.{rng.randint(1, 999):06d}"))
        for p in places if depth < 3 else []:
            stream(f"{code}.{p:06d}", depth + 1)

    stream("100", 0)
    codes = [w for w, _ in rows] or ["100"]
    rows += [(rng.choice(codes), rng.choice(codes)) for _ in range(3)]
    return [(i, w, lo, float(rng.randint(1, 50))) for i, (w, lo) in enumerate(rows)]


def test_sums_equal_the_pairwise_definition(spark):
    rng = random.Random(3)
    for _ in range(3):
        rows = random_tree(rng)
        got = {r["id"]: r["area"] for r in network.upstream_sums(spark.createDataFrame(rows, "id long, w string, l string, area double"), ["area"]).collect()}
        want = {i: sum(a for _, w2, l2, a in rows if upstream(w, lo, w2, l2)) for i, w, lo, _ in rows}
        assert got == want


def test_source_pick(spark):
    rows = [(1, None, 5.0, True), (2, 0.5, 5.0, True), (3, 0.5, 5.0, False), (4, 1.0, 5.0, True), (5, None, None, True), (6, 3.0, None, True), (7, 0.0, 0.0, True)]
    picked = network.pick_source(spark.createDataFrame(rows, "id int, routed double, balance double, own_line boolean"))
    assert [r["pick"] for r in picked.orderBy("id").collect()] == ["balance", "balance", "routed", "routed", None, "routed", "routed"]


def test_publish_verify_and_scan(spark, tmp_path):
    root = str(tmp_path / "v")
    rows = spark.createDataFrame([(1, "BULK", 0, 1.5, "historical", "f", "a", "BULK", True), (2, "FRAN", 0, 2.5, "historical", "f", "b", "FRAN", True)], "linear_feature_id int, watershed_group_code string, month int, q_m3s double, scenario string, forcing string, source string, code string, pick boolean")
    catalog.check_load(rows, ["linear_feature_id", "month"])
    catalog.publish(rows, root, "segment_monthly", ["linear_feature_id", "month"])
    manifest = catalog.write_manifest(spark, root, "discharge/net/v1", [{"source": "a"}, {"source": "b"}])
    assert sum(p["rows"] for p in manifest["parts"]) == 2
    parts = spark.createDataFrame([(p["key"], p["bytes"], p["md5"]) for p in manifest["parts"]], "key string, bytes long, md5 string")
    assert all(r["ok"] for r in catalog.verify(spark, root, parts).collect())
    assert catalog.scan(spark, root, parts, ids=[2]).count() == 1


def test_sums_leave_nothing_cached(spark):
    ws = spark.createDataFrame([(1, "100", "100", 5.0), (2, "100.000001", "100.000001", 2.0)], "id int, w string, l string, area double")
    before = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    assert {r["id"]: r["area"] for r in network.upstream_sums(ws, ["area"]).collect()} == {1: 7.0, 2: 2.0}
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == before
