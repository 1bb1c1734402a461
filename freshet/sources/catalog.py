"""Published partitioned datasets: manifests, part scans with pruning, writing, verification and replacing loads."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PART = re.compile(r"(?P<dataset>[a-z]+_(?:monthly|daily))/scenario=(?P<scenario>[^/]+)/forcing=(?P<forcing>[^/]+)/source=(?P<source>[^/]+)/part-(?P<code>[A-Za-z0-9]+)\.parquet")
PART_FIELDS = "dataset scenario forcing source code".split()


def check_id(name: str) -> tuple[str, str, int]:
    """variable/network/v<n>."""
    m = re.fullmatch(r"([a-z][a-z0-9_]*)/([a-z][a-z0-9_]*)/v([1-9]\d*)", name)
    if not m:
        raise ValueError(f"{name!r} is no dataset id")
    return m[1], m[2], int(m[3])


def parse_parts(keys: DataFrame) -> DataFrame:
    """key and the fields in it; a key of another shape raises when the rows are read."""
    pattern = "^" + re.sub(r"\?P<\w+>", "", PART.pattern) + "$"
    ok = F.regexp_like("key", F.lit(pattern))
    checked = F.when(ok, F.col("key")).otherwise(F.raise_error(F.concat(F.lit("bad part key: "), "key")))
    return keys.withColumn("key", checked).select("*", *[F.regexp_extract("key", pattern, i).alias(f) for i, f in enumerate(PART_FIELDS, 1)])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per part: the fields come from its key, never from the manifest's own. Version 1, unique keys, md5 of 32 hex
    digits and a description of every part's source are required."""
    raw = spark.read.option("multiLine", True).json(path)
    head = raw.select("manifest_version", F.col("sources.source" if "source" in str(raw.schema["sources"].dataType) else "sources").alias("sources")).first()
    if head["manifest_version"] != 1:
        raise ValueError(f"manifest version {head['manifest_version']} is not known")
    parts = parse_parts(raw.select(F.explode("parts").alias("p")).select("p.key", "p.rows", "p.bytes", "p.md5"))
    bad = parts.groupBy("key").agg(F.count("*").alias("n"), F.min(F.coalesce(F.regexp_like("md5", F.lit("^[0-9a-f]{32}$")), F.lit(False)).cast("int")).alias("good"), F.first("source").alias("source"))
    bad = bad.where((F.col("n") > 1) | (F.col("good") == 0) | ~F.coalesce(F.col("source").isin(list(head["sources"])), F.lit(False))).limit(1).collect()
    if bad:
        raise ValueError(f"manifest entry {bad[0]['key']} repeats, has no md5 or an undescribed source")
    return parts


def digest(parts: DataFrame) -> DataFrame:
    """md5 of the sorted lines "key md5"; does not depend on the order of rows. A manifest's lines fit one row."""
    line = F.concat("key", F.lit(" "), "md5", F.lit("\n"))
    return parts.agg(F.md5(F.array_join(F.array_sort(F.collect_list(line)), "").cast("binary")).alias("digest"))


def prune(parts: DataFrame, dataset: str, groups: list[str] | None = None, scenario: str | None = None) -> DataFrame:
    """Parts to scan: those of a four-letter group only if it is named; parts of whole drainages always."""
    out = parts.where(F.col("dataset") == dataset)
    out = out if scenario is None else out.where(F.col("scenario") == scenario)
    return out if groups is None else out.where(~F.regexp_like("code", F.lit("^[A-Z]{4}$")) | F.col("code").isin(groups))


def scan(spark: SparkSession, root: str, parts: DataFrame, ids: list[int] | None = None, groups: list[str] | None = None) -> DataFrame:
    """The rows of the parts, with scenario, forcing and source from the path; filters reach the Parquet reader."""
    keys = [f"{root}/{r['key']}" for r in parts.select("key").collect()]  # one per file of a manifest
    rows = spark.read.option("basePath", root).parquet(*keys)
    rows = rows if ids is None else rows.where(F.col("linear_feature_id").isin(ids))
    return rows if groups is None else rows.where(F.col("watershed_group_code").isin(groups))


def publish(rows: DataFrame, root: str, dataset: str, keys: list[str], file_rows: int = 5_000_000) -> None:
    """Write scenario/forcing/source/code partitions, sorted within files so that row groups can be skipped. Each partition given
    replaces that one only. Rows are dealt by ranges of partition and keys, so that one of many rows is written by several tasks,
    to several files of at most ``file_rows`` rows."""
    part = ("scenario", "forcing", "source", "code")
    order = [*part, *[k for k in keys if k not in part]]
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    spread.write.mode("overwrite").option("maxRecordsPerFile", file_rows).option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("scenario", "forcing", "source", "code").parquet(f"{root}/{dataset}")


def check_load(rows: DataFrame, keys: list[str]) -> None:
    """Raise unless keys are unique, flows are not negative, and at most one source is picked per feature and time."""
    bad = rows.groupBy(*keys, "source").agg(F.count("*").alias("n"), F.min("q_m3s").alias("low")).where("n > 1 or low < 0").limit(1).collect()
    picks = rows.where("pick").groupBy(*keys).count().where("count > 1").limit(1).collect()
    if bad or picks:
        raise ValueError(f"load refused: {(bad or picks)[0]}")


def _facts(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """path, bytes, md5 of the files under ``root``, read by the executors in pieces of a few megabytes through Arrow's file
    systems, whatever the size of a file."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path")

    def digested(batches):
        import hashlib

        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            sizes, sums = [], []
            for uri in batch.column("path").to_pylist():
                store, path = fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file:///") else uri)
                md5, size = hashlib.md5(), 0
                with store.open_input_stream(path, compression=None) as stream:
                    while piece := stream.read(1 << 22):
                        md5.update(piece)
                        size += len(piece)
                sizes.append(size)
                sums.append(md5.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(sizes, pa.int64()), pa.array(sums, pa.string())], ["path", "bytes", "md5"])

    return listed.mapInArrow(digested, "path string, bytes long, md5 string")


def write_manifest(spark: SparkSession, root: str, name: str, sources: list[dict], receipt: dict | None = None) -> dict:
    """Manifest of the parts under ``root``: rows from a count per file, bytes and md5 from the files' contents. One entry a file
    reaches the driver, as the manifest is one document. ``receipt`` (recipe, inputs, row counts of the result) goes with it."""
    check_id(name)
    facts = _facts(spark, root, "part-*.parquet")
    counts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "part-*.parquet").parquet(root).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("rows"))
    slashes = lambda c: F.regexp_replace(c, "^file:/+", "file:///")
    joined = facts.withColumn("path", slashes("path")).join(counts.withColumn("path", slashes("path")), "path", "left")
    parts = [r.asDict() for r in joined.orderBy("path").collect()]
    entries = [{"key": p["path"].split(root.rstrip("/") + "/")[-1], "rows": p["rows"] or 0, "bytes": p["bytes"], "md5": p["md5"]} for p in parts]
    return {"manifest_version": 1, "id": name, "sources": sources, "parts": entries} | ({"receipt": receipt} if receipt else {})


def check_entries(keys: list[str]) -> list[str]:
    """Keys of what a manifest holds beside parts: plain relative paths of known kinds, none of which climbs."""
    for key in keys:
        if not re.fullmatch(r"(?:receipt|fit)/[A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)*", key) or ".." in key:
            raise ValueError(f"{key!r} is no entry of a manifest")
    return keys


def ledger(loads: DataFrame, new: DataFrame) -> DataFrame:
    """One row per loaded part (dataset, scenario, key, rows, md5): those of a dataset and scenario that is loaded again are
    replaced as a whole."""
    again = new.select("dataset", "scenario").distinct()
    return loads.join(F.broadcast(again), ["dataset", "scenario"], "left_anti").unionByName(new)  # one row a dataset and scenario


def conform(rows: DataFrame, columns: list[str], keys: list[str], value: str = "q_m3s") -> DataFrame:
    """The rows with exactly the columns, in order, sorted by keys within partitions; an error where a column is lacking or
    foreign, a period is not two years, or a flow is negative. Unique keys are ``check_load``'s."""
    if set(rows.columns) != set(columns):
        raise ValueError(f"columns differ: {sorted(set(rows.columns) ^ set(columns))}")
    low = F.coalesce(F.col(value) < 0, F.lit(False))
    bad = low | (~F.regexp_like("period", F.lit("^[0-9]{4}-[0-9]{4}$")) if "period" in columns else F.lit(False))
    return rows.withColumn(value, F.when(bad, F.raise_error(F.lit("a flow is negative or a period is no two years"))).otherwise(F.col(value))).select(*columns).sortWithinPartitions(*keys)


def content_key(*columns: str):
    """md5 of the columns' texts joined by bars; NaN and null are alike."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.when(F.col(c).cast("string") != "NaN", F.col(c).cast("string")), F.lit("")) for c in columns]).cast("binary"))


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """station, ts, q, file of CSV files with columns station, ts, value, unit: names trimmed, litres a second brought to cubic
    metres, values that are no number gone."""
    raw = spark.read.schema("station string, ts timestamp, value double, unit string").option("header", True).csv(path).select("*", F.col("_metadata.file_path").alias("file"))
    q = F.when(F.trim("unit") == "l/s", F.col("value") / 1000).otherwise(F.col("value"))
    return raw.where(F.col("value").isNotNull() & ~F.isnan("value")).select(F.trim("station").alias("station"), "ts", q.alias("q"), "file")


def part_counts(rows: DataFrame) -> DataFrame:
    """scenario, forcing, source, n of a published dataset."""
    return rows.groupBy("scenario", "forcing", "source").agg(F.count("*").alias("n"))


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either that the other lacks, repeats counted, with ``side``."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def verify(spark: SparkSession, root: str, parts: DataFrame) -> DataFrame:
    """key, ok, reason: size and md5 of every part's file against the manifest."""
    there = _facts(spark, root, "*").select(F.regexp_replace("path", "^.*" + re.escape(root.rstrip("/")) + "/", "").alias("key"), F.col("bytes").alias("_bytes"), F.col("md5").alias("_md5"))
    reason = F.when(F.col("_md5").isNull(), "missing").when(F.col("bytes") != F.col("_bytes"), "size differs").when(F.col("md5") != F.col("_md5"), "md5 differs").otherwise("")
    return parts.select("key", "bytes", "md5").join(there, "key", "left").select("key", (reason == "").alias("ok"), reason.alias("reason"))


def save_manifest(manifest: dict, path: str) -> None:
    """Write beside, then rename."""
    import os

    with open(f"{path}.part", "w") as f:
        json.dump(manifest, f, indent=1)
    os.replace(f"{path}.part", path)
