"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

#: ASCII white space as the contracts define words: space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a bucket that are ranked together.
BUCKET_ROWS = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir`` of the session. Where it is unset a local one serves a local
    master; on a cluster that is an error, as its machines do not see each other's folders."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = context._jsc.sc().getCheckpointDir()
        if known.isDefined():
            folder = known.get()
        elif context.master == "local" or context.master.startswith("local["):
            folder = "file://" + tempfile.mkdtemp(prefix="freshet-")
        else:
            raise ValueError("spark.checkpoint.dir names no folder that all executors see")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there, so that a lost executor costs one step."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table written below the shared folder and read back. Loops of joins need this in place of ``cut``: a checkpoint
    keeps its plan's estimated size, joins multiply estimates, and after some rounds these are numbers of millions of digits."""
    path = fresh_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def exact_rank(df: DataFrame, keys: list[str], order: list[str], out: str, rows: int = 0) -> DataFrame:
    """Gapless rank from 0 within ``keys``, without one task per key.

    Rows of a key are dealt by a hash of the order columns over buckets, whose number grows with ``rows``; a row's rank is the number of rows in
    lower buckets (a table of keys x buckets rows) plus its row number within its own. Ties of all order columns get
    different ranks. Callers bound the number of distinct keys.
    """
    buckets = max(64, -(-rows // BUCKET_ROWS))
    dealt = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    below = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        dealt.groupBy(*keys, "__bucket").agg(F.count("*").alias("__n"))
        .withColumn("__base", F.coalesce(F.sum("__n").over(below), F.lit(0))).drop("__n")
    )
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    numbered = dealt.withColumn("__row", F.row_number().over(inside))
    if buckets <= 256:
        base = F.broadcast(base)  # at most so many rows for each of the callers' few hundred keys
    on = [numbered[k].eqNullSafe(base[k]) for k in keys] + [numbered["__bucket"] == base["__bucket"]]
    return numbered.join(base, on, "left").select(
        *[numbered[c] for c in df.columns], (base["__base"] + numbered["__row"] - 1).cast("long").alias(out)
    )
