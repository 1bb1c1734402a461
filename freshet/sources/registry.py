"""Where each source's values are: the one place that maps a source and a store to a location and a run."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a location with several runs that say which run a row is of.
RUN = ("model", "scenario", "period")


@dataclass(frozen=True)
class Entry:
    """``location``: a table, or the folder of a published dataset (one with a slash). ``run``: the run to read, where it holds several.
    ``made_by``: what to do if it is missing."""

    store: str
    source: str
    location: str
    run: tuple[tuple[str, str], ...] = ()
    made_by: str = ""


class Registry:
    def __init__(self, entries: Iterable[Entry]):
        self.entries: dict[tuple[str, str], Entry] = {}
        for e in entries:
            if (e.store, e.source) in self.entries:
                raise ValueError(f"source {e.source} is registered twice in store {e.store}")
            if {k for k, _ in e.run} - set(RUN):
                raise ValueError(f"a run is told by {', '.join(RUN)}")
            self.entries[e.store, e.source] = e

    def find(self, store: str, source: str) -> Entry:
        if (store, source) not in self.entries:
            raise ValueError(f"store {store} has no source {source}; it has {sorted(s for t, s in self.entries if t == store)}")
        return self.entries[store, source]

    def read(self, spark: SparkSession, store: str, sources: list[str] | None = None, ids: list[int] | None = None, id_: str = "segment") -> DataFrame:
        """The rows of the store's sources (all, by default) with ``source``, each from its own location and run. Filters reach the
        scans. A location that is missing is an error that says what makes it."""
        wanted = [self.find(store, s) for s in (sources or sorted(s for t, s in self.entries if t == store))]
        if not wanted:
            raise ValueError(f"nothing is registered in store {store}")
        out = None
        for e in wanted:
            rows = self._open(spark, e)
            for k, v in e.run:
                rows = rows.where(F.col(k) == v)
            rows = rows if ids is None else rows.where(F.col(id_).isin(ids))
            rows = rows.drop(*[c for c in RUN if c in dict(e.run)]).withColumn("source", F.lit(e.source))
            out = rows if out is None else out.unionByName(rows)
        return out

    @staticmethod
    def _open(spark: SparkSession, e: Entry) -> DataFrame:
        if "/" not in e.location:
            if not spark.catalog.tableExists(e.location):
                raise ValueError(f"{e.location} of source {e.source} is missing: {e.made_by}")
            return spark.table(e.location)
        path = spark._jvm.org.apache.hadoop.fs.Path(e.location)
        if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
            raise ValueError(f"{e.location} of source {e.source} is missing: {e.made_by}")
        return spark.read.parquet(e.location)
