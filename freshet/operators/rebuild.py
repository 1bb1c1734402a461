"""Rebuild of the groups that a change of a network reaches, from their closure alone, held against what is published."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.functions.columns import ancestors, upstream_of
from freshet.operators.network import closure, compare_values
from freshet.sources import catalog
from freshet.sources.shared import settled


def changed_rows(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """id, w, l of every place that a changed row has or had: rows that came, went, moved or have other ``columns``. Ids are unique on
    either side."""
    side = lambda df, p: df.select(F.col("id").alias(f"_{p}id"), *[F.col(c).alias(f"_{p}{c}") for c in ("w", "l", *columns)])
    met = side(old, "a").join(side(new, "b"), F.col("_aid") == F.col("_bid"), "full_outer")
    same = F.col("_aid").eqNullSafe(F.col("_bid"))
    for c in ("w", "l", *columns):
        same = same & F.col(f"_a{c}").eqNullSafe(F.col(f"_b{c}"))
    places = F.array(*[F.struct(F.col(f"_{p}id").alias("id"), F.col(f"_{p}w").alias("w"), F.col(f"_{p}l").alias("l")) for p in "ab"])
    return met.where(~same).select(F.inline(places)).where("id is not null and w is not null and l is not null").distinct()


def affected(ws: DataFrame, changed: DataFrame) -> DataFrame:
    """id of the rows that have a changed place upstream (or are one): changes run down the network. A changed place meets the streams on
    its own ancestors by equality."""
    down = changed.select(F.col("w").alias("w2"), F.col("l").alias("l2"), F.explode(ancestors(F.col("w"))).alias("w")).distinct()
    return ws.select("id", "w", "l").join(down, "w").where(upstream_of(F.col("w"), F.col("l"), F.col("w2"), F.col("l2"))).select("id").distinct()


def affected_groups(ws: DataFrame, changed: DataFrame, group: str) -> DataFrame:
    """The groups with an affected row, and those that a changed row is or was in (``changed`` may have the column)."""
    hit = ws.join(affected(ws, changed), "id", "left_semi").select(group)
    gone = changed.select(group) if group in changed.columns else hit.limit(0)
    return hit.unionByName(gone).where(F.col(group).isNotNull()).distinct()


def rebuild_groups(ws: DataFrame, groups: DataFrame, build: Callable[[DataFrame], DataFrame], group: str) -> DataFrame:
    """The rows of ``build`` for the given groups, with their ``group``. It is given their closure, which holds everything upstream of
    them, instead of the network. ``build`` takes rows like those of ``ws`` and returns a row or several an id."""
    # tables, as ``build`` may read its input many times over
    mine = settled(ws.join(groups.select(group), group, "left_semi"), "mine")
    near = settled(ws.join(closure(ws, mine), "id", "left_semi"), "closure")
    return build(near).join(mine.select("id", group), "id")


def against_published(rebuilt: DataFrame, published: DataFrame, keys: list[str], tolerances: dict[str, float]) -> DataFrame:
    """A row per value column: value, only_a (rebuilt), only_b (published), compared, differing, max_abs_diff, within its relative
    tolerance; ``same`` where nothing differs and no row is on one side only."""
    out = None
    for value, tolerance in tolerances.items():
        told = compare_values(rebuilt, published, keys, value, tolerance).select(F.lit(value).alias("value"), "*")
        out = told if out is None else out.unionByName(told)
    return out.withColumn("same", (F.col("only_a") == 0) & (F.col("only_b") == 0) & (F.col("differing") == 0))


def republish(ws: DataFrame, changed: DataFrame, build: Callable[[DataFrame], DataFrame], root: str, dataset: str, group: str, run: dict[str, str], keys: list[str], tolerances: dict[str, float]) -> DataFrame:
    """Rebuild what ``changed`` reaches, compare it with the published parts, and write those parts only.

    ``run``: scenario, forcing and source of the parts; a part's code is its group. Parts of other groups, and of other runs, keep their
    files; a group that has no row any more keeps its part, and its rows show as only_b. Returns the comparison with what was published before.
    """
    spark = ws.sparkSession
    groups = settled(affected_groups(ws, changed, group), "groups")
    rows = settled(rebuild_groups(ws, groups, build, group), "rebuilt")
    before = spark.read.parquet(f"{root}/{dataset}").where(" and ".join(f"{k} = '{v}'" for k, v in run.items()))
    report = settled(against_published(rows, before.join(groups.select(F.col(group).alias("code")), "code", "left_semi"), keys, tolerances), "report")
    tagged = rows.withColumn("code", F.col(group)).withColumns({k: F.lit(v) for k, v in run.items()})
    catalog.publish(tagged, root, dataset, keys)
    return report
