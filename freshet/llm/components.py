"""Connected components of an edge table, with Spark joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import written


def _to_ends(hook: DataFrame) -> DataFrame:
    """Hooks (a, b), b < a, with b replaced by the end of its chain. A join of the hooks with themselves doubles the steps
    taken, so a chain of n hooks takes log2(n) joins."""
    while True:
        for _ in range(3):
            up = hook.select(F.col("a").alias("from"), F.col("b").alias("to"))
            hook = hook.join(up, hook["b"] == up["from"], "left").select("a", F.coalesce("to", "b").alias("b"), F.col("to").isNotNull().alias("further"))
        hook = written(hook)
        if hook.where("further").isEmpty():
            return hook.select("a", "b")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root: the smallest node reachable, for every node that has an edge (a, b).

    Each round hooks every group of nodes to its smallest neighbouring group, follows chains of hooks to their ends,
    relabels, and drops edges inside a group. State is written to the shared folder every
    round; nothing but a row count reaches the driver. A hub's rows are spread by the skew join of adaptive execution.
    """
    edges = written(edges.select("a", "b").where("a <> b").distinct())
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    state = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    state = written(state)
    group = edges
    for _ in range(max_rounds):
        both = group.select("a", "b").unionByName(group.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = written(both.groupBy("a").agg(F.min("b").alias("b")).where("b < a"))
        hook = _to_ends(hook)
        state = written(state.join(hook, state["root"] == hook["a"], "left").select("node", F.coalesce("b", "root").alias("root")))
        left = hook.select(F.col("a").alias("la"), F.col("b").alias("lb"))
        right = hook.select(F.col("a").alias("ra"), F.col("b").alias("rb"))
        group = (
            group.join(left, group["a"] == left["la"], "left").join(right, group["b"] == right["ra"], "left")
            .select(F.coalesce("lb", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
            .where("a <> b").distinct()
        )
        group = written(group)
        if group.isEmpty():
            return state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
