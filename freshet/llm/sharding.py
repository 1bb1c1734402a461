"""Sharding by balanced label propagation, in Spark joins.

Equal texts are linked. Documents start in shards by their exact rank, so counts differ by one at most, and then in rounds
move to the shard where most of their group is. A shard takes in at most the room that its unlinked documents leave it plus
what leaves it the other way (moves s to t and t to s are exchanged), so linked documents never exceed a shard's quota. At
the end the unlinked documents fill every shard to its quota. Law: ``rows`` (counts at most one apart).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from freshet.llm.common import cut, exact_rank, written

#: Share of a shard's quota that one piece of a group takes at most: a larger group is salted into pieces.
PIECE = 0.5
#: A group is hot if it has over one in so many of all rows: there are at most so many hot groups, and they are joined by broadcast.
HOT = 1_000
#: Moves are granted in the order of this many hash classes of groups, so that a group tends to move as a whole.
TURNS = 64


def _grants(wanted: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many of the wanted moves (s, t) to allow: exchanges first, then into the room of t, the largest demand first."""
    grants = {(s, t): min(n, wanted.get((t, s), 0)) for (s, t), n in wanted.items()}
    left = list(room)
    for (s, t), n in sorted(wanted.items(), key=lambda x: (-x[1], x[0])):
        more = min(n - grants[s, t], left[t])
        grants[s, t] += more
        left[t] -= more
    return {k: n for k, n in grants.items() if n}


def _targeted(state: DataFrame, target: DataFrame) -> DataFrame:
    """The rows with their node's target. Rows of hot nodes are not shuffled to their node: its target is brought to them."""
    hot = F.broadcast(target.where("hot").select("node", "target"))  # HOT groups in at most as many pieces as there are shards, and HOT more
    return state.where("hot").join(hot, "node").unionByName(state.where("not hot").join(target.where("not hot").select("node", "target"), "node"))


def propagate(linked: DataFrame, quotas: list[int], rounds: int = 8) -> DataFrame:
    """uid, node (group piece), hot, shard after label propagation of (uid, node, hot, shard); shards x shards numbers reach the
    driver each round. State is a table between rounds: a checkpoint's estimated size would grow with each round's joins."""
    total = sum(quotas)
    state = linked
    for _ in range(rounds):
        votes = state.groupBy("node", "hot", "shard").agg(F.count("*").alias("n"))
        # the shard with most of the piece; ties by a hash, so that pieces spread
        target = votes.groupBy("node", "hot").agg(F.max(F.struct("n", F.xxhash64("node", "shard").alias("h"), "shard"))["shard"].alias("target"))
        moves = _targeted(state, target).where("shard <> target").withColumn("turn", F.pmod(F.xxhash64("node"), F.lit(TURNS)).cast("int"))
        moves = cut(moves.select("uid", "node", "shard", "target", "turn"))
        wanted = {(r["shard"], r["target"]): r["n"] for r in moves.groupBy("shard", "target").agg(F.count("*").alias("n")).collect()}
        held = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.count("*").alias("n")).collect()}
        grants = _grants(wanted, [q - held.get(i, 0) for i, q in enumerate(quotas)])
        if not grants:
            break
        spark = linked.sparkSession
        allowed = spark.createDataFrame([(s, t, n) for (s, t), n in grants.items()], "shard int, target int, granted long")
        # whole turns first: all moves of a turn while they fit, then by rank inside the turn that does not
        turns = moves.groupBy("shard", "target", "turn").agg(F.count("*").alias("n"))
        below = Window.partitionBy("shard", "target").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
        turns = turns.withColumn("before", F.coalesce(F.sum("n").over(below), F.lit(0))).join(F.broadcast(allowed), ["shard", "target"])
        whole = turns.where("before + n <= granted").select("shard", "target", "turn")
        part = turns.where("before < granted and before + n > granted").select("shard", "target", "turn", (F.col("granted") - F.col("before")).alias("rest"))
        # shards x shards x TURNS rows at most
        first = moves.join(F.broadcast(whole), ["shard", "target", "turn"], "left_semi").select("uid", F.col("target").alias("to"))
        some = exact_rank(moves.join(F.broadcast(part), ["shard", "target", "turn"]), ["shard", "target"], ["node", "uid"], "rank", total).where("rank < rest").select("uid", F.col("target").alias("to"))
        go = first.unionByName(some)
        state = written(state.join(go, "uid", "left").select("uid", "node", "hot", F.coalesce("to", "shard").alias("shard")))
    return state


def assign(docs: DataFrame, shards: int = 24, rounds: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    Size: UTF-8 bytes of the text plus 8. Counts per shard differ by one at most; slots run from 0 without gaps. Null texts
    have no bytes, crc32 0, and are linked to each other; empty texts likewise. Groups larger than a piece of a shard's quota
    are split by salt. Rows with equal ids and texts are rows of their own. grown_shard is null (law ``rows``).
    """
    raw = F.col("text").cast("binary")
    slim = docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.coalesce(F.crc32(raw), F.lit(0)).alias("text_crc32"),
        F.xxhash64(F.sha2(raw, 256)).alias("group"), F.monotonically_increasing_id().alias("uid"),
    )
    slim = cut(slim)
    total = slim.count()
    quotas = [total // shards + (i < total % shards) for i in range(shards)]
    piece = max(2, int(PIECE * (total // shards)))
    sizes = cut(slim.groupBy("group").agg(F.count("*").alias("n")).where("n > 1"))
    hot = F.broadcast(sizes.where(F.col("n") > max(1, total // HOT)))  # HOT rows at most
    rare = sizes.where(F.col("n") <= max(1, total // HOT))
    nodes = slim.select("uid", "group")
    salted = nodes.join(hot, "group").select("uid", F.xxhash64("group", F.pmod(F.xxhash64("uid"), F.ceil(F.col("n") / piece))).alias("node"), F.lit(True).alias("hot")).unionByName(
        nodes.join(hot, "group", "left_anti").join(rare, "group", "left_semi").select("uid", F.xxhash64("group", F.lit(0).cast("long")).alias("node"), F.lit(False).alias("hot"))
    )
    # linked documents start in shards by rank, the same number in each but for one
    linked = exact_rank(salted, [], ["uid"], "rank", total).select("uid", "node", "hot", F.pmod("rank", F.lit(shards)).cast("int").alias("shard"))
    settled = cut(propagate(cut(linked), quotas, rounds).select("uid", F.col("shard").alias("linked_shard")))
    held = {r["linked_shard"]: r["n"] for r in settled.groupBy("linked_shard").agg(F.count("*").alias("n")).collect()}
    rows = slim.join(settled, "uid", "left")
    free = exact_rank(rows.where("linked_shard is null").select("uid"), [], ["uid"], "rank", total)
    fill, start = F.lit(None).cast("int"), 0
    for i in range(shards):
        end = start + quotas[i] - held.get(i, 0)
        fill = F.when((F.col("rank") >= start) & (F.col("rank") < end), F.lit(i)).otherwise(fill)
        start = end
    placed = free.select("uid", fill.alias("free_shard"))
    every = rows.join(placed, "uid", "left").select("doc_id", "size", "text_crc32", "group", "uid", F.coalesce("linked_shard", "free_shard").alias("shard"))
    slots = exact_rank(every, ["shard"], ["group", "uid"], "slot", total)
    return slots.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def cut_share(assigned: DataFrame) -> DataFrame:
    """pairs of equal texts, and those in different shards, from counts per group and shard."""
    per = assigned.groupBy("text_crc32", "size", "shard").agg(F.count("*").alias("n"))
    group = per.groupBy("text_crc32", "size").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("inside"))
    return group.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"), F.sum(F.col("n") * (F.col("n") - 1) / 2 - F.col("inside")).alias("cut"))
