"""Damage to conversations and its cheapest repair.

Rows become one-letter codes of role and fault; a conversation's codes in order are all that the repair needs. A backward
pass gives the cheapest cost to go for each turn and state of the grammar ``(s?(ua)+)?``, a forward walk then takes, among the
edits that keep that cost, the ASCII-least. The edits meet the rows again where a conversation's rows stream by in order, so a
task holds a conversation's codes and edits (a byte a row), and of its texts one batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.llm.common import written

#: States of the grammar: nothing yet, after s, after u (a must come), after a (may end). State by state: what s, u and a lead to.
_NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
_ENDS = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows of a conversation whose codes are put in order together.
CHUNK_BITS = 12
_FAR = np.iinfo(np.int64).max // 4
_WORD = r"[^\x20\x09-\x0D]"


def _wanted(state: int) -> str:
    """The role that must or may come next, other than a system turn."""
    return "a" if state == 2 else "u"


def repair(codes: str) -> tuple[int, str]:
    """Cost and audit of the cheapest edits of a conversation given by two characters a row: the role's initial (s, u, a, or -),
    and the fault (b blank, d duplicate, t truncated, or -). Of equally cheap ones the audit is the ASCII-least."""
    n = len(codes) // 2
    togo = np.full((n + 1, 4), _FAR, np.int64)

    def inserted(row: list[int]) -> list[int]:
        # two insertions at most are worth making in one place
        for _ in range(2):
            row = [min(row[q], INSERT + row[_NEXT[q][_wanted(q)]]) for q in range(4)]
        return row

    ahead = inserted([0 if q in _ENDS else _FAR for q in range(4)])
    togo[n] = ahead
    for i in range(n - 1, -1, -1):
        role, fault = codes[2 * i], codes[2 * i + 1]
        extra, now = (TRUNCATED if fault == "t" else 0), []
        for q in range(4):
            best = DELETE + ahead[q]
            if fault not in "bd":
                best = min(best, REROLE + extra + ahead[_NEXT[q][_wanted(q)]])
                if role in _NEXT[q]:
                    best = min(best, extra + ahead[_NEXT[q][role]])
            now.append(best)
        togo[i] = ahead = inserted(now)
    audit, q, i = [], 0, 0
    while True:
        left = togo[i, q]
        if i == n and left == 0:
            return int(togo[0, 0]), "".join(audit)
        to = _NEXT[q][_wanted(q)]
        role, fault = (codes[2 * i], codes[2 * i + 1]) if i < n else ("-", "-")
        extra = TRUNCATED if fault == "t" else 0
        # in ASCII order: D, I, K, R
        if i < n and left == DELETE + togo[i + 1, q]:
            audit.append("D")
            i += 1
        elif left == INSERT + togo[i, to]:
            audit.append("I")
            q = to
        elif i < n and role in _NEXT[q] and fault not in "bd" and left == extra + togo[i + 1, _NEXT[q][role]]:
            audit.append("K")
            i, q = i + 1, _NEXT[q][role]
        else:
            audit.append("R")
            i, q = i + 1, to


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of ``rows`` after damage, ``gone`` for those that it drops. Nulls count as one space, but for
    the conv_id and turn themselves, which stay null."""
    named = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    drawn = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(named.cast("binary")) % 20).alias("k"))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    hit = drawn.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("k") == 0).alias("gone"), "k")
    return hit.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("k") == 3, 2).otherwise(1)))).drop("k", "copy")


def _code(dup: Column) -> Column:
    """Two characters: the role's initial and the first fault."""
    initial = F.substr("role", F.lit(1), F.lit(1))
    last = F.regexp_extract("text", rf"({_WORD})[\x20\x09-\x0D]*\z", 1)
    fault = F.when(~F.regexp_like("text", F.lit(_WORD)), "b").when(dup, "d").when(~last.isin(".", "!", "?"), "t").otherwise("-")
    return F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise("-"), fault)


def ordered(rows: DataFrame) -> DataFrame:
    """The damaged rows that are left with ``seq``, which orders each conversation by turn (nulls first), then role, then the
    text's hash, and their code. A conversation may span any number of tasks."""
    left = rows.where("not gone").drop("gone").withColumn("t", F.xxhash64("text")).withColumn("u", F.xxhash64(F.lit(1), "text"))
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = ["conv_id", "turn", "role", "t", "u"]
    # a drawn number spreads repeats of one row
    dealt = left.withColumn("tie", F.rand(7)).repartitionByRange(parts, *keys, "tie").sortWithinPartitions(*keys, "tie").drop("tie")
    placed = written(dealt.withColumn("seq", F.monotonically_increasing_id()))
    slim = placed.select("conv_id", F.xxhash64("role").alias("r"), "t", "u", "seq")
    firsts = slim.groupBy("conv_id", "r", "t", "u").agg(F.min("seq").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = firsts.select(F.col("conv_id").alias("c"), F.col("r").alias("fr"), F.col("t").alias("ft"), F.col("u").alias("fu"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("r") == F.col("fr")) & (F.col("t") == F.col("ft")) & (F.col("u") == F.col("fu"))
    again = slim.join(firsts, same).where("seq > first").select(F.col("seq").alias("again"))
    return placed.join(again, placed["seq"] == again["again"], "left").select("conv_id", "turn", "role", "text", "seq", _code(F.col("again").isNotNull()).alias("code"))


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, blank, duplicate, truncated, illegal, cost, audit of each conversation with rows in ``ordered``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        legal = {"su", "ua", "au"}
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            for codes in batch.column("codes").to_pylist():
                roles, faults = codes[::2], codes[1::2]
                out.append((faults.count("b"), faults.count("d"), faults.count("t"), sum(a + b not in legal for a, b in zip(roles, roles[1:])), *repair(codes)))
            kinds = [pa.int64()] * 5 + [pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *[pa.array(c, k) for c, k in zip(zip(*out), kinds)]], names)

    names = ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    joined = lambda key, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value]), "")
    # 4,096 rows at most in the first grouping, a row for so many in the second
    chunks = rows.groupBy("conv_id", F.shiftright("seq", CHUNK_BITS).alias("chunk")).agg(joined("seq", "code").alias("codes"))
    whole = chunks.groupBy("conv_id").agg(joined("chunk", "codes").alias("codes"))
    shape = T.StructType([rows.schema["conv_id"], *[T.StructField(c, T.LongType()) for c in names[1:-1]], T.StructField("audit", T.StringType())])
    return whole.mapInArrow(run, shape)


def rebuilt(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256 of ``ordered`` rows under the audits in ``edits``. Each conversation's audit comes before its
    rows, which stream by in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = _Rebuild(None, "")
        begun, done = False, ([], [])

        def close() -> None:
            done[0].append(now.conv)
            done[1].append(now.digest())

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(done[0], kind), pa.array(done[1], pa.string())], ["conv_id", "repaired_sha256"])
            done[0].clear(), done[1].clear()
            return batch

        kind = None
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, audit, role, text in zip(*[batch.column(c) for c in ("conv_id", "audit", "role", "text")]):
                if audit.is_valid:
                    if begun:
                        close()
                    now, begun = _Rebuild(conv.as_py(), audit.as_py()), True
                else:
                    now.row(role.as_py(), text.as_py())
            if done[0]:
                yield flush()
        if begun:
            close()
            yield flush()

    none = lambda c: F.lit(None).cast("string").alias(c)
    both = rows.select("conv_id", "seq", none("audit"), "role", "text").unionByName(edits.select("conv_id", F.lit(-1).cast("long").alias("seq"), "audit", none("role"), none("text")))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "seq").drop("seq").mapInArrow(run, T.StructType([rows.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())]))


class _Rebuild:
    """The repaired turns of one conversation, hashed as its rows come by."""

    def __init__(self, conv: object, audit: str) -> None:
        self.conv, self.audit, self.at, self.state, self.any = conv, audit, 0, 0, False
        self.hash = hashlib.sha256()

    def _turn(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.any else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.any = True
        self.state = _NEXT[self.state][role[0]]

    def _insertions(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._turn(ROLES[_wanted(self.state)], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._insertions()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self._turn(role, text)
        elif edit == "R":
            self._turn(ROLES[_wanted(self.state)], text)

    def digest(self) -> str:
        self._insertions()
        return self.hash.hexdigest()


def repaired(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    Only conv_id, turn, role and text are used. A null conv_id is a conversation of its own, null roles and texts count as one
    space, null turns come first and count for no gap. Rows of equal turn are taken by role and the text's hash, so repeated rows
    are neighbours. Conversations that lose all rows keep a row of zeros. An empty table gives no rows.
    """
    rows = written(damaged(conversations))
    turns = rows.groupBy("conv_id").agg(*[f(F.when(~F.col("gone"), F.col("turn"))).alias(c) for f, c in ((F.min, "low"), (F.max, "high"))])
    distinct = rows.where("not gone and turn is not null").select("conv_id", "turn").distinct().groupBy("conv_id").agg(F.count("*").alias("n"))
    placed = written(ordered(rows))
    edits = written(audits(placed))
    parts = [df.withColumnRenamed("conv_id", f"__{i}") for i, df in enumerate((distinct, edits, rebuilt(placed, edits)))]
    whole = turns
    for i, part in enumerate(parts):
        whole = whole.join(part, whole["conv_id"].eqNullSafe(part[f"__{i}"]), "left").drop(f"__{i}")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c if isinstance(c, str) else "gaps")
    return whole.select(
        "conv_id", zero(F.col("high") - F.col("low") + 1 - F.col("n")), *map(zero, ("blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"),
    )
