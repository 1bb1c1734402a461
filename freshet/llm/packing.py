"""Variable-capacity best-fit packing of documents into training sequences.

Every input partition packs its own rows, block by block, so nothing is shuffled and no group grows with the data. A block
is packed longest first: a piece goes to the open bin, of whatever size, that it leaves the least room in; if none fits, the
permitted size that is cheapest for it is opened. The permitted lengths are optimised jointly: the block is packed once for
each smallest size that may be opened, every bin is downsized to its contents, and the cheapest outcome is kept.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.llm.common import WORD

LENGTHS = (256, 512, 1024, 2048, 4096)
#: Rows of a partition that are packed together; the cost of a bin edge is paid once in so many rows.
BLOCK = 32_768
OUT = "piece int, start long, length int, bin_id long, bin_length int, bin_start int"


def words_and_end(text: Column) -> Column:
    """Default length: the words of the text and one end mark; a null text has the mark alone."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long") + 1


def cost(length: int, overhead: float = 16.0, attention: float = 1 / 8192) -> float:
    """Of one sequence: linear in its length, an attention term, and what a bin costs whatever its length."""
    return overhead + length + attention * length * length


def _pack(sizes: np.ndarray, lengths: Sequence[int], least: int) -> tuple[np.ndarray, np.ndarray, list[int], list[int]]:
    """Best fit of sizes in descending order: (bin, start in it) of each, capacity and fill of each bin. ``least`` is the
    smallest capacity that may be opened."""
    where, start = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    cap: list[int] = []
    fill: list[int] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set if a bin with r free places is open
    opened = {}
    for i, n in enumerate(sizes.tolist()):
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            bin_ = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            if n not in opened:
                opened[n] = min((c for c in lengths if c >= max(n, least)), key=lambda c: (cost(c) / c, c))
            bin_, room = len(cap), opened[n]
            cap.append(room)
            fill.append(0)
        where[i], start[i] = bin_, fill[bin_]
        fill[bin_] += n
        if room > n:
            by_room.setdefault(room - n, []).append(bin_)
            rooms |= 1 << (room - n)
    return where, start, cap, fill


def pack(sizes: np.ndarray, lengths: Sequence[int] = LENGTHS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, start in the bin, final length of the bin) of each size; every size is at most the largest length."""
    lengths = sorted(lengths)
    order = np.argsort(-sizes, kind="stable")
    best = None
    for least in lengths:
        where, start, _, fill = _pack(sizes[order], lengths, least)
        final = np.array(lengths)[np.searchsorted(lengths, fill)] if fill else np.zeros(0, int)
        total = sum(map(cost, final.tolist()))
        if best is None or total < best[0]:
            best = total, where, start, final
    _, where, start, final = best
    bins, starts = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    bins[order], starts[order] = where, start
    return bins, starts, final[bins] if len(sizes) else np.zeros(0, int)


def best_fit(docs: DataFrame, lengths: Sequence[int] = LENGTHS, length: Column | None = None) -> DataFrame:
    """doc_id, piece, start, length, bin_id, bin_length, bin_start: where each piece of each row goes.

    A row longer than the largest permitted length is cut into full pieces and a rest; a row of no words has its end mark.
    The pieces of a row cover it exactly; a bin's pieces lie in it without gaps; its length is the smallest permitted one
    that holds them. Null ids and repeated rows are packed like any other. Only doc_id and what ``length`` (by default
    from text) refers to are read. Bin ids are unique in the result and follow the input's partitions.
    """
    lengths = sorted(set(lengths))
    if not lengths or lengths[0] < 1:
        raise ValueError("permitted lengths are positive")
    most = lengths[-1]

    def block(rows: pa.Table, base: int) -> pa.RecordBatch:
        n = rows["n"].to_numpy().astype(np.int64)
        pieces = np.maximum(1, -(-n // most))
        row = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(most, n[row] - piece * most)
        bins, starts, final = pack(size, lengths)
        ids = rows["doc_id"].combine_chunks().take(pa.array(row))  # Arrow keeps ids as they are, beside nulls too
        numbers = {"piece": piece.astype(np.int32), "start": piece * most, "length": size.astype(np.int32), "bin_id": base + bins, "bin_length": final.astype(np.int32), "bin_start": starts.astype(np.int32)}
        return pa.RecordBatch.from_arrays([ids, *map(pa.array, numbers.values())], ["doc_id", *numbers])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= BLOCK:
                out = block(pa.Table.from_batches(held), base)
                base, held = int(out.column("bin_id").to_numpy().max()) + 1, []
                yield out
        if sum(map(len, held)):
            yield block(pa.Table.from_batches(held), base)

    n = words_and_end(F.col("text")) if length is None else length
    rows = docs.select("doc_id", F.greatest(F.coalesce(n.cast("long"), F.lit(0)), F.lit(0)).alias("n"))
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL(OUT).fields]))
