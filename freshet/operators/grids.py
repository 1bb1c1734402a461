"""Grid cells filled from their neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.sources.shared import settled

_AROUND = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]


def fill_from_neighbours(cells: DataFrame, by: tuple[str, ...] = (), passes: int = 200) -> DataFrame:
    """by, x, y, value, fill_pass of every cell: a cell without a value gets the mean of those of its eight neighbours that have one, pass by
    pass, until none is left. fill_pass is 0 for cells that had a value.

    ``cells``: by, x, y, value; one row a cell, NaN counts as missing. Only missing cells and what touches them are carried from pass to
    pass: the grid is read twice, however many passes there are. Cells that no value can reach are an error, as are more than ``passes``.
    """
    key = [*by, "x", "y"]
    clean = cells.select(*key, F.when(~F.isnan(F.col("value").cast("double")), F.col("value").cast("double")).alias("value"))
    missing = clean.where("value is null").select(*key)
    touch = F.explode(F.array(*[F.struct((F.col("x") + i).alias("nx"), (F.col("y") + j).alias("ny")) for i, j in _AROUND])).alias("n")
    sides = missing.select(*key, touch).select(*key, "n.*")
    # the sides of missing cells that are cells themselves, with their values
    others = clean.select(*[F.col(b) for b in by], F.col("x").alias("nx"), F.col("y").alias("ny"), "value")
    sides = settled(sides.join(others, [*by, "nx", "ny"]))
    left, done = settled(missing).count(), None
    for turn in range(1, passes + 1):
        if not left:
            break
        fresh = settled(sides.where("value is not null").groupBy(*key).agg(F.avg("value").alias("value"), F.lit(turn).alias("fill_pass")))
        n = fresh.count()
        if not n:
            raise ValueError(f"{left} cells have no way to a value")
        left -= n
        done = fresh if done is None else done.unionByName(fresh)
        filled = fresh.select(*[F.col(b) for b in by], F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("value").alias("now"))
        sides = settled(sides.join(fresh.select(*key), key, "left_anti").join(filled, [*by, "nx", "ny"], "left").select(*key, "nx", "ny", F.coalesce("value", "now").alias("value")))
    if left:
        raise ValueError(f"{left} cells are still missing after {passes} passes")
    had = clean.where("value is not null").select(*key, "value", F.lit(0).alias("fill_pass"))
    return had if done is None else had.unionByName(done.select(*key, "value", "fill_pass"))
