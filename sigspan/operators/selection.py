"""Order statistics by histogram refinement: the value of a rank without a sort of the rows.

A round counts the rows of each cell of a group, cells being numbered in the order of the values; a running sum
over the cells of a group tells which cell holds a wanted rank, and only rows of such a cell go on to the
next round. The first round's cells are shares of a doubling (sign and logarithm), the later ones cut a
cell evenly between its smallest and largest value into ``FINE`` parts. A cell whose smallest and largest value are
equal is done. A first cell spans an eighth of a doubling, so after three later rounds less than one step
of a double is left: there are at most four rounds, and two on most data.

Rows are never sorted or exchanged: a round is a scan with map-side counting, and the wanted cells are small tables
(two ranks for each group and level).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import sized_broadcast, stage_table
from .sequence import null_safe_join

COARSE = 8  # first cells for each doubling
FINE = 1 << 24
_CELL_BYTES, _KEY_BYTES = 64, 32  # a wanted cell with its bounds, and each of its group keys


def coarse_cell(v: Column) -> Column:
    """Cell of a double in the first round, rising with it; zeros share one, NaN has the last."""
    a = F.abs(v)
    small = F.floor(F.log2(F.when((a > 0) & (a < float("inf")), a).otherwise(F.lit(1.0))) * COARSE) + 1100 * COARSE
    size = F.when(F.isnan(v), F.lit(2200 * COARSE + 1)).when(a == float("inf"), F.lit(2200 * COARSE)).when(a == 0, F.lit(0)).otherwise(small)
    return F.when((v < 0) & ~F.isnan(v), -size).otherwise(size).cast("long")


def _counted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of ``rows(keys, _cell, _v)`` with their bounds, and how many rows lie in cells before."""
    cells = rows.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def _picked(cells: DataFrame, keys: list[str], names: list[Column]) -> DataFrame:
    """One row for each wanted rank in the cell that holds it, with the rank inside the cell."""
    inside = lambda w: (w["rank"] >= F.col("_before")) & (w["rank"] < F.col("_before") + F.col("_n"))
    hit = cells.select(*keys, *names, "_low", "_high", "_before", F.explode(F.filter("_wanted", inside)).alias("_w"))
    return hit.withColumn("_w", F.struct((F.col("_w.rank") - F.col("_before")).alias("rank"), "_w.level", "_w.side", "_w.frac")).drop("_before")


def select_quantiles(df: DataFrame, keys: Sequence[str], value: str, levels: Sequence[float]) -> DataFrame:
    """Exact interpolated percentiles ``(keys..., p, q)`` of groups of any size; NULL values do not count.

    The result equals ``percentile(value, p)``. NULL keys form a group. Each round writes its wanted cells (a few rows
    for each group) to the shared scratch folder; they are broadcast to the scan behind a bound of their
    size, and joined by a shuffle beyond it.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    rows = rows.withColumn("_c0", coarse_cell(F.col("_v")))

    # the first round also gives the group sizes, and with them the wanted ranks (from 0)
    cells = _counted(rows.withColumnRenamed("_c0", "_cell"), keys).withColumn("_size", F.sum("_n").over(Window.partitionBy(*keys)))
    wanted, asked_here = [], F.lit(False)
    for p in levels:
        at = F.lit(float(p)) * (F.col("_size") - 1)
        low = F.floor(at).cast("long")
        for side, rank in ((0, low), (1, F.least(low + 1, F.col("_size") - 1))):
            asked_here = asked_here | ((rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_n")))
            wanted.append(F.struct(rank.alias("rank"), F.lit(float(p)).alias("level"), F.lit(side).alias("side"), (at - F.floor(at)).alias("frac")))
    path = ["_c0"]  # numbers of the cells around a row, from the first round's on
    picked = stage_table(_picked(cells.where(asked_here).withColumn("_wanted", F.array(*wanted)), keys, [F.col("_cell").alias("_c0")]), "ranks")
    done, most = [], None
    while True:
        found, open_ = picked.agg(F.count(F.lit(1)), F.count(F.when(F.col("_low") < F.col("_high"), F.lit(1)))).first()
        most = found if most is None else most  # every later round has as many wanted ranks at most
        done.append(picked.where(~(F.col("_low") < F.col("_high"))))
        if not open_:
            break
        left = picked.where(F.col("_low") < F.col("_high"))
        asked = left.groupBy(*keys, *path, "_low", "_high").agg(F.collect_list("_w").alias("_wanted"))
        bounds = asked.select(*keys, *path, "_low", "_high")
        small = sized_broadcast(bounds, most, _CELL_BYTES + _KEY_BYTES * len(keys))
        rows = null_safe_join(rows, small, [*keys, *path])
        part = F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * FINE).cast("long")
        inner = rows.select(*keys, *path, part.alias("_cell"), "_v")
        cells = null_safe_join(_counted(inner, [*keys, *path]), asked.drop("_low", "_high"), [*keys, *path])
        new = f"_c{len(path)}"
        picked = stage_table(_picked(cells, [*keys, *path], [F.col("_cell").alias(new)]), "ranks")
        rows = rows.select(*keys, *path, "_v", part.alias(new))
        path.append(new)
    flat = [d.select(*keys, "_low", "_w") for d in done]
    out = reduce(DataFrame.unionByName, flat).groupBy(*keys, F.col("_w.level").alias("p")).agg(
        F.max(F.when(F.col("_w.side") == 0, F.col("_low"))).alias("_lo"), F.max(F.when(F.col("_w.side") == 1, F.col("_low"))).alias("_hi"), F.max("_w.frac").alias("_frac"))
    between = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_frac")
    return out.select(*keys, "p", F.when((F.col("_frac") == 0) | (F.col("_lo") == F.col("_hi")), F.col("_lo")).otherwise(between).alias("q"))
