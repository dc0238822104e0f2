"""Spatial joins over boxes of documents: grids of cells by size make them equi-joins, and rings find nearest boxes.

A box belongs to a level by its longer side and, by its centre, to one cell of that level, so large boxes are no more rows than small ones.
A box that searches goes to the cells that a partner of each level may have its centre in; only levels that the document has are searched. A pair meets
once, in its partner's cell. Nearest boxes are searched within a radius; a search that finds enough inside it is over, the others go on
with twice the radius, so what meets follows the neighbourhood and not the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import geometry as G
from docloom.sources.cut import cut

LEAST_CELL, MOST_CELL, DEFAULT_CELL = 1.0, 4096.0, 16.0
#: Cells of the lowest level are so many times the median of the longer sides.
CELL_SIDES = 2.0
#: A document with so many boxes for each one wanted is searched whole.
FEW = 8


def cell_size(boxes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, cell): the cell of each document, the median of the shorter sides within limits."""
    side = F.when((F.col("width") > 0) & (F.col("height") > 0), F.least("width", "height"))
    return boxes.groupBy(key).agg(F.coalesce(F.median(side), F.lit(DEFAULT_CELL)).alias("m")).select(key, F.least(F.lit(MOST_CELL), F.greatest(F.lit(LEAST_CELL), F.col("m"))).alias("cell"))


def named(boxes: DataFrame, prefix: str, key: str = "doc_id") -> DataFrame:
    return boxes.select(key, *(F.col(c).alias(f"{prefix}{c}") for c in boxes.columns if c != key))


def _level(base: Column, width: Column, height: Column) -> Column:
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(width, height, F.lit(1e-9)) / base))).cast("int")


def grid_join(a: DataFrame, b: DataFrame, test: Column, key: str = "doc_id", reach: Column | float = 0.0, base: Column | None = None) -> DataFrame:
    """Pairs of a box of a (columns a_x ...) and one of b (b_x ...) of the same document that pass `test`.

    `test` may hold only for boxes at most `reach` apart on each axis (a column of a, or a number). base: cell of the lowest level, an aggregate of b's columns; about twice the reach, so that few cells are searched."""
    one, two = G.Box("a_"), G.Box("b_")
    reach = reach if isinstance(reach, Column) else F.lit(float(reach))
    sides = F.coalesce(F.median(F.greatest("b_width", "b_height")), F.lit(DEFAULT_CELL)) * CELL_SIDES if base is None else base
    own = b.groupBy(key).agg(F.greatest(F.lit(LEAST_CELL), sides).alias("_base"), F.collect_set(F.struct("b_width", "b_height")).alias("_sides"))
    own = own.select(key, "_base", F.array_distinct(F.transform("_sides", lambda s: _level(F.col("_base"), s["b_width"], s["b_height"]))).alias("_levels"))
    cell = F.col("_base") * F.pow(F.lit(2.0), F.col("_level"))
    right = b.join(own.select(key, "_base"), key).withColumn("_level", _level(F.col("_base"), two.width, two.height))
    right = right.select(key, "_level", F.floor(two.center_x / cell).alias("_cx"), F.floor(two.center_y / cell).alias("_cy"), *(c for c in b.columns if c != key))
    # A partner's centre is at most reach and half of its level's cell beyond the box.
    low, high = lambda v: F.floor((v - reach) / cell - 0.5), lambda v: F.floor((v + reach) / cell + 0.5)
    left = a.join(own, key).withColumn("_level", F.explode("_levels"))
    left = left.withColumn("_cx", F.explode(F.sequence(low(one.x), high(one.right)))).withColumn("_cy", F.explode(F.sequence(low(one.y), high(one.bottom)))).drop("_base", "_levels")
    return left.join(right, [key, "_level", "_cx", "_cy"]).filter(test).drop("_level", "_cx", "_cy")


def nearest(a: DataFrame, b: DataFrame, distance: Column, k: int, by: list[str], order: list[str], test: Column, key: str = "doc_id") -> DataFrame:
    """The k nearest boxes of b (b_x ...) of each box of a (a_x ...) that pass test, with distance and rank: by distance to six digits, then order.

    distance: of the columns a_ and b_, never less than the boxes' gap on either axis. by: columns that tell the boxes of a apart."""
    extent = lambda df, p: df.groupBy(key).agg(F.count("*").alias(f"_{p}n"), *(f(F.col(f"{p}{c}") + more).alias(f"_{p}{n}") for f, c, more, n in ((F.min, "x", F.lit(0), "x0"), (F.min, "y", F.lit(0), "y0"), (F.max, "x", F.col(f"{p}width"), "x1"), (F.max, "y", F.col(f"{p}height"), "y1"))))
    page = extent(a, "a_").join(extent(b, "b_"), key)
    across = F.greatest("_a_x1", "_b_x1") - F.least("_a_x0", "_b_x0")
    down = F.greatest("_a_y1", "_b_y1") - F.least("_a_y0", "_b_y0")
    start = F.greatest(F.sqrt(across * down * (k + 1) / F.col("_b_n")), F.greatest(across, down) * (k + 1) / F.col("_b_n"), F.lit(1.0))
    # Within _all lies everything of the document.
    page = page.withColumn("_all", across + down + 1.0).select(key, "_all", F.when(F.col("_b_n") <= FEW * (k + 1), F.col("_all")).otherwise(F.least(start, F.col("_all"))).alias("_r"))
    left, page = a, cut(page)
    best = Window.partitionBy(key, *by).orderBy(F.round("distance", 6), *order)
    done = None
    while left is not None:
        held = b if done is None else b.join(left.select(key).distinct(), key, "left_semi")
        met = grid_join(left.join(page, key), held.join(page.select(key, F.col("_r").alias("b_r")), key), test, key, F.col("_r"), F.max("b_r") * 2).drop("b_r").withColumn("distance", distance).filter(F.col("distance") <= F.col("_r"))
        ranked = met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        # The k-th is final if nothing outside the radius can come before it.
        over = F.count(F.when(F.round("distance", 6) < F.col("_r") - 1e-6, 1)).over(Window.partitionBy(key, *by)) >= k
        ranked = cut(ranked.withColumn("_over", over | (F.col("_r") >= F.col("_all"))))
        kept = ranked.filter("_over").drop("_over", "_r", "_all")
        done = kept if done is None else done.unionByName(kept)
        rest = cut(left.join(page.filter("_r < _all").select(key), key, "left_semi").join(ranked.filter("_over").select(key, *by).distinct(), [key, *by], "left_anti"))
        left, page = None if rest.isEmpty() else rest, page.withColumn("_r", F.least(F.col("_r") * 2, F.col("_all")))
    return done
