"""Overlap joins of half-open intervals, and fixed-width bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Cells of a level are so many times as wide as those of the level below; and the number of levels.
GROWTH, LEVELS = 8, 16


def _level(start: str, end: str, width: int) -> Column:
    """The lowest level whose cells are as wide as the interval; a sum of comparisons, so that no rounding is in it."""
    size = F.col(end) - F.col(start)
    return sum(((size > width * GROWTH**k).cast("int") for k in range(LEVELS - 1)), F.lit(0))


def _levels(left: DataFrame, right: DataFrame) -> tuple[list[int], list[int]]:
    """The levels of both sides, in one job; at most LEVELS for each."""
    both = left.select("level", F.lit(0).alias("side")).union(right.select("level", F.lit(1).alias("side"))).distinct().collect()
    return tuple(sorted(r.level for r in both if r.side == k) for k in (0, 1))


def _cells(rows: DataFrame, start: str, end: str, at: Column, width: int) -> DataFrame:
    """Rows in the cells that they touch at each level of the array ``at``: two at most for each."""
    rows = rows.withColumn("at", F.explode(at)).withColumn("w", F.element_at(F.array(*[F.lit(width * GROWTH**k).cast("long") for k in range(LEVELS)]), F.col("at") + 1))
    return rows.withColumn("cell", F.explode(F.sequence(F.floor(F.col(start) / F.col("w")), F.floor((F.col(end) - 1) / F.col("w")))))


def interval_join(a: DataFrame, b: DataFrame, *, width: int) -> DataFrame:
    """All pairs of rows of ``a`` (chrom, start, end, ..) and ``b`` (chrom, b_start, b_end, ..) that share a base.

    Cells are nested: ``width`` bases at the lowest level and ``GROWTH`` times as many at each above. An interval belongs to the
    lowest level whose cells are as wide as it, and touches two cells there and at each level above, however long it is. A pair meets at the
    higher one of its levels, in the cell of the larger start: intervals of one level meet there, and shorter ones are spread over
    the levels that the other side has above theirs. So rows are repeated for each level, not for each base, and no chromosome is one
    task. The levels that there are, a few numbers, are looked up first; with one level on both sides one equi-join is all.
    About the length of most intervals is best for ``width``. Columns besides chrom must differ in name.
    """
    left = a.where("start < end").withColumn("level", _level("start", "end", width))
    right = b.where("b_start < b_end").withColumn("level", _level("b_start", "b_end", width))
    of_left, of_right = _levels(left, right)
    own = F.array(F.col("level"))
    above = lambda levels: F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: x > F.col("level"))
    higher = lambda rows, others: rows.where(F.col("level") > min(others))
    joins = [(left, own, right, own)]
    if of_right and of_left and of_left[-1] > of_right[0]:
        joins.append((higher(left, of_right), own, right, above(of_left)))
    if of_left and of_right and of_right[-1] > of_left[0]:
        joins.append((left, above(of_right), higher(right, of_left), own))
    out = None
    for x, x_at, y, y_at in joins:
        x = _cells(x, "start", "end", x_at, width).drop("level")
        y = _cells(y, "b_start", "b_end", y_at, width).drop("level", "w")
        both = x.join(y, ["chrom", "at", "cell"]).where("start < b_end and b_start < end")
        both = both.where(F.col("cell") == F.floor(F.greatest("start", "b_start") / F.col("w"))).drop("at", "cell", "w")
        out = both if out is None else out.unionByName(both)
    return out


def bins(chromsizes: DataFrame, resolution: int) -> DataFrame:
    """(bin_id, chrom, start, end) of chromsizes (chrom, chrom_idx, size): fixed width, the last of each chromosome cut short."""
    sized = bin_offsets(chromsizes, resolution)
    at = sized.where("size > 0").select("chrom", "size", "first_bin", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(resolution).cast("long"))).alias("k", "start"))
    return at.select((F.col("first_bin") + F.col("k")).alias("bin_id"), "chrom", "start", F.least(F.col("start") + resolution, "size").alias("end"))


def bin_offsets(chromsizes: DataFrame, resolution: int) -> DataFrame:
    """Adds first_bin, the number of bins of the chromosomes before; chromosomes are few."""
    from pyspark.sql import Window

    count = F.ceil(F.col("size") / resolution).cast("long")
    before = Window.orderBy("chrom_idx").rowsBetween(Window.unboundedPreceding, -1)
    return chromsizes.withColumn("first_bin", F.coalesce(F.sum(count).over(before), F.lit(0)))


def bin_of(position: Column, size: Column, first_bin: Column, resolution: int) -> Column:
    """The bin of a position, null outside the chromosome; no join is needed."""
    return F.when((position >= 0) & (position < size), first_bin + F.floor(position / resolution))
