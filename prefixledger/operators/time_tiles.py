"""Interval joins in time by dyadic tiles: an equi-join whose rows do not grow with the length of a window.

Time is counted in units of ``UNIT`` seconds. A tile of level k is a run of 2^k units that starts at a multiple of 2^k.
The units of a window are covered without overlap by at most two tiles a level, so a window of n units takes
2 log2(n) rows at most; a point is looked up under one tile for each level that some window uses. Short windows
use low levels only, so usual points take few rows. The exact bounds are compared after the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = 60.0
#: Levels of a cover: 2^40 minutes are longer than any time a timestamp can hold.
LEVELS = 41


def unit_of(seconds: Column, unit: float = UNIT) -> Column:
    return F.floor(seconds / unit).cast("bigint")


def cover(first: Column, last: Column) -> Column:
    """Tiles ``level, tile`` of the units ``first`` to ``last``, both included; empty if the window is, null if a bound is.

    A tile belongs to the cover if it lies inside the window and its parent does not: at every level this can only be
    the first whole tile, where its number is odd, and the last one, where it is even.
    """

    def at(k: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("bigint"), k)
        low, high = F.call_function("shiftright", first + size - 1, k), F.call_function("shiftright", last + 1, k) - 1
        tile = lambda wanted, number: F.when((low <= high) & wanted, F.struct(k.alias("level"), number.alias("tile")))
        return F.array(tile(low.bitwiseAND(1) == 1, low), tile(high.bitwiseAND(1) == 0, high))

    # A tile inside the window is no longer than it: levels beyond the logarithm of its length (one more for rounding) hold none.
    length = F.greatest(last - first + 1, F.lit(1))
    highest = F.least(F.floor(F.log2(length.cast("double"))).cast("int") + 1, F.lit(LEVELS - 1))
    # Most windows lie in one unit: a lambda is interpreted, so these do without it.
    own = F.array(F.struct(F.lit(0).alias("level"), first.alias("tile")))
    return F.when(first == last, own).otherwise(
        F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.when(first.isNotNull() & last.isNotNull(), highest)), at))))


def join_points(windows: DataFrame, points: DataFrame, on: list[str], *, start: str, stop: str, at: str, unit: float = UNIT) -> DataFrame:
    """Pairs of a window and a point with equal ``on`` and ``start <= at <= stop`` (seconds as doubles), with the columns of both.

    Windows that end before they start, and rows with a null bound, time or key, match nothing. Columns besides ``on``
    must differ. Repeated rows stay repeated. The lengths of all windows meet in one row of at most ``LEVELS`` numbers.
    """
    tiled = windows.withColumn("_t", F.explode(cover(unit_of(F.col(start), unit), unit_of(F.col(stop), unit)))).select("*", F.col("_t.level").alias("_level"), F.col("_t.tile").alias("_tile")).drop("_t")
    levels = tiled.agg(F.collect_set("_level").alias("_levels"))
    spread = points.withColumn("_level", F.explode(levels.scalar()))
    spread = spread.withColumn("_tile", F.call_function("shiftright", unit_of(F.col(at), unit), F.col("_level")))
    met = tiled.join(spread, [*on, "_level", "_tile"]).drop("_level", "_tile")
    return met.filter(F.col(at).between(F.col(start), F.col(stop)))
