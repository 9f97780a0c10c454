"""Set algebra over CIDR prefixes, written as equi-joins and aggregations.

Prefixes only nest, so overlap is containment and containment is an equality of
masked network addresses. Nothing here sorts a whole snapshot or needs a window
over more ends of prefixes than a 16-bit slice of the address space can hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefixledger.functions import address as A

PREFIX = list(A.PREFIX)


def lengths_present(prefixes: DataFrame) -> DataFrame:
    """``family, lengths``: at most two rows and at most 33 + 129 lengths in all."""
    return prefixes.groupBy("family").agg(F.collect_set("plen").alias("lengths"))


def at_lengths(
    df: DataFrame, lengths: DataFrame, *, keep: list[str], condition: Column | None = None
) -> DataFrame:
    """One row per length in ``lengths``: ``keep`` plus ``c_plen, c_hi, c_lo``, the masked prefix.

    The broadcast side is bounded by the number of prefix lengths, not by the data.
    """
    long = df.join(F.broadcast(lengths), "family").select(
        *df.columns, F.explode("lengths").alias("c_plen")
    )
    if condition is not None:
        long = long.filter(condition)
    return long.select(
        *keep,
        "c_plen",
        A.mask_half_hi("hi", "c_plen").alias("c_hi"),
        A.mask_half_lo("lo", "c_plen").alias("c_lo"),
    )


def containers(inner: DataFrame, outer: DataFrame, on: list[str], outer_fields: list[str]) -> DataFrame:
    """Every (inner, strictly shorter containing outer) pair as ``inner`` columns, ``c_*`` and ``outer_fields``."""
    outer = outer.select(
        *on, "family", F.col("plen").alias("c_plen"), F.col("hi").alias("c_hi"), F.col("lo").alias("c_lo"),
        *outer_fields,
    )
    lengths = outer.groupBy("family").agg(F.collect_set("c_plen").alias("lengths"))
    probes = at_lengths(inner, lengths, keep=inner.columns, condition=F.col("c_plen") < F.col("plen"))
    return probes.join(outer, [*on, "family", "c_plen", "c_hi", "c_lo"])


def overlaps(prefixes: DataFrame, on: list[str]) -> DataFrame:
    """Prefixes that lie inside a shorter prefix of the same group, with the container's columns."""
    distinct = prefixes.select(*on, *PREFIX).distinct()
    return containers(distinct, distinct, on, [])


def drop_covered(prefixes: DataFrame, on: list[str]) -> DataFrame:
    """The distinct prefixes that no shorter prefix of their group contains: a disjoint set."""
    distinct = prefixes.select(*on, *PREFIX).distinct()
    covered = overlaps(distinct, on).select(*on, *PREFIX)
    return distinct.join(covered, [*on, *PREFIX], "left_anti")


def _end(half: str, low: str) -> Column:
    return F.struct(F.col(half).alias("hi"), F.col(low).alias("lo"))


def collapse(prefixes: DataFrame, on: list[str], *, disjoint: bool = False, longest: int = 128) -> DataFrame:
    """The smallest CIDR cover of each group as maximal runs: ``on, family, blocks``.

    A prefix opens at its first address and closes behind its last one. Where one closes and another opens the
    two cancel, and what remains alternates between the openings and closings of maximal runs. Buckets of the
    address space pair them: the finest hold at most 65,536 prefixes, and each coarser level (16 bits shorter)
    sees one row for each finer bucket, with the closing before its first and the opening after its last pair.
    So no window partition exceeds 65,536 rows (131,072 ends at the finest level) however many rows a group
    holds, and the input is read once. A run's blocks follow from its two ends in closed form.

    ``longest`` is the longest IPv6 length that can occur (64 after the strict checks), which sets the number of
    levels; a longer prefix is counted rightly too, but widens the finest buckets.
    """
    base = prefixes.select(*on, *PREFIX).distinct() if disjoint else drop_covered(prefixes, on)
    base = base.filter(F.col("family").isNotNull())
    finest = max((longest + 15) // 16 * 16 - 16, 16)
    group = [*on, "family"]

    def with_bucket(df: DataFrame, bits: int) -> DataFrame:
        # An IPv4 address has 32 bits, so its buckets are never finer than 16 bits.
        sized = df.withColumn("bits", F.when(F.col("family") == 4, min(bits, 16)).otherwise(bits))
        return sized.select(*df.columns, A.mask_half_hi("hi", "bits").alias("b_hi"), A.mask_half_lo("lo", "bits").alias("b_lo"))

    last_hi, last_lo = A.last_address(F.col("hi"), F.col("lo"), F.col("plen"))
    closed = base.withColumn("z", F.struct(last_hi.alias("hi"), last_lo.alias("lo")))
    past, next_hi, next_lo = A.next_address(F.col("z.hi"), F.col("z.lo"))
    none = F.lit(None).cast("struct<hi:bigint,lo:bigint>")
    point = lambda end, hi, lo, step, z: F.struct(
        end.alias("past_end"), hi.alias("hi"), lo.alias("lo"), F.lit(step).alias("step"), z.alias("z"))
    ends = F.array(point(F.lit(False), F.col("hi"), F.col("lo"), 1, none), point(past, next_hi, next_lo, -1, F.col("z")))
    points = with_bucket(closed.select(*group, F.inline(ends)), finest)
    cell = [*group, "b_hi", "b_lo"]
    # One exchange by bucket serves the cancelling aggregation, the window and the bucket's own row.
    left = (
        points.repartition(*cell).groupBy(*cell, "past_end", "hi", "lo")
        .agg(F.sum("step").alias("step"), F.max("z").alias("z")).filter("step <> 0")
    )
    order = F.struct("past_end", "hi", "lo")
    following = F.lead("z").over(Window.partitionBy(*cell).orderBy("past_end", "hi", "lo"))
    ordered = left.withColumn("following", following).withColumn("opening", F.when(F.col("step") > 0, _end("hi", "lo")))
    paired = A.with_cover_blocks(ordered, "opening", "following", "blocks")
    rows = paired.groupBy(*cell).agg(
        F.coalesce(F.sum("blocks"), F.lit(0)).alias("blocks"),
        F.min_by(F.when(F.col("step") < 0, F.col("z")), order).alias("closing"),
        F.max_by("opening", order).alias("opening"),
    )
    for bits in range(finest - 16, -1, -16):
        inner = with_bucket(rows.select(*group, F.col("b_hi").alias("hi"), F.col("b_lo").alias("lo"), "blocks", "closing", "opening"), bits)
        following = F.lead("closing").over(Window.partitionBy(*cell).orderBy("hi", "lo"))
        joined = A.with_cover_blocks(inner.withColumn("following", following), "opening", "following", "joined")
        rows = joined.groupBy(*cell).agg(
            F.sum(F.col("blocks") + F.coalesce("joined", F.lit(0))).alias("blocks"),
            F.min_by("closing", _end("hi", "lo")).alias("closing"),
            F.max_by("opening", _end("hi", "lo")).alias("opening"),
        )
    return rows.select(*group, "blocks")
