"""Connected components by alternating star contraction, with DataFrame operations only.

Every round replaces the links of a node by links to the smallest node of its neighbourhood: first
those to larger nodes (large star), then those to smaller ones (small star). The link table never
grows, a round count of about log(diameter) suffices, and each step is an aggregation with map-side
combine plus an equi-join of two stored tables, which adaptive execution can split where one node
has very many links. Nothing is collected but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixledger.llm.common import cut_lineage
from prefixledger.session import remove_stored


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(links: DataFrame, source: str = "u", target: str = "v") -> DataFrame:
    """``node, root`` for every node of ``links``; root is the smallest node reachable, itself included.

    Null ends and links of a node to itself are ignored; an empty table gives an empty result.
    """
    ends = links.select(F.col(source).alias("x"), F.col(target).alias("y")).filter("x <> y")
    state = cut_lineage(ends.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    mark = _mark(state)
    while mark[0]:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut_lineage(both.groupBy(F.col("u").alias("k")).agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = cut_lineage(both.join(least, F.col("u") == F.col("k")).filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least_below = cut_lineage(large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")))
        small = large.join(least_below, F.col("u") == F.col("k")).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        following = cut_lineage(small.select("e.*").filter("u <> v").distinct())
        for old in (state, least, large, least_below):
            remove_stored(old)
        state, before, mark = following, mark, _mark(following)
        if mark == before:
            break
    roots = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
