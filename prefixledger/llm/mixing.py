"""Mixing sources to target weights: repetition rates from token totals, whole copies plus a seeded coin.

A source's rate is its target divided by its total. A document is taken floor(rate) times, and once
more if a hash of seed, id and text falls below the fraction. The coin depends on nothing else, so
reruns agree at any partitioning. Totals come from one aggregation with map-side combine; the table
of sources has one row a source, and only windows over that table see a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefixledger.llm.common import cut_lineage, packed, unpacked, with_group_values, word_count

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SEED = "mix-1"


def source_targets(sized: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """``source, source_size, target`` from rows ``source, size``.

    Sources in code point order (null last) weigh ``weights``, repeating, and share the sum of all
    sizes. A target above ``most_repeats`` times its source's size stops there, and what it leaves
    goes to the others by weight until none is above. In order of size per weight, the sources that stop
    come first; the level of the rest is what remains of the sum divided by what remains of the weights.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = totals.select("source", "source_size", weight.cast("long").alias("weight"))
    by_room = Window.orderBy(F.col("source_size").cast("double") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy()
    rest = F.sum("source_size").over(over) - most_repeats * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    rest_weight = F.sum("weight").over(over) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levels = weighed.withColumn("level", rest.cast("double") / rest_weight)
    # a source stops if the level reached with all before it stopped still lifts it above its most
    stops = levels.withColumn("stops", F.col("level") * F.col("weight") > most_repeats * F.col("source_size"))
    level = F.min(F.when(~F.col("stops"), F.struct((F.col("source_size").cast("double") / F.col("weight")).alias("r"), F.col("source").isNull().alias("n"), "source", "level"))).over(over)["level"]
    target = F.when(F.col("stops"), (most_repeats * F.col("source_size")).cast("double")).otherwise(level * F.col("weight"))
    return stops.select("source", "source_size", target.alias("target"))


def coin(seed: str, key: Column, text: Column) -> Column:
    """A number in [0, 1) with 52 bits from the hash of seed, key and text."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(key.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def copies(df: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most_repeats: int = MOST_REPEATS, seed: str = SEED) -> DataFrame:
    """``row`` (the whole row), ``size, source_size, target, copies`` for every row of ``df``.

    Size is the number of words (null text: 0). A source without words has target 0 and its rows are
    taken 0 times. Null keys share no coin unless their texts are equal; wholly equal rows share one.
    An empty table gives an empty result.
    """
    rows = packed(df, _k=key, _t=text, source=source).select("row", "source", word_count(F.col("_t")).alias("size"), coin(seed, F.col("_k"), F.col("_t")).alias("_coin"))
    sized = df.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    targets = cut_lineage(source_targets(sized, weights=weights, most_repeats=most_repeats))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    taken = F.floor(rate) + (F.col("_coin") < rate - F.floor(rate)).cast("long")
    return with_group_values(rows, targets, ["source"]).select("row", "size", "source_size", "target", taken.cast("long").alias("copies"))


def mixed(df: DataFrame, **options) -> DataFrame:
    """The rows of ``df``, all columns unchanged, each emitted as often as the mix takes it."""
    rows = copies(df, **options).filter("copies > 0")
    return unpacked(rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).select("row"))


#: DuckDB statement for the digest of the query.
ORACLE = f"""
WITH sized AS (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [{', '.join(map(str, WEIGHTS))}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT] AS weight FROM totals),
levels AS (SELECT *, row_number() OVER w AS place,
    (sum(source_size) OVER () - {MOST_REPEATS} * coalesce(sum(source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
  FROM weighed WINDOW w AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST)),
stops AS (SELECT *, level * weight > {MOST_REPEATS} * source_size AS stops FROM levels),
targets AS (SELECT source, source_size, CASE WHEN stops THEN {MOST_REPEATS}::DOUBLE * source_size ELSE (SELECT arg_min(level, place) FROM stops WHERE NOT stops) * weight END AS target FROM stops),
rated AS (SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('{SEED}|' || coalesce(s.doc_id::VARCHAR, '') || '|' || md5(coalesce(s.text, ''))), 1, 13))::BIGINT / {2**52}::DOUBLE AS coin
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate)::BIGINT + (coin < rate - floor(rate))::BIGINT))::BIGINT AS taken FROM rated
"""
