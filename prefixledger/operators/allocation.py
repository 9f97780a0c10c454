"""Counts and shares per country, duplicates and overlap of catalogue rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixledger.functions import address as A
from prefixledger.functions import labels as L
from prefixledger.operators.intervals import PREFIX, collapse, drop_covered



def _is(family: int) -> Column:
    return F.col("family") == family


def _per_length(df: DataFrame, keys: list) -> DataFrame:
    """Row counts per (keys, family, length): sizes then need one multiplication per length."""
    return df.groupBy(*keys, "family", "plen").agg(F.count("*").alias("n"))


def _totals(blocks: Column) -> list[Column]:
    v4_addresses = F.when(_is(4), F.col("n") * A.v4_count(F.col("plen")))
    v6_blocks = F.when(_is(6), F.col("n").cast("decimal(38,0)") * blocks)
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return [
        zero(F.when(_is(4), F.col("n"))).alias("ipv4_prefixes"),
        zero(v4_addresses).cast("bigint").alias("ipv4_addresses"),
        zero(F.when(_is(6), F.col("n"))).alias("ipv6_prefixes"),
        zero(v6_blocks).cast("decimal(38,0)").alias("ipv6_64_blocks"),
    ]


def country_allocation(catalogue: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """Lenient rollup: prefixes, IPv4 addresses and /64 blocks (at least one each) per country.

    Malformed rows count in ``malformed`` only.
    """
    keyed = catalogue.withColumn("country", L.country_key(F.col("country")))
    keys = [*on, "country"]
    counted = _per_length(keyed, keys).groupBy(*keys).agg(
        *_totals(A.v6_blocks_lenient(F.col("plen"))),
        F.coalesce(F.sum(F.when(F.col("family").isNull(), F.col("n"))), F.lit(0)).alias("malformed"),
    )
    return counted.withColumn("total_prefixes", F.col("ipv4_prefixes") + F.col("ipv6_prefixes"))


def country_series(catalogue: DataFrame) -> DataFrame:
    """Strict rollup per date and country."""
    keyed = catalogue.withColumn("country", L.country_key(F.col("country")))
    keys = ["snapshot_date", "country"]
    counted = _per_length(keyed, keys).groupBy(*keys).agg(*_totals(A.v6_blocks(F.col("plen"))))
    return counted.withColumn("total_prefixes", F.col("ipv4_prefixes") + F.col("ipv6_prefixes"))


def country_share(allocation: DataFrame, country: str) -> DataFrame:
    """Selected country's share of all prefixes, IPv4 prefixes, IPv4 addresses and IPv6 prefixes."""
    code = L.selected_country(country)
    measures = {"all": "total_prefixes", "ipv4": "ipv4_prefixes", "ipv4_addresses": "ipv4_addresses", "ipv6": "ipv6_prefixes"}
    mine = F.col("country") == code
    sums = allocation.agg(
        *[F.coalesce(F.sum(F.when(mine, F.col(c))), F.lit(0)).alias(f"{m}_selected") for m, c in measures.items()],
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"{m}_whole") for m, c in measures.items()],
    )
    rows = F.array(*[
        F.struct(
            F.lit(m).alias("measure"),
            F.col(f"{m}_selected").alias("selected"),
            F.col(f"{m}_whole").alias("whole"),
            L.percent_text(F.col(f"{m}_selected"), F.col(f"{m}_whole"), 2).alias("percent"),
        )
        for m in measures
    ])
    return sums.select(F.inline(rows))


def top_countries(allocation: DataFrame, first_seen: DataFrame | None, n: int) -> DataFrame:
    """The n countries with most prefixes; ties keep first-seen order (``country, first_seen``)."""
    if first_seen is not None:
        allocation = allocation.join(first_seen, "country", "left")
        tie = F.col("first_seen")
    else:
        tie = F.col("country")
    return allocation.filter("total_prefixes > 0").orderBy(F.desc("total_prefixes"), tie).limit(n)


def first_seen(catalogue: DataFrame) -> DataFrame:
    return catalogue.groupBy(L.country_key(F.col("country")).alias("country")).agg(F.min("_ordinal").alias("first_seen"))


def snapshot_series(catalogue: DataFrame) -> DataFrame:
    """Catalogue size and integrity per date: the strict scan's rows, disjoint and at most /64."""
    label = F.struct(*[F.coalesce(F.trim(F.col(c)), F.lit("")).alias(c) for c in ("country", "region", "city")])
    date = ["snapshot_date"]
    # Distinct labels in two exact steps; the second sees one row per (date, label, family, length).
    per_label = catalogue.groupBy(*date, label.alias("label"), "family", "plen").agg(
        F.count("*").alias("n"),
        F.count_if(~A.is_canonical(F.col("cidr"), F.col("canonical"))).alias("odd"),
    )
    sized = per_label.groupBy(*date).agg(*_totals(A.v6_blocks(F.col("plen"))), F.sum("odd").alias("noncanonical_cidrs"))
    labels = per_label.select(*date, "label").distinct()
    places = labels.groupBy(*date).agg(F.count("*").alias("locations"))
    countries = (
        labels.select(*date, L.country_key(F.col("label.country")).alias("c")).distinct()
        .groupBy(*date).agg(F.count("*").alias("countries"))
    )
    blocks = collapse(catalogue, date, disjoint=True, longest=64)
    family = lambda f: F.coalesce(F.sum(F.when(_is(f), F.col("blocks"))), F.lit(0)).alias(f"collapsed_ipv{f}_blocks")
    wide = blocks.groupBy(*date).agg(family(4), family(6))
    return (
        sized.join(countries, date).join(places, date).join(wide, date)
        .withColumn("rows", F.col("ipv4_prefixes") + F.col("ipv6_prefixes"))
        .select(
            "snapshot_date", "rows", "ipv4_prefixes", "ipv6_prefixes", "ipv4_addresses", "ipv6_64_blocks",
            "countries", "locations", "collapsed_ipv4_blocks", "collapsed_ipv6_blocks", "noncanonical_cidrs",
        )
    )


def duplicate_cidrs(catalogue: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """CIDR texts that occur more than once, with the count."""
    return (
        catalogue.groupBy(*on, F.trim("cidr").alias("cidr")).agg(F.count("*").alias("n")).filter("n > 1")
    )


def duplicate_summary(duplicates: DataFrame) -> DataFrame:
    return duplicates.agg(
        F.count("*").alias("duplicate_cidrs"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows")
    )


def top_duplicates(duplicates: DataFrame, n: int = 5) -> DataFrame:
    return duplicates.orderBy(F.desc("n"), "cidr").limit(n)


def malformed(catalogue: DataFrame, examples: int = 5) -> DataFrame:
    """Count of malformed CIDR texts and up to ``examples`` of them, in scan order."""
    bad = catalogue.filter(F.col("family").isNull())
    shown = bad.orderBy("_ordinal").limit(examples).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_ordinal", F.trim("cidr").alias("c")))), lambda x: x["c"])
    )
    return bad.agg(F.count("*").alias("malformed")).withColumn("examples", shown.scalar())


def overlap_report(catalogue: DataFrame, on: tuple[str, ...] = (), *, longest: int = 128) -> DataFrame:
    """Naive against overlap-free address sums, prefixes and collapsed blocks per family."""
    on = list(on)
    keys = [*on, "family"]
    valid = catalogue.filter(F.col("family").isNotNull())
    total = lambda df, rows, name: _per_length(df, on).groupBy(*keys).agg(
        F.sum("n").alias(rows),
        F.sum(F.col("n").cast("decimal(38,0)") * A.address_count(F.col("family"), F.col("plen"))).cast("decimal(38,0)").alias(name),
    )
    naive = total(valid, "prefixes", "naive_addresses")
    disjoint = drop_covered(valid, on)
    dedup = total(disjoint, "disjoint_prefixes", "addresses")
    blocks = collapse(disjoint, on, disjoint=True, longest=longest)
    over = F.col("naive_addresses") - F.col("addresses")
    return (
        naive.join(dedup, keys).join(blocks, keys)
        .select(
            *keys, "prefixes", F.col("blocks").alias("collapsed"), "naive_addresses", "addresses",
            over.cast("decimal(38,0)").alias("over_count"),
            L.percent_text(over, F.col("naive_addresses"), 4).alias("over_percent"),
        )
    )
