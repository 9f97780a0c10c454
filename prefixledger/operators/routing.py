"""Longest-prefix match and what is counted from it.

The match explodes each distinct probe over the prefix lengths that occur in the
routing table (33 + 129 at most), masks it and joins by equality; the longest hit
is kept by ``max_by``. Only short prefixes can hold very many probes, so keys up to
a family's ``SHORT`` length are salted on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefixledger.functions import address as A
from prefixledger.functions import labels as L
from prefixledger.operators.intervals import PREFIX, at_lengths, collapse
from prefixledger.session import dealt

SALTS = 16
#: Rows of the name table (one per ASN) up to which it is broadcast.
BROADCAST_NAMES = 500_000
#: Rows of a table of routes beyond which it is never broadcast, however small its files are estimated to be.
BROADCAST_ROUTES = 100_000


def _short(family: Column) -> Column:
    return F.when(family == 4, 16).otherwise(32)


def longest_match(probes: DataFrame, routes: DataFrame, payload: list[str], on: tuple[str, ...] = (), *, ordinal: str | None = None, rows: int = 0) -> DataFrame:
    """Distinct probes that hit a route: ``on, PREFIX, r_plen, r_hi, r_lo`` and the route's ``payload``.

    ``routes`` holds one row per (on, prefix), or with ``ordinal`` any number, of which the least ordinal wins (a row
    without one comes last): only rows that a probe hits are compared. ``rows`` is their number where it is known to
    be large. A probe is looked up by its first
    address, so a hit may be longer than the probe itself.
    """
    on = list(on)
    keys = [*on, *PREFIX]
    probes = probes.filter(F.col("family").isNotNull()).select(*keys).distinct()
    lengths = routes.groupBy("family").agg(F.collect_set("plen").alias("lengths"))
    spread = at_lengths(probes, lengths, keep=keys).withColumn(
        "salt",
        F.when(F.col("c_plen") <= _short(F.col("family")), F.pmod(F.xxhash64("hi", "lo"), F.lit(SALTS))).otherwise(0).cast("int"),
    )
    copies = F.when(
        F.col("plen") <= _short(F.col("family")), F.sequence(F.lit(0), F.lit(SALTS - 1))
    ).otherwise(F.array(F.lit(0)))
    table = routes.select(
        *on, "family", F.col("plen").alias("c_plen"), F.col("hi").alias("c_hi"), F.col("lo").alias("c_lo"),
        F.struct(*payload).alias("payload"), *([F.coalesce(-F.col(ordinal).cast("bigint"), F.lit(-(2**63))).alias("_rank")] if ordinal else []),
        F.explode(copies).alias("salt"),
    )
    place = [*on, "family", "c_plen", "c_hi", "c_lo", "salt"]
    table = dealt(table, rows, *place)
    # A feed of many days is estimated by the rows it was made from, so the planner would broadcast all of its days.
    hits = spread.join(table.hint("merge") if rows > BROADCAST_ROUTES else table, place)
    order = F.struct("c_plen", "_rank") if ordinal else F.col("c_plen")
    best = hits.groupBy(*keys).agg(F.max_by(F.struct("c_plen", "c_hi", "c_lo", "payload"), order).alias("b"))
    return best.select(
        *keys,
        F.col("b.c_plen").alias("r_plen"),
        F.col("b.c_hi").alias("r_hi"),
        F.col("b.c_lo").alias("r_lo"),
        *[F.col(f"b.payload.{p}").alias(p) for p in payload],
    )


def route_table(routes: DataFrame) -> DataFrame:
    """One row per announced prefix from ``PREFIX, asn`` (+ ``strict_ok``); a repeated prefix keeps its lowest ASN."""
    ok = F.col("strict_ok") if "strict_ok" in routes.columns else F.lit(True)
    return (
        routes.filter(F.col("family").isNotNull())
        .groupBy(*PREFIX)
        .agg(F.min("asn").alias("asn"), F.min(ok).alias("strict_ok"))
    )


def attribute(catalogue: DataFrame, routes: DataFrame) -> DataFrame:
    """Add ``outcome``, ``asn``, ``route`` of the covering route to every catalogue row.

    ``matched``, ``unrouted``, ``lookup_failure`` (the route has no ASN or no valid
    prefix) or ``containment_failure`` (a more specific route starts at the network
    address: no shorter one is tried). Malformed rows have a NULL outcome.
    """
    hits = longest_match(catalogue, route_table(routes), ["asn", "strict_ok"])
    outcome = (
        F.when(F.col("r_plen").isNull(), "unrouted")
        .when(F.col("asn").isNull() | ~F.col("strict_ok"), "lookup_failure")
        .when(F.col("r_plen") > F.col("plen"), "containment_failure")
        .otherwise("matched")
    )
    matched = F.col("outcome") == "matched"
    hits = hits.withColumnRenamed("asn", "r_asn")
    # malformed rows have no prefix and match nothing: a number of their own spreads them over the tasks of the join
    spread = catalogue.withColumn("_spread", F.coalesce(F.col("hi"), F.xxhash64(F.monotonically_increasing_id())))
    held = hits.select(*[F.col(c).alias(f"_h_{c}") for c in PREFIX], F.col("hi").alias("_h_spread"), *[c for c in hits.columns if c not in PREFIX])
    same = [F.col(c) == F.col(f"_h_{c}") for c in PREFIX]
    joined = spread.join(held, [F.col("_spread") == F.col("_h_spread"), *same], "left").withColumn("asn", F.col("r_asn"))
    return joined.withColumn("outcome", F.when(F.col("family").isNotNull(), outcome)).select(
        *catalogue.columns,
        "outcome",
        F.when(matched, F.col("asn")).alias("asn"),
        F.when(matched, A.cidr_text("family", "r_plen", "r_hi", "r_lo")).alias("route"),
    )


def with_operator(attributed: DataFrame, as_names: DataFrame, *, broadcast_names: int = BROADCAST_NAMES) -> DataFrame:
    """Add ``as_name`` and ``operator`` from ``asn, as_name``; rows without a match get a bracketed label.

    Few ASNs hold most rows, so no row is shuffled by its ASN while the names are counted to be at most
    ``broadcast_names``. Beyond that rows without an ASN are spread by a number of their own.
    """
    label = (
        F.when(F.col("outcome") == "matched", L.operator_class(F.col("as_name")))
        .when(F.col("outcome") == "unrouted", L.UNROUTED)
        .when(F.col("outcome") == "lookup_failure", L.LOOKUP_FAILURE)
        .when(F.col("outcome") == "containment_failure", L.CONTAINMENT_FAILURE)
    )
    if as_names.limit(broadcast_names + 1).count() <= broadcast_names:
        return attributed.join(F.broadcast(as_names), "asn", "left").withColumn("operator", label)
    spread = attributed.withColumn("_spread", F.when(F.col("asn").isNotNull(), F.xxhash64("asn")).otherwise(F.xxhash64(F.monotonically_increasing_id())))
    held = as_names.withColumnRenamed("asn", "_h_asn").withColumn("_h_spread", F.xxhash64("_h_asn"))
    joined = spread.join(held, [F.col("_spread") == F.col("_h_spread"), F.col("asn") == F.col("_h_asn")], "left")
    return joined.drop("_spread", "_h_asn", "_h_spread").withColumn("operator", label)


def strict_attribution(attributed: DataFrame) -> DataFrame:
    """The audit's rule: a failed lookup or containment is an error, not a bucket."""
    failed = F.col("outcome").isin("lookup_failure", "containment_failure")
    message = F.concat(F.lit("route lookup failed: "), A.cidr_text())
    return attributed.withColumn(
        "outcome", F.when(failed, F.raise_error(message).cast("string")).otherwise(F.col("outcome"))
    )


def attribution_quality(attributed: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """Input-quality counters and ASN coverage in percent of the valid rows."""
    count = lambda o: F.count_if(F.col("outcome") == o)
    return attributed.groupBy(*on).agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("outcome").isNull()).alias("malformed"),
        count("matched").alias("matched"),
        count("unrouted").alias("unrouted"),
        count("lookup_failure").alias("lookup_failures"),
        count("containment_failure").alias("containment_failures"),
        F.round(count("matched") / F.nullif(F.count("outcome"), F.lit(0)) * 100, 6).alias("coverage_percent"),
    )


def operator_mix(attributed: DataFrame, on: tuple[str, ...] = (), *, collapsed: bool = False) -> DataFrame:
    """Prefixes (or collapsed blocks) per operator and family with the share of the total."""
    on = list(on)
    rows = attributed.filter(F.col("operator").isNotNull())
    if collapsed:
        counted = collapse(rows, [*on, "operator"])
    else:
        counted = rows.groupBy(*on, "operator", "family").agg(F.count("*").alias("blocks"))
    family = lambda f: F.coalesce(F.sum(F.when(F.col("family") == f, F.col("blocks"))), F.lit(0)).alias(f"ipv{f}")
    table = counted.groupBy(*on, "operator").agg(family(4), family(6)).withColumn("total", F.col("ipv4") + F.col("ipv6"))
    return _with_share(table, on)


def _with_share(table: DataFrame, on: list[str]) -> DataFrame:
    """Share of the group's total; the totals are joined back, never windowed over one group."""
    if on:
        totals = table.groupBy(*on).agg(F.sum("total").alias("whole"))
        joined = table.join(totals, on)
    else:
        joined = table.withColumn("whole", table.agg(F.sum("total")).scalar())
    return joined.withColumn("share_percent", L.percent_text(F.col("total"), F.col("whole"))).drop("whole")


def operator_report(mix: DataFrame, top: int) -> DataFrame:
    """Named operators first, then the ``top`` others by total, then one remainder row.

    ``mix`` is one row per organisation. The top is found by a limit sort, so no
    task holds the whole tail.
    """
    named = mix.filter(F.col("operator").isin(L.NAMED_OPERATORS))
    spark = mix.sparkSession
    fixed = spark.createDataFrame([(n, i) for i, n in enumerate(L.NAMED_OPERATORS)], "operator string, position int")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    cols = ["ipv4", "ipv6", "total"]
    first = fixed.join(named, "operator", "left").select(
        F.lit(1).alias("section"), "position", "operator", *[zero(c) for c in cols]
    )
    others = mix.filter(~F.col("operator").isin(L.NAMED_OPERATORS))
    head = others.orderBy(F.desc("total"), "operator").limit(top)
    rank = F.row_number().over(Window.orderBy(F.desc("total"), "operator"))
    second = head.select(F.lit(2).alias("section"), (rank - 1).alias("position"), "operator", *cols)
    rest = others.join(head.select("operator"), "operator", "left_anti").agg(
        F.count("*").alias("n"), *[F.sum(c).cast("bigint").alias(c) for c in cols]
    )
    third = rest.filter("n > 0").select(
        F.lit(3).alias("section"), F.lit(0).alias("position"),
        F.concat(F.lit("... ("), F.col("n").cast("string"), F.lit(" more)")).alias("operator"), *cols,
    )
    return first.unionByName(second).unionByName(third)


def operator_series(attributed: DataFrame) -> DataFrame:
    """Raw and collapsed blocks per date and operator; prefixes are disjoint and at most /64 (strict scan)."""
    keys = ["snapshot_date", "operator"]
    raw = operator_mix(attributed, ("snapshot_date",)).withColumnsRenamed(
        {"ipv4": "ipv4_prefixes", "ipv6": "ipv6_prefixes", "total": "total_prefixes"}
    )
    blocks = collapse(attributed, keys, disjoint=True, longest=64)
    family = lambda f: F.coalesce(F.sum(F.when(F.col("family") == f, F.col("blocks"))), F.lit(0)).alias(
        f"collapsed_ipv{f}_blocks"
    )
    wide = blocks.groupBy(*keys).agg(family(4), family(6))
    return raw.join(wide, keys).withColumn(
        "collapsed_total_blocks", F.col("collapsed_ipv4_blocks") + F.col("collapsed_ipv6_blocks")
    )


def _distinct_routes(attributed: DataFrame, keys: list[str]) -> DataFrame:
    # Two exact steps instead of count(distinct): a popular route is combined before the shuffle.
    distinct = attributed.groupBy(*keys, "family", "route").agg(F.count("*").alias("rows"))
    family = lambda f: F.count_if(F.col("route").isNotNull() & (F.col("family") == f))
    return distinct.groupBy(*keys).agg(
        family(4).alias("ipv4_routes"), family(6).alias("ipv6_routes"), F.sum("rows").alias("egress_rows")
    ).withColumn("total_routes", F.col("ipv4_routes") + F.col("ipv6_routes"))


def route_series(attributed: DataFrame) -> DataFrame:
    """Distinct covering routes per date and operator."""
    rows = attributed.filter(F.col("operator").isNotNull())
    return _distinct_routes(rows, ["snapshot_date", "operator"]).select(
        "snapshot_date", "operator",
        F.col("ipv4_routes").alias("ipv4_bgp_prefixes"),
        F.col("ipv6_routes").alias("ipv6_bgp_prefixes"),
        F.col("total_routes").alias("total_bgp_prefixes"),
    )


def route_comparison(attributed: DataFrame, routes: DataFrame) -> DataFrame:
    """Per operator: routes in use, catalogue rows, announced footprint of its ASNs, used percent."""
    rows = attributed.filter(F.col("operator").isNotNull())
    used = _distinct_routes(rows, ["operator"])
    seen = rows.filter(F.col("asn").isNotNull()).select("operator", "asn").distinct()
    announced = route_table(routes).groupBy("asn").agg(F.count("*").alias("n"))
    footprint = seen.join(announced, "asn").groupBy("operator").agg(F.sum("n").alias("footprint"))
    return used.join(footprint, "operator", "left").select(
        "operator", "ipv4_routes", "ipv6_routes", "total_routes", "egress_rows",
        F.coalesce("footprint", F.lit(0)).alias("footprint"),
        L.percent_text(F.col("total_routes"), F.coalesce("footprint", F.lit(0)), 1).alias("used_percent"),
    )


def asn_breakdown(attributed: DataFrame) -> DataFrame:
    """Routes in use and rows per origin ASN."""
    rows = attributed.filter(F.col("asn").isNotNull())
    return _distinct_routes(rows, ["asn", "operator", "as_name"])


def per_asn_share(attributed: DataFrame) -> DataFrame:
    """Share of all valid rows per ASN label; unmatched outcomes keep their bracketed label."""
    rows = attributed.filter(F.col("outcome").isNotNull())
    label = F.when(F.col("outcome") == "matched", L.asn_label(F.col("asn"), F.col("as_name"))).otherwise(F.col("operator"))
    table = rows.groupBy(label.alias("label")).agg(F.count("*").alias("total"))
    return _with_share(table, []).withColumnsRenamed({"total": "subnets"})


def snapshot_report(attributed: DataFrame, country: str) -> DataFrame:
    """Country share, total, and IPv4 subnets per IPv4 route (NULL without a route) in one row."""
    code = L.selected_country(country)
    valid = attributed.filter(F.col("outcome").isNotNull())
    v4 = F.col("family") == 4
    by_route = valid.groupBy("family", "route").agg(
        F.count("*").alias("n"),
        F.count_if(F.upper(F.trim("country")) == code).alias("selected"),
    )
    return by_route.agg(
        F.sum("selected").alias("selected_subnets"),
        F.sum("n").alias("total_subnets"),
        F.coalesce(F.sum(F.when(v4, F.col("n"))), F.lit(0)).alias("ipv4_subnets"),
        F.count_if(v4 & F.col("route").isNotNull()).alias("ipv4_routes"),
    ).select(
        "*",
        L.percent_text(F.col("selected_subnets"), F.col("total_subnets"), 2).alias("selected_percent"),
        F.round(F.col("ipv4_subnets") / F.nullif(F.col("ipv4_routes"), F.lit(0)), 6).alias("ipv4_ratio"),
    )


def match_first(probes: DataFrame, feed: DataFrame, fields: list[str], on: tuple[str, ...] = ()) -> DataFrame:
    """Longest match of addresses in a feed; among rows of one prefix the first by ``_ordinal`` wins."""
    return longest_match(probes, feed.filter(F.col("family").isNotNull()), fields, tuple(on), ordinal="_ordinal", rows=feed.count())


def match_unique(probes: DataFrame, table: DataFrame, fields: list[str], on: tuple[str, ...] = ()) -> DataFrame:
    """Longest match where the rows of the longest prefix must agree on ``fields`` (as text; NULL is the empty text); else no match.

    Rows agree on a field if its least value is its greatest and none or all are NULL, so numbers are compared as
    numbers in a hash aggregation and only the text columns of a table need a sort.
    """
    on = list(on)
    texts = {f.name for f in table.schema if f.dataType.typeName() == "string"}
    value = lambda f: F.coalesce(F.col(f), F.lit("")) if f in texts else F.col(f)
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"{f}_lo").eqNullSafe(F.col(f"{f}_hi")) & F.col(f"{f}_n").isin(0, F.col("n"))
    agreed = (
        table.filter(F.col("family").isNotNull())
        .groupBy(*on, *PREFIX)
        .agg(F.count("*").alias("n"), *[a for f in fields for a in (F.min(value(f)).alias(f"{f}_lo"), F.max(value(f)).alias(f"{f}_hi"), F.count(value(f)).alias(f"{f}_n"))])
        .select(*on, *PREFIX, same.alias("agree"), *[F.coalesce(F.col(f"{f}_lo").cast("string"), F.lit("")).alias(f) for f in fields])
    )
    return longest_match(probes, agreed, ["agree", *fields], tuple(on)).filter("agree").drop("agree")


def route_origin(evidence: DataFrame, probes: DataFrame) -> DataFrame:
    """Origin of each address in nested route evidence ``on, target_prefix, path ARRAY``.

    All paths of the longest matching prefix must end in one scalar origin.
    """
    table = A.with_prefix(evidence.withColumn("origin", F.try_element_at("path", F.lit(-1))), "target_prefix")
    return match_unique(probes, table, ["origin"], ("observed_at",))
