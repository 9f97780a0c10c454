"""Data-quality rules: each returns one row per violation as ``rule, key, detail``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixledger.functions import address as A
from prefixledger.operators.intervals import PREFIX, overlaps


class QualityError(ValueError):
    """A strict entry point found violations."""


def violations(df: DataFrame, rule: str, condition: Column, key: Column, detail: Column | None = None) -> DataFrame:
    return df.filter(F.coalesce(condition, F.lit(False))).select(
        F.lit(rule).alias("rule"), key.cast("string").alias("key"),
        (detail if detail is not None else F.lit("")).cast("string").alias("detail"),
    )


def require_clean(found: DataFrame, shown: int = 5) -> None:
    """Raise when there is any violation; a handful is shown, the rest stay in the frame."""
    rows = found.limit(shown).collect()
    if rows:
        raise QualityError("; ".join(f"{r.rule}: {r.key} {r.detail}".strip() for r in rows))


def _repeated(df: DataFrame, rule: str, keys: list[str], key: Column) -> DataFrame:
    counted = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return violations(counted, rule, F.col("n") > 1, key, F.concat(F.col("n").cast("string"), F.lit(" rows")))


def _cidr() -> Column:
    return A.cidr_text()


def catalogue_violations(catalogue: DataFrame) -> DataFrame:
    """Strict catalogue rules: five fields with an empty fifth, well-formed, unique, at most /64, disjoint.

    ``catalogue`` comes from the strict scan: ``snapshot_date, cidr, PREFIX`` and ``bad_shape``.
    """
    where = F.concat_ws(" ", F.col("snapshot_date").cast("string"), F.coalesce("cidr", F.lit("")))
    dated = lambda text: F.concat_ws(" ", F.col("snapshot_date").cast("string"), text)
    valid = catalogue.filter(F.col("family").isNotNull() & ~F.col("bad_shape"))
    found = [
        violations(catalogue, "row_shape", F.col("bad_shape"), where),
        violations(catalogue, "malformed_cidr", F.col("family").isNull() & ~F.col("bad_shape"), where),
        _repeated(valid, "duplicate_cidr", ["snapshot_date", *PREFIX], dated(_cidr())),
        violations(valid, "ipv6_longer_than_64", (F.col("family") == 6) & (F.col("plen") > 64), dated(_cidr())),
        violations(
            overlaps(valid, ["snapshot_date"]), "overlap", F.lit(True), dated(_cidr()),
            A.cidr_text("family", "c_plen", "c_hi", "c_lo"),
        ),
    ]
    return reduce(DataFrame.unionByName, found)


def source_list_violations(lines: DataFrame) -> DataFrame:
    """Source-block list: IPv4 /24, global, strictly increasing.

    ``lines``: ``position, prefix, PREFIX`` (strict parse). Order is checked against
    the nearest earlier line, found with an equality on line number over the
    numbered non-blank lines.
    """
    start = A.v4_from_half(F.col("hi"))
    is24 = F.coalesce((F.col("family") == 4) & (F.col("plen") == 24), F.lit(False))
    key = F.concat_ws(":", F.col("position").cast("string"), "prefix")
    mine = lines.select("position", "prefix", start.alias("start"))
    before = lines.select((F.col("position") + 1).alias("position"), start.alias("previous"))
    order = mine.join(before, "position")
    return reduce(DataFrame.unionByName, [
        violations(lines, "malformed_prefix", F.col("family").isNull(), key),
        violations(lines, "not_ipv4_24", F.col("family").isNotNull() & ~is24, key),
        violations(lines, "not_global", is24 & ~A.is_global_v4(start, F.lit(24)), key),
        violations(order, "not_increasing", F.col("start") <= F.col("previous"), key),
    ])


def churn_series_violations(series: DataFrame) -> DataFrame:
    """Stored churn series: families, interval against dates, counts, one interval per end, unique rows."""
    key = F.concat_ws(" ", "family", F.col("date_to").cast("string"))
    negative = (F.col("added_pfx") < 0) | (F.col("removed_pfx") < 0) | (F.col("reassign_count") < 0)
    missing = F.lit(False)
    for c in ("date_from", "date_to", "interval_days", "added_pfx", "removed_pfx", "reassign_count"):
        missing = missing | F.col(c).isNull()
    ends = series.groupBy("date_to").agg(F.min(F.struct("date_from", "interval_days")).alias("a"), F.max(F.struct("date_from", "interval_days")).alias("b"))
    return reduce(DataFrame.unionByName, [
        violations(series, "invalid_value", missing, key),
        violations(series, "invalid_family", ~F.coalesce(F.col("family").isin("v4", "v6"), F.lit(False)), key),
        violations(series, "invalid_interval", (F.col("interval_days") <= 0) | (F.datediff("date_to", "date_from") != F.col("interval_days")), key),
        violations(series, "negative_count", negative, key),
        violations(ends, "inconsistent_interval", F.col("a") != F.col("b"), F.col("date_to")),
        _repeated(series, "duplicate_row", ["family", "date_to"], key),
    ])


def _asn(text: Column) -> Column:
    number = F.trim(text.cast("string")).try_cast("bigint")
    return F.when(number.between(1, 4294967295), number)


def origin_violations(rows: DataFrame) -> DataFrame:
    """Dated origins: date, prefix and ASN valid, source given, 64-hex hash, unique (date, prefix, asn).

    ``rows``: text columns ``date, prefix, asn, source, source_hash`` and the parsed ``PREFIX``.
    """
    key = F.concat_ws(" ", "date", "prefix", "asn")
    good_date = F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$") & F.col("date").try_cast("date").isNotNull()
    valid = rows.filter(F.col("family").isNotNull()).withColumn("asn_number", _asn(F.col("asn")))
    return reduce(DataFrame.unionByName, [
        violations(rows, "invalid_date", ~F.coalesce(good_date, F.lit(False)), key),
        violations(rows, "invalid_prefix", F.col("family").isNull(), key),
        violations(rows, "invalid_asn", _asn(F.col("asn")).isNull(), key),
        violations(rows, "missing_source", F.trim(F.coalesce("source", F.lit(""))) == "", key),
        violations(rows, "invalid_source_hash", ~F.coalesce(F.lower(F.trim("source_hash")).rlike("^[0-9a-f]{64}$"), F.lit(False)), key),
        _repeated(valid, "duplicate_row", ["date", *PREFIX, "asn_number"], F.concat_ws(" ", F.col("date"), _cidr(), F.col("asn_number").cast("string"))),
    ])


def operator_map_violations(rows: DataFrame, *, version: str, required: dict[int, str], siblings: list[int]) -> DataFrame:
    """Operator map: ASN range and uniqueness, one version, filled fields, required ids, siblings sharing one id of their own."""
    spark = rows.sparkSession
    rows = rows.withColumn("number", _asn(F.col("asn")))
    empty = F.lit(False)
    for c in ("operator_id", "operator_name", "mapping_rule"):
        empty = empty | (F.trim(F.coalesce(F.col(c), F.lit(""))) == "")
    must = spark.createDataFrame([(a, o) for a, o in required.items()], "number bigint, want string")
    sib = spark.createDataFrame([(a,) for a in siblings], "number bigint")
    need = must.join(rows.select("number", "operator_id"), "number", "left")
    group = sib.join(rows.select("number", "operator_id"), "number", "left")
    ids = group.agg(F.count_distinct("operator_id").alias("n"), F.min("operator_id").alias("id"))
    return reduce(DataFrame.unionByName, [
        violations(rows, "invalid_asn", F.col("number").isNull(), F.col("asn")),
        _repeated(rows.filter("number is not null"), "duplicate_asn", ["number"], F.col("number")),
        violations(rows, "wrong_version", ~F.coalesce(F.col("version") == version, F.lit(False)), F.col("asn")),
        violations(rows, "empty_field", empty, F.col("asn")),
        violations(need, "required_mapping", ~F.coalesce(F.col("operator_id") == F.col("want"), F.lit(False)), F.col("number")),
        violations(group, "missing_sibling", F.col("operator_id").isNull(), F.col("number")),
        violations(ids, "siblings_differ", F.col("n") > 1, F.lit("siblings")),
        violations(ids.join(must.select("want"), F.col("id") == F.col("want")), "sibling_shares_required_id", F.lit(True), F.col("id")),
    ])


def feed_violations(feed: DataFrame, files: DataFrame) -> DataFrame:
    """Feeds: a prefix with differing labels on one day; days that do not have exactly one file (``date, files``)."""
    label = F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in ("country", "region", "city")])
    per = feed.filter("family is not null").groupBy("date", *PREFIX).agg(F.min(label).alias("a"), F.max(label).alias("b"))
    return violations(per, "conflicting_prefix", F.col("a") != F.col("b"), F.concat_ws(" ", F.col("date").cast("string"), _cidr())).unionByName(
        violations(files, "not_one_feed", F.col("files") != 1, F.col("date"), F.col("files"))
    )


def feed_day_facts(feed: DataFrame, files: DataFrame) -> DataFrame:
    """``date, files, conflict`` for the pairing from a feed frame and its file counts per day."""
    label = F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in ("country", "region", "city")])
    per = feed.groupBy("date", *PREFIX).agg(F.min(label).alias("a"), F.max(label).alias("b"))
    bad = per.groupBy("date").agg(F.bool_or((F.col("a") != F.col("b")) | F.col("family").isNull()).alias("conflict"))
    return files.join(bad, "date", "left").withColumn("conflict", F.coalesce("conflict", F.lit(False)))


def log_violations(tagged: DataFrame) -> DataFrame:
    """Tagged log rows that fail the schema or identity checks."""
    return violations(tagged, "log_row_schema", F.col("is_bad"), F.concat_ws(":", "artifact", F.col("line_number").cast("string")), F.col("run_id"))


def attempt_violations(records: DataFrame) -> DataFrame:
    """Metadata and response problems of decided or selected records, one row per message."""
    long = records.select("attempt_path", F.explode(F.concat("metadata_problems", "response_problems")).alias("m"))
    return violations(long, "attempt", F.lit(True), F.col("attempt_path"), F.col("m"))


def date_mismatches(spark, snapshot_path: str, artifacts: dict[str, str]) -> DataFrame:
    """Artifacts whose dated file name differs from the snapshot's date; undated names are not compared."""
    from prefixledger.sources.catalogue import inferred_date

    rows = [(label, path, snapshot_path) for label, path in artifacts.items()]
    df = spark.createDataFrame(rows, "label string, path string, snapshot string")
    a, b = inferred_date(F.col("path")), inferred_date(F.col("snapshot"))
    return violations(df, "date_mismatch", a != b, F.col("label"), F.concat_ws(" ", b, a))


