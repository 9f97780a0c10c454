"""Catalogue snapshots, routing tables, AS names, feeds and churn series as typed DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixledger.functions import address as A

FIELDS = ["cidr", "country", "region", "city", "extra"]
_SCHEMA = ", ".join(f"{c} string" for c in FIELDS)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def inferred_date(path: Column) -> Column:
    """``YYYY-MM-DD`` from a dated file name (``20YY-MM-DD``, ``_`` or compact), else NULL."""
    shape = r"(?<!\d)(20\d{2})[-_]?(\d{2})[-_]?(\d{2})(?!\d)"
    name = file_name(path)
    part = lambda g: F.regexp_extract(name, shape, g)
    return F.when(part(1) != "", F.concat_ws("-", part(1), part(2), part(3)))


def snapshot_date(path: Column) -> Column:
    """Date of an ``egress-YYYY-MM-DD.csv`` file; NULL for other names."""
    return F.regexp_extract(file_name(path), r"^egress-(\d{4}-\d{2}-\d{2})\.csv$", 1).try_cast("date")


def ordinal() -> Column:
    """Scan order of a row: file, block within the file, row within the task."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def scan_lenient(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue rows with trimmed labels; blank rows are dropped, absent labels are empty, host bits masked."""
    df = spark.read.schema(_SCHEMA).option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    text = lambda c: F.coalesce(F.trim(F.col(c)), F.lit(""))
    df = df.select(
        snapshot_date(F.col("_metadata.file_path")).alias("snapshot_date"), *[text(c).alias(c) for c in FIELDS[:4]], ordinal().alias("_ordinal")
    ).filter(F.col("cidr") != "")
    parsed = A.with_prefix(df, "cidr")
    return parsed.withColumn("canonical", A.cidr_text())


def scan_strict(spark: SparkSession, path: str) -> DataFrame:
    """Like :func:`scan_lenient` but keeps blank rows and marks ``bad_shape``: not five fields, or a fifth that is not empty.

    Lines are parsed one by one, so the field count of each is known; run
    ``quality.catalogue_violations`` on the result before using it.
    """
    lines = spark.read.text(path)
    shape = f"{_SCHEMA}, malformed string"
    parsed = F.from_csv(F.col("value"), F.lit(shape), {"escape": '"', "columnNameOfCorruptRecord": "malformed"})
    df = lines.select(snapshot_date(F.col("_metadata.file_path")).alias("snapshot_date"), F.col("value"), parsed.alias("p"), ordinal().alias("_ordinal"))
    text = lambda c: F.coalesce(F.trim(F.col(f"p.{c}")), F.lit(""))
    bad = (F.trim("value") == "") | F.col("p").isNull() | F.col("p.malformed").isNotNull() | (F.coalesce("p.extra", F.lit("")) != "")
    df = df.select("snapshot_date", *[text(c).alias(c) for c in FIELDS[:4]], bad.alias("bad_shape"), "_ordinal")
    parsed = A.with_prefix(df, "cidr")
    return parsed.withColumn("canonical", A.cidr_text())


def scan_snapshots(spark: SparkSession, folder: str, *, strict: bool = False) -> DataFrame:
    """Every dated snapshot of a folder; at least two dates are needed."""
    scan = scan_strict if strict else scan_lenient
    df = scan(spark, f"{folder.rstrip('/')}/egress-*.csv").filter(F.col("snapshot_date").isNotNull())
    # Names only: a snapshot is one file, so this lists files and reads no row.
    files = spark.read.format("binaryFile").load(f"{folder.rstrip('/')}/egress-*.csv").select(snapshot_date(F.col("path")).alias("d"))
    if len(files.filter("d is not null").distinct().limit(2).collect()) < 2:
        raise ValueError(f"need at least two dated snapshots in {folder}")
    return df


def scan_routes(spark: SparkSession, path: str) -> DataFrame:
    """Routing table of tab-separated ``prefix, asn`` lines; ``;`` starts a comment. ``strict_ok``: no host bits set."""
    df = spark.read.schema("prefix string, asn string").option("sep", "\t").option("comment", ";").csv(path)
    parsed = A.with_prefix(df.filter(F.trim("prefix") != ""), "prefix")
    same = F.trim(F.col("prefix")) == A.cidr_text()
    return parsed.select("prefix", F.trim("asn").try_cast("bigint").alias("asn"), *A.PREFIX, F.coalesce(same | F.col("prefix").contains(":"), F.lit(False)).alias("strict_ok"))


def scan_as_names(spark: SparkSession, path: str) -> DataFrame:
    """``asn, as_name`` from one JSON object of ``"asn": "name"`` pairs."""
    doc = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("asn", "as_name"))
    return doc.select(F.col("asn").try_cast("bigint").alias("asn"), "as_name")


def scan_announced(spark: SparkSession, path: str) -> DataFrame:
    """Announced prefixes from whitespace text ``network length ...`` (gzip by suffix); short lines are skipped.

    A malformed prefix keeps NULL columns, for a strict caller to reject.
    """
    fields = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f")).filter(F.size("f") >= 2)
    return A.with_prefix(fields.select(F.concat_ws("/", F.get("f", F.lit(0)), F.get("f", F.lit(1))).alias("prefix")), "prefix")


def scan_source_list(spark: SparkSession, path: str) -> DataFrame:
    """``position, prefix, PREFIX`` of a source-block list without comments, strictly parsed.

    Lines are numbered within their file block; the blocks' sizes, one row each, give the offsets.
    """
    from pyspark.sql import Window

    lines = spark.read.text(path).select(ordinal().alias("o"), F.trim(F.split_part("value", F.lit("#"), F.lit(1))).alias("prefix")).filter("prefix <> ''")
    block = ["o.file", "o.block"]
    local = lines.select("prefix", *block, F.row_number().over(Window.partitionBy(*block).orderBy("o.row")).alias("n"))
    sizes = lines.groupBy(*block).agg(F.count("*").alias("lines"))
    before = F.sum("lines").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("file", "block", F.coalesce(before, F.lit(0)).alias("offset"))
    numbered = local.join(offsets, ["file", "block"]).select("prefix", (F.col("offset") + F.col("n")).alias("position"))
    return A.with_prefix(numbered, "prefix", strict=True)


def scan_results(spark: SparkSession, path: str) -> DataFrame:
    """Enumeration results with typed columns; an answerless reply has a NULL answer."""
    schema = "query_utc string, ecs_prefix string, returned_scope string, answer_ip string"
    df = spark.read.schema(schema).option("header", "true").csv(path)
    return df.select(
        F.col("query_utc").try_cast("timestamp").alias("query_utc"), "ecs_prefix", F.col("returned_scope").try_cast("int").alias("returned_scope"),
        F.nullif(F.trim("answer_ip"), F.lit("")).alias("answer_ip"),
    )


def scan_feed(spark: SparkSession, path: str) -> DataFrame:
    """Location feeds, with or without a header line naming the four fields.

    ``file, date, ip_prefix, country, region, city, PREFIX, bad_shape, _ordinal``. The first
    non-blank line of each file decides; one line per file is joined back. Rows of a
    headerless file need four fields and no text after them. Lines may have any number of cells;
    quoted cells may hold commas and doubled quotes.
    """
    names = ["ip_prefix", "country", "region", "city"]
    line = F.concat(F.lit(","), F.regexp_replace("value", "^﻿", ""))
    cells = F.regexp_extract_all(line, F.lit(r',("(?:[^"]|"")*"[^,]*|[^,]*)'), F.lit(1))
    plain = lambda c: F.when(c.startswith('"'), F.replace(F.regexp_replace(c, r'^"|"[^"]*$', ""), F.lit('""'), F.lit('"'))).otherwise(c)
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.transform(cells, plain).alias("cells"), ordinal().alias("_ordinal"))
    lines = lines.withColumn("n", F.size("cells"))
    lines = lines.filter(F.exists("cells", lambda c: F.trim(c) != ""))
    head = lines.groupBy("file").agg(F.min("_ordinal").alias("first"), F.min_by(F.transform("cells", lambda c: F.lower(F.trim(c))), "_ordinal").alias("head"))
    is_header = F.forall(F.array(*[F.lit(n) for n in names]), lambda n: F.array_contains("head", n))
    df = lines.join(head.withColumn("has_header", is_header), "file").filter(~F.col("has_header") | (F.col("_ordinal") != F.col("first")))
    at = lambda n, i: F.coalesce(F.when(F.col("has_header"), F.get("cells", F.array_position("head", n).cast("int") - 1)).otherwise(F.get("cells", F.lit(i))), F.lit(""))
    trailing = F.exists(F.slice("cells", 5, F.greatest(F.size("cells"), F.lit(0))), lambda c: F.trim(c) != "")
    rows = df.select(
        "file", inferred_date(F.col("file")).try_cast("date").alias("date"), *[at(n, i).alias(n) for i, n in enumerate(names)],
        (~F.col("has_header") & ((F.col("n") < 4) | trailing)).alias("bad_shape"), "_ordinal",
    )
    return A.with_prefix(rows, "ip_prefix")


def scan_origins(spark: SparkSession, path: str) -> DataFrame:
    """Dated origin rows as text with parsed prefix; validate with ``quality.origin_violations``."""
    schema = "date string, prefix string, asn string, source string, source_hash string"
    return A.with_prefix(spark.read.schema(schema).option("header", "true").csv(path), "prefix")


def scan_operator_map(spark: SparkSession, path: str) -> DataFrame:
    schema = "asn string, operator_id string, operator_name string, mapping_rule string, version string"
    return spark.read.schema(schema).option("header", "true").csv(path)


def scan_churn_series(spark: SparkSession, path: str) -> DataFrame:
    """Stored churn series; unreadable values are NULL for ``quality.churn_series_violations``."""
    text = ["date_from", "date_to", "interval_days", "family", "added_pfx", "removed_pfx", "added_addrs", "removed_addrs",
            "reassigned_addrs", "reassign_count", "fake_churn_pfx"]
    wide = {"added_addrs", "removed_addrs", "reassigned_addrs"}
    kind = lambda c: "date" if c.startswith("date") else "int" if c == "interval_days" else "decimal(38,0)" if c in wide else "bigint"
    df = spark.read.schema(", ".join(f"{c} string" for c in text)).option("header", "true").csv(path)
    return df.select(*[F.col(c) if c == "family" else F.col(c).try_cast(kind(c)).alias(c) for c in text])
