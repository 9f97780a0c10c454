"""Access logs, packets, attempt documents, query logs, manifests and route evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prefixledger.functions import values as V
from prefixledger.operators.manifests import file_hashes
from prefixledger.session import cut_lineage

# Fields of a server access-log line.
LOG_SCHEMA = (
    "ts double, status int, run_id string, request_uuid string, "
    "request struct<remote_ip:string, remote_port:string, proto:string, method:string, host:string, uri:string>"
)
# Decoder column names of a packet export.
DECODED = [
    "frame.number", "frame.time_epoch", "ip.src", "ip.dst", "ipv6.src", "ipv6.dst", "tcp.srcport", "tcp.dstport",
    "tcp.flags.syn", "tcp.flags.ack", "tcp.seq_raw", "tcp.len", "tcp.stream", "udp.srcport", "udp.dstport", "udp.length",
    "udp.stream", "quic.long.packet_type", "quic.dcid", "quic.scid", "quic.version",
]
# Field names of a packet JSON line that have no decoder spelling.
PLAIN = [
    "frame_number", "time_epoch", "src_ip", "dst_ip", "transport", "src_port", "dst_port", "tcp_srcport", "tcp_dstport", "udp_srcport",
    "udp_dstport", "tcp_syn", "tcp_ack", "tcp_seq_raw", "tcp_len", "udp_length", "stream", "quic_initial", "quic_dcid", "quic_scid", "quic_version",
]


def log_lines(lines: DataFrame) -> DataFrame:
    """Flattened log rows from ``value, artifact``: parsed fields, ``row_sha256`` of the line with its newline, ``malformed``."""
    parsed = F.from_json("value", LOG_SCHEMA + ", bad string", {"columnNameOfCorruptRecord": "bad"})
    df = lines.filter(F.trim("value") != "").select("*", F.sha2(F.concat("value", F.lit("\n")), 256).alias("row_sha256"), parsed.alias("j"))
    keep = [c for c in lines.columns if c != "value"]
    return df.select(
        *keep, "row_sha256", F.col("j.bad").isNotNull().alias("malformed"), "j.ts", "j.status", "j.run_id", "j.request_uuid",
        *[F.col(f"j.request.{c}").alias(c) for c in ("remote_ip", "remote_port", "proto", "method", "host", "uri")],
    )


def numbered_lines(spark: SparkSession, path: str, *, glob: str = "*.jsonl*") -> DataFrame:
    """``value, artifact, line_number`` of text files: absolute numbers from 1, as one reader of each file would count.

    A first pass counts the lines of every file split; sums over the splits before it, by their first byte, give each
    split its offset. Only these counts (one row a split) meet the lines again. Blank lines count. Splits depend on
    the session's settings alone, so both passes see the same ones; a compressed file is one split.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    lines = files.select("value", F.col("_metadata.file_path").alias("artifact"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))
    counted = lines.groupBy("artifact", "split").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = Window.partitionBy("artifact").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = cut_lineage(counted.select(F.col("artifact").alias("_a"), F.col("split").alias("_s"), "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lines_before")))
    # a split's lines share its key: the small side is broadcast while its size allows, else adaptive execution splits the join
    found = lines.join(splits, (F.col("artifact") == F.col("_a")) & (F.col("split") == F.col("_s")))
    return found.select("value", "artifact", (F.col("lines_before") + F.col("row") - F.col("first") + 1).alias("line_number"))


def scan_access_log(spark: SparkSession, path: str) -> DataFrame:
    """Access-log rows (JSON lines, gzip by suffix) with absolute ``line_number``, identical lines kept once: the first by path and line.

    The choice is a combinable minimum per line hash, so a line repeated in every
    rotated file is merged before the shuffle.
    """
    named = numbered_lines(spark, path)
    return first_copies(log_lines(named.filter(~F.col("artifact").rlike(r"\.packets\.jsonl(\.gz)?$"))))


def first_copies(rows: DataFrame) -> DataFrame:
    """One row per ``row_sha256``: the first by ``artifact`` and, where lines are numbered, ``line_number``."""
    others = [c for c in rows.columns if c != "row_sha256"]
    place = [c for c in ("artifact", "line_number") if c in rows.columns]
    first = rows.groupBy("row_sha256").agg(F.min_by(F.struct(*others), F.struct(*place)).alias("r"))
    return first.select("row_sha256", "r.*")


def normalize_packets(raw: DataFrame) -> DataFrame:
    """Typed packets from text columns of either spelling (decoder export or plain JSON)."""
    have = set(raw.columns)
    col = lambda c: F.col(f"`{c}`").cast("string") if c in have else F.lit(None).cast("string")
    first = lambda *names: V.first_present(*[col(n) for n in names])
    integer = lambda *names: V.lenient_integer(first(*names))
    tcp_s, tcp_d = integer("tcp_srcport", "tcp.srcport"), integer("tcp_dstport", "tcp.dstport")
    udp_s, udp_d = integer("udp_srcport", "udp.srcport"), integer("udp_dstport", "udp.dstport")
    transport = F.coalesce(
        V.present(col("transport")),
        F.when(tcp_s.isNotNull() | tcp_d.isNotNull(), "tcp").when(udp_s.isNotNull() | udp_d.isNotNull(), "udp"),
    )
    by = lambda tcp, udp, plain: F.when(transport == "tcp", F.coalesce(tcp, integer(plain))).when(transport == "udp", F.coalesce(udp, integer(plain))).otherwise(udp)
    keep = [c for c in ("attempt_path", "artifact", "artifact_sha256") if c in have]
    return raw.select(
        *keep,
        integer("frame_number", "frame.number").alias("frame_number"),
        V.lenient_number(first("time_epoch", "frame.time_epoch")).alias("time_epoch"),
        first("src_ip", "ip.src", "ipv6.src").alias("src_ip"), first("dst_ip", "ip.dst", "ipv6.dst").alias("dst_ip"),
        transport.alias("transport"), by(tcp_s, udp_s, "src_port").cast("int").alias("src_port"), by(tcp_d, udp_d, "dst_port").cast("int").alias("dst_port"),
        V.flag(first("tcp_syn", "tcp.flags.syn")).alias("tcp_syn"), V.flag(first("tcp_ack", "tcp.flags.ack")).alias("tcp_ack"),
        integer("tcp_seq_raw", "tcp.seq_raw").alias("tcp_seq_raw"), F.coalesce(integer("tcp_len", "tcp.len"), F.lit(0)).cast("int").alias("tcp_len"),
        F.coalesce(integer("udp_length", "udp.length"), F.lit(0)).cast("int").alias("udp_length"),
        F.when(transport == "tcp", first("stream", "tcp.stream")).otherwise(first("stream", "udp.stream")).alias("stream"),
        V.quic_initial(col("quic_initial"), col("quic.long.packet_type")).alias("quic_initial"),
        first("quic_dcid", "quic.dcid").alias("quic_dcid"), first("quic_scid", "quic.scid").alias("quic_scid"), first("quic_version", "quic.version").alias("quic_version"),
    )


def _with_hash(spark: SparkSession, packets: DataFrame, path: str) -> DataFrame:
    """Packets with the hash of the file they came from, which tells captures apart whatever they are called."""
    hashes = cut_lineage(file_hashes(spark, path)).select(F.col("path").alias("_path"), F.col("sha256").alias("artifact_sha256"))
    named = packets.withColumn("artifact", F.col("_metadata.file_path"))
    return named.join(hashes, F.regexp_replace("artifact", "^[a-z0-9]+:/+", "/") == F.col("_path"), "left").drop("_path")


def scan_packet_lines(spark: SparkSession, path: str) -> DataFrame:
    """Packets from JSON lines of either spelling."""
    fields = ", ".join(f"`{c}` string" for c in dict.fromkeys([*PLAIN, *DECODED]))
    return normalize_packets(_with_hash(spark, spark.read.schema(fields).json(path), path))


def scan_packet_export(spark: SparkSession, path: str) -> DataFrame:
    """Packets from a tab-separated decoder export with a header line."""
    fields = ", ".join(f"`{c}` string" for c in DECODED)
    df = spark.read.schema(fields).option("sep", "\t").option("header", "true").csv(path)
    return normalize_packets(_with_hash(spark, df, path))


def attempt_path(file: Column) -> Column:
    """Folder of an attempt document."""
    return F.regexp_replace(file, "/[^/]+$", "")


def scan_documents(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """One JSON object per attempt folder, with ``attempt_path`` and ``malformed`` for unreadable ones."""
    reader = spark.read.schema(f"{schema}, _bad string").option("multiLine", "true").option("columnNameOfCorruptRecord", "_bad")
    df = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", name).json(root)
    fields = [c for c in df.columns if c != "_bad"]
    return df.select(attempt_path(F.col("_metadata.file_path")).alias("attempt_path"), *fields, F.col("_bad").isNotNull().alias("malformed"))


def scan_events(spark: SparkSession, root: str) -> DataFrame:
    """Life-cycle events of all attempts (``events.jsonl``)."""
    schema = "event string, recorded_utc string, outcome string, condition_changed boolean, end_condition_confirmation string, url string"
    df = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "events.jsonl").json(root)
    return df.select(attempt_path(F.col("_metadata.file_path")).alias("attempt_path"), *df.columns)


def scan_query_log(spark: SparkSession, root: str) -> DataFrame:
    """DNS query log of all attempts (``dns-queries.jsonl``)."""
    schema = "recorded_utc string, name string, qtype string, supported boolean"
    df = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "dns-queries.jsonl").json(root)
    return df.select(attempt_path(F.col("_metadata.file_path")).alias("attempt_path"), *df.columns)


def scan_manifest_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("path string, bytes bigint, sha256 string").option("header", "true").csv(path)


def scan_manifest_text(spark: SparkSession, path: str) -> DataFrame:
    from prefixledger.operators.manifests import manifest_lines

    return manifest_lines(spark.read.text(path))


def scan_route_evidence(spark: SparkSession, path: str) -> DataFrame:
    """Historical route evidence as one row per route: ``date, observed_at, status, target_prefix, path``."""
    schema = (
        "observation_date_utc string, responses array<struct<requested_timestamp:string, api_response:struct<status:string, "
        "data:struct<bgp_state:array<struct<target_prefix:string, path:array<string>>>>>>>"
    )
    doc = spark.read.schema(schema).option("multiLine", "true").json(path)
    long = doc.select(F.col("observation_date_utc").try_cast("date").alias("date"), F.explode("responses").alias("r"))
    return long.select(
        "date", F.col("r.requested_timestamp").alias("observed_at"), F.col("r.api_response.status").alias("status"),
        F.explode_outer("r.api_response.data.bgp_state").alias("s"),
    ).select("date", "observed_at", "status", "s.target_prefix", "s.path")
