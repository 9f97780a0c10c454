"""Address tables projected from the driver's star schema.

The test tables hold no prefixes, so each domain table is a deterministic
projection of one of them and grows with it. The same projections are written in
SQL in ``oracle_queries.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixledger.functions import address as A
from prefixledger.functions import values as V
from prefixledger.session import cut_lineage

DAYS = ["2026-01-01", "2026-01-02", "2026-01-04"]
V4_BASE = 167772160
V6_BASE = 0x20010DB8 << 32
FIRST_ASN = 64500
# Customers below WIDE_SLOTS own 2,048 IPv4 addresses each; later ones own 8 above them, where the same layout has
# prefixes 8 bits longer. The address space ends after V4_SLOTS customers; from there on there is IPv6 only.
WIDE_SLOTS = 2**20
NARROW_BASE = V4_BASE + WIDE_SLOTS * 2048
V4_SLOTS = WIDE_SLOTS + (2**32 - NARROW_BASE) // 8


def variants() -> list[tuple[int, int, int, int, str]]:
    """``(day, case, offset, length, city suffix)``: what customer ``b`` with ``b % 10 = case`` publishes."""
    quarters = [0, 256, 512, 768]
    out = []
    for case in range(10):
        plain = [(0, 22, "")]
        day1 = {
            0: [],
            1: [(q, 24, "") for q in quarters],
            2: [(0, 22, " 2")],
            3: [(0, 23, "")],
            4: [(0, 22, ""), (1024, 24, "")],
            5: [(q, 24, " 3" if q == 512 else "") for q in quarters],
        }.get(case, plain)
        day2 = {1: plain, 2: [(0, 22, " 4")]}.get(case, day1)
        for day, entries in enumerate((plain, day1, day2)):
            out += [(day, case, *e) for e in entries]
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a scan that one task widens into domain rows.
ROWS_A_TASK = 20_000
#: Attempts of one task: they stay together by path through the joins of the evidence.
ATTEMPTS_A_TASK = 50_000


def spread(rows: DataFrame, key: str, most: int) -> DataFrame:
    """A table dealt by ``key`` over a number of tasks that follows its rows: a file of one row group is one task else."""
    tasks = -(-rows.count() // most)
    return rows.repartition(tasks, key) if tasks > 1 else rows


#: Rows of one partition of an exchange, and about how many rows the widest step makes from one of each table.
EXCHANGE_ROWS = 50_000
WIDENED = {"customer": 8, "events": 1, "orders": 1, "supplier": 2}


def exchange_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Partitions into which the largest derived table is dealt, ``EXCHANGE_ROWS`` each."""
    present = [name for name in WIDENED if _exists(spark, f"{sf_dir}/{name}.parquet")]
    return max([-(-table(spark, sf_dir, name).count() * WIDENED[name] // EXCHANGE_ROWS) for name in present], default=1)


def _exists(spark: SparkSession, name: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _labelled_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return (
        spread(table(spark, sf_dir, "customer"), "c_custkey", ROWS_A_TASK)
        # The customers may be estimated as small as the nations: these are what is broadcast.
        .join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("c_custkey").alias("b"),
            F.when(F.col("c_custkey") % 97 == 0, "").otherwise(F.substring("r_name", 1, 2)).alias("country"),
            F.col("n_name").alias("region"),
            F.col("c_mktsegment").alias("segment"),
        )
    )


def _v4_address(slot: Column, offset: Column) -> Column:
    """Address at ``offset`` of a slot's 2,048; narrow slots hold one address for each 256 of them."""
    narrow = F.lit(NARROW_BASE) + (slot - WIDE_SLOTS) * 8 + F.shiftright(offset, 8)
    return F.when(slot < WIDE_SLOTS, F.lit(V4_BASE) + slot * 2048 + offset).otherwise(narrow)


def _v4_cidr(offset: Column, plen: Column) -> Column:
    length = F.when(F.col("b") < WIDE_SLOTS, plen).otherwise(plen + 8)
    return F.concat(A.v4_text(_v4_address(F.col("b"), offset)), F.lit("/"), length.cast("string"))


def _v6_cidr(offset: Column, plen: Column) -> Column:
    low = F.col("b") * 8 + F.shiftright(offset, 8)
    group = lambda v: F.lower(F.hex(v.bitwiseAND(65535)))
    return F.concat(
        F.lit("2001:0db8:"), group(F.shiftright(low, 16)), F.lit(":"), group(low), F.lit("::/"),
        (plen + 40).cast("string"),
    )


def _both_families(rows: DataFrame, keep: list[str]) -> DataFrame:
    """One text row per family from ``b, off, len``."""
    texts = F.array(
        F.when(F.col("b") < V4_SLOTS, _v4_cidr(F.col("off"), F.col("len"))),
        _v6_cidr(F.col("off"), F.col("len")),
    )
    return rows.select(*keep, F.explode(F.filter(texts, lambda t: t.isNotNull())).alias("cidr"))


def catalogue_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three dated snapshots as ``snapshot_date, cidr, country, region, city``."""
    shape = spark.createDataFrame(variants(), "day int, case int, off bigint, len int, suffix string")
    rows = _labelled_customers(spark, sf_dir).join(F.broadcast(shape), F.col("b") % 10 == F.col("case")).select(
        F.get(F.array(*[F.to_date(F.lit(d)) for d in DAYS]), F.col("day")).alias("snapshot_date"),
        "b", "off", "len", "country", "region",
        F.concat("segment", "suffix").alias("city"),
    )
    return _both_families(rows, ["snapshot_date", "country", "region", "city"])


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = A.with_prefix(catalogue_text(spark, sf_dir), "cidr")
    return parsed.withColumn("canonical", A.cidr_text())


def lenient_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first snapshot with malformed rows, repeated rows and prefixes nested in others."""
    extra = F.concat(
        F.array(F.struct(F.lit(0).cast("bigint").alias("off"), F.lit(22).alias("len"))),
        F.when(F.col("b") % 40 == 39, F.array(F.struct(F.lit(0).cast("bigint").alias("off"), F.lit(22).alias("len"))))
        .otherwise(F.array()),
        F.when(F.col("b") % 30 == 29, F.array(F.struct(F.lit(256).cast("bigint").alias("off"), F.lit(24).alias("len"))))
        .otherwise(F.array()),
    )
    rows = (
        _labelled_customers(spark, sf_dir)
        .withColumn("city", F.col("segment"))
        .select("b", "country", "region", "city", F.inline(extra))
    )
    good = _both_families(rows, ["b", "country", "region", "city"])
    bad = F.col("b") % 50 == 49
    text = good.withColumn("cidr", F.when(bad, F.concat(F.lit("x"), "cidr")).otherwise(F.col("cidr")))
    parsed = A.with_prefix(text.withColumnRenamed("b", "_ordinal"), "cidr")
    return parsed.withColumn("canonical", A.cidr_text())


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Announced prefixes ``PREFIX, asn``: one /16 (or /56) per 32 slots, a few /23 (or /63) inside, every eleventh absent."""
    suppliers = table(spark, sf_dir, "supplier").agg(F.count("*")).scalar()
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("b"), suppliers.alias("suppliers"))
    block = F.floor(F.col("b") / 32).cast("bigint")
    wide = (
        customers.select(block.alias("i"), "suppliers").distinct()
        .filter(F.col("i") % 11 != 10)
        .select((F.col("i") * 32).alias("b"), F.lit(0).cast("bigint").alias("off"), F.lit(16).alias("len"),
                (F.lit(FIRST_ASN) + F.col("i") % F.col("suppliers")).alias("asn"))
    )
    narrow = customers.filter(F.col("b") % 64 == 7).select(
        "b", F.lit(0).cast("bigint").alias("off"), F.lit(23).alias("len"),
        (F.lit(FIRST_ASN) + F.col("b") % F.col("suppliers")).alias("asn"),
    )
    return A.with_prefix(_both_families(wide.unionByName(narrow), ["asn"]), "cidr")


def as_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    org = (
        F.when(key % 4 == 0, F.lit("Akamai International"))
        .when(key % 4 == 1, F.lit("Cloudflare, Inc."))
        .when(key % 4 == 2, F.lit("Fastly"))
        .otherwise(F.col("s_name"))
    )
    return (
        table(spark, sf_dir, "supplier")
        .filter(key % 9 != 8)
        .select(
            (F.lit(FIRST_ASN) + key).alias("asn"),
            F.concat(F.lit("NET"), key.cast("string"), F.lit(" - "), org, F.lit(", US")).alias("as_name"),
        )
    )


# Attempts, log rows and packets: one attempt per row of ``events``. The case number
# ``event_id % 12`` says which piece of evidence is broken (see ``CASES``).
HOST = "probe.example.net"
PRIVATE = "10.0.0.5"
PIN = "198.51.100.7"
CASES = {2: "no log row", 3: "second flow", 4: "stale flow", 5: "other ingress", 6: "real address", 7: "not in feed",
         8: "clock", 9: "condition changed", 10: "two rows without uuid", 11: "no origin"}


def _attempt_base(spark: SparkSession, sf_dir: str, *, together: bool = True) -> DataFrame:
    """Attempts; not ``together`` where they are only aggregated, so that they need not be dealt by their paths."""
    customers = table(spark, sf_dir, "customer").agg(F.count("*")).scalar()
    e = F.col("event_id")
    case = (e % 12).cast("int")
    slot = F.col("user_id") % F.least(F.col("n"), F.lit(V4_SLOTS))
    offset = F.when(case == 7, 1500).otherwise(e % 1024)
    udp = F.floor(e / 12) % 2 == 0
    shifted = lambda s: F.timestamp_micros(F.unix_micros("ts") + int(s * 1000000))
    iso = lambda s: V.utc_text(shifted(s))
    # Dealt by the path that the evidence of an attempt is joined and grouped by, so these steps need no exchange of their own.
    paths = table(spark, sf_dir, "events").withColumn("attempt_path", F.concat(F.lit("day/"), e.cast("string")))
    events = (spread(paths, "attempt_path", ATTEMPTS_A_TASK) if together else paths).withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withColumn("n", customers).select(
        e.alias("e"), case.alias("case"), "ts", "user_id", "event_type",
        F.concat(F.lit("r"), e.cast("string")).alias("run_id"),
        "attempt_path",
        F.when(udp, "udp").otherwise("tcp").alias("transport"),
        F.when(udp, "HTTP/3.0").otherwise("HTTP/2.0").alias("proto"),
        A.v4_text(_v4_address(slot, offset)).alias("remote_ip"),
        (F.lit(1024) + e % 60000).cast("int").alias("remote_port"),
        (F.unix_micros("ts") / 1000000).alias("epoch"),
        F.when(F.floor(e / 24) % 2 == 0, "unpinned").otherwise("pinned").alias("grp"),
        iso(0).alias("t0"), iso(2).alias("t2"), iso(10).alias("t10"), iso(12).alias("t12"), iso(92).alias("t92"), iso(5).alias("t5"),
        F.to_date(shifted(5)).alias("day"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pinned = F.col("grp") == "pinned"
    text = lambda v: F.lit(v)
    return _attempt_base(spark, sf_dir).select(
        "attempt_path", "run_id", text("c1").alias("campaign"), text("live").alias("run_mode"),
        F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("session"),
        F.concat(F.lit("slot"), F.col("e").cast("string")).alias("slot_id"),
        F.concat(F.lit("b"), (F.col("user_id") % 5).cast("string")).alias("block_id"),
        F.lit(1).alias("attempt_number"), F.col("t0").alias("client_start_utc"), F.col("t2").alias("safari_launch_requested_utc"),
        F.col("t92").alias("timeout_deadline_utc"),
        F.when(F.col("case") == 8, "drifting").otherwise("synchronized").alias("clock_status"),
        F.struct(F.lit("Network Time: On").alias("network_time")).alias("clock_evidence"),
        text("on").alias("private_relay_state"),
        F.when(F.col("e") % 3 == 0, "maintain_general_location").otherwise("country_and_time_zone").alias("location_setting"),
        F.when(pinned, "pinned_group").otherwise("unpinned").alias("intended_ingress_group"),
        F.when(pinned, PIN).alias("intended_ingress_ip"),
        F.array(F.lit(PIN), F.lit("198.51.100.8")).alias("approved_ingress_candidates"),
        F.array(F.lit(PIN)).alias("approved_pin_group_addresses"),
        F.struct(F.create_map(F.lit("mask.example.net"), F.struct(F.array(
            F.struct(F.lit(PIN).alias("address")), F.struct(F.lit("198.51.100.8").alias("address"))).alias("A"))).alias("hostnames")).alias("effective_dns"),
        text("port 443").alias("capture_filter"), text("none").alias("quic_block_state"), text(HOST).alias("hostname"),
        text("https://probe.example.net/").alias("url"), text("15").alias("macos_version"), text("18").alias("safari_version"),
        text("en0").alias("active_interface"), text("wifi").alias("network_type"),
        F.when(F.col("case") == 6, F.col("remote_ip")).otherwise("203.0.113.9").alias("real_public_ipv4"),
        F.when(F.col("e") % 5 == 0, "quit_browser").otherwise("new_window").alias("freshness_method"),
        text(BOUNDED_POLICY).alias("ingress_attribution_policy"), text("ok").alias("operator_condition_confirmation"),
    )


BOUNDED_POLICY = "bounded_candidate_contact_v2"


def attempt_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = lambda name, at, outcome=None, changed=None, end=None: F.struct(
        F.lit(name).alias("event"), F.col(at).alias("recorded_utc"), F.lit(outcome).cast("string").alias("outcome"),
        (changed if changed is not None else F.lit(None)).cast("boolean").alias("condition_changed"),
        F.lit(end).cast("string").alias("end_condition_confirmation"),
    )
    rows = F.array(
        row("run_started", "t0"), row("safari_url_launch_requested", "t2"), row("capture_stopped", "t10"),
        row("run_finished", "t12", "success", F.col("case") == 9, "same"),
    )
    return _attempt_base(spark, sf_dir).select("attempt_path", F.inline(rows))


def log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _attempt_base(spark, sf_dir).filter(F.col("case") != 2)
    copies = F.when(F.col("case").isin(3, 10), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return base.withColumn("copy", F.explode(copies)).select(
        "run_id", F.concat_ws("-", F.lit("u"), F.col("e").cast("string"), F.col("copy").cast("string")).alias("request_uuid"),
        (F.col("epoch") + 5 + F.col("copy") * 0.5).alias("ts"), F.lit(200).alias("status"), "remote_ip",
        (F.col("remote_port") + F.when(F.col("case") == 3, F.col("copy")).otherwise(0)).alias("remote_port"),
        "proto", F.lit("GET").alias("method"), F.lit(HOST + ":443").alias("host"), F.concat(F.lit("/probe/"), "run_id").alias("uri"),
        F.lit("log/a.jsonl").alias("artifact"), F.col("e").alias("line_number"),
        F.sha2(F.concat_ws("-", F.col("e").cast("string"), F.col("copy").cast("string")), 256).alias("row_sha256"),
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attempt_base(spark, sf_dir).select(
        "attempt_path", "run_id", F.col("t5").alias("server_utc"), F.round((F.col("epoch") + 5) * 1000).cast("bigint").alias("server_unix_ms"),
        F.when(F.col("case") != 10, F.concat_ws("-", F.lit("u"), F.col("e").cast("string"), F.lit("0"))).alias("request_uuid"),
        "remote_ip", F.col("remote_port").cast("string").alias("remote_port"), F.col("proto").alias("http_protocol"),
        F.lit(HOST).alias("request_host"), F.concat(F.lit("/probe/"), "run_id").alias("request_uri"),
    )


def _packet(at: Column, src: Column, sport: Column, dst: Column) -> list[Column]:
    tcp = F.col("transport") == "tcp"
    return [
        F.lit(1).alias("frame_number"), at.alias("time_epoch"), src.alias("src_ip"), dst.alias("dst_ip"), F.col("transport"),
        sport.alias("src_port"), F.lit(443).alias("dst_port"), tcp.alias("tcp_syn"), F.lit(False).alias("tcp_ack"),
        F.when(tcp, F.col("e")).alias("tcp_seq_raw"), F.lit(0).alias("tcp_len"), F.when(tcp, 0).otherwise(1200).alias("udp_length"),
        F.lit(None).cast("string").alias("stream"), (~tcp).alias("quic_initial"), F.when(~tcp, F.concat(F.lit("d"), F.col("e").cast("string"))).alias("quic_dcid"),
        F.lit("p.jsonl").alias("artifact"), F.lit("00").alias("artifact_sha256"),
    ]


def server_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("epoch") + F.when(F.col("case") == 4, -30).otherwise(4)
    return _attempt_base(spark, sf_dir).select(*_packet(at, F.col("remote_ip"), F.col("remote_port"), F.lit(PRIVATE)))


def client_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Case 5 reaches no candidate when unpinned and the wrong one when pinned.
    dst = F.when((F.col("case") == 5) & (F.col("grp") == "pinned"), "198.51.100.8").when(F.col("case") == 5, "198.51.100.99").otherwise(PIN)
    return _attempt_base(spark, sf_dir).select("attempt_path", *_packet(F.col("epoch") + 3, F.lit("192.168.1.2"), F.col("remote_port"), dst))


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first snapshot's IPv4 rows as the feed of every day on which an attempt was served."""
    served = _attempt_base(spark, sf_dir, together=False)
    first, last = served.agg(F.min("day")).scalar(), served.agg(F.max("day")).scalar()
    rows = catalogue(spark, sf_dir).filter((F.col("family") == 4) & (F.col("snapshot_date") == DAYS[0])).select(
        *A.PREFIX, F.col("canonical").alias("ip_prefix"), "country", "region", "city", F.lit(0).alias("_ordinal")
    )
    # A feed per day is what a feed archive holds; the rows are parsed once for all days.
    return cut_lineage(rows).withColumn("date", F.explode(F.sequence(first, last)))


def feed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attempt_base(spark, sf_dir, together=False).select(F.col("day").alias("date")).distinct().select(
        "date", F.lit(1).alias("files"), F.lit(False).alias("conflict"), F.sha2(F.col("date").cast("string"), 256).alias("feed_sha256")
    )


def origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated origins: the pin's and each served address of the attempts that are not case 11."""
    base = lambda together: _attempt_base(spark, sf_dir, together=together).filter("case <> 11")
    served = base(True).select(
        F.col("day").alias("date"), F.concat("remote_ip", F.lit("/32")).alias("prefix"), (F.lit(FIRST_ASN) + F.col("user_id") % 4).alias("asn")
    )
    pins = base(False).select(F.col("day").alias("date")).distinct().select("date", F.lit("198.51.100.0/24").alias("prefix"), F.lit(FIRST_ASN).cast("bigint").alias("asn"))
    return A.with_prefix(served.unionByName(pins).distinct(), "prefix")


def operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        (F.lit(FIRST_ASN) + F.col("s_suppkey")).alias("asn"), F.concat(F.lit("op"), (F.col("s_suppkey") % 2).cast("string")).alias("operator_id")
    )


def announced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Announced IPv4 prefixes from ``orders``: scattered networks of /16 to /24, some inside others."""
    key = F.col("o_orderkey")
    plen = F.when(key % 400 == 0, 16).otherwise(20 + key % 5).cast("int")
    network = F.pmod(key * 2654435761, F.lit(1 << 32))
    text = F.concat(A.v4_text(network), F.lit("/"), plen.cast("string"))
    return A.with_prefix(table(spark, sf_dir, "orders").select(text.alias("prefix")), "prefix")


def scan_outcomes(blocks: DataFrame) -> DataFrame:
    """Outcomes of a scan over /24 blocks: a few answers cover a /20, some fail, some are still to come."""
    b = F.col("block")
    return blocks.filter(b % 31 != 0).select(
        "block", (b % 13 != 0).alias("ok"), F.when(b % 17 == 0, 20).when(b % 3 == 0, 24).cast("int").alias("scope"),
        F.when(b % 13 == 0, 3).otherwise(1).alias("attempts"), F.when(b % 13 == 0, 3).otherwise(0).alias("errors"),
    )


def scan_results(blocks: DataFrame) -> DataFrame:
    return blocks.filter((F.col("block") % 31 != 0) & (F.col("block") % 13 != 0)).select(
        "block", F.when(F.col("block") % 5 != 0, A.v4_text(F.lit(3221225984) + F.col("block") % 250)).alias("answer_ip")
    )


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolver transcripts from ``orders``: up to two answers, some without a scope or with another status."""
    key = F.col("o_orderkey")
    answer = lambda n: F.concat(F.lit("mask.example.net. 60 IN A 192.0.2."), ((key + n) % 250).cast("string"))
    text = F.concat_ws(
        "\n",
        F.concat(F.lit(";; ->>HEADER<<- opcode: QUERY, status: "), F.when(key % 11 == 0, "SERVFAIL").otherwise("NOERROR"), F.lit(", id: 1")),
        F.when(key % 5 != 0, F.concat(F.lit("; CLIENT-SUBNET: 198.51.100.0/24/"), (key % 26).cast("string"))),
        F.lit(";; ANSWER SECTION:"),
        F.when(key % 3 != 0, answer(0)), F.when(key % 3 == 2, answer(1)),
        F.lit("mask.example.net. 60 IN AAAA 2001:db8::1"),
    )
    return table(spark, sf_dir, "orders").select(key.alias("id"), text.alias("output"))


def document_manifest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A manifest over the texts of ``documents`` and the stored files, some missing, unlisted or altered."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id"), F.concat(F.lit("archive/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), "text"
    )
    manifest = docs.filter(F.col("doc_id") % 23 != 5).select(
        "path", F.octet_length("text").cast("bigint").alias("bytes"), F.upper(F.sha2("text", 256)).alias("sha256")
    )
    changed = F.when(F.col("doc_id") % 19 == 4, F.concat("text", F.lit("!"))).when(F.col("doc_id") % 29 == 6, F.reverse(F.lower("text"))).otherwise(F.col("text"))
    files = docs.filter(F.col("doc_id") % 17 != 3).select("path", F.octet_length(changed).cast("bigint").alias("bytes"), F.sha2(changed, 256).alias("sha256"))
    return manifest, files


def log_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines in two rotated files; every third line is repeated in the second file."""
    rows = log_rows(spark, sf_dir)
    line = F.to_json(F.struct(
        "ts", "status", "run_id", "request_uuid",
        F.struct("remote_ip", F.col("remote_port").cast("string").alias("remote_port"), "proto", "method", "host", "uri").alias("request"),
    ))
    copies = F.when(F.col("line_number") % 3 == 0, F.array(F.lit("log/b.jsonl"), F.lit("log/a.jsonl"))).otherwise(F.array(F.lit("log/b.jsonl")))
    return rows.select(line.alias("value"), F.explode(copies).alias("artifact"), "line_number")


def packet_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoder-style text columns from ``events``."""
    base = _attempt_base(spark, sf_dir)
    tcp = F.col("transport") == "tcp"
    text = lambda c: c.cast("string")
    return base.select(
        "attempt_path", text(F.col("e")).alias("frame.number"), text(F.col("e") * 0.5).alias("frame.time_epoch"),
        F.when(F.col("e") % 2 == 0, F.col("remote_ip")).otherwise("").alias("ip.src"), F.lit("2001:db8::1").alias("ipv6.src"), F.lit("").alias("dst_ip"), F.lit(PRIVATE).alias("ip.dst"),
        F.when(tcp, F.concat(F.lit("0x"), F.lower(F.hex("remote_port")))).alias("tcp.srcport"), F.when(tcp, "443").alias("tcp.dstport"),
        F.when(~tcp, F.concat(text(F.col("remote_port")), F.lit(".0"))).alias("udp.srcport"), F.when(~tcp, "443").alias("udp.dstport"),
        F.when(tcp, "True").otherwise("").alias("tcp.flags.syn"), F.lit("0").alias("tcp.flags.ack"),
        F.when(~tcp, text(F.col("e") % 3)).alias("quic.long.packet_type"), F.when(tcp, text(F.col("e"))).otherwise("").alias("tcp.len"),
    )


# Diagnostic trials: one per row of ``events``; ``event_id % 10`` says what is wrong.
ANCHOR, LABEL = "example/diagnostic", "udp-block"
ORIGIN = "203.0.113.80"


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _attempt_base(spark, sf_dir)
    at = lambda s: F.timestamp_micros(((F.col("epoch") + s) * 1000000).cast("bigint"))
    kase = F.col("e") % 10
    return base.select(
        "e", "attempt_path", "run_id", F.concat(F.lit("slot"), F.floor(F.col("e") / 2).cast("string")).alias("slot_id"), (F.col("e") % 2 + 1).cast("int").alias("retry_number"),
        F.col("e").alias("_ordinal"),
        F.when(F.floor(F.col("e") / 10) % 2 == 0, "udp_permitted").otherwise("udp_blocked").alias("condition"),
        F.when(kase == 1, F.col("remote_ip")).otherwise("203.0.113.9").alias("real_public_ipv4"),
        F.lit(ORIGIN).alias("origin_ip"), F.lit(PIN).alias("intended_ip"), at(2).alias("t_from"), at(10).alias("t_to"),
        (F.col("epoch") + 2).alias("w_from"), (F.col("epoch") + 8).alias("w_to"),
        F.when(kase == 9, "mechanical_failure").when(kase == 8, "timeout").otherwise("success").alias("outcome"),
        (kase == 7).alias("condition_changed"), (kase != 6).alias("cleanup_valid"), F.lit(False).alias("deadline_missed"),
        F.when(kase == 5, F.array(F.lit("missing metadata fields"))).otherwise(F.array().cast("array<string>")).alias("integrity_errors"),
    )


def trial_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Client packets: a start to the pin, for TCP a full handshake, and for ``event_id % 10 = 2`` a direct origin contact."""
    base = _attempt_base(spark, sf_dir)
    tcp = F.floor(F.col("e") / 20) % 2 == 0
    pkt = lambda dt, out, syn, ack, frame, dst=None: F.struct(
        F.lit(frame).alias("frame_number"), (F.col("epoch") + dt).alias("time_epoch"),
        (F.lit("192.168.1.2") if out else F.lit(PIN)).alias("src_ip"), (F.lit(dst or PIN) if out else F.lit("192.168.1.2")).alias("dst_ip"),
        F.when(tcp, "tcp").otherwise("udp").alias("transport"), (F.lit(50000) if out else F.lit(443)).alias("src_port"), (F.lit(443) if out else F.lit(50000)).alias("dst_port"),
        (tcp & F.lit(syn)).alias("tcp_syn"), (tcp & F.lit(ack)).alias("tcp_ack"), (~tcp & F.lit(syn)).alias("quic_initial"), F.when(~tcp, "d").alias("quic_dcid"),
    )
    packets = F.array(pkt(3.0, True, True, False, 1), pkt(3.25, False, True, True, 2), pkt(3.5, True, False, True, 3))
    direct = F.when(F.col("e") % 10 == 2, F.array(pkt(1.0, True, False, True, 4, ORIGIN))).otherwise(F.array())
    return base.select("attempt_path", F.inline(F.concat(packets, direct)))


def trial_firewall(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trials(spark, sf_dir)
    blocked = F.col("condition") == "udp_blocked"
    rule = F.concat(F.lit("block drop out quick on en0 inet proto udp from any to "), "intended_ip", F.lit(f' port = 443 label "{LABEL}"'))
    iso = lambda s: V.utc_text(F.timestamp_micros(F.unix_micros("t_from") + s * 1000000))
    names = ["prepared_utc", "rule_load_started_utc", "rule_load_completed_utc", "statistics_after_load_utc", "targeted_state_reset_utc",
             "statistics_before_cleanup_utc", "restored_utc"]
    return t.select(
        "attempt_path", "condition", F.col("condition").alias("evidence_condition"), F.lit("en0").alias("interface"), "intended_ip", F.lit(ANCHOR).alias("anchor"),
        F.when(blocked, rule).otherwise("").alias("exact_rule"), F.when(blocked, rule).otherwise("").alias("loaded_rules"), F.lit("").alias("previous_rules"),
        blocked.alias("rule_loaded"), F.when(blocked, 2).cast("bigint").alias("counter_before"),
        F.when(blocked, F.when(F.col("e") % 30 == 13, 1).otherwise(2 + F.col("e") % 3)).cast("bigint").alias("counter_after"), *[iso(i - 5).alias(n) for i, n in enumerate(names)],
    )


def route_evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Route evidence at two times for addresses of ``supplier``, and the planned addresses."""
    key = F.col("s_suppkey")
    base = table(spark, sf_dir, "supplier").withColumn("net", F.lit(V4_BASE) + key * 65536)
    route = lambda text, asn: F.struct(text.alias("target_prefix"), F.array(F.lit("65001"), asn.cast("string")).alias("path"))
    wide = F.concat(A.v4_text(F.col("net")), F.lit("/16"))
    narrow = F.concat(A.v4_text(F.col("net")), F.lit("/24"))
    own = F.lit(FIRST_ASN) + key
    long = base.select("s_suppkey", "net", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    routes_ = F.concat(
        F.array(route(F.concat(A.v4_text(F.lit(V4_BASE)), F.lit("/8")), F.lit(64000))),
        F.when(key % 7 != 3, F.array(route(wide, own))).otherwise(F.array()),
        F.when(key % 5 == 1, F.array(route(narrow, own + 1))).otherwise(F.array()),
        F.when(key % 9 == 2, F.array(route(wide, own + 2))).otherwise(F.array()),
        F.when((key % 11 == 4) & (F.col("k") == 1), F.array(route(F.concat(A.v4_text(F.col("net")), F.lit("/20")), own))).otherwise(F.array()),
    )
    evidence = long.select(
        F.to_date(F.lit("2026-01-05")).alias("date"), F.concat(F.lit("2026-01-05T0"), F.col("k").cast("string"), F.lit(":00")).alias("observed_at"),
        F.lit("ok").alias("status"), F.inline(routes_),
    )
    planned = base.select(F.to_date(F.lit("2026-01-05")).alias("date"), A.v4_text(F.col("net") + 9).alias("address"))
    return evidence, planned


def plan_attempts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Attempts of a plan from ``supplier`` (a schedule-sized table): one slot each, with planted violations."""
    key = F.col("s_suppkey")
    base = table(spark, sf_dir, "supplier")
    slots = base.select(F.concat(F.lit("slot"), key.cast("string")).alias("slot_id"), key.alias("position"))
    tries = F.when(key % 10 == 3, F.array(F.lit(1), F.lit(2))).when(key % 10 == 5, F.array(F.lit(1), F.lit(1))).when(key % 10 == 7, F.array(F.lit(2))).otherwise(F.array(F.lit(1)))
    attempts_ = base.select("s_suppkey", F.explode(tries).alias("retry_number")).select(
        F.when(key % 25 == 24, "ghost").otherwise(F.concat(F.lit("slot"), key.cast("string"))).alias("slot_id"), "retry_number",
        F.when((key % 20 == 3) & (F.col("retry_number") == 1), "timeout").otherwise("success").alias("outcome"),
        F.when(key % 33 == 32, "other").otherwise("plan").alias("execution_plan_sha256"),
        (F.when(key % 40 == 11, key + 10).otherwise(key) * 10 + F.col("retry_number")).alias("started_at"),
    )
    return attempts_, slots


def numbered_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source-block list of a line per customer with all its faults: malformed, /25, private, descending and repeated lines."""
    k = F.col("c_custkey")
    public = F.lit(V4_BASE + 2**24) + (k + F.when(k % 31 == 0, -2).otherwise(0)) % 65536 * 256
    net = F.when(k % 29 == 0, F.lit(V4_BASE) + k % 65536 * 256).otherwise(public)
    text = F.when(k % 23 == 0, F.concat(F.lit("x"), k.cast("string"))).otherwise(
        F.concat(A.v4_text(net), F.when(k % 37 == 0, "/25").otherwise("/24")))
    return A.with_prefix(table(spark, sf_dir, "customer").select(k.alias("position"), text.alias("prefix")), "prefix")


def stored_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a stored churn series, one per order: an end date per customer key, with every kind of fault."""
    k = F.col("o_orderkey")
    start = F.date_add(F.lit("2026-01-01").cast("date"), F.floor(k / 2).cast("int") * 4 % 2900000)
    days = F.when(k % 41 == 0, -1).otherwise(F.when(k % 43 == 0, 3).otherwise(2))
    return table(spark, sf_dir, "orders").select(
        F.when(k % 47 == 0, "v5").when(k % 2 == 0, "v4").otherwise(F.when(k % 53 == 0, "v4").otherwise("v6")).alias("family"),
        start.alias("date_from"), F.date_add(start, 2).alias("date_to"), days.alias("interval_days"),
        F.when(k % 59 == 0, F.lit(None)).otherwise(k).cast("bigint").alias("added_pfx"), F.when(k % 61 == 0, -k).otherwise(k).alias("removed_pfx"),
        F.lit(0).cast("bigint").alias("reassign_count"),
    )


def slot_results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Results of retried slots (a row per order, a slot per customer of it) and the planned slots (all customers)."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    condition = lambda key: F.when(key % 2 == 0, "udp_permitted").otherwise("udp_blocked")
    results = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("s"), c.cast("string")).alias("slot_id"), (k % 5).alias("retry_number"), k.alias("_ordinal"),
        F.when(k % 7 == 0, condition(c + 1)).otherwise(condition(c)).alias("condition"),
        F.when(k % 3 == 0, "accepted").otherwise("excluded").alias("acceptance"), F.concat(F.lit("class"), (k % 4).cast("string")).alias("classification"),
        (k % 2 == 0).alias("response_evidence_preserved"),
    )
    key = F.col("c_custkey")
    return results, table(spark, sf_dir, "customer").select(F.concat(F.lit("s"), key.cast("string")).alias("slot_id"), condition(key).alias("condition"))


def host_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of host names, one per event: shared addresses, other record types, malformed addresses."""
    e = F.col("event_id")
    address = F.concat(F.lit("192.0."), (e % 199).cast("string"), F.lit("."), (F.col("user_id") % 300).cast("string"))
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("q"), (e % 17).cast("string")).alias("query_name"), F.concat(F.lit("n"), (F.col("user_id") % 13).cast("string")).alias("name"),
        F.when(e % 9 == 0, "AAAA").otherwise("A").alias("type"), address.alias("value"),
    )


def counter_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule listings and evidence cells, one per event."""
    e, n = F.col("event_id"), (F.col("event_id") % 1000).cast("string")
    listing = (
        F.when(e % 5 == 0, F.concat(F.lit("[ Evaluations: 7  Packets: "), n, F.lit("  Bytes: 9 ]")))
        .when(e % 5 == 1, F.concat(F.lit('{"rule": {"packets": '), n, F.lit("}}")))
        .when(e % 5 == 2, F.concat(F.lit("packets="), n, F.lit(" packets="), n, F.lit(" packets=5000")))
        .when(e % 5 == 3, F.lit("no counter")))
    cell = F.when(e % 4 == 0, F.concat(F.lit("["), n, F.lit("]"))).when(e % 4 == 1, F.lit("{ }")).when(e % 4 == 2, F.concat(F.lit("{\"a\": "), n, F.lit("}")))
    return table(spark, sf_dir, "events").select("event_id", listing.alias("listing"), cell.alias("cell"))
