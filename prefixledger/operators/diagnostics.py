"""Diagnostic trials: log pairing, flow and handshake evidence, firewall and gate checks, classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixledger.functions import address as A
from prefixledger.functions import values as V

# Condition names of a trial.
PERMITTED, BLOCKED = "udp_permitted", "udp_blocked"


# Fields of a log row; those that the pairing compares; those that the verdicts read.
LOG_ROW = ["run_id", "request_uuid", "ts", "status", "remote_ip", "remote_port", "proto", "method", "host", "uri", "artifact", "line_number", "row_sha256"]
COMPARED = ["request_uuid", "ts", "status", "remote_ip", "remote_port", "proto", "method", "host"]
ROW_READ = ["ts", "remote_ip", "remote_port", "proto"]


def exact_log_pair(attempts: DataFrame, responses: DataFrame, logs: DataFrame, fields: list[str] = LOG_ROW) -> DataFrame:
    """``attempt_path, row, pairing_errors``: exactly one tagged row (``fields`` of it) that the response confirms.

    Without a response there is no row; that is an error only if tagged rows exist.
    """
    keyed = attempts.select("attempt_path", "run_id")
    tagged = logs.join(keyed, "run_id").filter(F.col("uri") == F.concat(F.lit("/probe/"), F.col("run_id")))
    # A row counts only where it is the only one, so fields that nobody reads need not decide which is the greatest.
    row = F.struct(*[f for f in LOG_ROW if f in fields or f in COMPARED])
    facts = tagged.groupBy("attempt_path").agg(F.count("*").alias("n"), F.max(row).alias("row"))
    answer = responses.select("attempt_path", F.struct(*[c for c in responses.columns if c != "attempt_path"]).alias("r"))
    df = keyed.join(facts, "attempt_path", "left").join(answer, "attempt_path", "left")
    uuid = V.present(F.col("r.request_uuid"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    expected = {"run_id": F.col("run_id"), "remote_ip": F.col("row.remote_ip"), "remote_port": text("row.remote_port"),
                "http_protocol": F.col("row.proto"), "request_uri": F.concat(F.lit("/probe/"), F.col("run_id"))}
    ms = F.col("r.server_unix_ms").cast("double")
    field_errors = V.messages(
        (~F.coalesce(F.col("row.method") == "GET", F.lit(False)), "request method is not GET"),
        (~F.coalesce(F.col("row.status") == 200, F.lit(False)), "response status is not 200"),
        *[(text(f"r.{c}") != F.coalesce(e, F.lit("")), f"response.{c} does not match the log row") for c, e in expected.items()],
        (V.host_without_port(text("r.request_host")) != V.host_without_port(text("row.host")), "response.request_host does not match the log row"),
        (ms.isNull(), "response.server_unix_ms is missing or invalid"),
        (F.abs(ms - F.col("row.ts") * 1000) > 2000, "response time differs from the log row by more than 2 seconds"),
    )
    n = F.coalesce("n", F.lit(0))
    count_error = lambda what, k: F.array(F.concat(F.lit(f"expected one {what} row, found "), k.cast("string")))
    errors = (
        F.when(F.col("r").isNull() & (n == 0), F.array().cast("array<string>"))
        .when(F.col("r").isNull(), F.array(F.concat(F.lit("the response is absent but "), n.cast("string"), F.lit(" tagged log row(s) exist"))))
        .when((F.col("run_id") == "") | uuid.isNull(), F.array(F.lit("missing run_id or response request_uuid")))
        .when(n != 1, count_error("tagged", n))
        .when(~F.coalesce(F.col("row.request_uuid") == uuid, F.lit(False)), count_error("exact", F.lit(0)))
        .otherwise(field_errors)
    )
    out = df.select("attempt_path", errors.alias("pairing_errors"), "row", F.col("r").isNotNull().alias("has_response"))
    ok = F.size("pairing_errors") == 0
    return out.select(
        "attempt_path", "pairing_errors", F.when(ok & F.col("row").isNotNull(), F.struct(*[F.col(f"row.{f}").alias(f) for f in fields])).alias("row"),
        (ok & F.col("has_response")).alias("response_evidence_preserved"),
    )


def server_flow(paired: DataFrame, server_packets: DataFrame, private_ipv4: str) -> DataFrame:
    """Freshness of the paired row's five-tuple: its earliest start lies in the window and not after the log time.

    ``paired`` has ``attempt_path, row, t_from, t_to``. Only captures that start 0 to 2 hours before the
    log time count (a packet without a dated capture counts by its own time), so a port used again
    later is judged by its own captures. The starts of a five-tuple are first reduced to one per capture.
    """
    started = F.unix_timestamp(F.try_to_timestamp(F.regexp_extract(F.col("artifact"), r"_(\d{14})\.(?:pcap|pcapng)", 1), F.lit("yyyyMMddHHmmss")))
    capture = F.coalesce(started.cast("double"), F.floor(F.col("time_epoch") / 60) * 60.0) if "artifact" in server_packets.columns else F.floor(F.col("time_epoch") / 60) * 60.0
    transport = V.transport_of(F.col("row.proto"), exact=True)
    starts = server_packets.filter(
        V.setup_packet(server_side=True) & F.col("time_epoch").isNotNull() & (F.col("dst_ip") == private_ipv4) & (F.col("dst_port") == 443)
    ).groupBy("transport", F.col("src_ip").alias("ip"), F.col("src_port").cast("int").alias("port"), capture.alias("capture")).agg(
        F.min("time_epoch").alias("earliest")
    )
    wanted = paired.filter(F.col("row").isNotNull()).select(
        "attempt_path", transport.alias("transport"), F.col("row.remote_ip").alias("ip"), F.col("row.remote_port").cast("int").alias("port"),
        F.col("row.ts").alias("log_ts"), "t_from", "t_to",
    )
    near = wanted.select("attempt_path", "transport", "ip", "port", "log_ts").join(starts, ["transport", "ip", "port"])
    near = near.filter(F.col("capture").between(F.col("log_ts") - 7200, F.col("log_ts"))).groupBy("attempt_path").agg(F.min("earliest").alias("earliest"))
    seen = wanted.join(near, "attempt_path", "left")
    at, log = V.epoch_timestamp(F.col("earliest")), V.epoch_timestamp(F.col("log_ts"))
    fresh = F.coalesce((F.col("t_from") <= at) & (at <= log) & (log <= F.col("t_to")), F.lit(False))
    kind = F.when(F.col("transport") == "udp", "udp_quic_initial").otherwise("tcp_syn")
    return seen.select("attempt_path", fresh.alias("fresh"), F.when(fresh, kind).otherwise("none").alias("server_transport"), "earliest")


def connection_ids(paired: DataFrame, server_packets: DataFrame, private_ipv4: str) -> DataFrame:
    """Distinct QUIC connection ids seen on the paired five-tuple up to the log time, in long form."""
    wanted = paired.filter(F.col("row.proto") == "HTTP/3.0").select(
        "attempt_path", F.col("row.remote_ip").alias("src_ip"), F.col("row.remote_port").cast("int").alias("src_port"), F.col("row.ts").alias("log_ts")
    )
    ids = server_packets.filter(
        V.setup_packet(server_side=True) & (F.col("transport") == "udp") & (F.col("dst_ip") == private_ipv4) & (F.col("dst_port") == 443)
    ).groupBy("src_ip", F.col("src_port").cast("int").alias("src_port"), "quic_dcid").agg(F.min("time_epoch").alias("first"))
    return wanted.join(ids, ["src_ip", "src_port"]).filter(F.col("first") <= F.col("log_ts")).select("attempt_path", "quic_dcid")


def outer_contacts(attempts: DataFrame, packets: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidate connection starts in the attribution window with reply and handshake facts.

    ``attempts``: ``attempt_path, origin_ip, intended_ip, w_from, w_to`` (epoch seconds);
    ``candidates``: ``attempt_path, ingress_ip, attributable``. Replies and handshakes are
    decided from per-flow maxima: a reply follows a start iff the last reply does;
    a handshake is complete iff the last SYN-ACK that an ACK follows is not before the start.
    """
    bounds = attempts.select("attempt_path", "origin_ip", "intended_ip", "w_from", "w_to")
    timed = packets.filter(F.col("time_epoch").isNotNull()).join(bounds, "attempt_path")
    timed = timed.filter(F.col("w_to").isNull() | (F.col("time_epoch") <= F.col("w_to")))
    flow = ["attempt_path", "transport", "client_ip", "client_port", "ingress_ip"]
    starts = timed.filter(
        V.setup_packet(server_side=True) & (F.col("dst_port") == 443) & (F.col("w_from").isNull() | (F.col("time_epoch") >= F.col("w_from")))
    ).select(
        "attempt_path", "transport", F.col("src_ip").alias("client_ip"), F.col("src_port").alias("client_port"),
        F.col("dst_ip").alias("ingress_ip"), "time_epoch", "frame_number", (F.col("dst_ip") == F.col("intended_ip")).alias("intended"), "origin_ip",
    ).filter(F.col("ingress_ip") != F.col("origin_ip"))
    starts = starts.join(candidates, ["attempt_path", "ingress_ip"])
    back = timed.filter(F.col("src_port") == 443).select(
        "attempt_path", "transport", F.col("dst_ip").alias("client_ip"), F.col("dst_port").alias("client_port"), F.col("src_ip").alias("ingress_ip"),
        "time_epoch", (F.col("tcp_syn") & F.col("tcp_ack")).alias("syn_ack"),
    )
    acks = timed.filter((F.col("dst_port") == 443) & F.col("tcp_ack") & ~F.col("tcp_syn") & (F.col("transport") == "tcp")).groupBy(
        "attempt_path", "transport", F.col("src_ip").alias("client_ip"), F.col("src_port").alias("client_port"), F.col("dst_ip").alias("ingress_ip")
    ).agg(F.max("time_epoch").alias("last_ack"))
    replies = back.join(acks, flow, "left").groupBy(*flow).agg(
        F.max("time_epoch").alias("last_reply"),
        F.max(F.when(F.col("syn_ack") & (F.col("time_epoch") <= F.col("last_ack")), F.col("time_epoch"))).alias("last_answered_syn_ack"),
    )
    joined = starts.join(replies, flow, "left")
    after = lambda c: F.coalesce(F.col(c) >= F.col("time_epoch"), F.lit(False))
    return joined.select(
        *flow, "time_epoch", "frame_number", "intended", "attributable",
        after("last_reply").alias("bidirectional"),
        ((F.col("transport") == "tcp") & after("last_answered_syn_ack")).alias("established"),
    )


def handshakes(contacts: DataFrame, packets: DataFrame) -> DataFrame:
    """First SYN-ACK and ACK after each established start (a report over established flows only)."""
    est = contacts.filter("established")
    flow = ["attempt_path", "client_ip", "client_port", "ingress_ip"]
    syn_acks = packets.filter(F.col("tcp_syn") & F.col("tcp_ack") & (F.col("src_port") == 443)).select(
        "attempt_path", F.col("dst_ip").alias("client_ip"), F.col("dst_port").alias("client_port"), F.col("src_ip").alias("ingress_ip"),
        F.struct("time_epoch", "frame_number").alias("sa"),
    )
    acks = packets.filter(F.col("tcp_ack") & ~F.col("tcp_syn") & (F.col("dst_port") == 443)).select(
        "attempt_path", F.col("src_ip").alias("client_ip"), F.col("src_port").alias("client_port"), F.col("dst_ip").alias("ingress_ip"),
        F.struct("time_epoch", "frame_number").alias("ack"),
    )
    start = [*flow, "time_epoch", "frame_number"]
    first = est.join(syn_acks, flow).filter(F.col("sa.time_epoch") >= F.col("time_epoch")).groupBy(*start).agg(F.min("sa").alias("syn_ack"))
    return first.join(acks, flow).filter(F.col("ack.time_epoch") >= F.col("syn_ack.time_epoch")).groupBy(*start, "syn_ack").agg(F.min("ack").alias("ack"))


def direct_origin_contacts(attempts: DataFrame, packets: DataFrame) -> DataFrame:
    """Outbound packets to the origin's port 443 over the whole capture."""
    origins = attempts.select("attempt_path", F.col("origin_ip").alias("dst_ip"))
    return packets.filter(F.col("dst_port") == 443).join(origins, ["attempt_path", "dst_ip"])


def client_facts(attempts: DataFrame, contacts: DataFrame, direct: DataFrame) -> DataFrame:
    """One row per attempt: outer transport, fallback and failover flags, direct contact."""
    mine = contacts.filter("attributable")
    # A flow may start several times (retransmitted SYN): one row per flow before counting.
    flows = mine.groupBy("attempt_path", "transport", "ingress_ip", "client_port").agg(
        F.max("established").alias("established"), F.max("bidirectional").alias("bidirectional"), F.min("intended").alias("intended")
    )
    udp_other = (F.col("transport") == "udp") & ~F.col("intended")
    facts = flows.groupBy("attempt_path").agg(
        F.min("transport").alias("lo"), F.max("transport").alias("hi"),
        F.count_if((F.col("transport") == "tcp") & F.col("established")).alias("established_flows"),
        F.bool_or(udp_other).alias("other_udp"),
        F.bool_or(udp_other & F.col("bidirectional")).alias("other_udp_answered"),
    )
    hit = direct.select("attempt_path").distinct().withColumn("direct", F.lit(True))
    df = attempts.select("attempt_path").join(facts, "attempt_path", "left").join(hit, "attempt_path", "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    return df.select(
        "attempt_path",
        F.when(F.col("lo").isNull(), "none").when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("mixed").alias("outer_transport"),
        (F.coalesce("established_flows", F.lit(0)) == 1).alias("unambiguous_tcp_fallback"),
        no("other_udp").alias("alternative_udp_attempt"), no("other_udp_answered").alias("alternative_udp_failover"),
        no("direct").alias("direct_origin_contact"),
    )


# Times of a blocked trial in order.
FIREWALL_TIMES = ["prepared_utc", "rule_load_started_utc", "rule_load_completed_utc", "statistics_after_load_utc",
                  "targeted_state_reset_utc", "statistics_before_cleanup_utc", "restored_utc"]


def firewall_verdict(firewall: DataFrame, *, anchor: str, label: str) -> DataFrame:
    """``valid``, ``enforced`` and counter delta of firewall evidence, per trial condition.

    Columns: ``condition, evidence_condition, interface, intended_ip, anchor, exact_rule,
    loaded_rules, previous_rules, rule_loaded, counter_before, counter_after`` and the
    seven ``*_utc`` times. A missing time fails the order.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    expected = F.concat(
        F.lit("block drop out quick on "), F.col("interface"), F.lit(" inet proto udp from any to "), F.col("intended_ip"),
        F.lit(f' port = 443 label "{label}"'),
    )
    # Times and lines are read several times below, so they are columns first; rules of one line do without the interpreted lambdas.
    rules = text("loaded_rules")
    several = F.filter(F.transform(F.split(rules, r"\r?\n"), lambda s: F.trim(s)), lambda s: s != "")
    single = F.when(rules == "", F.array().cast("array<string>")).otherwise(F.array(rules))
    firewall = firewall.withColumns({
        "_lines": F.when(rules.contains("\n"), several).otherwise(single), **{f"_t_{n}": V.utc_timestamp(F.col(n)) for n in FIREWALL_TIMES},
    })
    one = F.get("_lines", F.lit(0))
    loaded_exact = F.size("_lines") == 1
    for part in (F.lit("block drop out quick"), F.concat(F.lit("on "), F.col("interface")), F.lit("inet proto udp"),
                 F.concat(F.lit("to "), F.col("intended_ip")), F.lit("port = 443"), F.lit(f'label "{label}"')):
        loaded_exact = loaded_exact & one.contains(part)
    before, after = F.col("counter_before"), F.col("counter_after")
    delta = F.when(after >= before, after - before)

    def ordered(*names: str) -> Column:
        times = [F.col(f"_t_{n}") for n in names]
        ok = F.lit(True)
        for a, b in zip(times, times[1:]):
            ok = ok & (a <= b)
        return F.coalesce(ok, F.lit(False))

    common = (
        (F.col("anchor") == anchor) & (F.col("evidence_condition") == F.col("condition")) & (text("previous_rules") == "")
        & (text("statistics_after_load_utc") != "") & (text("statistics_before_cleanup_utc") != "") & (text("restored_utc") != "")
    )
    permitted_order = ordered("prepared_utc", "statistics_after_load_utc", "statistics_before_cleanup_utc", "restored_utc")
    blocked_order = ordered(*FIREWALL_TIMES)
    zero = lambda c: c.isNull() | (c == 0)
    permitted = common & permitted_order & (text("exact_rule") == "") & (text("loaded_rules") == "") & ~F.col("rule_loaded") & zero(before) & zero(after)
    blocked = common & blocked_order & (text("exact_rule") == expected) & loaded_exact & F.col("rule_loaded") & delta.isNotNull()
    is_permitted = F.col("condition") == PERMITTED
    valid = F.coalesce(F.when(is_permitted, permitted).otherwise(blocked), F.lit(False))
    return firewall.select(
        "attempt_path", valid.alias("pf_valid"),
        (valid & ~is_permitted & F.coalesce(delta > 0, F.lit(False))).alias("pf_enforced"),
        delta.alias("pf_delta"),
        F.when(is_permitted, permitted_order).otherwise(blocked_order).alias("chronology_valid"),
    )


def gate_verdict(gates: DataFrame, *, private_ipv4: str, table_prefix: str, timer_prefix: str, rule: str,
                 priority: int = -10, policy: str = "accept", minimum_seconds: int = 1, timeout_seconds: int | None = None) -> DataFrame:
    """Origin-gate evidence of the stages ``pre`` and ``post``: one row per attempt, ``gate_valid``."""
    session = F.col("session_id")
    pinned = {
        "table_name": F.concat(F.lit(table_prefix), F.translate(session, "-", "_")), "table_count": F.lit(1), "chain_count": F.lit(1),
        "set_count": F.lit(1), "counter_count": F.lit(1), "rule_count": F.lit(1), "chain_priority": F.lit(priority),
        "chain_policy": F.lit(policy), "target_present": F.lit(True), "target_ipv4": F.lit(private_ipv4), "timer_active": F.lit(True),
        "timer_unit": F.concat(F.lit(timer_prefix), session, F.lit(".timer")), "server_active": F.lit(True), "capture_active": F.lit(True),
    }
    ok = session.rlike(r"^[0-9]{8}T[0-9]{6}Z-[0-9a-f]{8}$") & (F.col("remaining_seconds") >= minimum_seconds)
    if timeout_seconds is not None:
        ok = ok & (F.col("remaining_seconds") <= timeout_seconds)
    for name, value in pinned.items():
        ok = ok & (F.col(name) == value)
    squeezed = F.trim(F.regexp_replace("exact_rule", r"\s+", " "))
    ok = F.coalesce(ok & (squeezed == rule), F.lit(False))
    left = lambda stage: F.max(F.when(F.col("stage") == stage, F.col("remaining_seconds")))
    return gates.withColumn("ok", ok).groupBy("attempt_path").agg(
        F.bool_and("ok").alias("all_ok"), F.count_distinct("stage").alias("stages"), F.count_distinct("session_id").alias("sessions"),
        left("pre").alias("pre_left"), left("post").alias("post_left"),
    ).select(
        "attempt_path",
        F.coalesce(F.col("all_ok") & (F.col("stages") == 2) & (F.col("sessions") == 1) & (F.col("post_left") <= F.col("pre_left")), F.lit(False)).alias("gate_valid"),
    )


def pin_verdict(pins: DataFrame, hostnames: list[str]) -> DataFrame:
    """Effective pin evidence: every lookup resolves to the intended address alone, IPv6 only where no route exists.

    Columns: ``intended_ip, pin_ip, effective_ipv4, effective_ipv6, ipv6_route_absent`` and
    ``hostname_lookups MAP<host, STRUCT<ipv4, ipv6>>``.
    """
    absent = F.coalesce("ipv6_route_absent", F.lit(False))
    only = lambda a: F.coalesce(F.array_distinct(a) == F.array("intended_ip"), F.lit(False))
    quiet = lambda a: (F.size(F.coalesce(a, F.array().cast("array<string>"))) == 0) | absent
    ok = (F.col("pin_ip") == F.col("intended_ip")) & only(F.col("effective_ipv4")) & quiet(F.col("effective_ipv6"))
    for host in hostnames:
        lookup = F.try_element_at("hostname_lookups", F.lit(host))
        ok = ok & lookup.isNotNull() & only(lookup["ipv4"]) & quiet(lookup["ipv6"])
    return pins.select("attempt_path", F.coalesce(ok, F.lit(False)).alias("pin_valid"))


def captures_for(events: DataFrame, captures: DataFrame) -> DataFrame:
    """Rolling captures that start 0 to 2 hours before an event: equality on the hour, then the exact bound.

    ``captures``: ``path`` with ``_YYYYMMDDHHMMSS`` before its suffix; ``events``: ``attempt_path, event_time``.
    """
    stamp = F.regexp_extract("path", r"_(\d{14})\.(?:pcap|pcapng)$", 1)
    started = F.when(stamp != "", F.try_to_timestamp(stamp, F.lit("yyyyMMddHHmmss")))
    files = captures.select("path", started.alias("started")).filter("started is not null").withColumn("hour", F.date_trunc("hour", "started"))
    hours = F.array(*[F.date_trunc("hour", F.col("event_time")) - F.expr(f"interval {h} hours") for h in range(3)])
    spread = events.withColumn("hour", F.explode(hours))
    two_hours = F.expr("interval 2 hours")
    return spread.join(files, "hour").filter(
        (F.col("started") <= F.col("event_time")) & (F.col("event_time") - two_hours <= F.col("started"))
    ).drop("hour")


def _verdict(classification: str, acceptance: str) -> Column:
    return F.struct(F.lit(classification).alias("classification"), F.lit(acceptance).alias("acceptance"))


def classify_trial() -> Column:
    """Ordered verdict of an ungated trial as STRUCT<classification, acceptance>.

    Reads ``condition, row, fresh, server_transport, pf_*, real_ip_match, catalogue_match,
    pairing_errors, integrity_errors`` and the client facts.
    """
    return _common_verdicts("no_destination_observation").when(
        F.col("row.proto") == "HTTP/3.0",
        F.when(~_fresh_quic(), _verdict("http3_without_fresh_server_quic", "excluded_ambiguous"))
        .when((F.col("condition") == BLOCKED) & F.col("alternative_udp_failover"), _verdict("alternative_quic_ingress_failover", "supports_primary_only"))
        .when((F.col("condition") == BLOCKED) & F.col("pf_enforced") & F.col("unambiguous_tcp_fallback"),
              _verdict("outer_tcp_fallback_destination_http3", "supports_strong_fallback"))
        .when(F.col("condition") == BLOCKED, _verdict("blocked_destination_http3_without_strong_fallback_proof", "supports_primary_only"))
        .otherwise(_verdict("destination_http3_relayed", "supports_primary")),
    ).when(F.col("row.proto").startswith("HTTP/"), _verdict("destination_http2_or_tcp", "observed_non_supporting")).otherwise(
        _verdict("unknown_destination_protocol", "excluded_ambiguous")
    )


def classify_gated_trial() -> Column:
    """Ordered verdict of a trial that ran behind the origin gate (also reads ``gate_valid``)."""
    proto = F.col("row.proto")
    engaged = F.coalesce(F.col("pf_valid") & (F.col("pf_delta") > 0), F.lit(False))
    return (
        _common_verdicts("no_h3_required_destination_observation",
                         first=F.when(~F.coalesce("gate_valid", F.lit(False)), _verdict("origin_gate_integrity_failure", "excluded_ambiguous")))
        .when((proto != "HTTP/3.0") & proto.startswith("HTTP/"), _verdict("origin_gate_protocol_contradiction", "excluded_ambiguous"))
        .when(proto != "HTTP/3.0", _verdict("unknown_destination_protocol", "excluded_ambiguous"))
        .when(~_fresh_quic(), _verdict("http3_without_fresh_server_quic", "excluded_ambiguous"))
        .when((F.col("condition") == PERMITTED) & ((F.col("outer_transport") != "udp") | F.col("alternative_udp_failover")),
              _verdict("permitted_without_attributable_outer_udp", "observed_non_supporting"))
        .when(F.col("condition") == PERMITTED, _verdict("destination_h3_required", "supports_h3_required_capability"))
        .when(F.col("alternative_udp_failover"), _verdict("alternative_udp_ingress_h3_required", "supports_h3_required_capability_only"))
        .when(~engaged, _verdict("blocked_gate_not_engaged", "unevaluable_strong_endpoint"))
        .when(F.col("pf_enforced") & F.col("unambiguous_tcp_fallback"),
              _verdict("outer_tcp_fallback_destination_h3_required", "supports_strong_h3_required_fallback"))
        .otherwise(_verdict("blocked_udp_engaged_without_outer_tcp", "observed_non_supporting"))
    )


def _fresh_quic() -> Column:
    return F.coalesce(F.col("fresh") & (F.col("server_transport") == "udp_quic_initial"), F.lit(False))


def _common_verdicts(unobserved: str, first: Column | None = None) -> Column:
    chain = F if first is None else first
    return (
        chain.when(F.size("integrity_errors") > 0, _verdict("integrity_failure", "excluded_ambiguous"))
        .when(F.size("pairing_errors") > 0, _verdict("ambiguous_destination_pairing", "excluded_ambiguous"))
        .when(F.col("row").isNull(), _verdict(unobserved, "observed_non_supporting"))
        .when(F.col("real_ip_match"), _verdict("real_ip_bypass", "safety_stop"))
        .when(F.col("direct_origin_contact"), _verdict("direct_origin_contact", "excluded_bypass"))
        .when(~F.col("catalogue_match"), _verdict("egress_not_in_same_day_catalogue", "excluded_ambiguous"))
    )


def lifecycle_gate(verdict: Column) -> Column:
    """Keep life-cycle failures from becoming findings: reads ``outcome, condition_changed, cleanup_valid, deadline_missed``."""
    outcome = F.coalesce("outcome", F.lit(""))
    supportive = outcome.isin("success", "alternative_ingress")
    named = lambda acceptance: F.struct(outcome.alias("classification"), F.lit(acceptance).alias("acceptance"))
    return (
        F.when(outcome == "direct_bypass", _verdict("real_ip_bypass", "safety_stop"))
        .when(verdict["acceptance"].isin("excluded_ambiguous", "excluded_bypass", "safety_stop"), verdict)
        .when(supportive & ~F.col("cleanup_valid"), _verdict("integrity_failure", "excluded_ambiguous"))
        .when(F.col("condition_changed"), _verdict("condition_changed", "excluded_ambiguous"))
        .when(F.col("deadline_missed") | (outcome == "timeout"), _verdict("timeout", "observed_non_supporting"))
        .when(outcome == "private_relay_unavailable", named("observed_non_supporting"))
        .when(outcome == "multiple_destination_connections", named("excluded_ambiguous"))
        .when(outcome == "aborted", named("excluded_aborted"))
        .when(outcome == "operator_completion_timeout", named("excluded_operational"))
        .when(outcome.isin("mechanical_failure", "prepare_error"), named("excluded_mechanical"))
        .when(~supportive, _verdict("integrity_failure", "excluded_ambiguous"))
        .otherwise(verdict)
    )


def pair_trials(trials: DataFrame, responses: DataFrame, logs: DataFrame, server_packets: DataFrame, client_packets: DataFrame,
                candidates: DataFrame, firewall: DataFrame, catalogue: DataFrame, *, private_ipv4: str, anchor: str, label: str,
                gated: bool = False, gates: DataFrame | None = None) -> DataFrame:
    """Diagnostic pairing end to end: one classified row per trial.

    ``trials``: ``attempt_path, run_id, slot_id, retry_number, condition, real_public_ipv4,
    origin_ip, intended_ip, t_from, t_to, w_from, w_to, outcome, condition_changed,
    cleanup_valid, deadline_missed, integrity_errors``. ``catalogue`` has ``PREFIX, country,
    region, city`` of the same-day feed; ``gates`` (gated trials) one row per attempt, ``gate_valid``.
    An ``_ordinal`` of the trials is kept.
    """
    from prefixledger.operators import routing
    from prefixledger.operators.intervals import PREFIX
    from prefixledger.session import cut_lineage

    paired = cut_lineage(trials.join(exact_log_pair(trials, responses, logs, ROW_READ), "attempt_path"))
    # Read for its lengths and for its rows: parsed once.
    catalogue = cut_lineage(catalogue.select(*PREFIX, "country", "region", "city"))
    flow = server_flow(paired, server_packets, private_ipv4)
    contacts = cut_lineage(outer_contacts(trials, client_packets, candidates))
    facts = client_facts(trials, contacts, direct_origin_contacts(trials, client_packets))
    pf = firewall_verdict(firewall, anchor=anchor, label=label)
    probe = A.with_address(paired.select("attempt_path", F.col("row.remote_ip").alias("egress")), "egress", family=4)
    hit = probe.join(routing.match_unique(probe, catalogue, ["country", "region", "city"]).select(*PREFIX), PREFIX, "left_semi").select(
        "attempt_path", F.lit(True).alias("hit")
    )
    df = paired
    for part in (flow, facts, pf, hit):
        df = df.join(part, "attempt_path", "left")
    if gated:
        df = df.join(gates, "attempt_path", "left")
    bad_pf = ~F.coalesce("pf_valid", F.lit(False))
    df = df.withColumns({
        "catalogue_match": F.coalesce("hit", F.lit(False)),
        "real_ip_match": F.coalesce(F.col("row.remote_ip") == F.col("real_public_ipv4"), F.lit(False)),
        "integrity_errors": F.concat("integrity_errors", V.messages((bad_pf, "firewall evidence is invalid"))),
    })
    df = df.withColumn("v", classify_gated_trial() if gated else classify_trial())
    return df.withColumn("v", lifecycle_gate(F.col("v"))).select(
        "attempt_path", "slot_id", "run_id", "retry_number", "condition", "outer_transport", "server_transport",
        F.col("row.remote_ip").alias("observed_egress_ipv4"), F.col("row.proto").alias("http_version"), "catalogue_match",
        "direct_origin_contact", "real_ip_match", "response_evidence_preserved", "pairing_errors", "integrity_errors",
        "v.classification", "v.acceptance", *[c for c in trials.columns if c == "_ordinal"],
    )
