import datetime as dt

from pyspark.sql import functions as F

from prefixledger.functions import values as V
from prefixledger.operators import campaign, diagnostics, summaries

PIN, ORIGIN, ME = "198.51.100.7", "203.0.113.80", "192.168.1.2"
PACKET = ("attempt_path string, frame_number int, time_epoch double, transport string, src_ip string, src_port int, dst_ip string, dst_port int, "
          "tcp_syn boolean, tcp_ack boolean, quic_initial boolean, quic_dcid string")


def test_handshakes_and_contacts(spark):
    out = lambda a, n, t, kind, dst=PIN, port=50000: (a, n, t, "tcp" if kind != "quic" else "udp", ME, port, dst, 443, kind == "syn", kind == "ack", kind == "quic", "d" if kind == "quic" else None)
    back = lambda a, n, t, kind, src=PIN, port=50000: (a, n, t, "tcp" if kind != "quic" else "udp", src, 443, ME, port, kind == "synack", kind in ("synack", "ack"), False, None)
    rows = [
        out("full", 1, 10.0, "syn"), back("full", 2, 10.1, "synack"), out("full", 3, 10.2, "ack"),
        out("no_ack", 1, 10.0, "syn"), back("no_ack", 2, 10.1, "synack"),
        out("ack_before", 1, 10.0, "ack"), out("ack_before", 2, 10.1, "syn"), back("ack_before", 3, 10.2, "synack"),
        out("late_ack", 1, 10.0, "syn"), back("late_ack", 2, 10.1, "synack"), out("late_ack", 3, 99.0, "ack"),
        out("early", 1, 1.0, "syn"), back("early", 2, 10.1, "synack"),
        out("quic", 1, 10.0, "quic"), back("quic", 2, 10.5, "quic"),
        out("direct", 1, 1.0, "ack", ORIGIN),
        out("two", 1, 10.0, "syn"), back("two", 2, 10.1, "synack"), out("two", 3, 10.2, "ack"),
        out("two", 4, 11.0, "syn", port=50001), back("two", 5, 11.1, "synack", port=50001), out("two", 6, 11.2, "ack", port=50001),
    ]
    packets = spark.createDataFrame(rows, PACKET)
    names = sorted({r[0] for r in rows})
    attempts = spark.createDataFrame([(n, ORIGIN, "198.51.100.9", 5.0, 20.0) for n in names], "attempt_path string, origin_ip string, intended_ip string, w_from double, w_to double")
    candidates = spark.createDataFrame([(n, ip, True) for n in names for ip in (PIN, ORIGIN)], "attempt_path string, ingress_ip string, attributable boolean")
    contacts = diagnostics.outer_contacts(attempts, packets, candidates).cache()
    got = {(r.attempt_path, r.frame_number): (r.bidirectional, r.established) for r in contacts.collect()}
    assert got == {("full", 1): (True, True), ("no_ack", 1): (True, False), ("ack_before", 2): (True, False), ("late_ack", 1): (True, False),
                   ("quic", 1): (True, False), ("two", 1): (True, True), ("two", 4): (True, True)}
    facts = {r.attempt_path: r for r in diagnostics.client_facts(attempts, contacts, diagnostics.direct_origin_contacts(attempts, packets)).collect()}
    assert facts["full"].unambiguous_tcp_fallback and not facts["two"].unambiguous_tcp_fallback
    assert facts["quic"].alternative_udp_failover and facts["quic"].outer_transport == "udp" and facts["direct"].outer_transport == "none"
    assert facts["direct"].direct_origin_contact and not facts["full"].direct_origin_contact
    shake = {(r.attempt_path, r.frame_number): (r.syn_ack.frame_number, r.ack.frame_number) for r in diagnostics.handshakes(contacts, packets).collect()}
    assert shake == {("full", 1): (2, 3), ("two", 1): (2, 3), ("two", 4): (5, 6)}


def _firewall(**changes):
    rule = f'block drop out quick on en0 inet proto udp from any to {PIN} port = 443 label "L"'
    stamp = lambda i: f"2026-01-01T00:00:{i:02d}Z"
    row = dict(attempt_path="x", condition="udp_blocked", evidence_condition="udp_blocked", interface="en0", intended_ip=PIN, anchor="A", exact_rule=rule, loaded_rules=rule + "\n",
               previous_rules="", rule_loaded=True, counter_before=1, counter_after=4, prepared_utc=stamp(0), rule_load_started_utc=stamp(1), rule_load_completed_utc=stamp(2),
               statistics_after_load_utc=stamp(3), targeted_state_reset_utc=stamp(4), statistics_before_cleanup_utc=stamp(5), restored_utc=stamp(6))
    return {**row, **changes}


def test_firewall_gate_and_pin_verdicts(spark):
    cases = {
        "good": ({}, (True, True)), "no_delta": (dict(counter_after=1), (True, False)), "backwards": (dict(counter_after=0), (False, False)),
        "order": (dict(targeted_state_reset_utc="2026-01-01T00:00:59Z"), (False, False)), "missing_time": (dict(rule_load_started_utc=None), (False, False)),
        "two_rules": (dict(loaded_rules="a\nb"), (False, False)), "anchor": (dict(anchor="B"), (False, False)), "other_condition": (dict(evidence_condition="udp_permitted"), (False, False)),
        "permitted": (dict(condition="udp_permitted", evidence_condition="udp_permitted", exact_rule="", loaded_rules="", rule_loaded=False, counter_before=None, counter_after=0), (True, False)),
        "permitted_with_rule": (dict(condition="udp_permitted", evidence_condition="udp_permitted"), (False, False)),
    }
    ddl = ", ".join(f"{k} {'boolean' if k == 'rule_loaded' else 'bigint' if k.startswith('counter') else 'string'}" for k in _firewall())
    df = spark.createDataFrame([_firewall(**{**c, "attempt_path": n}) for n, (c, _) in cases.items()], ddl)
    got = {r.attempt_path: (r.pf_valid, r.pf_enforced) for r in diagnostics.firewall_verdict(df, anchor="A", label="L").collect()}
    assert got == {n: w for n, (_, w) in cases.items()}

    session = "20260101T000000Z-0123abcd"
    gate = lambda path, stage, left, **more: {**dict(attempt_path=path, stage=stage, session_id=session, table_name="t_" + session.replace("-", "_"), table_count=1, chain_count=1, set_count=1,
        counter_count=1, rule_count=1, chain_priority=-10, chain_policy="accept", target_present=True, target_ipv4="10.0.0.5", timer_active=True, timer_unit=f"u-{session}.timer",
        server_active=True, capture_active=True, remaining_seconds=left, exact_rule="drop  it"), **more}
    rows = [gate("ok", "pre", 90), gate("ok", "post", 60), gate("grew", "pre", 60), gate("grew", "post", 90), gate("alone", "pre", 60),
            gate("rule", "pre", 90, exact_rule="drop all"), gate("rule", "post", 60), gate("expired", "pre", 9), gate("expired", "post", 0)]
    kind = lambda v: "boolean" if isinstance(v, bool) else "int" if isinstance(v, int) else "string"
    gates = spark.createDataFrame(rows, ", ".join(f"{k} {kind(v)}" for k, v in rows[0].items()))
    verdict = diagnostics.gate_verdict(gates, private_ipv4="10.0.0.5", table_prefix="t_", timer_prefix="u-", rule="drop it")
    assert {r.attempt_path for r in verdict.collect() if r.gate_valid} == {"ok"}

    pins = spark.createDataFrame(
        [("ok", PIN, PIN, [PIN, PIN], [], False, {"h": ([PIN], [])}), ("v6", PIN, PIN, [PIN], ["::1"], False, {"h": ([PIN], [])}), ("v6_no_route", PIN, PIN, [PIN], ["::1"], True, {"h": ([PIN], ["::1"])}),
         ("two", PIN, PIN, [PIN, ORIGIN], [], False, {"h": ([PIN], [])}), ("no_host", PIN, PIN, [PIN], [], False, {"k": ([PIN], [])})],
        "attempt_path string, intended_ip string, pin_ip string, effective_ipv4 array<string>, effective_ipv6 array<string>, ipv6_route_absent boolean, "
        "hostname_lookups map<string,struct<ipv4:array<string>,ipv6:array<string>>>")
    assert {r.attempt_path for r in diagnostics.pin_verdict(pins, ["h"]).collect() if r.pin_valid} == {"ok", "v6_no_route"}


def test_captures_are_chosen_by_hour_and_bound(spark):
    events = spark.createDataFrame([("a", dt.datetime(2026, 1, 1, 12, 30))], "attempt_path string, event_time timestamp")
    names = {"cap_20260101123000.pcap": True, "cap_20260101103000.pcapng": True, "cap_20260101102959.pcap": False, "cap_20260101123001.pcap": False, "cap.pcap": False}
    files = spark.createDataFrame([(n,) for n in names], "path string")
    assert {r.path for r in diagnostics.captures_for(events, files).collect()} == {n for n, w in names.items() if w}


def test_gated_classification_and_lifecycle(spark):
    base = dict(condition="udp_blocked", proto="HTTP/3.0", fresh=True, server_transport="udp_quic_initial", gate_valid=True, pf_valid=True, pf_enforced=True, pf_delta=3, real_ip_match=False,
                direct_origin_contact=False, catalogue_match=True, alternative_udp_failover=False, unambiguous_tcp_fallback=True, outer_transport="tcp", outcome="success",
                condition_changed=False, cleanup_valid=True, deadline_missed=False)
    cases = [
        ({}, "outer_tcp_fallback_destination_h3_required", "supports_strong_h3_required_fallback"),
        (dict(gate_valid=False), "origin_gate_integrity_failure", "excluded_ambiguous"),
        (dict(proto="HTTP/2.0"), "origin_gate_protocol_contradiction", "excluded_ambiguous"),
        (dict(proto=None), "no_h3_required_destination_observation", "observed_non_supporting"),
        (dict(fresh=False), "http3_without_fresh_server_quic", "excluded_ambiguous"),
        (dict(alternative_udp_failover=True), "alternative_udp_ingress_h3_required", "supports_h3_required_capability_only"),
        (dict(pf_delta=0, pf_enforced=False), "blocked_gate_not_engaged", "unevaluable_strong_endpoint"),
        (dict(unambiguous_tcp_fallback=False), "blocked_udp_engaged_without_outer_tcp", "observed_non_supporting"),
        (dict(condition="udp_permitted", outer_transport="udp"), "destination_h3_required", "supports_h3_required_capability"),
        (dict(condition="udp_permitted"), "permitted_without_attributable_outer_udp", "observed_non_supporting"),
        (dict(real_ip_match=True), "real_ip_bypass", "safety_stop"),
        (dict(outcome="direct_bypass"), "real_ip_bypass", "safety_stop"),
        (dict(cleanup_valid=False), "integrity_failure", "excluded_ambiguous"),
        (dict(outcome="aborted"), "aborted", "excluded_aborted"),
        (dict(outcome="timeout"), "timeout", "observed_non_supporting"),
        (dict(outcome="strange"), "integrity_failure", "excluded_ambiguous"),
    ]
    kind = lambda v: "boolean" if isinstance(v, bool) else "bigint" if isinstance(v, int) else "string"
    df = spark.createDataFrame([{**base, **c, "i": i} for i, (c, _, _) in enumerate(cases)], "i int, " + ", ".join(f"{k} {kind(v)}" for k, v in base.items()))
    none = F.array().cast("array<string>")
    df = df.withColumns({"integrity_errors": none, "pairing_errors": none, "row": F.when(F.col("proto").isNotNull(), F.struct("proto"))})
    got = {r.i: (r.v.classification, r.v.acceptance) for r in df.withColumn("t", diagnostics.classify_gated_trial()).select("i", diagnostics.lifecycle_gate(F.col("t")).alias("v")).collect()}
    assert got == {i: (c, a) for i, (_, c, a) in enumerate(cases)}


def test_retry_ties_and_completeness(spark):
    rows = [("s1", 1, "udp_permitted", "x", "accepted", 0), ("s1", 1, "udp_permitted", "y", "accepted", 1), ("s2", 2, "udp_blocked", "z", "accepted", 2), ("s2", 1, "udp_blocked", "w", "excluded", 3)]
    df = spark.createDataFrame(rows, "slot_id string, retry_number int, condition string, classification string, acceptance string, _ordinal int")
    assert {r.slot_id: r.classification for r in summaries.latest_retry(df, ["slot_id"]).collect()} == {"s1": "y", "s2": "z"}
    assert {r.slot_id: r.classification for r in summaries.latest_retry(df, ["slot_id"], ties="first").collect()} == {"s1": "x", "s2": "z"}
    plan = lambda *slots: spark.createDataFrame(list(slots), "slot_id string, condition string")
    first, second = ("s1", "udp_permitted"), ("s2", "udp_blocked")
    row = summaries.series_completeness(df, plan(first, second)).first()
    assert tuple(row) == (2, 2, 0, True, True)
    # acceptance plays no part: only a missing slot or another condition leaves a series open
    row = summaries.series_completeness(df.withColumn("acceptance", F.lit("excluded")), plan(first, second)).first()
    assert row.final_complete
    assert tuple(summaries.series_completeness(df, plan(first, second, ("s3", "udp_permitted"))).first()) == (3, 2, 1, False, False)
    assert tuple(summaries.series_completeness(df, plan(first, ("s2", "udp_permitted"))).first()) == (2, 2, 0, False, False)


def test_probe_summary_and_slots_without_id(spark):
    schema = "slot_id string, run_id string, retry_number int, condition string, classification string, acceptance string, response_evidence_preserved boolean, _ordinal int"
    rows = [("probe", "r1", 1, "c", "x", "a", False, 0), ("probe", "r2", 2, "c", "y", "b", True, 1), (None, "r3", 1, "c", "z", "a", None, 2), ("", "r4", 1, "c", "z", "a", None, 3)]
    df = spark.createDataFrame(rows, schema)
    assert tuple(summaries.probe_summary(df, "probe").first()) == (1, 1, True, "y", "b", True)
    assert tuple(summaries.probe_summary(df, "other").first()) == (1, 0, False, None, None, False)
    counts = {(r.classification, r.slots, r.attempts) for r in summaries.condition_summary(df).collect()}
    assert counts == {("y", 1, 4), ("z", 2, 4)}


def test_safety_stops_dns_and_counters(spark):
    df = spark.createDataFrame([("a", "direct_bypass", None, "1.1.1.1", False, None), ("b", "success", "1.1.1.1", "1.1.1.1", True, "code"), ("c", "success", "2.2.2.2", "1.1.1.1", False, "")],
                               "attempt_path string, outcome string, response_remote_ip string, real_public_ipv4 string, condition_changed boolean, safety_stop_code string")
    assert sorted((r.attempt_path, r.reason) for r in campaign.safety_stops(df).collect()) == [
        ("a", "real-address bypass"), ("b", "code"), ("b", "condition changed"), ("b", "real-address bypass")]
    texts = ["evaluations: 3 packets: 7", '{"a": {"packets": 5}, "b": {"packets": "5"}}', "packets: 1 packets: 2", "none", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", V.single_packet_counter(F.col("t")).alias("n")).collect()
    assert [r.n for r in sorted(rows)] == [7, 5, None, None, None]
    ints = ["0x10", "1.0", "12", "-3", "007", "x", "", "0b11", "1e2"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(ints)], "i int, t string").select(
        "i", V.lenient_integer(F.col("t")).alias("a"), V.lenient_integer(F.col("t"), allow_decimal=False).alias("b")).collect()
    assert [(r.a, r.b) for r in sorted(rows)] == [(16, 16), (1, None), (12, 12), (-3, -3), (7, None), (None, None), (None, None), (3, 3), (100, None)]


def test_log_pair_without_a_response(spark):
    attempts = spark.createDataFrame([("quiet", "q"), ("seen", "s")], "attempt_path string, run_id string")
    logs = spark.createDataFrame([("s", "u", 5.0, 200, "1.1.1.1", "5", "HTTP/3.0", "GET", "h", "/probe/s", "log", 1, "x")],
                                 "run_id string, request_uuid string, ts double, status int, remote_ip string, remote_port string, proto string, method string, host string, uri string, artifact string, line_number bigint, row_sha256 string")
    answers = spark.createDataFrame([], "attempt_path string, run_id string, request_uuid string, server_unix_ms bigint, remote_ip string, remote_port string, http_protocol string, request_host string, request_uri string")
    got = {r.attempt_path: r for r in diagnostics.exact_log_pair(attempts, answers, logs).collect()}
    assert got["quiet"].pairing_errors == [] and got["quiet"].row is None and not got["quiet"].response_evidence_preserved
    assert len(got["seen"].pairing_errors) == 1 and "1 tagged" in got["seen"].pairing_errors[0]


def test_a_port_used_again_is_judged_by_its_own_capture(spark):
    day, event = 86400.0, 1_767_225_600.0 + 3600  # 2026-01-01 01:00 UTC
    row = "struct<proto:string,remote_ip:string,remote_port:string,ts:double>"
    paired = spark.createDataFrame([("a", ("HTTP/3.0", "1.1.1.1", "50000", event), event - 60, event + 60)], f"attempt_path string, row {row}, t_from double, t_to double")
    paired = paired.withColumns({c: V.epoch_timestamp(F.col(c)) for c in ("t_from", "t_to")})
    packets = [(event - day, "x_20251231001500.pcap"), (event - 30, "x_20260101001500.pcap")]
    df = spark.createDataFrame([(t, "udp", "1.1.1.1", 50000, "10.0.0.1", 443, False, False, True, "d", f) for t, f in packets],
                               "time_epoch double, transport string, src_ip string, src_port int, dst_ip string, dst_port int, tcp_syn boolean, tcp_ack boolean, quic_initial boolean, quic_dcid string, artifact string")
    assert diagnostics.server_flow(paired, df, "10.0.0.1").first().fresh
    assert not diagnostics.server_flow(paired, df.filter(F.col("time_epoch") < event - 60), "10.0.0.1").first().fresh
    assert diagnostics.server_flow(paired, df.drop("artifact"), "10.0.0.1").first().fresh
