"""Pairing scenarios: one attempt per case, one thing changed, all decided in one job."""

import datetime as dt
import zlib

import pytest
from pyspark.sql import functions as F

from prefixledger.functions import address as A
from prefixledger.operators import eligibility, pairing, summaries

T0 = dt.datetime(2026, 3, 1, 23, 59, 50, tzinfo=dt.timezone.utc)
EPOCH = T0.timestamp()
HOST, PRIVATE, PIN, OTHER, EGRESS, REAL = "probe.example.net", "10.0.0.5", "198.51.100.7", "198.51.100.8", "203.0.113.20", "192.0.2.9"
RULES = pairing.PairingRules(
    hostname=HOST, private_ipv4=PRIVATE, group_asns={"pinned": (64500,)}, true_country="GB",
    permitted_locations=(("GB", "", ""),), allowed_cities=("london",), true_time_zone="Europe/London", intersection_rule="exact_value_intersection")


def iso(seconds):
    return (T0 + dt.timedelta(seconds=seconds)).isoformat().replace("+00:00", "Z")


class Case:
    """Inputs of one attempt; ``change`` edits them in place."""

    def __init__(self, name, transport="udp", change=None, run_id=None):
        self.path, self.run_id, port = f"a/{name}", run_id or name, 20000 + zlib.crc32(name.encode()) % 30000
        self.attempt = dict(
            attempt_path=self.path, run_id=self.run_id, campaign="c", run_mode="live", session="s", slot_id="1", block_id="b", attempt_number=1,
            client_start_utc=iso(0), safari_launch_requested_utc=iso(1), timeout_deadline_utc=iso(91), clock_status="synchronized",
            clock_evidence=dict(network_time="Network Time: On"), private_relay_state="on", location_setting="maintain_general_location",
            intended_ingress_group="pinned", intended_ingress_ip=PIN, approved_ingress_candidates=[PIN, OTHER], approved_pin_group_addresses=[PIN],
            effective_dns=dict(hostnames={"m": dict(A=[dict(address=PIN)])}), capture_filter="x", quic_block_state="none", hostname=HOST, url="u",
            macos_version="1", safari_version="1", active_interface="en0", network_type="wifi", real_public_ipv4=REAL, freshness_method="A",
            ingress_attribution_policy="bounded_candidate_contact_v2", operator_condition_confirmation="ok")
        self.events = {e: dict(event=e, recorded_utc=iso(s)) for e, s in ((pairing.START, 0), (pairing.LAUNCH, 1), (pairing.STOP, 60), (pairing.FINISH, 62))}
        self.events[pairing.FINISH].update(outcome="success", condition_changed=False, end_condition_confirmation="same")
        self.events = list(self.events.values())
        proto = "HTTP/3.0" if transport == "udp" else "HTTP/2.0"
        self.logs = [self.log(20, transport, port)]
        self.response = dict(run_id=self.run_id, server_utc=iso(20), server_unix_ms=int((EPOCH + 20) * 1000), request_uuid="u0", remote_ip=EGRESS,
                             remote_port=str(port), http_protocol=proto, request_host=HOST, request_uri=f"/probe/{self.run_id}")
        self.server = [self.packet(19, transport, EGRESS, port, PRIVATE)]
        self.client = [self.packet(15, transport, "192.168.1.2", port, PIN)]
        self.port = port
        if change:
            change(self)

    def log(self, at, transport, port, uuid="u0", ip=EGRESS):
        return dict(run_id=self.run_id, request_uuid=uuid, ts=EPOCH + at, status=200, remote_ip=ip, remote_port=str(port),
                    proto="HTTP/3.0" if transport == "udp" else "HTTP/2.0", method="GET", host=f"{HOST}:443", uri=f"/probe/{self.run_id}",
                    artifact="log", line_number=int(at), row_sha256=f"{self.run_id}{at}")

    @staticmethod
    def packet(at, transport, src, sport, dst, **more):
        tcp = transport == "tcp"
        return {**dict(frame_number=int(at), time_epoch=EPOCH + at, src_ip=src, dst_ip=dst, transport=transport, src_port=sport, dst_port=443,
                       tcp_syn=tcp, tcp_ack=False, tcp_seq_raw=sport if tcp else None, tcp_len=0, udp_length=0 if tcp else 1200, stream=None,
                       quic_initial=not tcp, quic_dcid=None if tcp else "aa", artifact="p", artifact_sha256="h"), **more}


def set_attempt(**fields):
    return lambda c: c.attempt.update(fields)


def real_ip(c):
    c.attempt["real_public_ipv4"] = EGRESS


def mixed(first, second):
    def change(c):
        c.logs = [c.log(20, first, c.port), c.log(21, second, c.port + 1, "u1")]
        c.response.update(http_protocol=c.logs[0]["proto"], remote_port=str(c.port))
        c.server = [c.packet(19, first, EGRESS, c.port, PRIVATE)]
    return change


def extra_packet(side, *args, **more):
    return lambda c: getattr(c, side).append(c.packet(*[c.port if a == "port" else a for a in args], **more))


def not_in_feed(c):
    for row in c.logs:
        row["remote_ip"] = "203.0.114.1"
    c.response["remote_ip"] = c.server[0]["src_ip"] = "203.0.114.1"


def drop(attr):
    return lambda c: setattr(c, attr, [])


def stale(c):
    c.server[0]["time_epoch"] = EPOCH - 5


def finish(**fields):
    return lambda c: c.events[-1].update(fields)


def no_log(c):
    c.logs, c.response = [], None
    c.events[-1]["outcome"] = "timeout"


def all_of(*changes):
    return lambda c: [x(c) for x in changes]


A_, P_, X_ = "accepted", "pending", "excluded"
# name: transport, change, disposition, exclusion code prefix or pending reason, protocol class
SCENARIOS = {
    "valid_quic": ("udp", None, A_, None, "http3_preserved"),
    "valid_tcp": ("tcp", None, A_, None, "tcp_downgrade"),
    "e01": ("udp", no_log, X_, "E01", "dropped_or_timeout"),
    "e02_flows": ("udp", mixed("udp", "tcp"), X_, "E02", "mixed_http3_then_tcp_delivery"),
    "e02_reverse": ("udp", mixed("tcp", "udp"), X_, "E02", "mixed_tcp_then_http3_delivery"),
    "e02_identities": ("tcp", extra_packet("server", 18, "tcp", EGRESS, "port", PRIVATE, tcp_seq_raw=7), X_, "E02", "ambiguous"),
    "e03_stale": ("udp", stale, X_, "E03", "ambiguous"),
    # A retransmission inside the window does not make a connection fresh that began before launch.
    "e03_reused": ("udp", extra_packet("server", -5, "udp", EGRESS, "port", PRIVATE), X_, "E03", "ambiguous"),
    "new_connection_id": ("udp", extra_packet("server", 19.5, "udp", EGRESS, "port", PRIVATE, quic_dcid="bb"), A_, None, "http3_preserved"),
    "e04_other": ("udp", lambda c: c.client[0].update(dst_ip=OTHER), X_, "E04", "ambiguous"),
    # A contact after the selected request is outside the attribution window.
    "late_contact": ("udp", extra_packet("client", 30, "udp", "192.168.1.2", 1234, OTHER), A_, None, "http3_preserved"),
    "e04_no_pin": ("udp", set_attempt(approved_pin_group_addresses=[OTHER]), X_, "E04", "ambiguous"),
    "e05": ("udp", real_ip, X_, "E05", "real_ip_bypass"),
    "control": ("udp", all_of(real_ip, set_attempt(private_relay_state="off_control")), X_, "E05", "direct_http3_control"),
    "e06": ("udp", not_in_feed, X_, "E06", "http3_preserved"),
    "e07_clock": ("udp", set_attempt(clock_status="drifting"), X_, "E07", "ambiguous"),
    "e07_response": ("udp", lambda c: c.response.update(server_unix_ms=0), X_, "E07", "ambiguous"),
    "e07_policy": ("udp", set_attempt(ingress_attribution_policy="other"), X_, "E07", "ambiguous"),
    "e07_event": ("udp", lambda c: c.events.append(dict(c.events[1])), X_, "E07", "ambiguous"),
    "e08_changed": ("udp", finish(condition_changed=True), X_, "E08", "ambiguous"),
    "e08_deadline": ("udp", set_attempt(timeout_deadline_utc=iso(10)), X_, "E08", "ambiguous"),
    "fresh_only": ("udp", all_of(set_attempt(ingress_attribution_policy="fresh_handshake_v1"), lambda c: c.client[0].update(quic_initial=False)), X_, "E04", "ambiguous"),
    "bounded_old_tunnel": ("udp", lambda c: c.client[0].update(quic_initial=False), A_, None, "http3_preserved"),
    "fallback_bare": ("tcp", set_attempt(quic_block_state="targeted_ingress_udp_443"), X_, "E04", "ambiguous"),
    "no_run_id": ("udp", set_attempt(run_id=None), X_, "E07", "ambiguous"),
    "unreadable": ("udp", set_attempt(malformed=True), X_, "E07", "ambiguous"),
    "missing_field": ("udp", set_attempt(url=""), X_, "E07", "ambiguous"),
}


@pytest.fixture(scope="module")
def records(spark):
    cases = [Case(name, s[0], s[1]) for name, s in SCENARIOS.items()]
    cases += [Case("twin_1", run_id="twin"), Case("twin_2", run_id="twin")]
    text = ["attempt_path", "run_id", "campaign", "run_mode", "session", "slot_id", "block_id", "client_start_utc", "safari_launch_requested_utc", "timeout_deadline_utc",
            "clock_status", "private_relay_state", "location_setting", "intended_ingress_group", "intended_ingress_ip", "capture_filter", "quic_block_state", "hostname",
            "url", "macos_version", "safari_version", "active_interface", "network_type", "real_public_ipv4", "freshness_method", "ingress_attribution_policy",
            "operator_condition_confirmation"]
    schema = ", ".join(f"{c} string" for c in text) + (
        ", malformed boolean, attempt_number int, clock_evidence struct<network_time:string>, approved_ingress_candidates array<string>, approved_pin_group_addresses array<string>, "
        "effective_dns struct<hostnames:map<string,struct<A:array<struct<address:string>>>>>")
    make = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    with_path = lambda c, rows: [{"attempt_path": c.path, **r} for r in rows]
    events = [dict(dict(outcome=None, condition_changed=None, end_condition_confirmation=None), **r) for c in cases for r in with_path(c, c.events)]
    packet = ("frame_number int, time_epoch double, src_ip string, dst_ip string, transport string, src_port int, dst_port int, tcp_syn boolean, tcp_ack boolean, "
              "tcp_seq_raw bigint, tcp_len int, udp_length int, stream string, quic_initial boolean, quic_dcid string, artifact string, artifact_sha256 string")
    # The served minute is the first of the next day, and the feed is dated by it.
    feed = A.with_prefix(make([("203.0.113.0/24", "GB", "ENG", "London", 1), ("203.0.113.0/26", "GB", "ENG", "London", 2)],
                              "ip_prefix string, country string, region string, city string, _ordinal int"), "ip_prefix").withColumn("date", F.lit("2026-03-02").cast("date"))
    origins = A.with_prefix(make([("203.0.113.0/24", 64501), ("203.0.114.0/24", 64501), ("198.51.100.0/24", 64500)], "prefix string, asn bigint"), "prefix").withColumn(
        "date", F.lit("2026-03-02").cast("date"))
    days = make([("2026-03-02",)], "d string").select(F.col("d").cast("date").alias("date"), F.lit(1).alias("files"), F.lit(False).alias("conflict"), F.lit("f").alias("feed_sha256"))
    decided = pairing.pair_attempts(
        make([c.attempt for c in cases], schema), make(events, "attempt_path string, event string, recorded_utc string, outcome string, condition_changed boolean, end_condition_confirmation string"),
        make([{"attempt_path": c.path, **c.response} for c in cases if c.response],
             "attempt_path string, run_id string, server_utc string, server_unix_ms bigint, request_uuid string, remote_ip string, remote_port string, http_protocol string, request_host string, request_uri string"),
        make([r for c in cases for r in c.logs if c.path != "a/twin_2"], "run_id string, request_uuid string, ts double, status int, remote_ip string, remote_port string, proto string, method string, "
             "host string, uri string, artifact string, line_number bigint, row_sha256 string"),
        make([r for c in cases for r in c.server], packet), make([r for c in cases for r in with_path(c, c.client)], "attempt_path string, " + packet),
        feed, days, origins, make([(64500, "one"), (64501, "two")], "asn bigint, operator_id string"), RULES)
    return decided


def test_scenarios(records):
    got = {r.attempt_path[2:]: r for r in records.collect()}
    wrong = {}
    for name, (_, _, disposition, why, protocol) in SCENARIOS.items():
        r = got[name]
        reason = (r.exclusion_reason or "")[:3] or None
        if (r.disposition, reason, r.protocol_classification) != (disposition, why, protocol):
            wrong[name] = (r.disposition, r.exclusion_reason, r.pending_reason, r.protocol_classification, r.triggered_exclusions, r.metadata_problems, r.response_problems)
    assert not wrong
    assert len(got) == len(SCENARIOS) + 2  # no attempt is lost
    assert all(got[t].triggered_exclusions == [pairing.E07] for t in ("twin_1", "twin_2"))
    assert got["no_run_id"].metadata_problems and got["unreadable"].triggered_exclusions == [pairing.E07]
    good = got["valid_quic"]
    assert (str(good.feed_date), good.matched_prefix, good.disclosure_class) == ("2026-03-02", "203.0.113.0/26", "city_level_consistent")
    assert (good.ingress_operator, good.egress_operator, good.same_operator) == ("one", "two", False)
    assert good.pin_contact_status == "intended_ingress_observed" and got["late_contact"].pin_contact_status == "intended_ingress_observed"
    assert got["e04_other"].pin_contact_status == "other_ingress_observed"


def test_eligibility_and_summaries(records):
    rows = {r.attempt_path[2:]: r for r in eligibility.eligibility(eligibility.records_for_eligibility(records)).collect()}
    good = rows["valid_quic"]
    assert good.objective_2_exact_pair_eligible and good.objective_3_location_eligible and not good.objective_3_primary_eligible
    assert good.objective_1_destination_result == "http3_preserved" and good.observation_date_utc == "2026-03-02"
    # The wrong ingress spoils the pair but not the destination leg.
    e04 = rows["e04_other"]
    assert e04.objective_1_destination_eligible and e04.objective_3_location_eligible and not e04.objective_2_exact_pair_eligible
    assert e04.objective_1_outer_leg_reason == (
        "missing_observed_ingress_ip;missing_ingress_transport;missing_ingress_5tuple;blocked_by_E04_WRONG_OR_UNKNOWN_INGRESS")
    assert rows["control"].objective_1_destination_result == "real_ip_bypass_http3"
    counts = {(r.kind, r.value): r.n for r in summaries.disposition_counts(records).collect()}
    assert counts[("disposition", "accepted")] == sum(s[2] == A_ for s in SCENARIOS.values())
    # Strata days come from the client clock, one day before the feed.
    days = {r.day for r in summaries.strata(records).select("day").distinct().collect()}
    assert days == {None, "2026-03-01"}


def test_ground_truth_needs_any_boundary():
    rules = lambda **more: pairing.PairingRules(**{**dict(hostname=HOST, private_ipv4=PRIVATE, true_country="GB", true_time_zone="Europe/London", intersection_rule="r", permitted_locations=(("GB", "", ""),)), **more})
    assert rules(allowed_countries=("GB",)).ground_truth_complete and rules(allowed_regions=("ENG",)).ground_truth_complete
    assert not rules().ground_truth_complete and not rules(allowed_cities=("x",), true_time_zone="").ground_truth_complete
    assert not rules(allowed_cities=("x",), permitted_locations=(("", "", ""),)).ground_truth_complete


def test_a_malformed_log_line_stops_the_job(spark):
    attempts = spark.createDataFrame([("a", "r")], "attempt_path string, run_id string")
    fields = "run_id string, request_uuid string, ts double, status int, remote_ip string, remote_port string, proto string, method string, host string, uri string, malformed boolean"
    logs = spark.createDataFrame([(None,) * 10 + (True,)], fields)
    with pytest.raises(Exception, match="malformed access-log line"):
        pairing.tagged_rows(attempts, logs, RULES).collect()
