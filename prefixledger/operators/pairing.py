"""Pairing of client attempts with server log rows and packets under ordered exclusion rules.

Every step joins on a key of the attempt (run id, path or five-tuple) and reduces
with combinable aggregates, so a run id or flow that holds a large part of the
rows never has to be gathered: "several flows" is min <> max, a selected row is a
guarded ``max``. Evidence rows stay in long tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixledger.functions import address as A
from prefixledger.functions import labels as L
from prefixledger.functions import values as V
from prefixledger.operators import routing
from prefixledger.operators.intervals import PREFIX
from prefixledger.operators.time_tiles import join_points
from prefixledger.session import cut_lineage

# Exclusion codes, in the usual order of precedence.
E07 = "E07_CLOCK_OR_LOG_CORRUPTION"
E08 = "E08_CONDITION_CHANGED"
E01 = "E01_NO_SERVER_OBSERVATION"
E02 = "E02_MULTIPLE_SERVER_CONNECTIONS"
E05 = "E05_REAL_IP_AT_DESTINATION"
E03 = "E03_NO_FRESH_FLOW"
E04 = "E04_WRONG_OR_UNKNOWN_INGRESS"
E06 = "E06_EGRESS_NOT_IN_FEED"
PRECEDENCE = (E07, E08, E01, E02, E05, E03, E04, E06)

# Metadata fields an attempt must carry.
REQUIRED_METADATA = [
    "run_id", "campaign", "block_id", "attempt_number", "clock_status", "clock_evidence", "private_relay_state",
    "location_setting", "intended_ingress_group", "hostname", "url", "macos_version", "safari_version",
    "active_interface", "network_type", "real_public_ipv4", "freshness_method", "operator_condition_confirmation",
    "effective_dns", "approved_ingress_candidates", "capture_filter", "quic_block_state", "timeout_deadline_utc",
]
# Response fields of a successful attempt.
REQUIRED_RESPONSE = [
    "run_id", "server_utc", "server_unix_ms", "remote_ip", "remote_port", "http_protocol", "request_host",
    "request_uri", "request_uuid",
]
# Names of the life-cycle events and of the attribution policies.
START, LAUNCH, STOP, FINISH = "run_started", "safari_url_launch_requested", "capture_stopped", "run_finished"
FRESH_ONLY, BOUNDED, LEGACY = "fresh_handshake_v1", "bounded_candidate_contact_v2", "legacy_candidate_contact_v1"
TARGETED = "targeted_ingress_udp_443"


# Columns of an attempt with its selected row, and fields of that row, that the rules after the selection read.
DECIDED_FROM = [
    "attempt_path", "run_id", "sel", "t_launch", "t_stop", "t_deadline", "intended_ingress_ip", "intended_ingress_group", "ingress_attribution_policy",
    "quic_block_state", "condition_changed", "corrupt", "location_setting", "private_relay_state",
]
SELECTED_READ = ["ts", "remote_ip", "remote_port", "proto", "transport"]
# Columns of the ingress attribution that the rules read.
INGRESS_READ = ["attempt_path", "observed_ingress_ip", "ingress_transport", "unknown_policy"]
#: Rows up to which a table of dates or ASNs is broadcast, and copies of its rows beyond that.
FEW_ROWS, SALTS = 500_000, 16


@dataclass(frozen=True)
class PairingRules:
    """Parameters of one campaign."""

    hostname: str
    private_ipv4: str
    precedence: tuple[str, ...] = PRECEDENCE
    group_asns: dict[str, tuple[int, ...]] = field(default_factory=dict)
    fallback_name: str = ""
    true_country: str = ""
    true_time_zone: str = ""
    intersection_rule: str = ""
    permitted_locations: tuple[tuple[str, str, str], ...] = ()
    allowed_countries: tuple[str, ...] = ()
    allowed_regions: tuple[str, ...] = ()
    allowed_cities: tuple[str, ...] = ()

    @property
    def ground_truth_complete(self) -> bool:
        """Country, time zone, rule, permitted places and a boundary of any kind; cities only for the city boundary."""
        declared = self.true_country and self.true_time_zone and self.intersection_rule and self.permitted_locations
        boundary = self.allowed_countries or self.allowed_regions or self.allowed_cities
        return bool(declared and boundary) and all(any(rule) for rule in self.permitted_locations)


def lifecycle(events: DataFrame) -> DataFrame:
    """One row per attempt: times of the four life-cycle events, end fields, ``duplicate_event``."""
    at = lambda name, value: F.max(F.when(F.col("event") == name, value))
    count = lambda name: F.count_if(F.col("event") == name)
    duplicate = F.lit(False)
    for name in (START, LAUNCH, STOP, FINISH):
        duplicate = duplicate | (count(name) > 1)
    return events.groupBy("attempt_path").agg(
        at(START, F.col("recorded_utc")).alias("started_utc"),
        at(LAUNCH, F.col("recorded_utc")).alias("safari_launch_utc"),
        at(STOP, F.col("recorded_utc")).alias("capture_stopped_utc"),
        at(FINISH, F.col("recorded_utc")).alias("client_end_utc"),
        at(FINISH, F.col("outcome")).alias("client_outcome"),
        F.coalesce(at(FINISH, F.col("condition_changed")), F.lit(False)).alias("condition_changed"),
        at(FINISH, F.col("end_condition_confirmation")).alias("end_condition_confirmation"),
        duplicate.alias("duplicate_event"),
    )


def with_metadata_checks(attempts: DataFrame, events: DataFrame, *, listed: bool = True) -> DataFrame:
    """Attempts with parsed times, ``metadata_problems`` and ``corrupt`` (unreadable document, duplicate run id or event).

    An attempt without a run id stays and has the problem "run_id". ``malformed`` is an optional column of the documents scan.
    Where the problems are not to be ``listed``, the boolean ``metadata_bad`` says whether there are any.
    """
    found = V.messages if listed else V.any_of
    text_types = {f.name for f in attempts.schema if f.dataType.typeName() == "string"}
    absent = lambda c: F.coalesce(F.col(c), F.lit("")) == "" if c in text_types else F.col(c).isNull()
    # Repeated run ids are found on the two keys alone, so whole documents are never dealt by run id.
    keys = attempts.select("attempt_path", "run_id").filter("run_id is not null")
    repeated = keys.join(keys.groupBy("run_id").agg(F.count("*").alias("_n")).filter("_n > 1"), "run_id")
    runs = repeated.groupBy("attempt_path").agg(F.collect_set("run_id").alias("_repeated"))
    # What the documents alone decide is decided before the joins, so that these move only the columns still read.
    own = attempts.withColumns({
        "_absent": found(*[(absent(c), c) for c in REQUIRED_METADATA]),
        "_clock": found(
            (F.coalesce(F.col("clock_status"), F.lit("")) != "synchronized", "clock_status is not synchronized"),
            (~F.coalesce(F.col("clock_evidence.network_time").contains("On"), F.lit(False)), "network time state is not enabled"),
        ),
    })
    df = own.join(lifecycle(events), "attempt_path", "left").join(runs, "attempt_path", "left")
    df = df.withColumns({
        "client_start_utc": F.coalesce("started_utc", "client_start_utc"),
        "safari_launch_utc": F.coalesce("safari_launch_utc", "safari_launch_requested_utc"),
        "condition_changed": F.coalesce("condition_changed", F.lit(False)),
    }).drop("started_utc", "safari_launch_requested_utc")
    times = {"t_start": "client_start_utc", "t_launch": "safari_launch_utc", "t_stop": "capture_stopped_utc",
             "t_end": "client_end_utc", "t_deadline": "timeout_deadline_utc"}
    df = df.withColumns({t: V.utc_timestamp(F.col(c)) for t, c in times.items()})
    in_order = (F.col("t_start") <= F.col("t_launch")) & (F.col("t_launch") <= F.col("t_stop")) & (F.col("t_stop") <= F.col("t_end"))
    parts = [
        F.col("_absent"), found((~F.coalesce(in_order, F.lit(False)), "attempt event chronology is inconsistent")), F.col("_clock"),
        found((V.present(F.col("end_condition_confirmation")).isNull(), "end condition confirmation is missing")),
    ]
    problems = F.concat(*parts) if listed else parts[0] | parts[1] | parts[2] | parts[3]
    unreadable = F.coalesce(F.col("malformed"), F.lit(False)) if "malformed" in attempts.columns else F.lit(False)
    corrupt = (
        F.when(unreadable, "unreadable attempt document")
        .when(F.col("duplicate_event"), "duplicate lifecycle event")
        .when(F.array_contains("_repeated", F.col("run_id")), "duplicate client run_id")
    )
    df = df.withColumn("metadata_problems" if listed else "metadata_bad", problems)
    return df.withColumn("corrupt", corrupt).drop("_absent", "_clock", "_repeated")


def tagged_rows(attempts: DataFrame, logs: DataFrame, rules: PairingRules) -> DataFrame:
    """Log rows of each attempt's run id with ``is_exact``, ``is_bad`` (schema), ``transport`` and ``flow_key``.

    ``logs`` has the flattened fields ``run_id, request_uuid, ts, status, remote_ip,
    remote_port, proto, method, host, uri`` and provenance columns. A malformed log line stops the job: a part of
    the log would decide attempts wrongly. A run id of several attempts (corrupt anyway) meets no rows.
    """
    keyed = attempts.groupBy("run_id").agg(F.count("*").alias("k"), F.min("attempt_path").alias("attempt_path")).filter("k = 1").drop("k")
    if "malformed" in logs.columns:
        logs = logs.withColumn("run_id", F.when(F.col("malformed"), F.raise_error(F.lit("malformed access-log line")).cast("string")).otherwise(F.col("run_id")))
    joined = logs.join(keyed, "run_id")
    uri_ok = F.col("uri") == F.concat(F.lit("/probe/"), F.col("run_id"))
    host_ok = V.host_without_port(F.col("host")) == rules.hostname
    exact = uri_ok & host_ok & (F.col("method") == "GET")
    port = F.trim(F.col("remote_port").cast("string")).try_cast("int")
    missing = F.lit(False)
    for c in ("remote_ip", "remote_port", "proto", "method", "host", "uri"):
        missing = missing | (F.coalesce(F.col(c).cast("string"), F.lit("")) == "")
    good = (
        ~missing & A.canonical_v4(F.col("remote_ip")).isNotNull() & port.between(1, 65535)
        & F.col("ts").isNotNull() & F.col("status").isNotNull()
        & exact & F.col("proto").startswith("HTTP/") & V.present(F.col("request_uuid")).isNotNull()
    )
    transport = V.transport_of(F.col("proto"))
    return joined.select(
        *joined.columns,
        F.coalesce(exact, F.lit(False)).alias("is_exact"),
        (~F.coalesce(good, F.lit(False))).alias("is_bad"),
        transport.alias("transport"),
        V.flow_key(transport, A.canonical_v4(F.col("remote_ip")), port, F.lit(rules.private_ipv4)).alias("flow_key"),
    )


def delivery_sequence(tagged: DataFrame) -> DataFrame:
    """Exact deliveries in long form; order by ``attempt_path, ts, artifact, line_number`` at the sink."""
    return tagged.filter("is_exact").select(
        "attempt_path", V.utc_text(V.epoch_timestamp(F.col("ts"))).alias("server_time_utc"), "remote_ip", "remote_port",
        F.col("proto").alias("http_protocol"), "transport", "request_uuid", "flow_key", "row_sha256", "artifact",
        "line_number", "ts",
    )


_ROW = ["ts", "status", "remote_ip", "remote_port", "proto", "transport", "request_uuid", "flow_key", "row_sha256", "artifact", "line_number"]


def with_selected_row(attempts: DataFrame, responses: DataFrame, tagged: DataFrame, fields: list[str] = _ROW) -> DataFrame:
    """Attach the response and the selected log row (``fields`` of it) with the multiplicity facts of the tagged rows."""
    answer = responses.select("attempt_path", F.struct(*[c for c in responses.columns if c != "attempt_path"]).alias("response"))
    uuid = answer.select("attempt_path", V.present(F.col("response.request_uuid")).alias("want_uuid"))
    rows = tagged.join(uuid, "attempt_path", "left")
    row = F.struct(*fields)
    exact, match = F.col("is_exact"), F.col("is_exact") & (F.col("request_uuid") == F.col("want_uuid"))
    facts = rows.groupBy("attempt_path").agg(
        F.count_if(exact).alias("server_delivery_count"),
        F.count_if("is_bad").alias("bad_rows"),
        F.count_if(match).alias("uuid_rows"),
        F.max(F.when(match, row)).alias("matched_row"),
        F.max(F.when(exact, row)).alias("only_row"),
        F.min(F.when(exact, F.col("flow_key"))).alias("first_flow"),
        F.max(F.when(exact, F.col("flow_key"))).alias("last_flow"),
        F.min(F.when(exact & (F.col("transport") == "udp"), F.struct("ts", "artifact", "line_number"))).alias("first_udp"),
        F.min(F.when(exact & (F.col("transport") == "tcp"), F.struct("ts", "artifact", "line_number"))).alias("first_tcp"),
    )
    df = attempts.join(answer, "attempt_path", "left").join(facts, "attempt_path", "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    has_uuid = V.present(F.col("response.request_uuid")).isNotNull()
    selected = F.when(has_uuid, F.when(F.col("uuid_rows") == 1, F.col("matched_row"))).otherwise(
        F.when(F.col("server_delivery_count") == 1, F.col("only_row"))
    )
    return df.select(
        *attempts.columns,
        "response",
        count("server_delivery_count").alias("server_delivery_count"),
        count("bad_rows").alias("bad_rows"),
        selected.alias("sel"),
        F.coalesce(has_uuid & (F.col("uuid_rows") > 1), F.lit(False)).alias("duplicate_uuid"),
        F.coalesce(~has_uuid & (F.col("server_delivery_count") > 1), F.lit(False)).alias("rows_without_uuid"),
        F.coalesce(F.col("first_flow") != F.col("last_flow"), F.lit(False)).alias("several_flows"),
        "first_udp",
        "first_tcp",
    )


def response_problems(rules: PairingRules, *, listed: bool = True) -> Column:
    """Contradictions between response, client outcome and selected log row; not ``listed``: whether there are any."""
    r = lambda c: F.col(f"response.{c}")
    has, sel = F.col("response").isNotNull(), F.col("sel").isNotNull()
    success = F.col("client_outcome") == "success"
    server_time = V.endpoint_timestamp(r("server_utc"))
    server_ms = r("server_unix_ms").cast("double")
    utc_ms = F.unix_micros(server_time) / 1000
    expected = {
        "remote_ip": F.col("sel.remote_ip"),
        "remote_port": F.col("sel.remote_port").cast("string"),
        "http_protocol": F.col("sel.proto"),
        "request_host": F.lit(rules.hostname),
        "request_uri": F.concat(F.lit("/probe/"), F.col("run_id")),
        "request_uuid": F.col("sel.request_uuid"),
    }
    text = lambda c: F.coalesce(r(c).cast("string"), F.lit(""))
    return (V.messages if listed else V.any_of)(
        (success & ~has, "successful attempt has no response"),
        *[(success & has & (text(c) == ""), f"response.{c} is missing") for c in REQUIRED_RESPONSE],
        (has & ~F.coalesce(r("run_id") == F.col("run_id"), F.lit(False)), "response run_id does not equal client run_id"),
        (has & (server_time.isNull() | server_ms.isNull()), "invalid response server timestamp"),
        (has & (F.abs(server_ms - utc_ms) > 2000), "response clocks differ by more than 2 seconds"),
        *[(has & sel & (text(c) != F.coalesce(e, F.lit(""))), f"response.{c} does not match the log row") for c, e in expected.items()],
        (has & sel & (F.abs(server_ms - F.col("sel.ts") * 1000) > 2000), "response time differs from the log row by more than 2 seconds"),
        (has & sel & ~F.coalesce(F.col("sel.status") == 200, F.lit(False)), "selected log row status is not 200"),
    )


def connection_identity() -> Column:
    """Identity of a server-side connection start within a five-tuple.

    UDP: the five-tuple itself, whatever its connection ids. TCP: the raw sequence
    number, else artifact and stream, else the tuple.
    """
    stream = V.present(F.col("stream"))
    return (
        F.when(F.col("transport") == "udp", "quic-five-tuple")
        .when(F.col("tcp_seq_raw").isNotNull(), F.concat(F.lit("tcp-sequence|"), F.col("tcp_seq_raw").cast("string")))
        .when(stream.isNotNull(), F.concat_ws("|", F.lit("tcp-stream"), F.coalesce("artifact_sha256", "artifact", F.lit("")), stream))
        .otherwise("tcp-five-tuple")
    )


def fresh_flows(selected: DataFrame, server_packets: DataFrame, rules: PairingRules) -> DataFrame:
    """Freshness verdict per attempt that has a selected row.

    ``identities`` with a start packet between launch and the earlier of capture
    stop and log time, ``fresh`` when there is exactly one and its first packet is
    not before launch. The join is on five-tuple and time tile, so a
    capture that stops late costs a few rows more and not one for each minute.
    """
    starts = server_packets.filter(
        V.setup_packet(server_side=True) & F.col("time_epoch").isNotNull()
        & (F.col("dst_ip") == rules.private_ipv4) & (F.col("dst_port") == 443)
    ).select(
        "transport", F.col("src_ip").alias("remote_ip"), F.col("src_port").cast("int").alias("remote_port"),
        connection_identity().alias("identity"), "time_epoch", "frame_number", "artifact", "artifact_sha256", "quic_dcid",
    )
    tuple_ = ["transport", "remote_ip", "remote_port"]
    first = starts.groupBy(*tuple_, "identity").agg(
        F.min("time_epoch").alias("first_epoch"),
        F.min_by(F.struct("frame_number", "artifact", "artifact_sha256", "quic_dcid"), F.struct("time_epoch", "frame_number")).alias("first_packet"),
    )
    seconds = lambda c: F.unix_micros(F.col(c)) / 1000000
    windows = selected.filter(F.col("sel").isNotNull() & F.col("t_launch").isNotNull() & F.col("t_stop").isNotNull()).select(
        "attempt_path",
        F.col("sel.transport").alias("transport"),
        F.col("sel.remote_ip").alias("remote_ip"),
        F.col("sel.remote_port").cast("int").alias("remote_port"),
        seconds("t_launch").alias("w_from"),
        F.least(seconds("t_stop"), F.col("sel.ts")).alias("w_to"),
    ).filter(F.col("w_from") <= F.col("w_to"))
    hits = join_points(windows, starts.select(*tuple_, "identity", "time_epoch"), tuple_, start="w_from", stop="w_to", at="time_epoch")
    live = hits.groupBy("attempt_path", *tuple_, "identity", "w_from").agg(F.count("*").alias("in_window"))
    per_attempt = live.join(first, [*tuple_, "identity"]).groupBy("attempt_path").agg(
        F.count("*").alias("identities"),
        F.min("identity").alias("identity"),
        F.min("first_epoch").alias("first_epoch"),
        F.min("w_from").alias("w_from"),
        F.min_by("first_packet", "first_epoch").alias("first_packet"),
    )
    one = F.col("identities") == 1
    fresh = one & (F.col("first_epoch") >= F.col("w_from"))
    return per_attempt.select(
        "attempt_path",
        (F.col("identities") > 1).alias("ambiguous_connection"),
        fresh.alias("fresh"),
        F.when(fresh, F.struct(
            F.when(F.col("identity") == "quic-five-tuple", "quic_initial").otherwise("tcp_syn").alias("kind"),
            F.col("first_epoch"), F.col("identity").alias("connection_identity"), "first_packet",
        )).alias("freshness_evidence"),
    )


def candidate_addresses(attempts: DataFrame) -> DataFrame:
    """Long table ``attempt_path, ingress_ip, in_scope, bounded`` of candidate ingress addresses.

    In scope: approved candidates and the intended pin. Bounded (may be attributed):
    the intended pin alone, else this attempt's resolver answers, else the approved
    list of early records.
    """
    v4 = lambda arr: F.array_distinct(F.array_compact(F.transform(F.coalesce(arr, F.array().cast("array<string>")), lambda x: A.canonical_v4(x))))
    pin = A.canonical_v4(F.col("intended_ingress_ip"))
    approved = v4(F.col("approved_ingress_candidates"))
    have = set(attempts.columns)
    opt = lambda c: v4(F.col(c)) if c in have else F.array().cast("array<string>")
    answers = v4(F.flatten(F.transform(
        F.coalesce(F.map_values("effective_dns.hostnames"), F.array()),
        lambda h: F.coalesce(F.transform(h["A"], lambda a: a["address"]), F.array().cast("array<string>")),
    )))
    direct = F.array_union(F.array_union(opt("dns_ingress_candidates"), opt("macos_effective_ingress_candidates")), answers)
    # Each list is parsed once, in a step of its own.
    lists = attempts.select("attempt_path", pin.alias("pin"), approved.alias("approved"), direct.alias("direct"))
    own, approved, direct = F.array("pin"), F.col("approved"), F.col("direct")
    bounded = F.when(F.col("pin").isNotNull(), own).when(F.size(direct) > 0, direct).otherwise(approved)
    scope = F.when(F.col("pin").isNotNull(), F.array_union(approved, own)).otherwise(approved)
    return lists.select("attempt_path", scope.alias("s"), bounded.alias("b")).select(
        "attempt_path", "s", "b", F.explode(F.array_union("s", "b")).alias("ingress_ip")
    ).select(
        "attempt_path", "ingress_ip", F.array_contains("s", F.col("ingress_ip")).alias("in_scope"),
        F.array_contains("b", F.col("ingress_ip")).alias("bounded"),
    )


def client_contacts(selected: DataFrame, client_packets: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """First contact packet per flow to an in-scope candidate within the attribution window.

    ``candidates`` is :func:`candidate_addresses` of the same attempts where ``selected`` lacks their columns.
    The window runs from launch to the selected log row when that is inside the
    capture, else to capture stop. ``is_fresh`` marks flows with a connection start.
    """
    end = F.when(
        V.epoch_timestamp(F.col("sel.ts")).between(F.col("t_launch"), F.col("t_stop")), V.epoch_timestamp(F.col("sel.ts"))
    ).otherwise(F.col("t_stop"))
    windows = selected.select("attempt_path", F.col("t_launch").alias("w_from"), end.alias("w_to"))
    packets = client_packets.filter((F.col("dst_port") == 443) & V.contact_packet() & F.col("time_epoch").isNotNull())
    at = V.epoch_timestamp(F.col("time_epoch"))
    inside = packets.join(windows, "attempt_path").filter(at.between(F.col("w_from"), F.col("w_to")))
    candidates = candidate_addresses(selected) if candidates is None else candidates
    hits = inside.withColumnRenamed("dst_ip", "ingress_ip").join(candidates.filter("in_scope"), ["attempt_path", "ingress_ip"])
    order = F.struct("artifact", "frame_number")
    packet = F.struct("artifact_sha256", "artifact", "frame_number", "time_epoch")
    src = F.coalesce(F.col("src_ip"), F.lit(""))
    port = F.coalesce(F.col("src_port"), F.lit(0)).cast("int")
    return (
        hits.withColumns({"src_ip": src, "src_port": port})
        .groupBy("attempt_path", "transport", "src_ip", "src_port", "ingress_ip", "bounded")
        .agg(
            F.min_by(packet, order).alias("first_packet"),
            F.max(V.setup_packet()).alias("is_fresh"),
            F.min_by(packet, F.when(V.setup_packet(), order)).alias("first_fresh_packet"),
        )
        .withColumn("five_tuple", V.flow_key(F.col("transport"), F.col("src_ip"), F.col("src_port"), F.col("ingress_ip")))
    )


def _contact_status(pin: Column, lowest: Column, highest: Column, hit_pin: Column) -> Column:
    return (
        F.when(pin.isNull(), "not_applicable")
        .when((lowest == pin) & (highest == pin), "intended_ingress_observed")
        .when(hit_pin, "intended_and_other_ingresses_observed")
        .when(lowest.isNotNull(), "other_ingress_observed")
        .otherwise("intended_ingress_not_observed")
    )


def ingress_attribution(selected: DataFrame, contacts: DataFrame) -> DataFrame:
    """Observed ingress per attempt under its policy, with both pin contact statuses."""
    base = selected.select(
        "attempt_path", V.present(F.col("intended_ingress_ip")).alias("pin"),
        F.coalesce("ingress_attribution_policy", F.lit(BOUNDED)).alias("policy"),
        (F.coalesce("quic_block_state", F.lit("")) == TARGETED).alias("fallback"),
    )
    ip, fresh = F.col("ingress_ip"), F.col("is_fresh")
    joined = base.join(contacts, "attempt_path", "left")
    aggs = []
    for name, cond in {"all": F.lit(True), "fresh": fresh}.items():
        pick = lambda c, cond=cond: F.when(cond, c)
        aggs += [
            F.min(pick(ip)).alias(f"{name}_lo"), F.max(pick(ip)).alias(f"{name}_hi"),
            F.coalesce(F.bool_or(pick(ip == F.col("pin"))), F.lit(False)).alias(f"{name}_pin"),
        ]
    # What may be chosen under the attempt's policy: fresh bounded contacts, and without a single one of them all bounded ones.
    policy, bounded = F.col("policy"), F.col("bounded")
    strict = policy.isin(FRESH_ONLY, BOUNDED) & bounded & fresh
    wide = ((policy == BOUNDED) & bounded) | (policy == LEGACY)
    for name, cond in {"strict": strict, "wide": wide}.items():
        pick = lambda c, cond=cond: F.when(cond, c)
        flow = F.struct("transport", "src_ip", "src_port", "five_tuple")
        aggs += [
            F.min(pick(ip)).alias(f"{name}_lo"), F.max(pick(ip)).alias(f"{name}_hi"),
            F.min(pick(F.col("transport"))).alias(f"{name}_tlo"), F.max(pick(F.col("transport"))).alias(f"{name}_thi"),
            F.min(pick(flow)).alias(f"{name}_flow"),
            F.min(F.when(cond & F.col("fallback") & (F.col("transport") == "tcp"), flow)).alias(f"{name}_tcp"),
        ]
    facts = joined.groupBy("attempt_path", "pin", "policy", "fallback").agg(*aggs)
    one_fresh = F.coalesce(F.col("strict_lo") == F.col("strict_hi"), F.lit(False))

    def chosen(suffix: str) -> Column:
        return F.when((policy == FRESH_ONLY) | one_fresh, F.col(f"strict_{suffix}")).otherwise(F.col(f"wide_{suffix}"))

    facts = facts.select(
        "*", *[chosen(s).alias(f"c_{s}") for s in ("lo", "hi", "tlo", "thi", "flow", "tcp")]
    )
    single = F.coalesce(F.col("c_lo") == F.col("c_hi"), F.lit(False))
    flow = F.when(F.col("fallback"), F.col("c_tcp")).otherwise(F.when(F.col("c_tlo") == F.col("c_thi"), F.col("c_flow")))
    found = single & flow.isNotNull()
    return facts.select(
        "attempt_path",
        F.when(found, F.col("c_lo")).alias("observed_ingress_ip"),
        F.when(found, flow["transport"]).alias("ingress_transport"),
        F.when(found, flow["five_tuple"]).alias("ingress_5tuple"),
        _contact_status(F.col("pin"), F.col("all_lo"), F.col("all_hi"), F.col("all_pin")).alias("pin_contact_status"),
        _contact_status(F.col("pin"), F.col("fresh_lo"), F.col("fresh_hi"), F.col("fresh_pin")).alias("fresh_pin_contact_status"),
        F.col("all_lo").isNotNull().alias("has_contacts"),
        F.array_distinct(F.array_compact(F.array("c_lo", "c_hi"))).alias("attribution_ips"),
        F.col("c_lo").isNull().alias("no_contact"),
        F.coalesce(F.col("c_lo") != F.col("c_hi"), F.lit(False)).alias("several_ingresses"),
        (~F.col("policy").isin(FRESH_ONLY, BOUNDED, LEGACY)).alias("unknown_policy"),
    )


def named_queries(selected: DataFrame, query_log: DataFrame, name: str, qtype: int = 1) -> DataFrame:
    """DNS queries for one name and type between launch and capture stop, per attempt."""
    at = V.utc_timestamp(F.col("recorded_utc"))
    clean = F.lower(F.regexp_replace(F.coalesce("name", F.lit("")), r"\.+$", ""))
    wanted = query_log.filter((clean == name) & (F.col("qtype") == qtype) & F.coalesce(F.col("supported"), F.lit(True)))
    return wanted.join(selected.select("attempt_path", "t_launch", "t_stop"), "attempt_path").filter(
        at.between(F.col("t_launch"), F.col("t_stop"))
    ).drop("t_launch", "t_stop")


def dns_condition_changed(query_log: DataFrame) -> DataFrame:
    """Attempts whose resolver saw a query type other than A and AAAA; an unreadable type counts as other."""
    qtype = F.coalesce(V.lenient_integer(F.col("qtype")), F.lit(-1))
    return query_log.groupBy("attempt_path").agg(F.bool_or(~qtype.isin(1, 28)).alias("dns_condition_changed"))


def _address_probe(df: DataFrame, ip: str, date: str, keep: list[str]) -> DataFrame:
    return A.with_address(df.select(*keep, F.col(ip).alias("_ip"), F.col(date).alias("date")), "_ip", family=4)


def _few(df: DataFrame) -> DataFrame:
    """``df`` as a broadcast while it is counted to be small: a date or an ASN may hold most records, which must not meet in one task."""
    return F.broadcast(df) if df.limit(FEW_ROWS + 1).count() <= FEW_ROWS else df


def _join_spread(df: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """Left join by a column that few values fill: by broadcast, or with rows of one value dealt over ``SALTS`` copies of it."""
    held = _few(small)
    if held is not small:
        return df.join(held, key, "left")
    salted = df.withColumn("_salt", F.pmod(F.xxhash64("attempt_path"), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [key, "_salt"], "left").drop("_salt")


def with_feed_and_origin(df: DataFrame, feed: DataFrame, feed_days: DataFrame, origins: DataFrame, operators: DataFrame, probes: DataFrame | None = None) -> DataFrame:
    """Attach the same-day feed match, dated origins of both ends and their operators.

    ``feed``: ``date, PREFIX, ip_prefix, country, region, city, _ordinal``;
    ``feed_days``: ``date, files, conflict``; ``origins``: ``date, PREFIX, asn``;
    ``operators``: ``asn, operator_id``. ``df`` needs ``feed_date, server_remote_ip, observed_ingress_ip``, as does
    ``probes`` (``df`` if not given), a cheaper frame of the same attempts from which the addresses are read.
    """
    fields = ["ip_prefix", "country", "region", "city"]
    probes = df if probes is None else probes
    egress = cut_lineage(_address_probe(probes, "server_remote_ip", "feed_date", ["attempt_path"]))
    ingress = _address_probe(probes, "observed_ingress_ip", "feed_date", ["attempt_path"])
    key = ["date", *PREFIX]
    feed_hit = egress.join(routing.match_first(egress, feed, fields, ("date",)).select(*key, *fields), key).select(
        "attempt_path", F.col("ip_prefix").alias("matched_prefix"), *[F.col(c).alias(f"advertised_{c}") for c in fields[1:]]
    )
    both = egress.withColumn("side", F.lit("egress")).unionByName(ingress.withColumn("side", F.lit("ingress")))
    hits = routing.match_unique(both, origins, ["asn"], ("date",)).select(*key, "asn")
    asn = both.join(hits, key).groupBy("attempt_path").agg(
        *[F.max(F.when(F.col("side") == s, F.col("asn"))).cast("bigint").alias(f"{s}_asn") for s in ("ingress", "egress")]
    )
    out = df.join(feed_hit, "attempt_path", "left").join(asn, "attempt_path", "left")
    out = _join_spread(out, feed_days.withColumnRenamed("date", "feed_date"), "feed_date")
    for side in ("ingress", "egress"):
        side_ops = operators.select(F.col("asn").alias(f"{side}_asn"), F.col("operator_id").alias(f"{side}_operator"))
        out = _join_spread(out, side_ops, f"{side}_asn")
    return out


def disclosure_class(rules: PairingRules) -> Column:
    """Class of the advertised location under the declared ground truth; NULL where it cannot be judged."""
    if not rules.ground_truth_complete:
        return F.lit(None).cast("string")
    loc = {c: L.location_key(F.col(f"advertised_{c}")) for c in ("country", "region", "city")}
    permitted = F.lit(False)
    for rule in rules.permitted_locations:
        hit = F.lit(True)
        for (c, value), want in zip(loc.items(), rule):
            if want:
                hit = hit & (value == want.strip().lower())
        permitted = permitted | hit
    country = rules.true_country.strip().lower()
    cities = [c.strip().lower() for c in rules.allowed_cities]
    boundary = F.lit(None).cast("string") if not any(cities) else (
        F.when((loc["country"] == "") | (loc["city"] == ""), "unclassifiable")
        .when(loc["country"] != country, "inconsistent")
        .when(loc["city"].isin(cities), "city_level_consistent")
        .otherwise("primary_boundary_non_match")
    )
    return (
        F.when(F.col("location_setting") == "country_and_time_zone",
               F.when(permitted, "within_declared_country_time_zone").otherwise("outside_declared_country_time_zone"))
        .when(F.col("location_setting") == "maintain_general_location", boundary)
    )


def protocol_class() -> Column:
    """Protocol outcome of a decided record."""
    reason, proto, transport = F.col("exclusion_reason"), F.coalesce("server_http_protocol", F.lit("")), F.col("server_transport")
    quic = proto.startswith("HTTP/3") & (transport == "udp")
    control = (F.col("private_relay_state") == "off_control") & (reason == E05)
    return (
        F.when(control, F.when(quic, "direct_http3_control").when(transport == "tcp", "direct_tcp_control").otherwise("ambiguous"))
        .when(reason == E05, "real_ip_bypass")
        .when(reason == E01, "dropped_or_timeout")
        .when(reason == E02, F.when(F.col("both_transports"), F.when(F.col("udp_first"), "mixed_http3_then_tcp_delivery")
                                    .otherwise("mixed_tcp_then_http3_delivery")).otherwise("ambiguous"))
        .when(reason.isin(E03, E04, E07, E08), "ambiguous")
        .when(F.col("disposition") == "pending", "pending")
        .when(quic, "http3_preserved")
        .when(transport == "tcp", "tcp_downgrade")
        .otherwise("ambiguous")
    )


def first_in(precedence: tuple[str, ...], triggered: Column) -> Column:
    """The first code of ``precedence`` that was triggered."""
    return F.coalesce(*[F.when(F.array_contains(triggered, c), c) for c in precedence])


def own_facts(df: DataFrame) -> dict[str, Column]:
    """What the rules read of an attempt and its selected row besides ``DECIDED_FROM``: booleans, so nothing wider is stored."""
    false = F.lit(False)
    real = A.canonical_v4(F.col("real_public_ipv4"))
    pin = V.present(F.col("intended_ingress_ip"))
    approved = F.coalesce("approved_pin_group_addresses", F.array().cast("array<string>"))
    listed = "metadata_problems" in df.columns
    bad = (F.size("metadata_problems") > 0) | (F.size("response_problems") > 0) if listed else F.col("metadata_bad") | F.col("response_bad")
    return {
        "evidence_bad": bad | (F.col("bad_rows") > 0) | F.col("duplicate_uuid"),
        "several_connections": F.col("several_flows") | F.col("rows_without_uuid"),
        "pin_not_approved": (F.col("intended_ingress_group") != "unpinned") & ~F.coalesce(F.array_contains(approved, pin), false),
        "real_at_server": F.coalesce(F.col("sel.remote_ip") == real, false),
        "real_malformed": V.present(F.col("real_public_ipv4")).isNotNull() & real.isNull(),
        "both_transports": F.col("first_udp").isNotNull() & F.col("first_tcp").isNotNull(),
        "udp_first": F.coalesce(F.col("first_udp") < F.col("first_tcp"), false),
    }


def _selected_fields(columns: list[str] | None) -> list[str]:
    return _ROW if columns is None or "sel" in columns else [f for f in _ROW if f in (*SELECTED_READ, "status", "request_uuid") or f"sel.{f}" in columns]


def _carried(selected: DataFrame, columns: list[str]) -> DataFrame:
    """``selected`` with what the later steps and ``columns`` read; ``sel.x`` asks for a field of the selected row."""
    fields = [f for f in _ROW if f in SELECTED_READ or f"sel.{f}" in columns]
    row = F.when(F.col("sel").isNotNull(), F.struct(*[F.col(f"sel.{f}").alias(f) for f in fields])).alias("sel")
    wanted = {*DECIDED_FROM, *columns}
    kept = [row if c == "sel" and c not in columns else c for c in selected.columns if c in wanted]
    return selected.select(*kept, *[fact.alias(name) for name, fact in own_facts(selected).items()])


def pair_attempts(
    attempts: DataFrame, events: DataFrame, responses: DataFrame, logs: DataFrame, server_packets: DataFrame,
    client_packets: DataFrame, feed: DataFrame, feed_days: DataFrame, origins: DataFrame, operators: DataFrame,
    rules: PairingRules, *, firewall: DataFrame | None = None, columns: list[str] | None = None,
) -> DataFrame:
    """One decided record per attempt: evidence, triggered codes, disposition, protocol class.

    ``firewall`` (optional): ``attempt_path, targeted_state_reset_utc, blocked_packets``. With ``columns`` (``sel.x`` for
    a field of the selected row) the records hold these and the frames stored on the way nothing else that no rule
    reads; such records are not stored themselves, as one pass over them needs no more than the plan.
    """
    listed = columns is None or not {"metadata_problems", "response_problems"}.isdisjoint(columns)
    checked = with_metadata_checks(attempts, events, listed=listed)
    # The rows need the run ids of the attempts alone, and not the checks, which would be made twice.
    selected = with_selected_row(checked, responses, tagged_rows(attempts, logs, rules), _selected_fields(columns))
    selected = selected.withColumn("response_problems" if listed else "response_bad", response_problems(rules, listed=listed))
    selected = cut_lineage(selected if columns is None else _carried(selected, columns))
    fresh = fresh_flows(selected, server_packets, rules)
    ingress = ingress_attribution(selected, client_contacts(selected, client_packets, candidate_addresses(attempts)))
    ingress = cut_lineage(ingress if columns is None else ingress.select(*[c for c in ingress.columns if c in (*INGRESS_READ, *columns)]))
    df = selected.join(fresh, "attempt_path", "left").join(ingress, "attempt_path", "left")
    has = F.col("sel").isNotNull()
    server_time = V.epoch_timestamp(F.col("sel.ts"))
    probes = selected.join(ingress, "attempt_path", "left").select(
        "attempt_path", "observed_ingress_ip", F.col("sel.remote_ip").alias("server_remote_ip"), F.to_date(server_time).alias("feed_date")
    )
    df = df.withColumns({
        "server_time": server_time,
        "server_time_utc": V.utc_text(server_time),
        "server_remote_ip": F.col("sel.remote_ip"),
        "server_remote_port": F.col("sel.remote_port"),
        "server_transport": F.col("sel.transport"),
        "server_http_protocol": F.col("sel.proto"),
        "feed_date": F.to_date(server_time),
    })
    if firewall is not None:
        df = df.join(firewall, "attempt_path", "left")
    else:
        df = df.withColumns({"targeted_state_reset_utc": F.lit(None).cast("string"), "blocked_packets": F.lit(None).cast("bigint")})
    decided = decide(with_feed_and_origin(df, feed, feed_days, origins, operators, probes), rules)
    if columns is None:
        return cut_lineage(decided)
    return decided.select(*[c for c in dict.fromkeys(c.split(".")[0] for c in columns)])


def decide(df: DataFrame, rules: PairingRules) -> DataFrame:
    """Triggered codes in rule order, then disposition by precedence, then the protocol class."""
    if "evidence_bad" not in df.columns:
        df = df.withColumns(facts := own_facts(df))
        return decide(df, rules).drop(*facts)
    false = F.lit(False)
    is_ = lambda c: F.coalesce(c, false)
    has = F.col("sel").isNotNull()
    pin = V.present(F.col("intended_ingress_ip"))
    observed = F.col("observed_ingress_ip")
    in_capture = F.col("server_time").between(F.col("t_launch"), F.col("t_stop"))
    fallback = F.coalesce("quic_block_state", F.lit("")) == TARGETED
    wrong_group = false
    for group, asns in rules.group_asns.items():
        wrong_group = wrong_group | ((F.col("intended_ingress_group") == group) & ~F.col("ingress_asn").isin(*asns))
    both_ends = F.col("feed_date").isNotNull() & observed.isNotNull() & F.col("server_remote_ip").isNotNull()
    mapped = F.col("ingress_asn").isNotNull() & F.col("egress_asn").isNotNull()
    feed_conflict = is_(F.col("conflict"))
    one_feed = is_(F.col("files") == 1)
    matched = F.col("matched_prefix").isNotNull()
    df = df.withColumn("disclosure_class", F.when(matched & one_feed & ~feed_conflict, disclosure_class(rules)))

    checks = [
        (F.col("evidence_bad"), E07),
        (F.col("condition_changed"), E08),
        (~has, E01),
        (F.col("several_connections"), E02),
        (has & ~is_(in_capture), E07),
        (has & is_(F.col("server_time") > F.col("t_deadline")), E08),
        (has & is_(F.col("ambiguous_connection")), E02),
        (has & ~is_(F.col("ambiguous_connection")) & ~is_(F.col("fresh")), E03),
        (is_(F.col("unknown_policy")), E07),
        (observed.isNull() | is_(pin.isNotNull() & (observed != pin)), E04),
        (F.col("pin_not_approved"), E04),
        (fallback & ~is_(F.col("ingress_transport") == "tcp"), E04),
        (fallback & V.present(F.col("targeted_state_reset_utc")).isNull(), E04),
        (fallback & (F.coalesce("blocked_packets", F.lit(0)) < 1), E04),
        (F.col("real_at_server"), E05),
        (F.col("real_malformed"), E07),
        (has & one_feed & feed_conflict, E07),
        (has & one_feed & ~feed_conflict & ~matched, E06),
        (both_ends & mapped & is_(wrong_group), E04),
    ]
    triggered = F.array_distinct(V.messages(*checks))
    corrupt = F.col("corrupt").isNotNull()
    df = df.withColumn("triggered_exclusions", F.when(corrupt, F.array(F.lit(E07))).otherwise(triggered))
    # Later stages overwrite the reason, so the last one that applies is listed first.
    pending = (
        F.when(matched & one_feed & ~feed_conflict & F.col("disclosure_class").isNull(), "objective_3_configuration_incomplete")
        .when(both_ends & mapped & (F.col("ingress_operator").isNull() | F.col("egress_operator").isNull()), "operator_mapping_missing")
        .when(both_ends & ~mapped, "dated_asn_mapping_missing")
        .when(has & (F.coalesce("files", F.lit(0)) == 0), "same_day_apple_feed_missing")
        .when(has & (F.col("files") > 1), "multiple_same_day_apple_feeds")
    )
    df = df.withColumn("exclusion_reason", first_in(rules.precedence, F.col("triggered_exclusions")))
    df = df.withColumn("pending_reason", F.when(~corrupt, pending))
    df = df.withColumn(
        "disposition",
        F.when(F.col("exclusion_reason").isNotNull(), "excluded")
        .when(F.col("pending_reason").isNotNull(), "pending")
        .otherwise("accepted"),
    )
    df = df.withColumn("same_operator", F.col("ingress_operator") == F.col("egress_operator"))
    return df.withColumn("protocol_classification", protocol_class())
