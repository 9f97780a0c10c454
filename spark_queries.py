"""The registered queries: each derives its inputs from the given tables and runs library operators on all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixledger.operators import allocation, churn, routing
from prefixledger.plans import derived as D
from prefixledger.session import cut_lineage

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _text(df: DataFrame, *columns: str) -> DataFrame:
    """Wide counts and dates as text, so both engines hash the same values."""
    return df.select(*[F.col(c).cast("string").alias(c) if c in columns else F.col(c) for c in df.columns])


@query
def country_series(spark, sf):
    return _text(allocation.country_series(D.catalogue(spark, sf)), "snapshot_date", "ipv6_64_blocks")


@query
def snapshot_series(spark, sf):
    return _text(allocation.snapshot_series(cut_lineage(D.catalogue(spark, sf))), "snapshot_date", "ipv6_64_blocks")


def _series(spark, sf):
    return churn.churn_series(cut_lineage(D.catalogue(spark, sf))).withColumn(
        "interval_days", F.col("interval_days").cast("bigint")
    )


def _pieces(spark, sf):
    paired = cut_lineage(churn.paired_prefixes(cut_lineage(D.catalogue(spark, sf))))
    return cut_lineage(churn.overlay(paired))


@query
def churn_series(spark, sf):
    return _text(_series(spark, sf), "date_from", "date_to", "added_addrs", "removed_addrs", "reassigned_addrs")


@query
def pair_summary(spark, sf):
    return _text(churn.pair_summary(_series(spark, sf)), "date_from", "date_to")


@query
def plot_series(spark, sf):
    return _text(churn.plot_series(_series(spark, sf)), "date_from", "date_to")


@query
def churn_transitions(spark, sf):
    return _text(churn.transitions(_pieces(spark, sf)).drop("interval_days"), "date_from", "date_to", "addresses")


@query
def top_transitions(spark, sf):
    top = churn.top_transitions(churn.transitions(_pieces(spark, sf)))
    return _text(top.select("date_from", "family", "from_city", "to_city", "addresses", "rank"), "date_from", "addresses")


@query
def catalogue_changes(spark, sf):
    changes = churn.catalogue_changes(churn.paired_prefixes(cut_lineage(D.catalogue(spark, sf))))
    return _text(
        changes.select("date_from", "date_to", "family", "change_kind", "cidr", "country", "region", "city"),
        "date_from", "date_to",
    )


@query
def country_allocation(spark, sf):
    return _text(allocation.country_allocation(D.lenient_catalogue(spark, sf)), "ipv6_64_blocks")


@query
def country_share(spark, sf):
    return allocation.country_share(allocation.country_allocation(D.lenient_catalogue(spark, sf)), "eu")


@query
def top_countries(spark, sf):
    rows = D.lenient_catalogue(spark, sf)
    valid = rows.filter(F.col("family").isNotNull())
    return allocation.top_countries(allocation.country_allocation(rows), allocation.first_seen(valid), 3).select(
        "country", "total_prefixes"
    )


@query
def duplicate_cidrs(spark, sf):
    return allocation.duplicate_summary(allocation.duplicate_cidrs(D.lenient_catalogue(spark, sf)))


@query
def malformed_rows(spark, sf):
    return allocation.malformed(D.lenient_catalogue(spark, sf)).select("malformed")


@query
def overlap_report(spark, sf):
    report = allocation.overlap_report(cut_lineage(D.lenient_catalogue(spark, sf)), longest=64)
    return _text(report, "naive_addresses", "addresses", "over_count")


def _attributed(spark, sf, rows):
    return routing.with_operator(routing.attribute(rows, D.routes(spark, sf)), D.as_names(spark, sf))


def _lenient(spark, sf):
    return _attributed(spark, sf, D.lenient_catalogue(spark, sf))


@query
def route_lookup(spark, sf):
    from prefixledger.functions import address as A

    rows = routing.attribute(D.lenient_catalogue(spark, sf), D.routes(spark, sf)).filter("outcome is not null")
    offset = F.when(F.col("family") == 4, A.v4_from_half(F.col("hi")) - D.V4_BASE).otherwise(
        F.col("hi").bitwiseXOR(F.lit(A.ZERO_HALF)) - D.V6_BASE
    )
    return rows.select("family", offset.alias("slot_offset"), "plen", "outcome", "asn", "route")


@query
def attribution_quality(spark, sf):
    return routing.attribution_quality(_lenient(spark, sf))


@query
def operator_mix(spark, sf):
    return routing.operator_mix(_lenient(spark, sf))


@query
def operator_mix_collapsed(spark, sf):
    rows = cut_lineage(_lenient(spark, sf))
    return routing.operator_mix(rows, collapsed=True)


@query
def operator_report(spark, sf):
    return routing.operator_report(cut_lineage(routing.operator_mix(_lenient(spark, sf))), 5)


@query
def operator_series(spark, sf):
    rows = cut_lineage(_attributed(spark, sf, D.catalogue(spark, sf)))
    return _text(routing.operator_series(rows), "snapshot_date")


@query
def route_series(spark, sf):
    return _text(routing.route_series(_attributed(spark, sf, D.catalogue(spark, sf))), "snapshot_date")


@query
def route_comparison(spark, sf):
    return routing.route_comparison(cut_lineage(_lenient(spark, sf)), D.routes(spark, sf))


@query
def asn_breakdown(spark, sf):
    return routing.asn_breakdown(_lenient(spark, sf))


@query
def per_asn_share(spark, sf):
    return routing.per_asn_share(_lenient(spark, sf))


@query
def snapshot_report(spark, sf):
    return routing.snapshot_report(_lenient(spark, sf), "EU")


# Evidence queries. Each stands alone: it decides the records it reports on.
from prefixledger.functions import address as A  # noqa: E402
from prefixledger.functions import values as V  # noqa: E402
from prefixledger.operators import campaign, diagnostics, eligibility, enumeration, manifests, pairing, quality, summaries  # noqa: E402
from prefixledger.sources import evidence  # noqa: E402

RULES = pairing.PairingRules(
    hostname=D.HOST, private_ipv4=D.PRIVATE, group_asns={"pinned_group": (D.FIRST_ASN,)}, true_country="EU", true_time_zone="Europe/London", intersection_rule="exact_value_intersection",
    permitted_locations=(("EU", "", ""), ("AS", "", "")), allowed_cities=("BUILDING", "MACHINERY"),
)

def _pairs(spark, sf, *columns):
    """Decided records with ``columns``; nothing else is stored on the way."""
    return pairing.pair_attempts(
        D.attempts(spark, sf), D.attempt_events(spark, sf), D.responses(spark, sf), D.log_rows(spark, sf), D.server_packets(spark, sf),
        D.client_packets(spark, sf), D.feed(spark, sf), D.feed_days(spark, sf), D.origins(spark, sf), D.operators(spark, sf), RULES, columns=list(columns),
    )


@query
def pair_records(spark, sf):
    records = _pairs(
        spark, sf, "run_id", "disposition", "exclusion_reason", "pending_reason", "triggered_exclusions", "protocol_classification", "matched_prefix",
        "advertised_country", "advertised_city", "disclosure_class", "ingress_asn", "egress_asn", "same_operator", "server_delivery_count",
        "pin_contact_status", "observed_ingress_ip", "ingress_transport",
    )
    return records.select(
        "run_id", "disposition", "exclusion_reason", "pending_reason", F.array_join("triggered_exclusions", ",").alias("triggered"),
        "protocol_classification", "matched_prefix", "advertised_country", "advertised_city", "disclosure_class", "ingress_asn", "egress_asn",
        "same_operator", "server_delivery_count", "pin_contact_status", "observed_ingress_ip", "ingress_transport",
    )


@query
def log_selection(spark, sf):
    checked = pairing.with_metadata_checks(D.attempts(spark, sf), D.attempt_events(spark, sf))
    tagged = pairing.tagged_rows(checked, D.log_rows(spark, sf), RULES)
    chosen = pairing.with_selected_row(checked, D.responses(spark, sf), tagged)
    return chosen.select("run_id", "server_delivery_count", "bad_rows", F.col("sel.request_uuid").alias("selected_uuid"), "rows_without_uuid", "several_flows")


@query
def server_freshness(spark, sf):
    checked = pairing.with_metadata_checks(D.attempts(spark, sf), D.attempt_events(spark, sf))
    tagged = pairing.tagged_rows(checked, D.log_rows(spark, sf), RULES)
    chosen = pairing.with_selected_row(checked, D.responses(spark, sf), tagged)
    fresh = pairing.fresh_flows(chosen, D.server_packets(spark, sf), RULES)
    return fresh.select("attempt_path", "fresh", "ambiguous_connection", F.col("freshness_evidence.kind").alias("kind"))


def _eligibility(spark, sf):
    return eligibility.eligibility(eligibility.records_for_eligibility(_pairs(spark, sf, *eligibility.READ)))


@query
def objective_eligibility(spark, sf):
    return _eligibility(spark, sf).select(
        "run_id", "objective_1_destination_eligible", "objective_1_destination_reason", "objective_1_destination_result",
        "objective_1_outer_leg_eligible", "objective_2_exact_pair_eligible", "objective_3_location_eligible", "objective_3_primary_eligible",
        "observation_date_utc",
    )


@query
def eligibility_summary(spark, sf):
    return eligibility.eligibility_summary(_eligibility(spark, sf)).withColumn("day", F.coalesce("day", F.lit("all")))


@query
def strata(spark, sf):
    columns = ["client_start_utc", "disposition", *summaries.DIMENSIONS[1:]]
    return summaries.strata(_pairs(spark, sf, *columns)).withColumn("day", F.coalesce("day", F.lit("all")))


@query
def disposition_counts(spark, sf):
    return summaries.disposition_counts(_pairs(spark, sf, "disposition", "exclusion_reason"))


@query
def temporal_intersection(spark, sf):
    rule = {"rule_id": "exact_value_intersection", "comparison_normalization": "trim_casefold_preserve_raw", "fields": ["country", "region"]}
    records = _pairs(
        spark, sf, "intended_ingress_group", "private_relay_state", "server_time_utc", "client_start_utc", "disposition",
        "advertised_country", "advertised_region", "advertised_city",
    )
    return summaries.temporal_intersection(cut_lineage(summaries.unpinned_sequence(records)), rule)


@query
def origin_gaps(spark, sf):
    return _text(summaries.origin_gaps(_pairs(spark, sf, "run_id", "pending_reason", "feed_date", "observed_ingress_ip", "server_remote_ip")), "date")


@query
def freshness_pilot(spark, sf):
    records = _pairs(spark, sf, "attempt_path", "disposition", "exclusion_reason", "observed_ingress_ip", "t_start", "t_end")
    return summaries.pilot_report(D.attempts(spark, sf), cut_lineage(records), ["new_window", "quit_browser"], minimum_accepts=1)


@query
def validation_report(spark, sf):
    return summaries.validation_report(
        _pairs(spark, sf, "run_id", "disposition", "protocol_classification", "exclusion_reason", "pending_reason"))


@query
def log_dedupe(spark, sf):
    rows = evidence.first_copies(evidence.log_lines(D.log_text(spark, sf)))
    return rows.select("run_id", "request_uuid", "artifact", "line_number", "remote_ip", "proto", "status", "malformed")


@query
def packet_normalisation(spark, sf):
    return evidence.normalize_packets(D.packet_text(spark, sf)).select(
        "attempt_path", "frame_number", "time_epoch", "src_ip", "dst_ip", "transport", "src_port", "dst_port", "tcp_syn", "tcp_ack", "tcp_len", "quic_initial"
    )


@query
def timestamp_parsing(spark, sf):
    t = D._attempt_base(spark, sf)
    micros = (F.col("e") % 1000000).cast("string")
    go = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("."), F.lpad(micros, 6, "0"), F.lit("789 +0000 UTC m=+1.5"))
    bad = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    return t.select(
        "run_id", F.unix_micros(V.endpoint_timestamp(go)).alias("endpoint_micros"), F.unix_micros(V.utc_timestamp(F.col("t5"))).alias("iso_micros"),
        V.utc_timestamp(bad).isNull().alias("offset_rejected"),
    )


@query
def source_blocks(spark, sf):
    return enumeration.source_blocks(D.announced(spark, sf)).select("block", enumeration.block_text(F.col("block")).alias("prefix"))


def _blocks(spark, sf):
    return cut_lineage(enumeration.source_blocks(D.announced(spark, sf)))


@query
def scope_coverage(spark, sf):
    blocks = _blocks(spark, sf)
    return enumeration.scope_coverage(blocks, D.scan_outcomes(blocks)).select("block", "state", "skip_until")


@query
def enumeration_summary(spark, sf):
    blocks = _blocks(spark, sf)
    outcomes = D.scan_outcomes(blocks)
    return enumeration.enumeration_summary(enumeration.scope_coverage(blocks, outcomes), outcomes, D.scan_results(blocks))


@query
def unique_addresses(spark, sf):
    return enumeration.unique_addresses(D.scan_results(_blocks(spark, sf)))


@query
def resolver_transcripts(spark, sf):
    return enumeration.transcript_rows(D.transcripts(spark, sf))


@query
def resolver_answer_lines(spark, sf):
    lines = enumeration.answer_lines(D.transcripts(spark, sf))
    return lines.groupBy("type", "name", "ttl").agg(F.count("*").alias("n"), F.count_distinct("value").alias("vals"))


@query
def manifest_check(spark, sf):
    return manifests.verify_manifest(*D.document_manifest(spark, sf))


@query
def daily_artifacts(spark, sf):
    files = D.document_manifest(spark, sf)[1]
    day = F.lpad((F.length("path") % 28 + 1).cast("string"), 2, "0")
    dated = files.select(F.concat("path", F.lit("-2026-01-"), day, F.lit(".log")).alias("path"), "sha256", F.lit(None).cast("timestamp").alias("modified"))
    return manifests.daily_counts(manifests.daily_index(dated.unionByName(dated)))


@query
def catalogue_violations(spark, sf):
    rows = D.lenient_catalogue(spark, sf).withColumn("snapshot_date", F.to_date(F.lit(D.DAYS[0]))).withColumn("bad_shape", F.col("_ordinal") % 70 == 69)
    found = quality.catalogue_violations(cut_lineage(rows))
    return found.groupBy("rule").agg(F.count("*").alias("n"))


@query
def origin_violations(spark, sf):
    key = F.col("s_suppkey")
    rows = D.table(spark, sf, "supplier").select(
        F.when(key % 7 == 0, "2026-02-30").otherwise("2026-02-03").alias("date"),
        F.when(key % 11 == 0, "10.0.0.0/40").otherwise(F.concat(A.v4_text(F.lit(D.V4_BASE) + F.floor(key / 2) * 256), F.lit("/24"))).alias("prefix"),
        F.when(key % 13 == 0, "0").otherwise("64500").alias("asn"), F.when(key % 17 == 0, " ").otherwise("x").alias("source"),
        F.when(key % 19 == 0, "zz").otherwise(F.sha2(key.cast("string"), 256)).alias("source_hash"),
    )
    return quality.origin_violations(A.with_prefix(rows, "prefix")).groupBy("rule").agg(F.count("*").alias("n"))


def _trials(spark, sf):
    t = D.trials(spark, sf)
    candidates = t.select("attempt_path", F.lit(D.PIN).alias("ingress_ip"), F.lit(True).alias("attributable"))
    days = D.catalogue(spark, sf).filter((F.col("family") == 4) & (F.col("snapshot_date") == D.DAYS[0]))
    return diagnostics.pair_trials(
        t, D.responses(spark, sf), D.log_rows(spark, sf), D.server_packets(spark, sf), D.trial_packets(spark, sf), candidates,
        D.trial_firewall(spark, sf), days, private_ipv4=D.PRIVATE, anchor=D.ANCHOR, label=D.LABEL,
    )


@query
def diagnostic_trials(spark, sf):
    return _trials(spark, sf).select("run_id", "condition", "outer_transport", "server_transport", "catalogue_match", "direct_origin_contact", "classification", "acceptance")


@query
def condition_summary(spark, sf):
    # Read for the latest retries and for all attempts.
    return summaries.condition_summary(cut_lineage(_trials(spark, sf)))


@query
def handshake_contacts(spark, sf):
    t = D.trials(spark, sf)
    candidates = t.select("attempt_path", F.lit(D.PIN).alias("ingress_ip"), F.lit(True).alias("attributable"))
    found = diagnostics.outer_contacts(t, D.trial_packets(spark, sf), candidates)
    return found.select("attempt_path", "transport", "client_port", "ingress_ip", "intended", "bidirectional", "established")


@query
def plan_violations(spark, sf):
    attempts, slots = D.plan_attempts(spark, sf)
    found = campaign.plan_violations(attempts, slots, plan_sha256="plan", maximum=2)
    return found.groupBy("rule").agg(F.count("*").alias("n"))


@query
def reconstructed_origins(spark, sf):
    ev, planned = D.route_evidence(spark, sf)
    return campaign.reconstructed_origins(ev, planned, timestamps_per_day=2).select("address", "prefix", "asn", "problem")


@query
def required_runs(spark, sf):
    return campaign.required_runs(D.attempts(spark, sf), D.log_rows(spark, sf), exactly_once=True)


@query
def pending_addresses(spark, sf):
    return _text(campaign.pending_addresses(_pairs(spark, sf, "pending_reason", "feed_date", "observed_ingress_ip", "server_remote_ip")), "date")


@query
def source_list_check(spark, sf):
    return quality.source_list_violations(cut_lineage(D.numbered_blocks(spark, sf))).select("rule", "key")


@query
def stored_series_check(spark, sf):
    return quality.churn_series_violations(D.stored_series(spark, sf)).select("rule", "key")


@query
def slot_retries(spark, sf):
    results, _ = D.slot_results(spark, sf)
    return summaries.latest_retry(results, ["slot_id"]).select("slot_id", "retry_number", "condition", "acceptance", "classification")


@query
def slot_completeness(spark, sf):
    return summaries.series_completeness(*D.slot_results(spark, sf))


@query
def host_names(spark, sf):
    return enumeration.address_names(D.host_answers(spark, sf), ["q3", "n5"])


@query
def packet_counters(spark, sf):
    return D.counter_texts(spark, sf).select(
        "event_id", V.single_packet_counter(F.col("listing")).alias("counter"), V.structured_present(F.col("cell")).alias("present")
    )
