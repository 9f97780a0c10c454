"""Objective-specific eligibility of decided pair records; the strict disposition stays as it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixledger.functions import values as V
from prefixledger.operators.pairing import E01, E02, E03, E04, E05, E06, E07, E08

# Codes that block each objective; reasons list them in code order.
SERVER_BLOCKERS = [E01, E02, E03, E07, E08]
OUTER_BLOCKERS = sorted([*SERVER_BLOCKERS, E04])
PAIR_BLOCKERS = sorted([*OUTER_BLOCKERS, E05, E06])
LOCATION_BLOCKERS = sorted([*SERVER_BLOCKERS, E05, E06])
# Summary columns.
FLAGS = [
    "objective_1_destination_eligible", "objective_1_outer_leg_eligible", "objective_2_exact_pair_eligible",
    "objective_3_location_eligible", "objective_3_primary_eligible",
]


def _absent(name: str) -> Column:
    return V.present(F.col(name).cast("string")).isNull()


def _missing(*names: str) -> list[tuple[Column, str]]:
    return [(_absent(n), f"missing_{n}") for n in names]


def _reasons(missing: Column, blockers: list[str]) -> Column:
    """Missing evidence in check order, then the blocking codes in code order."""
    return F.concat(missing, V.messages(*[(F.array_contains("triggered_exclusions", b), f"blocked_by_{b}") for b in sorted(blockers)]))


def _decide(df: DataFrame, name: str, reasons: Column) -> DataFrame:
    df = df.withColumn("_r", reasons)
    eligible = F.size("_r") == 0
    return df.withColumns({
        f"{name}_eligible": eligible,
        f"{name}_reason": F.when(eligible, "eligible").otherwise(F.array_join("_r", ";")),
    }).drop("_r")


def destination_result(eligible: Column) -> Column:
    """Label of the destination delivery alone, independent of the ingress side."""
    proto = F.coalesce("server_http_protocol", F.lit(""))
    transport = F.coalesce("server_transport", F.lit(""))
    suffix = (
        F.when(proto.startswith("HTTP/3") & (transport == "udp"), "http3")
        .when(proto.startswith("HTTP/2") & (transport == "tcp"), "http2")
        .otherwise(F.concat(F.coalesce(V.present(transport), F.lit("unknown")), F.lit("_delivery")))
    )
    hit = lambda code: F.array_contains("triggered_exclusions", code)
    return (
        F.when(~eligible, "ineligible")
        .when(hit(E05), F.concat(F.lit("real_ip_bypass_"), suffix))
        .when(hit(E06), F.concat(F.lit("non_feed_"), suffix))
        .when(F.col("private_relay_state") == "off_control", F.concat(F.lit("direct_"), suffix, F.lit("_control")))
        .when(~F.col("has_feed_match"), F.concat(F.lit("feed_unverified_"), suffix))
        .when(suffix == "http3", "http3_preserved")
        .when(suffix == "http2", "http2_delivered")
        .otherwise(suffix)
    )


def eligibility(records: DataFrame) -> DataFrame:
    """Four eligibility decisions with ordered reasons and the destination result per record."""
    server = V.messages(
        (~F.coalesce(F.col("client_outcome") == "success", F.lit(False)), "client_outcome_not_success"),
        (F.coalesce("condition_changed", F.lit(False)), "condition_changed"),
        (~F.coalesce(F.col("server_delivery_count") == 1, F.lit(False)), "server_delivery_count_not_one"),
        (~F.coalesce(F.col("response_status") == 200, F.lit(False)), "response_status_not_200"),
        *_missing("server_time_utc", "server_remote_ip", "server_remote_port", "server_transport",
                  "server_http_protocol", "server_flow_key", "request_uuid"),
        (~F.col("has_freshness_evidence"), "missing_freshness_evidence"),
    )
    df = _decide(records, "objective_1_destination", _reasons(server, SERVER_BLOCKERS))
    destination = F.col("objective_1_destination_eligible")
    df = df.withColumn("objective_1_destination_result", destination_result(destination))
    outer = V.messages(
        (~destination, "destination_leg_ineligible"),
        *_missing("observed_ingress_ip", "ingress_transport", "ingress_5tuple"),
        (~F.col("has_contacts"), "missing_client_ingress_candidates"),
    )
    df = _decide(df, "objective_1_outer_leg", _reasons(outer, OUTER_BLOCKERS))
    selected = V.present(F.col("observed_ingress_ip"))
    others = F.exists("attribution_ips", lambda ip: ip != selected)
    pair = V.messages(
        (~F.col("objective_1_outer_leg_eligible"), "outer_leg_ineligible"),
        (~F.coalesce(F.col("private_relay_state") == "on", F.lit(False)), "private_relay_not_on"),
        *_missing("ingress_asn", "egress_asn", "ingress_operator", "egress_operator"),
        (selected.isNotNull() & others, "ambiguous_attribution_ingress_contact"),
        (selected.isNotNull() & ~F.array_contains("attribution_ips", selected), "selected_ingress_absent_from_attribution_contacts"),
        (F.col("same_operator").isNull(), "missing_same_operator_result"),
    )
    df = _decide(df, "objective_2_exact_pair", _reasons(pair, PAIR_BLOCKERS))
    location = V.messages(
        (~destination, "destination_leg_ineligible"),
        (~F.coalesce(F.col("private_relay_state") == "on", F.lit(False)), "private_relay_not_on"),
        *_missing("apple_feed_date", "apple_feed_hash", "matched_prefix", "advertised_country", "disclosure_class"),
        (~F.col("has_feed_match"), "missing_apple_feed_match"),
    )
    df = _decide(df, "objective_3_location", _reasons(location, LOCATION_BLOCKERS))
    unpinned = F.coalesce(F.col("intended_ingress_group") == "unpinned", F.lit(False))
    return df.withColumns({
        "objective_3_analysis_role": F.when(unpinned, "primary_unpinned").otherwise("supporting_pinned"),
        "objective_3_primary_eligible": F.col("objective_3_location_eligible") & unpinned,
        "observation_date_utc": F.substring(F.coalesce(V.present(F.col("server_time_utc")), V.present(F.col("client_start_utc")), F.lit("")), 1, 10),
    })


#: Columns of a decided pair frame that :func:`records_for_eligibility` and :func:`eligibility` read.
READ = [
    "attempt_path", "run_id", "client_outcome", "condition_changed", "server_delivery_count", "sel.status", "sel.flow_key", "sel.request_uuid",
    "server_time_utc", "server_remote_ip", "server_remote_port", "server_transport", "server_http_protocol", "freshness_evidence",
    "triggered_exclusions", "private_relay_state", "observed_ingress_ip", "ingress_transport", "ingress_5tuple", "has_contacts", "attribution_ips",
    "ingress_asn", "egress_asn", "ingress_operator", "egress_operator", "same_operator", "feed_date", "feed_sha256", "matched_prefix",
    "advertised_country", "disclosure_class", "intended_ingress_group", "client_start_utc",
]


def records_for_eligibility(pairs: DataFrame) -> DataFrame:
    """The columns of a decided pair frame that the eligibility rules read."""
    return pairs.withColumns({
        "response_status": F.col("sel.status"),
        "server_flow_key": F.col("sel.flow_key"),
        "request_uuid": F.col("sel.request_uuid"),
        "has_freshness_evidence": F.col("freshness_evidence").isNotNull(),
        "has_feed_match": F.col("matched_prefix").isNotNull(),
        "apple_feed_date": F.col("feed_date").cast("string"),
        "apple_feed_hash": F.col("feed_sha256"),
        "attribution_ips": F.coalesce("attribution_ips", F.array().cast("array<string>")),
        "has_contacts": F.coalesce("has_contacts", F.lit(False)),
    })


def eligibility_summary(rows: DataFrame) -> DataFrame:
    """Counts per flag value and per destination result, for each day and overall (day NULL)."""
    flags = F.array(
        *[F.struct(F.lit(f).alias("measure"), F.when(F.col(f), "eligible").otherwise("ineligible").alias("value")) for f in FLAGS],
        F.struct(F.lit("objective_1_destination_result").alias("measure"), F.col("objective_1_destination_result").alias("value")),
    )
    # Combined per day first: the grouping sets then expand a handful of rows.
    daily = (
        rows.select(F.col("observation_date_utc").alias("day"), F.explode(flags).alias("m"))
        .groupBy("day", "m.measure", "m.value").agg(F.count("*").alias("n"))
    )
    return daily.groupingSets([["day", "measure", "value"], ["measure", "value"]], "day", "measure", "value").agg(F.sum("n").alias("n"))
