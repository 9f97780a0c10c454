"""Campaign summaries over decided records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefixledger.functions import labels as L
from prefixledger.functions import values as V
from prefixledger.operators.pairing import E02, E03, E04, E07

# The dimensions of the strata report.
DIMENSIONS = [
    "pin_mode", "intended_ingress_group", "location_setting", "private_relay_state", "block_id", "session",
    "quic_block_state", "protocol_classification",
]


def disposition_counts(records: DataFrame) -> DataFrame:
    """``kind, value, n``: attempts per disposition and per exclusion reason."""
    pairs = F.array(
        F.struct(F.lit("disposition").alias("kind"), F.coalesce("disposition", F.lit("pending")).alias("value")),
        F.struct(F.lit("exclusion").alias("kind"), V.present(F.col("exclusion_reason")).alias("value")),
    )
    return records.select(F.explode(pairs).alias("p")).filter("p.value is not null").groupBy("p.kind", "p.value").agg(
        F.count("*").alias("n")
    )


def strata(records: DataFrame) -> DataFrame:
    """Attempts and dispositions per dimension value, for each day and overall (``day`` NULL).

    A record is reduced to its dimension tuple and counted before the unpivot, so
    the eight-fold expansion works on combinations and not on records.
    """
    day = F.substring(F.coalesce(V.present(F.col("client_start_utc")), F.lit("unknown")), 1, 10)
    group = F.col("intended_ingress_group")
    base = records.select(
        day.alias("day"),
        F.coalesce("disposition", F.lit("pending")).alias("disposition"),
        F.when(group == "unpinned", "unpinned").otherwise("pinned").alias("pin_mode"),
        *[F.coalesce(V.present(F.col(c).cast("string")), F.lit("unspecified")).alias(c) for c in DIMENSIONS[1:]],
    )
    combos = base.groupBy("day", "disposition", *DIMENSIONS).agg(F.count("*").alias("n"))
    long = combos.unpivot(["day", "disposition", "n"], DIMENSIONS, "dimension", "value")
    return long.groupingSets(
        [["day", "dimension", "value"], ["dimension", "value"]], "day", "dimension", "value"
    ).agg(
        F.sum("n").alias("attempts"),
        *[F.coalesce(F.sum(F.when(F.col("disposition") == d, F.col("n"))), F.lit(0)).alias(d) for d in ("accepted", "excluded", "pending")],
    )


def unpinned_sequence(records: DataFrame) -> DataFrame:
    """Unpinned relay-on records with ``order_time`` (server time, else client time); sort by it and ``run_id`` at the sink."""
    rows = records.filter((F.col("intended_ingress_group") == "unpinned") & (F.col("private_relay_state") == "on"))
    key = F.coalesce(V.present(F.col("server_time_utc")), V.present(F.col("client_start_utc")), F.lit(""))
    return rows.withColumn("order_time", key)


def temporal_intersection(sequence: DataFrame, declaration) -> DataFrame:
    """Common normalised value per declared field over the accepted rows, as one row per field.

    A single-row ``status`` frame is returned where the declaration or the data do
    not allow an evaluation. Two aggregated facts per field decide: whether any value
    is blank, and whether the smallest equals the largest.
    """
    spark = sequence.sparkSession
    out = "status string, field string, observations bigint, common string, distinct_raw bigint"
    status = lambda s: spark.createDataFrame([(s, None, 0, None, 0)], out)
    fields = {"country", "region", "city", "advertised_country", "advertised_region", "advertised_city"}
    if not declaration:
        return status("blocked_rule_not_declared")
    if isinstance(declaration, str):
        return status("manual_evaluation_required_for_free_text_rule")
    if not isinstance(declaration, dict):
        return status("invalid_rule_declaration")
    if declaration.get("rule_id") not in ("exact_value_intersection", "exact_advertised_field_intersection"):
        return status("unsupported_rule_id")
    if declaration.get("comparison_normalization") != "trim_casefold_preserve_raw":
        return status("unsupported_comparison_normalization")
    wanted = declaration.get("fields")
    if not isinstance(wanted, list) or not wanted or not set(wanted) <= fields or len(set(wanted)) != len(wanted):
        return status("invalid_or_unsupported_fields")
    accepted = sequence.filter("disposition = 'accepted'")
    column = lambda f: F.col(f if f.startswith("advertised_") else f"advertised_{f}")
    values = accepted.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.coalesce(column(f), F.lit("")).alias("raw")) for f in wanted
    ])).alias("v")).select("v.field", "v.raw", L.location_key(F.col("v.raw")).alias("key"))
    per_value = values.groupBy("field", "raw", "key").agg(F.count("*").alias("n"))
    facts = per_value.groupBy("field").agg(
        F.sum("n").alias("observations"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("distinct_raw")
    )
    grid = spark.createDataFrame([(f,) for f in wanted], "field string")
    facts = grid.join(facts, "field", "left")
    # One row over at most six fields: any blank value makes the whole rule incomplete.
    whole = facts.agg(F.struct(
        F.coalesce(F.max("observations"), F.lit(0)).alias("seen"), F.coalesce(F.bool_or(F.col("lo") == ""), F.lit(False)).alias("blank")
    )).scalar()
    facts = facts.withColumn("w", whole).select("*", "w.seen", "w.blank")
    verdict = (
        F.when(F.col("seen") == 0, "insufficient_accepted_unpinned_observations")
        .when(F.col("blank"), "incomplete_location_fields").otherwise("evaluated")
    )
    done = verdict == "evaluated"
    return facts.select(
        verdict.alias("status"), "field", F.coalesce("observations", F.lit(0)).alias("observations"),
        F.when(done & (F.col("lo") == F.col("hi")), F.col("lo")).alias("common"),
        F.coalesce("distinct_raw", F.lit(0)).alias("distinct_raw"),
    )


def origin_gaps(records: DataFrame) -> DataFrame:
    """Records that lack a dated origin, per feed date: run ids and both address sets in long form.

    ``date, kind (run_id, ingress, egress), value`` distinct, plus ``sort_key``: the
    numeric address. Long form, because one date may hold most of the rows.
    """
    gap = records.filter(F.col("pending_reason") == "dated_asn_mapping_missing")
    items = F.array(
        F.struct(F.lit("run_id").alias("kind"), F.col("run_id").alias("value")),
        F.struct(F.lit("ingress").alias("kind"), F.col("observed_ingress_ip").alias("value")),
        F.struct(F.lit("egress").alias("kind"), F.col("server_remote_ip").alias("value")),
    )
    from prefixledger.functions.address import v4_int

    return (
        gap.select(F.col("feed_date").alias("date"), F.explode(items).alias("i"))
        .select("date", "i.kind", "i.value").filter("value is not null").distinct()
        .withColumn("sort_key", v4_int(F.col("value")))
    )


def pilot_report(attempts: DataFrame, records: DataFrame, ladder: list[str], *, minimum_accepts: int = 1) -> DataFrame:
    """Per freshness method: attempts, accepted, reuse, no fresh flow, ambiguous, invalid, unpaired, mean seconds.

    The first method of the ladder that is clean (nothing invalid or unpaired, ingress always reliable) and has
    enough accepted attempts is selected. ``reused`` and ``attempt_invalid`` are optional columns of the inputs.
    """
    has = lambda df, c: F.coalesce(F.col(c), F.lit(False)) if c in df.columns else F.lit(False)
    decided = records.select(
        "attempt_path", "disposition", "exclusion_reason", "observed_ingress_ip", has(records, "reused").alias("reused"),
        F.lit(True).alias("paired"), (F.unix_micros("t_end") - F.unix_micros("t_start")).alias("micros"),
    )
    df = attempts.select("attempt_path", "freshness_method", has(attempts, "attempt_invalid").alias("bad")).join(decided, "attempt_path", "left")
    reason, ok = F.coalesce("exclusion_reason", F.lit("")), ~F.col("bad")
    accepted = ok & (F.col("disposition") == "accepted")
    counted = df.groupBy("freshness_method").agg(
        F.count("*").alias("attempts"),
        F.count_if(accepted).alias("accepted"),
        F.count_if(ok & F.col("reused")).alias("reused_connections"),
        F.count_if(ok & (reason == E03)).alias("no_fresh_flow"),
        F.count_if(ok & (reason == E02)).alias("ambiguous"),
        F.count_if("bad").alias("invalid"),
        F.count_if(ok & F.col("paired").isNull()).alias("unpaired"),
        F.count_if(ok & F.col("observed_ingress_ip").isNotNull() & ~reason.isin(E04, E07)).alias("reliable"),
        F.sum(F.when(accepted, F.col("micros"))).alias("micros"),
        F.count(F.when(accepted, F.col("micros"))).alias("timed"),
    )
    rank = F.array_position(F.array(*[F.lit(m) for m in ladder]), F.col("freshness_method"))
    clean = (F.col("invalid") == 0) & (F.col("unpaired") == 0) & (F.col("reliable") == F.col("attempts"))
    eligible = clean & (F.col("accepted") >= minimum_accepts) & (rank > 0)
    counted = counted.select(
        "*", clean.alias("clean"), rank.alias("ladder_rank"), eligible.alias("eligible"),
        F.round(F.col("micros") / F.nullif(F.col("timed"), F.lit(0)) / 1000000, 6).alias("mean_seconds"),
    ).drop("micros", "timed")
    choice = counted.agg(F.min_by("freshness_method", F.when(F.col("eligible"), F.col("ladder_rank"))))
    return counted.drop("eligible").withColumn("selected_method", choice.scalar())


def daily_report(strata_rows: DataFrame, eligibility_rows: DataFrame, day: str) -> DataFrame:
    """One day's strict counts beside its objective counts."""
    counts = ("attempts", "accepted", "excluded", "pending")
    strict = strata_rows.filter((F.col("day") == day) & (F.col("dimension") == "pin_mode")).agg(
        F.struct(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts])
    )
    objective = eligibility_rows.filter((F.col("day") == day) & (F.col("value") == "eligible")).select(
        F.col("measure"), F.col("n").alias("eligible")
    )
    return objective.withColumn("s", strict.scalar()).select(F.lit(day).alias("day"), "measure", "eligible", *[f"s.{c}" for c in counts])


def validation_report(records: DataFrame) -> DataFrame:
    """Run, disposition, protocol and the reason: exclusion code or what is pending."""
    return records.select(
        "run_id", "disposition", "protocol_classification",
        F.coalesce(V.present(F.col("exclusion_reason")), V.present(F.col("pending_reason")), F.lit("")).alias("reason"),
    )


def latest_retry(rows: DataFrame, slot: list[str], *, ties: str = "last") -> DataFrame:
    """The row of the highest retry number per slot; equal numbers keep the later (or first) ordinal."""
    ordinal = F.col("_ordinal") if ties == "last" else -F.col("_ordinal")
    others = [c for c in rows.columns if c not in slot]
    best = rows.groupBy(*slot).agg(F.max_by(F.struct(*others), F.struct("retry_number", ordinal.alias("o"))).alias("b"))
    return best.select(*slot, "b.*")


def condition_summary(results: DataFrame) -> DataFrame:
    """Latest retry per slot counted by acceptance and classification, with all attempts per condition.

    A result without a slot id stands for itself: its run id takes the slot's place.
    """
    own = V.present(F.col("slot_id"))
    by_slot = results.withColumn("slot_key", F.coalesce(own, F.col("run_id")) if "run_id" in results.columns else own)
    latest = latest_retry(by_slot, ["slot_key"])
    counts = latest.groupBy("condition", "acceptance", "classification").agg(F.count("*").alias("slots"))
    attempts = results.groupBy("condition").agg(F.count("*").alias("attempts"))
    return counts.join(attempts, "condition")


def series_completeness(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Planned slots (``slot_id, condition``) against the latest retry of each: one row of counts.

    A series is complete when every planned slot has a result and each has its planned condition;
    acceptance plays no part, and results of other slots are no part of the series.
    """
    latest = latest_retry(results, ["slot_id"]).select("slot_id", F.col("condition").alias("seen"), F.lit(True).alias("has"))
    merged = expected.select("slot_id", F.col("condition").alias("planned")).join(latest, "slot_id", "left")
    return merged.agg(
        F.count("*").alias("planned_total"),
        F.count("has").alias("finalized_slot_count"),
        F.count_if(F.col("has").isNull()).alias("missing"),
        F.bool_and(F.coalesce(F.col("seen") == F.col("planned"), F.lit(False))).alias("exact_condition_order"),
    ).withColumn("final_complete", (F.col("missing") == 0) & F.col("exact_condition_order"))


def probe_summary(results: DataFrame, slot: str) -> DataFrame:
    """The single-slot probe: its latest retry (the first of equal ones), never counted in a series; one row."""
    mine = results.filter(F.col("slot_id") == slot)
    best = mine.agg(F.max_by(F.struct("classification", "acceptance", "response_evidence_preserved"), F.struct(F.coalesce("retry_number", F.lit(0)), -F.col("_ordinal"))).alias("b"), F.count("*").alias("n"))
    return best.select(
        F.lit(1).alias("planned_total"), F.least("n", F.lit(1)).cast("int").alias("finalized_observation_count"),
        F.coalesce("b.response_evidence_preserved", F.lit(False)).alias("response_evidence_preserved"),
        F.col("b.classification").alias("classification"), F.col("b.acceptance").alias("acceptance"), (F.col("n") > 0).alias("final_complete"),
    )
