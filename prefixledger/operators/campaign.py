"""Plan conformance, safety latch, DNS conditions and historical origin reconstruction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefixledger.functions import address as A
from prefixledger.functions import values as V
from prefixledger.operators.intervals import PREFIX
from prefixledger.operators.quality import violations

# Outcomes after which another attempt of a slot is allowed.
RETRYABLE = ("error", "timeout", "prepare_error", "aborted")
#: Plan positions that one task orders at a time.
PLAN_RANGE = 4096


def plan_violations(attempts: DataFrame, slots: DataFrame, *, plan_sha256: str, maximum: int, retryable=RETRYABLE) -> DataFrame:
    """Attempts of a campaign against its frozen plan.

    ``attempts``: ``slot_id, retry_number, outcome, execution_plan_sha256, started_at``;
    ``slots``: ``slot_id, position``. Rules: foreign plan, unknown slot, repeated
    slot and retry, retry number out of range, retry without its predecessor or after
    a success, an attempt that began while an earlier slot was still open, and an attempt
    after a later slot had been started (back-fill). A slot is complete with its first success or
    with a technical failure on the last retry. Positions and times are
    compared through running maxima over ranges of positions and inside each range.
    """
    key = F.concat_ws(" ", "slot_id", F.col("retry_number").cast("string"))
    mine = attempts.filter(F.col("execution_plan_sha256") == plan_sha256)
    known = mine.join(slots, "slot_id")
    repeated = mine.groupBy("slot_id", "retry_number").agg(F.count("*").alias("n"))
    previous = mine.groupBy("slot_id", (F.col("retry_number") + 1).alias("retry_number")).agg(
        F.count("*").alias("n"), F.max("outcome").alias("before")
    )
    retries = mine.filter("retry_number > 1").join(previous, ["slot_id", "retry_number"], "left")
    done = (F.col("outcome") == "success") | (F.col("outcome").isin(*retryable) & (F.col("retry_number") == maximum))
    per_slot = slots.join(
        mine.groupBy("slot_id").agg(F.min(F.when(done, F.col("started_at"))).alias("complete_at"), F.min("started_at").alias("first_at"), F.max("started_at").alias("last_at")),
        "slot_id", "left",
    )
    ordered = _around(per_slot)
    placed = known.join(ordered, "slot_id")
    return reduce(DataFrame.unionByName, [
        violations(attempts, "foreign_plan", ~F.coalesce(F.col("execution_plan_sha256") == plan_sha256, F.lit(False)), key),
        violations(mine.join(slots, "slot_id", "left_anti"), "unknown_slot", F.lit(True), key),
        violations(repeated, "repeated_retry", F.col("n") > 1, key),
        violations(mine, "retry_out_of_range", ~F.col("retry_number").between(1, maximum), key),
        violations(retries, "retry_not_allowed", ~F.coalesce((F.col("n") == 1) & F.col("before").isin(*retryable), F.lit(False)), key),
        violations(placed, "earlier_slot_open", ~F.col("earlier_complete") | F.coalesce(F.col("earlier_complete_at") >= F.col("started_at"), F.lit(False)), key),
        violations(placed, "back_fill", F.col("started_at") > F.col("later_started"), key),
    ])


def _around(per_slot: DataFrame) -> DataFrame:
    """``slot_id`` with what holds for all slots before and after its position.

    Running values go over ranges of positions first (one row each), then over the slots of one range, so no task
    holds more than ``PLAN_RANGE`` positions. Slots without a position come first.
    """
    ranged = per_slot.withColumn("range", F.coalesce(F.floor(F.col("position") / PLAN_RANGE), F.lit(-(2**62))))
    done = F.col("complete_at").isNotNull()
    edges = ranged.groupBy("range").agg(F.min(done).alias("all_done"), F.max("complete_at").alias("last_done"), F.min("first_at").alias("first_begun"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    after = lambda w: w.rowsBetween(1, Window.unboundedFollowing)
    ranges, inside = Window.orderBy("range"), Window.partitionBy("range").orderBy("position")
    carried = edges.select(
        "range",
        F.min("all_done").over(before(ranges)).alias("ranges_done"),
        F.max("last_done").over(before(ranges)).alias("ranges_done_at"),
        F.min("first_begun").over(after(ranges)).alias("ranges_begun"),
    )
    return ranged.join(carried, "range").select(
        "slot_id",
        (F.coalesce(F.min(done).over(before(inside)), F.lit(True)) & F.coalesce("ranges_done", F.lit(True))).alias("earlier_complete"),
        F.greatest(F.max("complete_at").over(before(inside)), "ranges_done_at").alias("earlier_complete_at"),
        F.least(F.min("first_at").over(after(inside)), "ranges_begun").alias("later_started"),
    )


def safety_stops(attempts: DataFrame) -> DataFrame:
    """Latched safety-stop reasons, one row each: real-address bypass, changed condition, explicit code."""
    bypass = F.coalesce(F.col("outcome") == "direct_bypass", F.lit(False)) | F.coalesce(
        V.present(F.col("response_remote_ip")) == F.col("real_public_ipv4"), F.lit(False)
    )
    reasons = F.concat(
        V.messages((bypass, "real-address bypass"), (F.col("condition_changed"), "condition changed")),
        F.array_compact(F.array(V.present(F.col("safety_stop_code")))),
    )
    return attempts.select("attempt_path", F.explode(reasons).alias("reason"))


def required_runs(required: DataFrame, logs: DataFrame, *, exactly_once: bool) -> DataFrame:
    """Required run ids whose log rows are not exactly one (or, for the final check, at least one)."""
    counts = logs.groupBy("run_id").agg(F.count("*").alias("n"))
    seen = required.select("run_id").distinct().join(counts, "run_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return violations(seen, "log_prefix", (F.col("n") != 1) if exactly_once else (F.col("n") == 0), F.col("run_id"), F.col("n"))


def pending_addresses(records: DataFrame) -> DataFrame:
    """Distinct ``date, address`` of records that wait for a dated origin."""
    waiting = records.filter(F.col("pending_reason") == "dated_asn_mapping_missing")
    return waiting.select(
        F.col("feed_date").alias("date"), F.explode(F.array_compact(F.array("observed_ingress_ip", "server_remote_ip"))).alias("address")
    ).distinct()


def plan_coverage(pending: DataFrame, planned: DataFrame) -> DataFrame:
    """Addresses (``date, address``) that only the records or only the reconstruction plan holds."""
    a = pending.select("date", "address", F.lit(True).alias("waiting"))
    b = planned.select("date", "address", F.lit(True).alias("planned"))
    both = a.join(b, ["date", "address"], "full_outer")
    problem = F.when(F.col("planned").isNull(), "not planned").when(F.col("waiting").isNull(), "not pending")
    return both.select("date", "address", problem.alias("problem")).filter("problem is not null")


def reconstructed_origins(evidence: DataFrame, planned: DataFrame, *, timestamps_per_day: int) -> DataFrame:
    """Dated origins from route evidence: one row per planned address with ``prefix, asn`` or a ``problem``.

    ``evidence``: ``date, observed_at, status, target_prefix, path ARRAY``; at each
    time the longest prefix that contains the address must end in one scalar
    origin, and every time must agree on prefix and origin. An address planned twice is one address.
    """
    from prefixledger.operators.routing import longest_match

    planned = planned.select("date", "address").distinct()
    routes = A.with_prefix(evidence.filter("status = 'ok'").withColumn("origin", F.try_element_at("path", F.lit(-1))), "target_prefix")
    number = F.col("origin").try_cast("bigint")
    agreed = routes.filter("family is not null").groupBy("observed_at", *PREFIX).agg(
        F.min("origin").alias("low_origin"), F.max("origin").alias("high_origin"), F.bool_and(F.coalesce(number.between(1, 4294967295), F.lit(False))).alias("scalar")
    )
    times = evidence.select("date", "observed_at").distinct()
    asked = A.with_address(planned.join(times, "date"), "address")
    hits = longest_match(asked, agreed, ["low_origin", "high_origin", "scalar"], ("observed_at",))
    seen = asked.join(hits, ["observed_at", *PREFIX], "left").select(
        "date", "address", "observed_at",
        F.when(F.col("scalar") & (F.col("low_origin") == F.col("high_origin")),
               F.struct(A.cidr_text("family", "r_plen", "r_hi", "r_lo").alias("prefix"), F.col("low_origin").cast("bigint").alias("asn"))).alias("o"),
    )
    per = seen.groupBy("date", "address").agg(
        F.count("*").alias("times"), F.count("o").alias("usable"), F.min("o").alias("a"), F.max("o").alias("b")
    )
    all_ = planned.join(per, ["date", "address"], "left")
    problem = (
        F.when(F.coalesce("times", F.lit(0)) != timestamps_per_day, "evidence does not contain every planned time")
        .when(F.col("usable") != F.col("times"), "no single scalar origin at some time")
        .when(F.col("a") != F.col("b"), "prefix or origin changed")
    )
    return all_.select("date", "address", F.when(problem.isNull(), F.col("a.prefix")).alias("prefix"),
                       F.when(problem.isNull(), F.col("a.asn")).alias("asn"), problem.alias("problem"))


def origin_additions(derived: DataFrame, current: DataFrame) -> DataFrame:
    """Derived ``date, prefix, asn`` rows that the current table lacks, with ``conflict`` where it names another ASN."""
    new = derived.filter("problem is null").select("date", "prefix", "asn").distinct().join(current, ["date", "prefix", "asn"], "left_anti")
    others = current.select("date", "prefix", F.lit(True).alias("conflict")).distinct()
    return new.join(others, ["date", "prefix"], "left").withColumn("conflict", F.coalesce("conflict", F.lit(False)))
