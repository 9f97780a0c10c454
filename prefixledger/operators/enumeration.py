"""Routed source blocks, resolver transcripts and enumeration results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefixledger.functions import address as A
from prefixledger.functions import values as V


def source_blocks(announced: DataFrame, *, shortest: int = 8) -> DataFrame:
    """Distinct globally reachable IPv4 /24 blocks (``block`` = number of the /24) of announced space.

    Prefixes shorter than ``shortest`` are ignored. Prefixes inside a shorter
    announced one add nothing and are dropped before the expansion, which a /8
    bounds at 65,536 rows per prefix; the rest is distinct by construction.
    """
    from prefixledger.operators.intervals import drop_covered

    v4 = announced.filter((F.col("family") == 4) & (F.col("plen") >= shortest))
    # Every prefix longer than /24 counts as its whole /24.
    wide = v4.withColumn("plen", F.least("plen", F.lit(24))).withColumn("hi", A.mask_half_hi("hi", "plen"))
    tops = drop_covered(wide, [])
    first = F.shiftright(A.v4_from_half(F.col("hi")), 8)
    count = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(24) - F.col("plen"))
    blocks = tops.select(F.explode(F.sequence(first, first + count - 1)).alias("block"))
    return blocks.filter(A.is_global_v4(F.shiftleft("block", 8), F.lit(24)))


def block_text(block: Column) -> Column:
    return F.concat(A.v4_text(F.shiftleft(block, 8)), F.lit("/24"))


def blocks_in_order(blocks: DataFrame) -> DataFrame:
    """Sorted block list as text: a range-partitioned sort, written in order by the sink."""
    return blocks.orderBy("block").select(block_text(F.col("block")).alias("prefix"))


def unique_addresses(results: DataFrame) -> DataFrame:
    """Distinct well-formed IPv4 answers in numeric order."""
    answers = results.select(A.canonical_v4(F.col("answer_ip")).alias("answer_ip")).filter("answer_ip is not null").distinct()
    return answers.orderBy(A.v4_int(F.col("answer_ip")))


def transcript_rows(transcripts: DataFrame) -> DataFrame:
    """Status, scope and A answers of resolver transcripts ``id, output``: one row per answer, at least one."""
    out = F.col("output")
    status = V.present(F.regexp_extract(out, r"status:\s*([A-Z]+)", 1))
    ecs = r"CLIENT-SUBNET:\s*([0-9.]+)/(\d+)/(\d+)"
    source, scope = (F.regexp_extract(out, ecs, g).try_cast("int") for g in (2, 3))
    lines = F.split(out, r"\r?\n")
    answers = F.array_compact(F.transform(lines, lambda s: A.canonical_v4(F.regexp_extract(s, r"^\S+\s+\d+\s+IN\s+A\s+(\S+)\s*$", 1))))
    return transcripts.select(
        "id", status.alias("status"), F.when((source == 24) & scope.between(0, 24), scope).alias("scope"),
        F.posexplode_outer(answers).alias("position", "answer_ip"),
    )


def answer_lines(transcripts: DataFrame) -> DataFrame:
    """Answer lines of transcripts as ``id, name, ttl, type, value``; comments and short lines are skipped."""
    line = transcripts.select("id", F.explode(F.split("output", r"\r?\n")).alias("line")).select("id", F.trim("line").alias("line"))
    fields = line.filter((F.col("line") != "") & ~F.col("line").startswith(";")).select("id", F.split("line", r"\s+").alias("f"))
    dotless = lambda c: F.regexp_replace(c, r"\.+$", "")
    return fields.filter((F.size("f") >= 5) & (F.get("f", F.lit(2)) == "IN")).select(
        "id", dotless(F.get("f", F.lit(0))).alias("name"), F.get("f", F.lit(1)).cast("bigint").alias("ttl"),
        F.get("f", F.lit(3)).alias("type"), dotless(F.get("f", F.lit(4))).alias("value"),
    )


def address_names(answers: DataFrame, fallback_names: list[str] = ()) -> DataFrame:
    """Host names per IPv4 answer (``query_name, name, type, value``), distinct, with the fallback mark, long form."""
    a = answers.filter(F.col("type") == "A").select(A.canonical_v4(F.col("value")).alias("address"), F.array("query_name", "name").alias("n"))
    long = a.filter("address is not null").select("address", F.explode("n").alias("hostname")).distinct()
    return long.withColumn("is_fallback", F.col("hostname").isin(*fallback_names) if fallback_names else F.lit(False))


def scope_coverage(blocks: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Input blocks with ``state``: ``answered``, ``failed``, ``skipped`` (inside an earlier answer's scope) or ``pending``.

    ``blocks``: ``block``; ``outcomes``: committed outcomes, ``block, scope, ok`` (a scan commits none for a
    skipped block), with an optional ``retried`` for answers of a later retry pass, which cover nothing. Answers
    with a scope of 0-23 cover the masked block up to its last /24; the skip line at a block is the running
    maximum of those ends over earlier blocks. The maximum over whole /16 buckets is carried by one small table
    (65,536 buckets at most), so no window holds more than the 256 blocks of one bucket.
    """
    first_pass = ~F.coalesce("retried", F.lit(False)) if "retried" in outcomes.columns else F.lit(True)
    queried = outcomes.groupBy("block").agg(F.max("ok").alias("ok"), F.min(F.when(F.col("ok") & first_pass, F.col("scope"))).alias("scope"))
    df = blocks.select("block").distinct().join(queried, "block", "left")
    step = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(24) - F.col("scope"))
    covered = F.when(F.col("ok") & F.col("scope").between(0, 23), F.col("block") - F.pmod(F.col("block"), step) + step - 1)
    df = df.select("*", covered.alias("covers_to"), F.shiftright("block", 8).alias("bucket"))
    tops = df.groupBy("bucket").agg(F.max("covers_to").alias("top"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select("bucket", F.max("top").over(before).alias("carried"))
    inside = Window.partitionBy("bucket").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    marked = df.join(carried, "bucket").withColumn("skip_until", F.greatest(F.col("carried"), F.max("covers_to").over(inside)))
    state = (
        F.when(F.coalesce(F.col("block") <= F.col("skip_until"), F.lit(False)), "skipped")
        .when(F.col("ok").isNull(), "pending").when(F.col("ok"), "answered").otherwise("failed")
    )
    return marked.select("block", "ok", "scope", "skip_until", state.alias("state"))


def enumeration_summary(coverage: DataFrame, outcomes: DataFrame, results: DataFrame) -> DataFrame:
    """One row of scan counters: inputs, processed, queries, scope skips, errors, pending errors, unique addresses."""
    states = coverage.agg(
        F.count("*").alias("inputs"),
        F.count_if(F.col("state") != "pending").alias("inputs_processed"),
        F.count_if(F.col("state") == "skipped").alias("skipped_by_returned_scope"),
        F.count_if(F.col("state") == "failed").alias("pending_error_prefixes"),
    )
    asked = outcomes.agg(F.struct(
        F.coalesce(F.sum("attempts"), F.lit(0)).alias("dns_queries_sent"), F.coalesce(F.sum("errors"), F.lit(0)).alias("errors_or_timeouts")
    ))
    found = results.select(A.canonical_v4(F.col("answer_ip")).alias("a")).filter("a is not null").distinct().agg(F.count("*"))
    facts = states.withColumn("asked", asked.scalar()).withColumn("unique_ingress_ipv4_addresses", found.scalar())
    return facts.select("*", "asked.*").drop("asked")


def candidate_history(attempts: DataFrame, *, before: str, days: int) -> DataFrame:
    """Addresses directly evidenced by finalised attempts of the look-back: source, attempt and date in long form.

    ``attempts``: ``attempt_path, run_id, client_start_utc, finalised,
    dns_ingress_candidates, macos_effective_ingress_candidates, effective_dns``. Inherited scope columns are no evidence.
    """
    have = set(attempts.columns)

    def named(column: str) -> Column:
        values = F.coalesce(F.col(column), F.array().cast("array<string>"))
        return F.transform(values, lambda x: F.struct(F.lit(column).alias("source"), x.alias("address")))

    sources = [named(c) for c in ("dns_ingress_candidates", "macos_effective_ingress_candidates") if c in have]
    hosts = F.transform(
        F.coalesce(F.map_entries("effective_dns.hostnames"), F.array()),
        lambda e: F.transform(F.coalesce(e["value"]["A"], F.array()), lambda a: F.struct(
            F.concat(F.lit("effective_dns.hostnames."), e["key"], F.lit(".A")).alias("source"), a["address"].alias("address"))),
    )
    sources.append(F.flatten(hosts))
    date = F.to_date(F.substring("client_start_utc", 1, 10))
    upto = F.to_date(F.lit(before))
    recent = attempts.filter(F.col("finalised") & (date < upto) & (date >= F.date_sub(upto, days)))
    long = recent.select("run_id", date.alias("date"), F.explode(F.concat(*sources)).alias("s"))
    return long.select(
        A.canonical_v4(F.col("s.address")).alias("address"), "s.source", "run_id", "date"
    ).filter("address is not null").distinct()


def candidate_evidence(history: DataFrame) -> DataFrame:
    """Per address: sources, attempts and dates counted, first and last date (combinable, no collected lists)."""
    per = history.groupBy("address", "source", "run_id", "date").agg(F.lit(1).alias("one"))
    split = lambda c: per.select("address", c).distinct().groupBy("address").agg(F.count("*").alias(f"{c}s"))
    bounds = per.groupBy("address").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    return bounds.join(split("source"), "address").join(split("run_id"), "address").join(split("date"), "address")
