"""Snapshot-to-snapshot comparison of address catalogues.

A catalogue frame has ``snapshot_date DATE, family, plen, hi, lo, country, region,
city`` and, per date, disjoint prefixes. The overlay of two snapshots is built
from three joins on masked prefixes:

* equal prefixes meet in a full outer join;
* a changed prefix inside a changed prefix of the other side is a shared piece;
* what a container does not share is the set of unoccupied siblings on the way
  down to its pieces, which one aggregation over tree nodes yields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefixledger.functions import address as A
from prefixledger.operators.intervals import PREFIX, at_lengths
from prefixledger.session import cut_lineage, dealt

PAIR = ["date_from", "date_to", "interval_days"]
LABEL = ["country", "region", "city"]
KEY = [*PAIR, *PREFIX]
#: Snapshot dates up to which the table of date pairs is broadcast.
MOST_DATES = 20_000


def label_struct() -> Column:
    return F.struct(*[F.coalesce(F.trim(F.col(c)), F.lit("")).alias(c) for c in LABEL])


def adjacent_dates(dates: DataFrame) -> DataFrame:
    """Consecutive snapshot dates with their distance; ``dates`` holds one row per date."""
    ordered = Window.orderBy("snapshot_date")
    return (
        dates.select("snapshot_date")
        .distinct()
        .select(F.lag("snapshot_date").over(ordered).alias("date_from"), F.col("snapshot_date").alias("date_to"))
        .filter(F.col("date_from").isNotNull())
        .withColumn("interval_days", observation_interval(F.col("date_from"), F.col("date_to")))
    )


def observation_interval(date_from: Column, date_to: Column) -> Column:
    """Days from one observation to the next; an error unless positive."""
    days = F.datediff(date_to, date_from)
    return F.when(days > 0, days).otherwise(
        F.raise_error(F.concat(F.lit("invalid snapshot interval ending "), date_to.cast("string"))).cast("int")
    )


def paired_prefixes(catalogue: DataFrame) -> DataFrame:
    """One row per (pair of dates, prefix): ``old`` and ``new`` label structs, NULL where absent.

    Not a join of two sides: a row meets the (at most two) pairs its date takes part in, a
    report-sized table, and one aggregation brings the sides together.
    """
    pairs = adjacent_dates(catalogue.select("snapshot_date"))
    labelled = catalogue.select("snapshot_date", *PREFIX, label_struct().alias("label"))
    role = lambda date, is_new: F.struct(F.col(date).alias("snapshot_date"), F.lit(is_new).alias("is_new"))
    roles = pairs.select(*PAIR, F.inline(F.array(role("date_from", False), role("date_to", True))))
    # A date has at most two roles. Broadcast while the dates are counted to be few, so that no row is dealt by its date.
    few = catalogue.select("snapshot_date").distinct().limit(MOST_DATES + 1).count() <= MOST_DATES
    both = labelled.join(F.broadcast(roles) if few else roles, "snapshot_date")
    # Structs are aggregated by sorting: one exchange by the key, of a size a task that does not follow the table.
    return dealt(both, 2 * catalogue.count(), *KEY).groupBy(*KEY).agg(
        F.max(F.when(~F.col("is_new"), F.col("label"))).alias("old"),
        F.max(F.when(F.col("is_new"), F.col("label"))).alias("new"),
    )


def catalogue_changes(paired: DataFrame) -> DataFrame:
    """Raw row changes: ``added``, ``removed``, and ``label_before`` + ``label_after`` per relabelled prefix."""
    event = lambda kind, label: F.struct(F.lit(kind).alias("change_kind"), label.alias("label"))
    events = (
        F.when(F.col("old").isNull(), F.array(event("added", F.col("new"))))
        .when(F.col("new").isNull(), F.array(event("removed", F.col("old"))))
        .when(
            F.col("old") != F.col("new"),
            F.array(event("label_before", F.col("old")), event("label_after", F.col("new"))),
        )
    )
    return paired.select(*KEY, F.explode(events).alias("e")).select(
        *PAIR,
        F.concat(F.lit("v"), F.col("family").cast("string")).alias("family"),
        "e.change_kind",
        A.cidr_text().alias("cidr"),
        *[F.col(f"e.label.{c}").alias(c) for c in LABEL],
        *[F.col(c).alias(f"_{c}") for c in PREFIX],
    )


def changes_order() -> list[Column]:
    """Total order of the change report: family, numeric address, length."""
    return [F.col(c) for c in ("date_from", "_family", "_hi", "_lo", "_plen", "change_kind")]


def changed_prefixes(paired: DataFrame) -> DataFrame:
    """Prefixes present on one side only: ``KEY, is_new, label``."""
    return paired.filter(F.col("old").isNull() | F.col("new").isNull()).select(
        *KEY, F.col("old").isNull().alias("is_new"), F.coalesce("old", "new").alias("label")
    )


def nested_changes(changed: DataFrame) -> DataFrame:
    """Changed prefixes strictly inside a changed prefix of the other side.

    Snapshots are disjoint, so there is at most one container. Adds ``c_plen,
    c_hi, c_lo, c_label`` of the container and ``c_is_new``.
    """
    outer = changed.select(
        *PAIR,
        "family",
        (~F.col("is_new")).alias("is_new"),
        F.col("plen").alias("c_plen"),
        F.col("hi").alias("c_hi"),
        F.col("lo").alias("c_lo"),
        F.col("label").alias("c_label"),
    )
    lengths = changed.groupBy("family").agg(F.collect_set("plen").alias("lengths"))
    probes = at_lengths(changed, lengths, keep=changed.columns, condition=F.col("c_plen") < F.col("plen"))
    return probes.join(outer, [*PAIR, "family", "is_new", "c_plen", "c_hi", "c_lo"])


def overlay(paired: DataFrame) -> DataFrame:
    """Every differing piece of address space as a CIDR row.

    ``PAIR, family, plen, hi, lo, change`` (``added``, ``removed``, ``reassigned``),
    ``from_label, to_label``. Pieces of added and removed space follow the
    elementary segments: neighbouring pieces are not merged.
    """
    changed = changed_prefixes(paired)
    nested = cut_lineage(nested_changes(changed))
    piece = lambda df, change, old, new: df.select(
        *KEY, change.alias("change"), old.alias("from_label"), new.alias("to_label")
    )
    no_label = F.lit(None).cast("struct<country:string,region:string,city:string>")

    relabelled = piece(
        paired.filter(F.col("old") != F.col("new")), F.lit("reassigned"), F.col("old"), F.col("new")
    )
    old_label = F.when(F.col("is_new"), F.col("c_label")).otherwise(F.col("label"))
    new_label = F.when(F.col("is_new"), F.col("label")).otherwise(F.col("c_label"))
    shared = piece(
        nested.filter(F.col("label") != F.col("c_label")), F.lit("reassigned"), old_label, new_label
    )

    change_of = lambda is_new: F.when(is_new, "added").otherwise("removed")
    involved = nested.select(*KEY, "is_new").unionByName(
        nested.select(
            *PAIR, "family", F.col("c_plen").alias("plen"), F.col("c_hi").alias("hi"), F.col("c_lo").alias("lo"),
            (~F.col("is_new")).alias("is_new"),
        )
    )
    alone = changed.join(involved, [*KEY, "is_new"], "left_anti")
    alone = piece(
        alone,
        change_of(F.col("is_new")),
        F.when(~F.col("is_new"), F.col("label")).otherwise(no_label),
        F.when(F.col("is_new"), F.col("label")).otherwise(no_label),
    )

    # Nodes on the way from a container down to its pieces, each with the children taken.
    down = nested.select(
        *PAIR,
        "family",
        (~F.col("is_new")).alias("is_new"),
        F.col("c_label").alias("label"),
        "hi",
        "lo",
        F.explode(F.sequence(F.col("c_plen") + 1, F.col("plen"))).alias("node"),
    )
    place = [*PAIR, "family", "is_new", "node", "p_hi", "p_lo"]
    children = down.select(
        *PAIR,
        "family",
        "is_new",
        "label",
        "node",
        A.mask_half_hi("hi", "(node - 1)").alias("p_hi"),
        A.mask_half_lo("lo", "(node - 1)").alias("p_lo"),
        (A.node_bit(F.col("hi"), F.col("lo"), F.col("node")) + 1).alias("child"),
    )
    taken = (
        dealt(children, nested.agg(F.coalesce(F.sum(F.col("plen") - F.col("c_plen")), F.lit(0))).first()[0], *place)
        .groupBy(*place)
        .agg(F.bit_or("child").alias("children"), F.first("label").alias("label"))
        .filter(F.col("children") != 3)
    )
    right_hi, right_lo = A.flip_bit(F.col("p_hi"), F.col("p_lo"), F.col("node"))
    free_right = F.col("children") == 1
    gaps = taken.select(
        *PAIR,
        "family",
        F.col("node").alias("plen"),
        F.when(free_right, right_hi).otherwise(F.col("p_hi")).alias("hi"),
        F.when(free_right, right_lo).otherwise(F.col("p_lo")).alias("lo"),
        "is_new",
        "label",
    )
    gaps = piece(
        gaps,
        change_of(F.col("is_new")),
        F.when(~F.col("is_new"), F.col("label")).otherwise(no_label),
        F.when(F.col("is_new"), F.col("label")).otherwise(no_label),
    )
    return relabelled.unionByName(shared).unionByName(alone).unionByName(gaps)


def _sizes(df: DataFrame, keys: list[str], counts: dict[str, Column]) -> DataFrame:
    """``keys`` + for each name ``<name>_n`` rows and ``<name>_addrs`` addresses.

    Rows are counted per prefix length first, so the wide decimals are only touched
    once per length and not once per row.
    """
    per_length = df.groupBy(*keys, "plen").agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    # The family may be text ('v4') in a report or a number in a frame.
    size = A.address_count(F.regexp_extract(F.col("family").cast("string"), r"(\d)", 1).cast("int"), F.col("plen"))
    return per_length.groupBy(*keys).agg(
        *[F.sum(n).alias(f"{n}_n") for n in counts],
        *[
            F.coalesce(F.sum(F.when(F.col(n) > 0, F.col(n).cast("decimal(38,0)") * size)), F.lit(0))
            .cast("decimal(38,0)")
            .alias(f"{n}_addrs")
            for n in counts
        ],
    )


def run_starts(pieces: DataFrame) -> DataFrame:
    """Reassigned pieces with ``is_run_start``: no piece of the same transition ends right before.

    Pieces are disjoint, so the predecessor in address order is the one that ends at
    the start, found by equality instead of by sorting.
    """
    moved = pieces.filter(F.col("change") == "reassigned")
    after = A.next_start(F.col("hi"), F.col("lo"), F.col("plen"))
    before = (
        moved.select(*PAIR, "family", "from_label", "to_label", after.alias("a"))
        .filter(F.col("a.hi").isNotNull())
        .select(
            *PAIR, "family", "from_label", "to_label",
            F.col("a.hi").alias("hi"), F.col("a.lo").alias("lo"), F.lit(True).alias("continues"),
        )
    )
    return moved.join(before, [*PAIR, "family", "hi", "lo", "from_label", "to_label"], "left").withColumn(
        "is_run_start", F.col("continues").isNull()
    )


def transitions(pieces: DataFrame) -> DataFrame:
    """Addresses and contiguous runs per label transition."""
    keys = [*PAIR, "family", "from_label", "to_label"]
    sized = _sizes(run_starts(pieces), keys, {"all": F.lit(True), "start": F.col("is_run_start")})
    return sized.select(
        *PAIR,
        F.concat(F.lit("v"), F.col("family").cast("string")).alias("family"),
        *[F.col(f"from_label.{c}").alias(f"from_{c}") for c in LABEL],
        *[F.col(f"to_label.{c}").alias(f"to_{c}") for c in LABEL],
        F.col("start_n").alias("contiguous_runs"),
        F.col("all_addrs").alias("addresses"),
    )


def transitions_order() -> list[Column]:
    labels = [F.col(f"{s}_{c}") for s in ("from", "to") for c in LABEL]
    return [F.col("date_from"), F.col("family"), F.col("addresses").desc(), *labels]


def top_transitions(table: DataFrame, n: int = 10) -> DataFrame:
    """The n largest transitions of each pair and family, largest first."""
    ranked = Window.partitionBy(*PAIR, "family").orderBy(*transitions_order()[2:])
    return table.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= n)


def resliced(changed: DataFrame) -> DataFrame:
    """Changed rows that only re-cut unchanged coverage: ``PAIR, family, fake_churn_pfx``.

    A component is one container and the prefixes of the other side inside it; it
    is cosmetic when their sizes add up to the container's.
    """
    nested = nested_changes(changed)
    container = [*PAIR, "family", "is_new", "c_plen", "c_hi", "c_lo"]
    per_length = nested.groupBy(*container, "plen").agg(F.count("*").alias("n"))
    size = lambda plen: A.address_count(F.col("family"), plen)
    filled = per_length.groupBy(*container).agg(
        F.sum("n").alias("inner"),
        F.sum(F.col("n").cast("decimal(38,0)") * size(F.col("plen"))).cast("decimal(38,0)").alias("covered"),
    )
    return (
        filled.filter(F.col("covered") == size(F.col("c_plen")))
        .groupBy(*PAIR, "family")
        .agg(F.sum(F.col("inner") + 1).alias("fake_churn_pfx"))
    )


def churn_series(catalogue: DataFrame) -> DataFrame:
    """One row per adjacent pair of dates and family with every churn counter."""
    paired = cut_lineage(paired_prefixes(catalogue))
    pieces = cut_lineage(overlay(paired))
    return churn_counters(catalogue, paired, pieces)


def churn_counters(catalogue: DataFrame, paired: DataFrame, pieces: DataFrame) -> DataFrame:
    """:func:`churn_series` from stored ``paired`` and ``pieces`` frames."""
    grid = adjacent_dates(catalogue.select("snapshot_date")).select("*", F.explode(F.array(F.lit(4), F.lit(6))).alias("family"))
    keys = [*PAIR, "family"]
    sized = _sizes(
        pieces,
        keys,
        {k: F.col("change") == k for k in ("added", "removed", "reassigned")},
    )
    runs = run_starts(pieces).groupBy(*keys).agg(F.count_if("is_run_start").alias("reassign_count"))
    raw = changed_prefixes(paired).groupBy(*keys).agg(F.count("*").alias("naive_raw_churn"))
    cosmetic = resliced(changed_prefixes(paired))
    out = grid
    for part in (sized, runs, raw, cosmetic):
        out = out.join(part, keys, "left")
    zero = lambda c, t: F.coalesce(F.col(c), F.lit(0)).cast(t)
    return out.select(
        *PAIR,
        F.concat(F.lit("v"), F.col("family").cast("string")).alias("family"),
        zero("added_n", "bigint").alias("added_pfx"),
        zero("removed_n", "bigint").alias("removed_pfx"),
        zero("added_addrs", "decimal(38,0)").alias("added_addrs"),
        zero("removed_addrs", "decimal(38,0)").alias("removed_addrs"),
        zero("reassigned_addrs", "decimal(38,0)").alias("reassigned_addrs"),
        zero("reassign_count", "bigint").alias("reassign_count"),
        zero("fake_churn_pfx", "bigint").alias("fake_churn_pfx"),
        zero("naive_raw_churn", "bigint").alias("naive_raw_churn"),
    )


def pair_summary(series: DataFrame) -> DataFrame:
    """One line per pair over both families, with the label-change flag."""
    return series.groupBy(*PAIR).agg(
        F.sum("added_pfx").alias("added_pfx"),
        F.sum("removed_pfx").alias("removed_pfx"),
        F.sum("reassign_count").alias("label_change_runs"),
        F.sum("fake_churn_pfx").alias("resliced_rows"),
    ).withColumn("review_labels", F.col("label_change_runs") > 0)


def plot_series(series: DataFrame) -> DataFrame:
    """Dense plot rows: every interval for every family that occurs, absent counts as zero.

    Removals turn negative and intervals longer than a day carry a gap flag. Intervals
    and families are report-sized (one row per date pair, two families).
    """
    counts = ["added_pfx", "removed_pfx", "reassign_count"]
    families = series.agg(F.collect_set("family")).scalar()  # two at most
    grid = series.select(*PAIR).distinct().withColumn("family", F.explode(families))
    dense = grid.join(series.select("date_to", "family", *counts), ["date_to", "family"], "left")
    value = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return dense.select(
        *PAIR,
        "family",
        value("added_pfx").alias("added_pfx"),
        (-value("removed_pfx")).alias("removed_pfx"),
        value("reassign_count").alias("reassign_count"),
        (F.col("interval_days") > 1).alias("gap"),
    )
