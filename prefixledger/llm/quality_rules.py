"""Quality rules: fixed base rules, then robust multivariate outliers for each language and source.

Statistics of whole texts come from column expressions. Four of them are transformed into a vector
of integers (fixed point); for each language and source a minimum-covariance-determinant estimate is
found by deterministic concentration steps from three starts: the ``support`` share of the rows that are nearest
gives the next mean and covariance, a step counts only where it lowers the determinant, and the start that
reaches the smallest one goes on. Sums are exact integers and ranks come from bounded bins, so a rerun gives the
same verdicts at any partitioning. No group is gathered: every step is an aggregation with map-side combine
over a narrow stored table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefixledger.llm.common import cut_lineage, few_rows, packed, unpacked, with_group_values, words

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("f_length", "f_symbols", "f_lines", "f_repeats")
SCALE = 256
#: Least standard deviation of each feature: rules that most clean texts meet exactly have none of their own.
FLOORS = (0.12, 0.12, 0.12, 0.12)
SUPPORT = 0.75
#: Concentration steps from each start, and of the best one after them.
TRIAL_STEPS = 2
STEPS = 3
#: Distance bins for each doubling of distance + 1.
BINS = 256
#: Squared distance of rejection, the 1 - 5e-6 quantile of chi-square with four degrees of freedom.
CUTOFF = 30.0
#: Rows that the estimate of the level above counts for.
PRIOR_ROWS = 25.0
P = len(FEATURES)
#: Columns of an estimate: centre and lower triangle of the Cholesky factor.
MODEL = [*[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i in range(P) for j in range(i + 1)]]


def with_statistics(df: DataFrame, text: str, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """The five statistics of column ``text`` beside the columns ``keep``.

    ``n_repeat_words`` compares 64-bit hashes of the 8-word windows of a text. Only a text with a
    repeated one sorts its windows; the covered words follow from the gaps between their positions.
    Each step is a column of its own, so that no array is computed twice.
    """
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    base = base.select(*keep, "_t", words(F.col("_t")).alias("_words"), lines.alias("_lines"))
    base = base.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    numbers = ("n_words", "word_chars", "n_symbols", "n_dup_lines")
    window = ", ".join(["x", *[f"get(_hashes, i + {k})" for k in range(1, 8)]])
    base = base.select(*keep, *numbers, F.expr(f"slice(transform(_hashes, (x, i) -> xxhash64({window})), 1, greatest(size(_hashes) - 7, 0))").alias("_runs"))
    again = F.size(F.array_distinct("_runs")) < F.size("_runs")
    base = base.select(*keep, *numbers, F.when(again, F.expr("array_sort(transform(_runs, (h, i) -> struct(h AS h, i AS i)))")).alias("_sorted"))
    # neighbours of equal hash in the sorted list; then positions in order, each covering up to the next
    base = base.select(*keep, *numbers, F.expr("array_sort(transform(filter(_sorted, (x, k) -> x.h = get(_sorted, k - 1).h OR x.h = get(_sorted, k + 1).h), x -> x.i))").alias("_at"))
    covered = F.expr("aggregate(transform(_at, (p, k) -> CAST(least(8, coalesce(get(_at, k + 1) - p, 8)) AS BIGINT)), 0L, (a, x) -> a + x)")
    return base.select(*keep, *numbers, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def _base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _features() -> dict[str, Column]:
    """Transformed statistics: log of mean word length, and roots of shares per word (variance-stabilising)."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    raw = (
        F.log((F.col("word_chars") + 1.0) / (n + 1.0)),
        F.sqrt(F.col("n_symbols") / n),
        F.sqrt(F.col("n_dup_lines") / n),
        F.sqrt(F.col("n_repeat_words") / n),
    )
    return {k: F.round(x * SCALE).cast("long") for k, x in zip(FEATURES, raw, strict=True)}


def consistency(support: float = SUPPORT) -> float:
    """Factor that makes the covariance of the central ``support`` share unbiased for normal rows (four features)."""
    low, high = 0.0, 100.0
    for _ in range(80):
        x = (low + high) / 2
        low, high = (x, high) if 1 - math.exp(-x / 2) * (1 + x / 2) < support else (low, x)
    return support / (1 - math.exp(-x / 2) * (1 + x / 2 + x * x / 8))


def _cholesky(cov: list[list[Column]]) -> dict[str, Column]:
    """Steps of the Cholesky factor as named columns, in order of dependence."""
    out: dict[str, Column] = {}
    for i in range(P):
        for j in range(i + 1):
            rest = cov[i][j]
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out[f"l{i}{j}"] = F.sqrt(rest) if i == j else rest / F.col(f"l{j}{j}")
    return out


def _factor(df: DataFrame, cov: list[list[Column]], keys: list[str]) -> DataFrame:
    """``keys``, the centre ``m0..`` of ``df``, the factor ``l00..`` of ``cov`` and ``half_log_det``, half the log of its determinant."""
    for name, value in _cholesky(cov).items():
        df = df.withColumn(name, value)
    logs = sum((F.log(F.col(f"l{i}{i}")) for i in range(1, P)), F.log(F.col("l00")))
    return df.select(*keys, *MODEL, logs.alias("half_log_det"))


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution with the joined centre and factor."""
    z: list[Column] = []
    for i in range(P):
        rest = F.col(FEATURES[i]) / float(SCALE) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * z[j]
        z.append(rest / F.col(f"l{i}{i}"))
    total = z[0] * z[0]
    for x in z[1:]:
        total = total + x * x
    return total


def _covariance(of: str = "") -> list[list[Column]]:
    """Lower triangle of L Lᵀ from the factor columns, or from those of the struct ``of``."""
    part = lambda i, k: F.col(f"{of}l{i}{k}")
    return [[sum((part(i, k) * part(j, k) for k in range(1, j + 1)), part(i, 0) * part(j, 0)) for j in range(i + 1)] for i in range(P)]


def _starts(rows: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """Three starts a group around its medians, with its row count ``n``; the deviations are those of the medians.

    ``start`` 0 takes the features as uncorrelated, 1 takes the correlations of their hyperbolic tangents, 2 those of
    the directions from the centre (spatial signs), both drawn a tenth towards none, so every start is positive definite.
    """
    half = [F.percentile(F.col(f), F.lit(0.5)).alias(f"m{i}") for i, f in enumerate(FEATURES)]
    medians = cut_lineage(rows.groupBy(*keys).agg(F.count("*").alias("n"), *half))
    off = with_group_values(rows, medians, keys, few=few)
    mads = off.groupBy(*keys).agg(*[F.percentile(F.floor(F.abs(F.col(f) - F.col(f"m{i}"))), F.lit(0.5)).alias(f"d{i}") for i, f in enumerate(FEATURES)])
    sd = [F.sqrt(F.pow(F.col(f"d{i}") * 1.4826 / SCALE, 2) + FLOORS[i] ** 2).alias(f"sd{i}") for i in range(P)]
    scaled = cut_lineage(with_group_values(mads, medians, keys, few=few).select(*keys, "n", *[(F.col(f"m{i}") / SCALE).alias(f"m{i}") for i in range(P)], *sd))
    z = [((F.col(f) / float(SCALE) - F.col(f"m{i}")) / F.col(f"sd{i}")).alias(f"z{i}") for i, f in enumerate(FEATURES)]
    length = F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, P)), F.col("z0") * F.col("z0")))
    bent = with_group_values(rows, scaled, keys, few=few).select(*keys, *z).select(
        *keys, *[F.tanh(f"z{i}").alias(f"t{i}") for i in range(P)], *[F.coalesce(F.col(f"z{i}") / F.nullif(length, F.lit(0.0)), F.lit(0.0)).alias(f"u{i}") for i in range(P)])
    # integer sums, so that their order has no effect
    fixed = lambda x: F.sum(F.round(x * 2**20).cast("long"))
    products = bent.groupBy(*keys).agg(*[fixed(F.col(f"{k}{i}") * F.col(f"{k}{j}")).alias(f"{k}{i}{j}") for k in "tu" for i in range(P) for j in range(i + 1)])
    sums = with_group_values(products, scaled, keys, few=few).withColumn("start", F.explode(F.array(*[F.lit(k) for k in range(3)])))

    def entry(i: int, j: int) -> Column:
        if i == j:
            return F.col(f"sd{i}") * F.col(f"sd{i}")
        share = lambda k: F.coalesce(F.col(f"{k}{i}{j}") / F.nullif(F.sqrt(F.col(f"{k}{i}{i}") * F.col(f"{k}{j}{j}").cast("double")), F.lit(0.0)), F.lit(0.0)) * 0.9
        return F.when(F.col("start") == 1, share("t")).when(F.col("start") == 2, share("u")).otherwise(0.0) * F.col(f"sd{i}") * F.col(f"sd{j}")

    cov = [[entry(i, j) for j in range(i + 1)] for i in range(P)]
    # no determinant yet: that of a start is not the one of a subset of rows
    return _factor(sums, cov, [*keys, "start", "n"]).withColumn("half_log_det", F.lit(None).cast("double"))


def _concentrate(rows: DataFrame, model: DataFrame, keys: list[str], support: float, few: bool) -> DataFrame:
    """One concentration step: mean and covariance of the ceil(support * n) rows nearest to the centre.

    The nearest rows are those of the lower distance bins; the bin at the border counts with the share that
    makes the number of rows exact. A group keeps the estimate it had where the new determinant is no smaller.
    """
    bin_of = F.floor(F.log2(_distance() + 1.0) * BINS).cast("long").alias("bin")
    near = with_group_values(rows, model, keys, few=few).select(*keys, *FEATURES, bin_of)
    filled = near.groupBy(*keys, "bin").agg(F.count("*").alias("c"))
    upto = Window.partitionBy(*keys).orderBy("bin")  # at most some thousand bins a group
    counted = filled.select("*", F.sum("c").over(upto).alias("sum"), F.ceil(F.sum("c").over(Window.partitionBy(*keys)) * support).alias("h"))
    border = counted.filter("sum >= h and sum - c < h")
    reach = cut_lineage(border.select(*keys, F.col("bin").alias("reach"), "h", ((F.col("h") - F.col("sum") + F.col("c")) / F.col("c")).alias("share")))
    inside = with_group_values(near, reach, keys, few=few).filter("bin <= reach")
    terms = {f"s{i}": F.col(f) for i, f in enumerate(FEATURES)} | {f"q{i}{j}": F.col(FEATURES[i]) * F.col(FEATURES[j]) for i in range(P) for j in range(i + 1)}
    total = lambda x: F.coalesce(F.sum(F.when(F.col("bin") < F.col("reach"), x)), F.lit(0)) + F.max("share") * F.coalesce(F.sum(F.when(F.col("bin") == F.col("reach"), x)), F.lit(0))
    sums = inside.groupBy(*keys).agg(F.max("h").cast("double").alias("h"), *[total(x).alias(k) for k, x in terms.items()])
    h, factor = F.col("h"), consistency(support) / SCALE**2
    cov = [[(F.col(f"q{i}{j}") / h - (F.col(f"s{i}") / h) * (F.col(f"s{j}") / h)) * factor + (FLOORS[i] ** 2 if i == j else 0.0) for j in range(i + 1)] for i in range(P)]
    for i in range(P):
        sums = sums.withColumn(f"m{i}", F.col(f"s{i}") / h / SCALE)
    rest = [c for c in model.columns if c not in (*keys, *MODEL, "half_log_det")]
    held = model.select(*keys, *rest, F.struct(*MODEL, "half_log_det").alias("old"))
    both = with_group_values(_factor(sums, cov, keys), held, keys, few=few)
    better = F.col("old.half_log_det").isNull() | (F.col("half_log_det") < F.col("old.half_log_det"))
    return both.select(*keys, *rest, *[F.when(better, F.col(c)).otherwise(F.col(f"old.{c}")).alias(c) for c in (*MODEL, "half_log_det")])


def estimates(rows: DataFrame, keys: list[str], *, support: float = SUPPORT) -> DataFrame:
    """Centre (m0..), Cholesky factor (l00..), row count ``n`` and uncorrelated start ``prior`` of every group of the stored ``rows``.

    ``TRIAL_STEPS`` concentration steps from each start; the one of smallest determinant (ties: the first) takes ``STEPS`` more.
    """
    few = few_rows(rows.select(*keys).distinct())
    starts = cut_lineage(_starts(rows, keys, few))
    trial = starts
    tried = rows.select("*", F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("start"))
    for _ in range(TRIAL_STEPS):
        trial = cut_lineage(_concentrate(tried, trial, [*keys, "start"], support, few))
    best = trial.groupBy(*keys).agg(F.min_by(F.struct("n", *MODEL, "half_log_det"), F.struct("half_log_det", "start")).alias("b"))
    model = cut_lineage(best.select(*keys, "b.*"))
    for _ in range(STEPS):
        model = cut_lineage(_concentrate(rows, model, keys, support, few))
    prior = starts.filter("start = 0").select(*keys, F.struct(*MODEL).alias("prior"))
    return cut_lineage(with_group_values(model, prior, keys, few=few))


def judge(df: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", prior_rows: float = PRIOR_ROWS, cutoff: float = CUTOFF, keep: dict[str, str] | None = None) -> DataFrame:
    """Statistics, ``base_failed``, ``distance`` (squared) and ``kept`` for every row, beside the columns ``keep`` (new name: column).

    The estimate of a language and source uses the rows that pass the base rules and is drawn towards those of its
    language and of the table as if these were ``prior_rows`` rows more (``pair_estimates``), so every such row has a
    distance. Null languages and sources are groups like any other; a null or empty text fails the base rules.
    Repeated rows are judged alike, an empty table gives an empty result. Extra columns of ``df`` take no part
    unless ``keep`` names them; a new name there that is one of the result's own columns raises an error.
    """
    names = keep or {}
    if taken_names := {*names} & {*STATISTICS, "base_failed", "kept", "distance", *FEATURES, *MODEL, "_lang", "_source", "_t", "_words", "_lines", "_hashes", "_runs", "_sorted", "_at", "half_log_det"}:
        raise ValueError(f"names of the result cannot be kept columns: {sorted(taken_names)}")
    taken = df.select(*[F.col(c).alias(k) for k, c in names.items()], F.col(lang).alias("_lang"), F.col(source).alias("_source"), F.col(text).alias("_text"))
    stats = with_statistics(taken, "_text", keep=(*names, "_lang", "_source")).withColumn("base_failed", _base_failed())
    return _judged(stats, list(names), prior_rows, cutoff)


def _judged(stats: DataFrame, names: list[str], prior_rows: float, cutoff: float) -> DataFrame:
    # the narrow table of statistics is stored once; every step reads it and not the texts
    stats = cut_lineage(stats.select("*", *[c.alias(k) for k, c in _features().items()]))
    model = pair_estimates(stats.filter(~F.col("base_failed")).select("_lang", "_source", *FEATURES), prior_rows)
    out = with_group_values(stats, model, ["_lang", "_source"])
    distance = F.when(~F.col("base_failed"), _distance())
    verdict = ~F.col("base_failed") & (distance <= cutoff)
    return out.select(*names, *STATISTICS, "base_failed", verdict.alias("kept"), distance.alias("distance"))


def keep_good(df: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", prior_rows: float = PRIOR_ROWS, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``df``, all columns unchanged, that ``judge`` keeps.

    Rows are stored once with their statistics and read again for the estimates and the verdict, so no text is
    shuffled or measured twice, and repeated or null keys do no harm.
    """
    stats = with_statistics(packed(df, _text=text, _lang=lang, _source=source), "_text", keep=("row", "_lang", "_source"))
    # stored before it is filtered: a filter would be moved below and repeat the array expressions for every element
    stats = cut_lineage(stats.withColumn("base_failed", _base_failed()).select("*", *[c.alias(k) for k, c in _features().items()]))
    model = pair_estimates(stats.filter(~F.col("base_failed")).select("_lang", "_source", *FEATURES), prior_rows)
    out = with_group_values(stats, model, ["_lang", "_source"])
    return unpacked(out.filter(~F.col("base_failed") & (_distance() <= cutoff)))


def pair_estimates(good: DataFrame, prior_rows: float = PRIOR_ROWS) -> DataFrame:
    """Stored centre and factor for every language and source of the stored feature rows.

    Three levels are estimated alike, the table, each language and each pair. Every estimate of n rows is drawn towards
    the level above it with the weight of ``prior_rows`` rows, centre and covariance both: n / (n + prior_rows) of its
    own and the rest of the other. The table is drawn towards its medians and their deviations. The formula is the
    same at every size; a pair of many rows stands on its own estimate, one of a few rows mostly on its language's.
    """
    keys = ["g_level", "g_lang", "g_source"]
    lang, source = (good.schema[c].dataType.simpleString() for c in ("_lang", "_source"))
    level = F.expr(
        f"inline(array(named_struct('g_level', 0, 'g_lang', CAST(NULL AS {lang}), 'g_source', CAST(NULL AS {source})), "
        f"named_struct('g_level', 1, 'g_lang', _lang, 'g_source', CAST(NULL AS {source})), named_struct('g_level', 2, 'g_lang', _lang, 'g_source', _source)))")
    # one estimate for each group and level; the table of three times the narrow rows is stored once
    found = estimates(cut_lineage(good.select(*FEATURES, level)), keys)
    own = found.select(*keys, "n", F.struct(*MODEL).alias("own"), "prior")
    table = _drawn(own.filter("g_level = 0"), ["g_level"], prior_rows)
    at = lambda k: own.filter(F.col("g_level") == k).drop("prior")
    lifted = table.select((F.col("g_level") + 1).alias("g_level"), "prior")
    langs = _drawn(with_group_values(at(1), cut_lineage(lifted), ["g_level"], few=True), ["g_lang"], prior_rows)
    pairs = _drawn(with_group_values(at(2), cut_lineage(langs), ["g_lang"]), ["g_lang", "g_source"], prior_rows)
    return cut_lineage(pairs.select(F.col("g_lang").alias("_lang"), F.col("g_source").alias("_source"), "prior.*"))


def _drawn(groups: DataFrame, keys: list[str], prior_rows: float) -> DataFrame:
    """``keys`` and the estimate ``own`` of ``n`` rows drawn towards ``prior``, again as ``prior``."""
    weight = F.col("n") / (F.col("n") + prior_rows)
    mixed = lambda a, b: weight * a + (1.0 - weight) * b
    own, other = _covariance("own."), _covariance("prior.")
    cov = [[mixed(own[i][j], other[i][j]) for j in range(i + 1)] for i in range(P)]
    centred = groups.select("*", *[mixed(F.col(f"own.m{i}"), F.col(f"prior.m{i}")).alias(f"m{i}") for i in range(P)])
    return _factor(centred, cov, keys).select(*keys, F.struct(*MODEL).alias("prior"))
