"""Merkle manifest of a table as a content-addressed DAG, and proofs by descent from its root.

Rows are leaves, ordered by key inside their group; runs of ``FANOUT`` digests hash to the digest above until
one is left, the group's subroot. Subroots in group order make the tree on top in the same way.

Stored are records from a digest to its children's digests, one table for every level. A request for a leaf starts
at the root and goes down by the digits of its rank to the base ``FANOUT``: the digest at hand finds its
record, the digit picks the child, and the children not picked become a path segment (those left and
those right of it). Requests with the same leading digits go down together, so the work of a level is its
number of nodes and not the number of leaves. Reversed segments are the proof, from the leaf up to the root.

Places come from a range partitioning and per-partition counts, so a group that holds most rows is
spread over many tasks. Digests are lowercase hexadecimal SHA-256 text throughout.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefixledger.llm.common import cut_lineage, with_group_values

FANOUT = 8
_BITS = 3
_SEGMENT = "array<struct<left:string,right:string>>"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    """SHA-256 of the values, each as UTF-8 byte count, colon and text, or a hyphen if null."""
    return F.sha2(F.concat(*[_field(v) for v in values]), 256)


def node_digest(children: Column) -> Column:
    return F.sha2(F.concat_ws("", children), 256)


class Manifest(NamedTuple):
    """Stored frames: ``groups`` holds the rows below each lowest node, ``records[k]`` the nodes k + 1 levels above the leaves,
    ``subroots`` one row for each group of rows, ``top[k]`` the nodes over the subroots. ``root`` is None for an empty table."""

    groups: DataFrame
    records: list[DataFrame]
    subroots: DataFrame
    top: list[DataFrame]
    root: str | None


def _placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Stored rows with ``place``, counted from 0 inside each value of ``group`` (null is one), and ``n``, the group's size."""
    stored = cut_lineage(rows.withColumn("_row", F.monotonically_increasing_id()))
    by = [F.col(c).asc_nulls_first() for c in (group, *order, "_row")]
    numbered = cut_lineage(stored.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()).drop("_row"))
    numbered = numbered.withColumn("_part", F.shiftrightunsigned("_at", 33))
    parts = numbered.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    inside = Window.partitionBy(group)
    before = inside.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut_lineage(parts.select(group, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(inside).alias("n")))
    found = with_group_values(numbered, parts, [group, "_part"])
    return found.withColumn("place", F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_part", "_first", "_before")


def _record(nodes: DataFrame) -> DataFrame:
    return cut_lineage(nodes.groupBy("digest").agg(F.first("children").alias("children")))


def _raise(nodes: DataFrame) -> DataFrame:
    """The next level of rows ``tree, place, n, digest``: those of trees that still have several nodes."""
    up = nodes.filter("n > 1").groupBy("tree", F.shiftright("place", _BITS).alias("place"), F.ceil(F.col("n") / FANOUT).alias("n"))
    up = up.agg(F.array_sort(F.collect_list(F.struct("place", "digest"))).alias("c")).withColumn("children", F.col("c.digest")).drop("c")
    return cut_lineage(up.withColumn("digest", node_digest(F.col("children"))))


def _grown(level: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """All levels from a first one that has ``children``, until every tree has one node: nodes and records of each."""
    levels, records = [level], [_record(level)]
    while levels[-1].filter("n > 1").limit(1).count():
        levels.append(_raise(levels[-1]))
        records.append(_record(levels[-1]))
    return levels, records


def manifest(df: DataFrame, *, key: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), carry: dict[str, Column] | None = None) -> Manifest:
    """Hash every row of ``df`` and store the DAG over all rows; ``carry`` adds columns that stay with the leaves.

    Null fields hash as a hyphen, empty ones as ``0:``; null groups form a group, which comes first. Equal keys stand in the
    order of their leaf digests, null keys first; wholly equal rows are leaves of their own. Other columns of ``df``,
    whatever their names, play no part. Texts may be of any length. An empty table has no root.
    """
    carry = carry or {}
    rows = df.select(F.col(f"`{group}`").cast("string").alias("tree"), F.col(f"`{key}`").alias("key"), leaf_digest(*[F.col(f"`{f}`") for f in fields]).alias("leaf"), F.struct(F.lit(0).alias("_"), *[c.alias(k) for k, c in carry.items()]).alias("carried"))
    leaves = _placed(rows, "tree", ["key", "leaf"])
    groups = leaves.groupBy("tree", F.shiftright("place", _BITS).alias("place"), F.col("n").alias("leaves"))
    groups = groups.agg(F.array_sort(F.collect_list(F.struct("place", "leaf", "key", "carried"))).alias("members"))
    groups = cut_lineage(groups.withColumn("digest", F.when(F.col("leaves") > 1, node_digest(F.col("members.leaf"))).otherwise(F.col("members")[0]["leaf"])))
    lowest = groups.filter("leaves > 1").select("tree", "place", F.ceil(F.col("leaves") / FANOUT).alias("n"), F.col("members.leaf").alias("children"), "digest")
    levels, records = _grown(lowest)
    ends = groups.filter("leaves = 1").select("tree", "digest", F.lit(0).alias("height"))
    for k, level in enumerate(levels):
        ends = ends.unionByName(level.filter("n = 1").select("tree", "digest", F.lit(k + 1).alias("height")))
    subroots = cut_lineage(_placed(ends.withColumn("all", F.lit(0)), "all", ["tree"]).drop("all"))
    bottom = subroots.select(F.lit(None).cast("string").alias("tree"), "place", "n", "digest")
    tops, top_records = [], []
    if bottom.filter("n > 1").limit(1).count():
        tops, top_records = _grown(_raise(bottom))
    last = (tops[-1] if tops else bottom).select("digest").first()
    return Manifest(groups, records, subroots, top_records, last["digest"] if last else None)


def _opened(frontier: DataFrame, records: DataFrame) -> DataFrame:
    """Each node of the frontier with its ``children``, found by its digest."""
    held = records.select(F.col("digest").alias("_d"), "children")
    return frontier.join(held, F.col("digest") == F.col("_d")).drop("_d")


def _segment(children: Column, digit: Column) -> Column:
    """The children not picked: those left and those right of the digit."""
    rest = F.array_size(children)
    return F.struct(F.concat_ws("", F.slice(children, F.lit(1), digit)).alias("left"), F.concat_ws("", F.slice(children, digit + 2, rest)).alias("right"))


def _down(frontier: DataFrame, records: DataFrame, wanted: DataFrame | None, keys: list[str]) -> DataFrame:
    """One step of all requests: pick children by digit, keep the rest as a segment, leave out what nobody asked for."""
    opened = _opened(frontier, records)
    others = [c for c in frontier.columns if c not in ("digest", "place", "path")]
    step = opened.select(*others, "place", "path", "children", F.posexplode("children").alias("digit", "digest"))
    step = step.select(*others, "digest", (F.col("place") * FANOUT + F.col("digit")).alias("place"), F.concat("path", F.array(_segment(F.col("children"), F.col("digit")))).alias("path"))
    return step if wanted is None else _asked(step, wanted, keys)


def _asked(nodes: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    held = wanted.select(*[F.col(k).alias(f"_w_{k}") for k in keys])
    return nodes.join(held, [F.col(k).eqNullSafe(F.col(f"_w_{k}")) for k in keys], "left_semi")


def proofs(held: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """``tree, place, key, leaf, carried, subroot, root, path`` of every leaf, or of those in ``requests`` (``tree, place``).

    ``path`` is the proof: segments ``left, right`` from the leaf's run up to the root, joined digests in each.
    Requests for places that do not exist give no row, repeated ones give one.
    """
    spark = held.groups.sparkSession
    ranks = wanted = None
    if requests is not None:
        wanted = cut_lineage(requests.select(F.col("tree").cast("string").alias("tree"), F.col("place").cast("long").alias("place")).distinct())
        trees = held.subroots.select("tree", F.col("place").alias("rank"))
        asked = wanted.select(F.col("tree").alias("_t")).distinct()
        ranks = cut_lineage(trees.join(asked, F.col("tree").eqNullSafe(F.col("_t"))).select(F.col("rank").alias("place")))
    at = lambda rows, k, keys: None if rows is None else rows.select(*[F.shiftright("place", _BITS * k).alias("place") if c == "place" else c for c in keys]).distinct()
    frontier = spark.createDataFrame([(held.root, 0, [])] if held.root else [], f"digest string, place long, path {_SEGMENT}")
    for k in range(len(held.top) - 1, -1, -1):
        frontier = _down(frontier, held.top[k], at(ranks, k, ["place"]), ["place"])
    if ranks is not None and not held.top:
        frontier = _asked(frontier, ranks, ["place"])
    # the leaves of the top tree are the subroots: each goes on in its own tree, where it is known by its rank
    known = held.subroots.select("tree", F.col("place").alias("_rank"), "height")
    entered = frontier.join(known, F.col("place") == F.col("_rank")).select("tree", "height", F.lit(0).cast("long").alias("place"), "digest", F.col("digest").alias("subroot"), "path")
    entered = cut_lineage(entered)
    down, keys = None, ["tree", "place"]
    for k in range(len(held.records) - 1, 0, -1):
        here = entered.filter(F.col("height") == k + 1)
        down = _down(here if down is None else down.unionByName(here), held.records[k], at(wanted, k, keys), keys)
    # the last step stays by runs of leaves until the end, so paths are shuffled once a run
    lowest = entered.filter("height = 1") if down is None else down.unionByName(entered.filter("height = 1"))
    lowest = _opened(lowest, held.records[0]).unionByName(entered.filter("height = 0").withColumn("children", F.lit(None).cast("array<string>")))
    runs = held.groups.select(F.col("tree").alias("_t"), F.col("place").alias("_p"), "members")
    met = lowest.join(runs, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("place") == F.col("_p")))
    leaves = met.select("tree", "children", "subroot", "path", F.explode("members").alias("m"))
    digit = F.pmod(F.col("m.place"), F.lit(FANOUT)).cast("int")
    path = F.when(F.col("children").isNull(), F.col("path")).otherwise(F.concat("path", F.array(_segment(F.col("children"), digit))))
    out = leaves.select("tree", F.col("m.place").alias("place"), F.col("m.key").alias("key"), F.col("m.leaf").alias("leaf"), F.col("m.carried").alias("carried"), "subroot", F.lit(held.root).alias("root"), F.reverse(path).alias("path"))
    return out if wanted is None else _asked(out, wanted, keys)


def proof_digest(path: Column) -> Column:
    """SHA-256 of all digests of a proof, from the leaf's run to the root, left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda s: F.concat(s["left"], s["right"]))), 256)


def folded(path: Column, leaf: Column) -> Column:
    """The root that a proof gives for a leaf digest."""
    return F.aggregate(path, leaf, lambda below, s: F.sha2(F.concat(s["left"], below, s["right"]), 256))


def audited(docs: DataFrame) -> DataFrame:
    """Digest columns of the manifest of ``documents``, with proofs folded from texts tampered where 3 divides crc32(doc_id)."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    other = F.when(chosen, leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), lower))
    rows = proofs(manifest(docs, carry={"tampered": other}))
    root = folded(F.col("path"), F.coalesce("carried.tampered", "leaf"))
    out = rows.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), root.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: DuckDB statement over the whole table.
ORACLE = """
WITH RECURSIVE raw AS (
  SELECT doc_id, lang, text, concat(
    CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END,
    CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
    CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END,
    CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END) AS head,
    xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT), lambda c, b:
      list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END)), 4294967295::BIGINT) AS crc
  FROM documents),
hashed AS (SELECT doc_id, lang, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
  CASE WHEN crc % 3 = 0 THEN sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END) END AS other FROM raw),
leaves AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, leaf) AS id, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n,
  dense_rank() OVER (ORDER BY lang NULLS FIRST) AS tree FROM hashed),
nodes AS (SELECT tree, 0 AS lvl, place, n, leaf AS digest FROM leaves
  UNION ALL SELECT tree, lvl + 1, place // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY place)) FROM nodes WHERE n > 1 GROUP BY tree, lvl, place // 8, n),
subroots AS (SELECT tree, lvl AS height, digest, tree - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper_nodes AS (SELECT 0 AS lvl, place, n, digest FROM subroots
  UNION ALL SELECT lvl + 1, place // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY place)) FROM upper_nodes WHERE n > 1 GROUP BY lvl, place // 8, n),
steps AS (SELECT l.id, o.lvl, string_agg(o.digest, '' ORDER BY o.place) FILTER (o.place < l.place >> (3 * o.lvl)) AS lefts, string_agg(o.digest, '' ORDER BY o.place) FILTER (o.place > l.place >> (3 * o.lvl)) AS rights
  FROM leaves l JOIN nodes o ON o.tree = l.tree AND o.n > 1 AND o.place // 8 = l.place >> (3 * o.lvl + 3) GROUP BY l.id, o.lvl
  UNION ALL SELECT l.id, s.height + o.lvl, string_agg(o.digest, '' ORDER BY o.place) FILTER (o.place < s.place >> (3 * o.lvl)), string_agg(o.digest, '' ORDER BY o.place) FILTER (o.place > s.place >> (3 * o.lvl))
  FROM leaves l JOIN subroots s ON s.tree = l.tree JOIN upper_nodes o ON o.n > 1 AND o.place // 8 = s.place >> (3 * o.lvl + 3) GROUP BY l.id, s.height, o.lvl),
proof AS (SELECT id, string_agg(coalesce(lefts, '') || coalesce(rights, ''), '' ORDER BY lvl) AS digests FROM steps GROUP BY id),
fold AS (SELECT id, 0 AS lvl, coalesce(other, leaf) AS digest FROM leaves
  UNION ALL SELECT f.id, f.lvl + 1, sha256(coalesce(s.lefts, '') || f.digest || coalesce(s.rights, '')) FROM fold f JOIN steps s ON s.id = f.id AND s.lvl = f.lvl),
ends AS (SELECT id, arg_max(digest, lvl) AS digest FROM fold GROUP BY id)
SELECT l.doc_id, l.leaf, s.digest AS subroot, r.digest AS root, sha256(coalesce(p.digests, '')) AS proof_sha256, e.digest AS folded_root, e.digest = r.digest AS verified
FROM leaves l JOIN subroots s ON s.tree = l.tree JOIN (SELECT digest FROM upper_nodes WHERE n = 1) r ON true LEFT JOIN proof p ON p.id = l.id JOIN ends e ON e.id = l.id
"""
