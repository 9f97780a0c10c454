"""Exact top-k search by inner product: a ball tree per shard, branch and bound, shared k-th scores.

Every shard builds a ball tree (centre and radius per node) over its vectors. No vector of a node can
score above ``q . centre + |q| * radius``; nodes are visited in the order of that bound and a subtree is
left once the bound is below the query's current k-th score. A first round takes only the best
leaf of each shard; the highest k-th score that any shard reaches there is shared with all shards as the start
of the second round, which is complete. Scores are integer inner products, exact in float64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefixledger.llm.common import cut_lineage

LEAF = 256
SHARD_ROWS = 10_000
QUERY_BLOCK = 1_000


def as_integers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null if the vector is null or a component is null or not finite."""
    fine = F.forall(vector, lambda x: F.coalesce((x.cast("double") > float("-inf")) & (x.cast("double") < float("inf")), F.lit(False)))
    return F.when(fine, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


class BallTree:
    """Nodes as arrays: centre, radius, children or rows. ``ids`` break ties, so rows keep them beside the vectors."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        self.vectors, self.ids = vectors, ids
        self.centres, self.radii, self.children, self.spans = [], [], [], []
        self.order = np.arange(len(ids))
        self._build(0, len(ids), leaf)
        self.centres, self.radii = np.array(self.centres), np.array(self.radii)
        self.vectors, self.ids = vectors[self.order], ids[self.order]

    def _build(self, begin: int, end: int, leaf: int) -> int:
        """Splits between the two poles of a node; the stack keeps the depth off Python's."""
        stack, root = [(begin, end, None)], 0
        while stack:
            begin, end, parent = stack.pop()
            rows = self.vectors[self.order[begin:end]]
            centre = rows.mean(axis=0)
            away = ((rows - centre) ** 2).sum(axis=1)
            node = len(self.radii)
            self.centres.append(centre)
            self.radii.append(float(np.sqrt(away.max())))
            self.children.append([])
            self.spans.append((begin, end))
            if parent is not None:
                self.children[parent].append(node)
            if end - begin <= leaf or not away.max():
                continue
            pole = rows[int(away.argmax())]
            other = rows[int(((rows - pole) ** 2).sum(axis=1).argmax())]
            middle = (end - begin) // 2
            along = np.argsort(rows @ (other - pole), kind="stable")
            self.order[begin:end] = self.order[begin:end][along]
            stack += [(begin, begin + middle, node), (begin + middle, end, node)]
        return root

    def bounds(self, queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Upper bounds of inner products for each query and node, with room for rounding."""
        lengths = np.sqrt((queries**2).sum(axis=1))
        reach = self.radii[nodes] + 1e-9 * (1 + np.abs(self.centres[nodes]).sum(axis=1))
        return queries @ self.centres[nodes].T + lengths[:, None] * reach * (1 + 1e-12) + 1e-6

    def best_leaf(self, query: np.ndarray) -> int:
        node = 0
        while self.children[node]:
            pair = np.array(self.children[node])
            node = int(pair[self.bounds(query[None], pair)[0].argmax()])
        return node

    def search(self, query: np.ndarray, own: int, k: int, floor: float) -> list[tuple[int, int]]:
        """The k best (score, id), ties to the smaller id, among those that score ``floor`` or more."""
        import heapq

        top = np.zeros((0, 2), dtype=np.int64)
        heap = [(-float(self.bounds(query[None], np.array([0]))[0, 0]), 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            kth = float(top[k - 1, 0]) if len(top) >= k else floor
            if -bound < max(kth, floor):
                break
            if self.children[node]:
                pair = np.array(self.children[node])
                for limit, child in zip(self.bounds(query[None], pair)[0].tolist(), self.children[node], strict=True):
                    if limit >= max(kth, floor):
                        heapq.heappush(heap, (-limit, child))
                continue
            top = np.concatenate([top, self._scored(node, query, own, max(kth, floor))])
            top = top[np.lexsort((top[:, 1], -top[:, 0]))][:k]
        return top.tolist()

    def _scored(self, node: int, query: np.ndarray, own: int, floor: float) -> np.ndarray:
        begin, end = self.spans[node]
        scores = np.rint(self.vectors[begin:end] @ query).astype(np.int64)
        fine = (scores >= floor) & (self.ids[begin:end] != own)
        return np.stack([scores[fine], self.ids[begin:end][fine]], axis=1)

    def first_kth(self, query: np.ndarray, own: int, k: int) -> float:
        """k-th best score of the best leaf alone; minus infinity if it has fewer."""
        top = np.sort(self._scored(self.best_leaf(query), query, own, -np.inf)[:, 0])
        return float(top[-k]) if len(top) >= k else -np.inf


def _matrix(column: pa.Array) -> np.ndarray:
    width = len(column[0]) if len(column) else 0
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), width)


def top_k(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", is_query: Column, k: int = 5, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK, leaf: int = LEAF) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows for every query row, all other rows being candidates.

    Shards hold about ``shard_rows`` vectors of one dimension, queries go through them in blocks of
    ``query_block``, so memory is bounded whatever the table's size. Rows with a null key or an unusable vector take no part;
    vectors of another dimension than the query's are no candidates. Rows that repeat a query's key ask once (the smallest
    vector asks) and are no candidates of it. Equal scores go to the smaller keys. An empty table gives an empty result.
    """
    usable = df.select(F.col(key).cast("long").alias("id"), as_integers(F.col(vector)).alias("v"), is_query.alias("q")).filter("id is not null and v is not null and size(v) > 0")
    rows = cut_lineage(usable.withColumn("dim", F.size("v")))
    sizes = rows.agg(F.count("*"), F.count_if("q")).first()
    shards, blocks = max(1, -(-sizes[0] // shard_rows)), max(1, -(-sizes[1] // query_block))
    # two kinds of rows meet under (shard, block): the shard's vectors and the block's queries
    candidates = rows.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("asks", F.lit(False))
    asked = rows.filter("q").groupBy("id").agg(F.min(F.struct("dim", "v")).alias("w")).select("id", "w.*").withColumn("block", F.pmod(F.xxhash64("v", "id"), F.lit(blocks)))
    queries = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("asks", F.lit(True))
    columns = ["dim", "shard", "block", "asks", "id", "v"]
    floors = cut_lineage(_meet(candidates, queries.withColumn("floor", F.lit(float("-inf"))), columns, k, leaf, first=True).groupBy("query_id").agg(F.max("score").alias("floor")))
    held = queries.join(floors.withColumnRenamed("query_id", "id"), "id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    found = _meet(candidates, held, columns, k, leaf, first=False)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("score").cast("long").alias("score"))


def _meet(candidates: DataFrame, queries: DataFrame, columns: list[str], k: int, leaf: int, *, first: bool) -> DataFrame:
    both = candidates.withColumn("floor", F.lit(0.0)).select(*columns, "floor").unionByName(queries.select(*columns, "floor"))
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])

    def run(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy()
        vectors = _matrix(group.column("v").combine_chunks())
        ids, floors = group.column("id").to_numpy(), group.column("floor").to_numpy()
        out: list[tuple[int, int | None, float]] = []
        if (~asks).any() and asks.any():
            tree = BallTree(vectors[~asks], ids[~asks], leaf)
            for query, own, floor in zip(vectors[asks], ids[asks].tolist(), floors[asks].tolist(), strict=True):
                if first:
                    out.append((own, None, tree.first_kth(query, own, k)))
                else:
                    out += [(own, vec, float(score)) for score, vec in tree.search(query, own, k, floor)]
        columns = list(zip(*out, strict=True)) if out else [(), (), ()]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    return both.groupBy("dim", "shard", "block").applyInArrow(run, schema)


#: DuckDB statement over the whole table.
ORACLE = """
WITH usable AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
