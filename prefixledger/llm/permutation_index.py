"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. Pivots are taken from a bounded sample (``SAMPLE`` rows by
hash); every row is indexed. Rows are dealt to shards of about ``SHARD_ROWS``; inside a shard each pivot has an
inverted file of the vectors that name it, with the pivot's position in their order. A search walks the files of the
query's own pivots and adds up the footrule distance of the two orders (a pivot that only one of them names
counts as standing right behind the end of the other); the nearest ``RERANK`` share of a shard's vectors, ``LEAST`` at least, is
compared by exact distance. The share keeps recall the same at every size: on the tables here it is above 0.95.

Equal vectors of a shard are one entry with all its ids, so copies never crowd out others. Shards are stored once;
queries are sent to them and meet a shard in the order of a sort: first its vectors and files, then queries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefixledger.llm.common import cut_lineage, with_group_values

PIVOTS = 256
NAMED = 128
SAMPLE = 1024
SHARD_ROWS = 8_192
RERANK = 0.08
LEAST = 256
_VECTOR, _FILE, _QUERY = 0, 1, 2
_ROWS = "dim int, shard int, kind int, name int, ids array<long>, v array<double>, places array<int>, ranks array<int>"


def usable(vector: Column) -> Column:
    """The vector in double precision; null if it is null, empty or zero, or a component is null or not finite."""
    fine = F.forall(vector, lambda x: F.coalesce((x.cast("double") > float("-inf")) & (x.cast("double") < float("inf")), F.lit(False)))
    return F.when(fine & F.exists(vector, lambda x: x != 0), F.transform(vector, lambda x: x.cast("double")))


def _nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, named: int) -> np.ndarray:
    """Numbers of the nearest pivots of each vector, nearest first, ties to the lower number."""
    far = (pivots**2).sum(axis=1) - 2 * vectors @ pivots.T
    return np.argsort(far, axis=1, kind="stable")[:, :named]


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.zeros(0), kind))


def fit_pivots(rows: DataFrame, pivots: int, sample: int) -> dict[int, np.ndarray]:
    """Pivots of every dimension that the sample holds, from rows ``row, v, dim``; distinct vectors, at most ``pivots`` each."""
    drawn = rows.select("dim", "v", F.xxhash64("row", "v").alias("h")).orderBy("h").limit(sample).collect()
    out: dict[int, dict[tuple, None]] = {}
    for r in drawn:
        held = out.setdefault(r.dim, {})
        if len(held) < pivots:
            held[tuple(r.v)] = None
    return {dim: np.array(list(held), dtype=np.float64) for dim, held in out.items()}


def _entries(group: pa.Table, pivots: dict[int, np.ndarray], named: int) -> pa.Table:
    """Index rows of one shard: its distinct vectors with their ids, and one inverted file for each pivot."""
    dim, shard = group.column("dim")[0].as_py(), group.column("shard")[0].as_py()
    vectors = np.asarray(group.column("v").combine_chunks().flatten(), dtype=np.float64).reshape(-1, dim)
    ids = group.column("id").to_numpy()
    distinct, place = np.unique(vectors + 0.0, axis=0, return_inverse=True)
    order = np.lexsort((ids, place.reshape(-1)))
    counts = np.bincount(place.reshape(-1), minlength=len(distinct))
    n = len(distinct)
    parts = [np.split(ids[order], np.cumsum(counts)[:-1])]
    orders = _nearest_pivots(distinct, pivots[dim], named) if dim in pivots else np.zeros((n, 0), dtype=np.int64)
    flat = orders.reshape(-1)
    by = np.argsort(flat, kind="stable")
    names, sizes = np.unique(flat, return_counts=True)
    cuts = np.cumsum(sizes)[:-1]
    width = max(1, orders.shape[1])
    places = np.split((by // width).astype(np.int32), cuts) if len(names) else []
    ranks = np.split((by % width).astype(np.int32), cuts) if len(names) else []
    m = len(names)
    empty = lambda k, kind: _lists([np.zeros(0)] * k, kind)
    return pa.table(
        {
            "dim": pa.array([dim] * (n + m), pa.int32()),
            "shard": pa.array([shard] * (n + m), pa.int32()),
            "kind": pa.array([_VECTOR] * n + [_FILE] * m, pa.int32()),
            "name": pa.array([*range(n), *names.tolist()], pa.int32()),
            "ids": pa.chunked_array([_lists(parts[0], pa.int64()), empty(m, pa.int64())]),
            "v": pa.chunked_array([_lists(list(distinct), pa.float64()), empty(m, pa.float64())]),
            "places": pa.chunked_array([empty(n, pa.int32()), _lists(places, pa.int32())]),
            "ranks": pa.chunked_array([empty(n, pa.int32()), _lists(ranks, pa.int32())]),
        }
    )


class Shard:
    """One shard as its rows come in; ``search`` may be called once they all have."""

    def __init__(self, dim: int, named: int):
        self.dim, self.named = dim, named
        self.vectors: dict[int, np.ndarray] = {}
        self.ids: dict[int, np.ndarray] = {}
        self.files: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.table: np.ndarray | None = None

    def add(self, kind: int, name: int, ids: np.ndarray, v: np.ndarray, places: np.ndarray, ranks: np.ndarray) -> None:
        if kind == _VECTOR:
            self.vectors[name], self.ids[name] = v, ids
        else:
            self.files[name] = (places, ranks)

    def _close(self) -> None:
        n = len(self.vectors)
        self.table = np.stack([self.vectors[k] for k in range(n)]) if n else np.zeros((0, self.dim))
        first = np.array([self.ids[k][0] for k in range(n)], dtype=np.int64)
        self.turn = np.empty(n, dtype=np.int64)
        self.turn[np.argsort(first, kind="stable")] = np.arange(n)
        self.vectors.clear()

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Footrule distance to every vector, less a constant of the query."""
        far = np.zeros(len(self.table), dtype=np.int64)
        for rank, pivot in enumerate(order.tolist()):
            if pivot in self.files:
                places, ranks = self.files[pivot]
                # both name it: the gap of the positions, instead of twice the way to the ends
                far[places] += np.abs(ranks - rank) - (self.named - rank) - (self.named - ranks)
        return far

    def search(self, query: np.ndarray, own: int, order: np.ndarray, k: int, rerank: float, least: int) -> list[tuple[float, int]]:
        """The k nearest (distance, id) among the vectors nearest by footrule, ties to the smaller id."""
        if self.table is None:
            self._close()
        n = len(self.table)
        take = n if not self.files else min(n, max(least, int(np.ceil(rerank * n))))
        chosen = np.arange(n)
        if take < n:
            chosen = np.argpartition(self.footrule(order) * n + self.turn, take - 1)[:take]
        far = np.sqrt(((self.table[chosen] - query) ** 2).sum(axis=1))
        if len(far) > k + 1:
            near = far <= np.partition(far, k)[k]
            chosen, far = chosen[near], far[near]
        # k + 1 ids of each vector are enough, one may be the query's own; repeated rows of the own id never fill them up
        found = [(d, i) for d, c in zip(far.tolist(), chosen.tolist(), strict=True) for i in self.ids[c][self.ids[c] != own][:k].tolist()]
        return sorted(found)[:k]


def _split(column: pa.Array) -> list[np.ndarray]:
    values, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip((offsets[:-1] - offsets[0]).tolist(), (offsets[1:] - offsets[0]).tolist(), strict=True)]


def build(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, named: int = NAMED, sample: int = SAMPLE, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, DataFrame, dict[int, np.ndarray]]:
    """The stored index of all usable rows, the number of shards of every dimension, and the pivots."""
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), usable(F.col(f"`{vector}`")).alias("v")).filter("id is not null and v is not null")
    rows = cut_lineage(rows.withColumn("dim", F.size("v")).withColumn("row", F.monotonically_increasing_id()))
    fitted = fit_pivots(rows, pivots, sample)
    held = rows.sparkSession.sparkContext.broadcast(fitted)
    dims = cut_lineage(rows.groupBy("dim").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards")))
    dealt = with_group_values(rows, dims, ["dim"]).withColumn("shard", F.pmod(F.xxhash64("row"), F.col("shards")).cast("int")).select("dim", "shard", "id", "v")
    index = dealt.groupBy("dim", "shard").applyInArrow(lambda group: _entries(group, held.value, named), _ROWS)
    return cut_lineage(index), dims, fitted


def nearest(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", is_query: Column, k: int = 10, pivots: int = PIVOTS, named: int = NAMED, sample: int = SAMPLE, shard_rows: int = SHARD_ROWS, rerank: float = RERANK, least: int = LEAST) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows found for every query row by Euclidean distance.

    Rows with a null key or an unusable vector (see ``usable``) take no part; vectors of another dimension than the query's
    are no candidates. Rows that repeat a query's key ask once (the smallest vector asks) and are no candidates of it.
    Equal distances go to the smaller keys; a repeated other row counts as often as it stands there. A dimension that is
    not in the sample has no pivots and its few rows are all compared. An empty table gives an empty result. Columns
    of other names play no part.
    """
    index, dims, fitted = build(df, key=key, vector=vector, pivots=pivots, named=named, sample=sample, shard_rows=shard_rows)
    held = index.sparkSession.sparkContext.broadcast(fitted)
    asked = df.select(F.col(f"`{key}`").cast("long").alias("id"), usable(F.col(f"`{vector}`")).alias("v"), is_query.alias("q")).filter("q and id is not null and v is not null")
    asked = asked.groupBy("id").agg(F.min(F.struct(F.size("v").alias("dim"), F.col("v"))).alias("w")).select("id", "w.*")
    sent = with_group_values(asked, dims, ["dim"]).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    none = F.array().cast("array<int>")
    sent = sent.select("dim", "shard", F.lit(_QUERY).alias("kind"), F.lit(0).alias("name"), F.array("id").alias("ids"), "v", none.alias("places"), none.alias("ranks"))
    met = index.unionByName(sent).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "kind")

    def run(batches):
        shard, place = None, None
        for batch in batches:
            dims_, shards, kinds, names = (batch.column(c).to_numpy() for c in ("dim", "shard", "kind", "name"))
            ids, vs, places, ranks = (_split(batch.column(c)) for c in ("ids", "v", "places", "ranks"))
            out: list[tuple[int, int, float]] = []
            for row in range(batch.num_rows):
                here = (int(dims_[row]), int(shards[row]))
                if here != place:
                    shard, place = Shard(here[0], named), here
                if kinds[row] != _QUERY:
                    shard.add(int(kinds[row]), int(names[row]), ids[row], vs[row], places[row], ranks[row])
                    continue
                own, own_pivots = int(ids[row][0]), held.value.get(here[0])
                order = _nearest_pivots(vs[row][None], own_pivots, named)[0] if own_pivots is not None else np.zeros(0, dtype=np.int64)
                out += [(own, i, d) for d, i in shard.search(vs[row], own, order, k, rerank, least)]
            columns = list(zip(*out, strict=True)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "vec_id", "score"])

    found = met.mapInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
