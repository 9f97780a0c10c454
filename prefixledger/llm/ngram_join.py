"""N-gram Jaccard join: prefix filter to meet, then tries over globally ordered shingle sets.

1. Every text becomes a set of 64-bit shingle hashes; equal sets are one class. One pass also adds up
   a sketch of shingle counts of fixed size, which gives all workers the same global order: rare
   shingles first, ties by hash. Any order gives right results; this one keeps common passages out of prefixes.
2. Two linked sets share a shingle among the first n - ceil(4n/5) + 1 of both. A class sends these
   with the longest partner its position still allows. Shingles with one class go; the others tie classes
   together by one edge to a hub for each range of lengths, never by pairs.
3. Rounds: classes without an edge have no link and go. Counts among the classes left, and the shingles that tied them, give
   a finer order (those come last now), whose prefixes tie fewer. A sketch of fixed size cannot tell single shingles from passages that a
   few texts share; without rounds such ties join ever more of a growing corpus to one cluster.
4. Components of the last edges are clusters no link leaves. A cluster (or a block of a large one) goes to one task
   as a trie of ordered sets. A search goes down sharing the overlap of common beginnings and leaves a
   subtree when the shingles that remain there or in the search set cannot reach 4/9 of both lengths,
   or when all its sets already are in the searcher's component.
5. Verified links give the components. Large clusters work in rounds: blocks with shared pivots
   first, then only sets outside the cluster's main component against every block.

``a`` identifies a class: a 64-bit hash of its set and length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefixledger.llm.common import cut_lineage, tidied
from prefixledger.llm.components import components
from prefixledger.llm.shingles import mix, shingle_sets
from prefixledger.session import remove_stored, stored_frames

SIZE = 5
SKETCH_BITS = 22
SKETCH_BLOCKS = 64
#: Classes, and shingles of these, that a task takes from one cluster; larger clusters are worked in blocks.
BLOCK_CLASSES = 3_000
BLOCK_SHINGLES = 2_000_000
PIVOTS = 8
#: Orders tried at most; a round that leaves more than this share of its classes is the last.
ROUNDS = 4
STILL_TIED = 0.75


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _class_of(shingles: np.ndarray) -> int:
    """64-bit identity of a set: a mixed sum over its shingles and its length."""
    total = int(mix(shingles ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)) + len(shingles) * 0xD1B54A32D192ED03
    return int(mix(np.array([total % 2**64], dtype=np.uint64)).view(np.int64)[0])


def _scan(docs: DataFrame, size: int, bits: int) -> DataFrame:
    """Rows ``id, a, n`` of all documents and rows ``block, counts`` of every task's sketch, in one pass."""
    schema = T.StructType([docs.schema["id"], T.StructField("a", T.LongType()), T.StructField("n", T.LongType()), T.StructField("block", T.IntegerType()), T.StructField("counts", T.BinaryType())])

    def run(batches):
        sketch = np.zeros(1 << bits, dtype=np.uint32)
        shift = np.uint64(64 - bits)
        for batch in batches:
            marks, sizes, held, n_held = [], [], [], 0
            for shingles in shingle_sets(batch.column("text"), size):
                marks.append(_class_of(shingles))
                sizes.append(len(shingles))
                held.append((shingles >> shift).astype(np.int64))
                n_held += len(shingles)
                if n_held > 1 << 20:
                    np.add.at(sketch, np.concatenate(held), np.uint32(1))
                    held, n_held = [], 0
            if held:
                np.add.at(sketch, np.concatenate(held), np.uint32(1))
            n = len(marks)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(marks, pa.int64()), pa.array(sizes, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=["id", "a", "n", "block", "counts"])
        packer = zstandard.ZstdCompressor(level=1)
        parts = [packer.compress(p.tobytes()) for p in np.split(sketch, SKETCH_BLOCKS)]
        n = len(parts)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(parts, pa.binary())], names=["id", "a", "n", "block", "counts"])

    return docs.mapInArrow(tidied(run), schema)


def _order(scanned: DataFrame, bits: int) -> bytes:
    """The sketch as one byte a counter (half powers of two): its size is 2^bits whatever the corpus."""

    def add(batches):
        unpacker, sums = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for block, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts = np.frombuffer(unpacker.decompress(part.as_py()), dtype=np.uint32)
                sums[block] = sums[block] + counts if block in sums else counts.astype(np.uint64)
        for block, counts in sums.items():
            level = (2 * np.log2(counts.astype(np.float64) + 1)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["block", "level"])

    summed = scanned.filter("block is not null").select("block", "counts").repartition(SKETCH_BLOCKS, "block").mapInArrow(tidied(add), "block int, level binary")
    blocks = cut_lineage(summed).collect()  # stored first: Spark cleans the shuffles of writes, not those of collect()
    parts = {r.block: bytes(r.level) for r in blocks}
    empty = bytes((1 << bits) // SKETCH_BLOCKS)
    return b"".join(parts.get(k, empty) for k in range(SKETCH_BLOCKS))


def _bitmap(values: DataFrame, rows: int) -> tuple[bytes, int]:
    """A bitmap of the leading bits of a column of 64-bit hashes, at most 16 MB.

    It thins out what is shuffled to a join that decides; where it fills up, more rows are shuffled.
    """
    bits = min(27, max(16, (32 * rows).bit_length()))
    within = bits - 6

    def build(batches):
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            places = np.asarray(batch.column(0)).view(np.uint64) >> np.uint64(64 - bits)
            for block in np.unique(places >> np.uint64(within)).tolist():
                here = blocks.setdefault(block, np.zeros(1 << within, dtype=bool))
                here[(places[places >> np.uint64(within) == block] & np.uint64((1 << within) - 1)).astype(np.int64)] = True
        for block, here in blocks.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(here, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

    dealt = values.repartition(64, F.shiftrightunsigned(F.col(values.columns[0]), 58))
    found = {r.block: bytes(r.bits) for r in cut_lineage(dealt.mapInArrow(tidied(build), "block int, bits binary")).collect()}
    return b"".join(found.get(k, bytes((1 << within) // 8)) for k in range(64)), bits


def _may_hold(bitmap: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    places = hashes >> np.uint64(64 - bits)
    return (bitmap[(places >> np.uint64(3)).astype(np.int64)] >> (places & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _ordered(shingles: np.ndarray, order: tuple[bytes, list], bits: int) -> np.ndarray:
    """By the sketch, those that tied classes in an earlier round behind all others; ties by hash."""
    sketch, tied = order
    level = np.frombuffer(sketch, dtype=np.uint8)[shingles >> np.uint64(64 - bits)]
    for bitmap, width in tied:
        level = level | (_may_hold(np.frombuffer(bitmap, dtype=np.uint8), width, shingles).astype(np.uint8) << np.uint8(7))
    return shingles[np.lexsort((shingles, level))]


def _prefixes(docs: DataFrame, order, size: int, bits: int, only=None) -> DataFrame:
    """``t, a`` for each prefix shingle; with the bitmap ``only`` also ``n, reach``, and just for shingles it may hold.

    Reach is the longest partner that the shingle's position allows if it is the first in common.
    """
    names = ["t", "a", "n", "reach"] if only else ["t", "a"]
    schema = T.StructType([T.StructField(c, T.LongType()) for c in names])

    def run(batches):
        for batch in batches:
            held, rows = [], 0
            for shingles in shingle_sets(batch.column("text"), size):
                n = len(shingles)
                if n:
                    count = n - (4 * n + 4) // 5 + 1
                    held.append((_ordered(shingles, order.value, bits)[:count], _class_of(shingles), n))
                    rows += count
                if rows > 200_000:
                    yield _prefix_batch(held, names, only)
                    held, rows = [], 0
            if held:
                yield _prefix_batch(held, names, only)

    return docs.mapInArrow(tidied(run), schema)


def _prefix_batch(held: list, names: list[str], only) -> pa.RecordBatch:
    counts = [len(t) for t, _, _ in held]
    tokens, classes = np.concatenate([t for t, _, _ in held]), np.repeat(np.array([a for _, a, _ in held]), counts)
    if only is None:
        return pa.RecordBatch.from_arrays([_signed(tokens), pa.array(classes, pa.int64())], names=names)
    n = np.repeat(np.array([n for _, _, n in held]), counts)
    reach = (9 * (n - np.concatenate([np.arange(c) for c in counts]))) // 4 - n
    bitmap, bits = only.value
    fine = _may_hold(np.frombuffer(bitmap, dtype=np.uint8), bits, tokens)
    return pa.RecordBatch.from_arrays([_signed(tokens[fine]), pa.array(classes[fine], pa.int64()), pa.array(n[fine], pa.int64()), pa.array(reach[fine], pa.int64())], names=names)


def _ties(shared: DataFrame) -> DataFrame:
    """Edges ``u, v`` between classes that may be linked, from rows ``t, a, n, reach`` of shared prefix shingles.

    The smaller set of a link reaches the larger one's length, so it registers under all ranges of
    lengths from its own to its reach; every set looks under its own. A registered set and a
    looking one are tied to the same hub, the smallest class registered there.
    """
    bucket = lambda x: F.floor(F.log(x.cast("double")) / F.log(F.lit(1.25))).cast("int")
    strong = shared.filter("reach >= n").select("t", "a", "n", "reach", F.explode(F.sequence(bucket(F.col("n")), bucket(F.col("reach")))).alias("b"))
    hubs = cut_lineage(strong.groupBy(F.col("t").alias("ht"), F.col("b").alias("hb")).agg(F.min("a").alias("hub"), F.min("n").alias("least"), F.max("reach").alias("most")))
    looks = shared.withColumn("b", bucket(F.col("n"))).join(hubs, (F.col("t") == F.col("ht")) & (F.col("b") == F.col("hb"))).filter("least <= reach and most >= n")
    registered = strong.join(hubs, (F.col("t") == F.col("ht")) & (F.col("b") == F.col("hb")))
    edges = looks.select(F.col("a").alias("u"), F.col("hub").alias("v")).unionByName(registered.select(F.col("a").alias("u"), F.col("hub").alias("v")))
    return edges.filter("u <> v").distinct()


class _Node:
    __slots__ = ("children", "label", "longest", "members", "one", "rep", "shortest")

    def __init__(self, label: list[int], member: int, length: int):
        self.label, self.children, self.members = label, {}, []
        self.shortest = self.longest = length
        self.rep, self.one = member, True


class Trie:
    """Compressed prefix tree of ordered sets; finds links and keeps the components found so far."""

    def __init__(self):
        self.root, self.parents = _Node([], -1, 0), []
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        parents = self.parents
        while parents[x] != x:
            parents[x] = parents[parents[x]]
            x = parents[x]
        return x

    def member(self, root: int | None = None) -> int:
        """A new member, in the component of member ``root`` if given."""
        self.parents.append(len(self.parents) if root is None else self.find(root))
        return len(self.parents) - 1

    def insert(self, tokens: list[int], member: int) -> None:
        n, at, node = len(tokens), 0, self.root
        while True:
            if node is not self.root:
                node.shortest, node.longest = min(node.shortest, n), max(node.longest, n)
                node.one = node.one and self.find(node.rep) == self.find(member)
            if at == n:
                node.members.append(member)
                return
            child = node.children.get(tokens[at])
            if child is None:
                leaf = node.children[tokens[at]] = _Node(tokens[at:], member, n)
                leaf.members.append(member)
                return
            label, same = child.label, 1
            most = min(len(label), n - at)
            while same < most and label[same] == tokens[at + same]:
                same += 1
            if same < len(label):  # split the edge where the sets part
                upper = _Node(label[:same], child.rep, child.shortest)
                upper.longest, upper.one = child.longest, child.one
                child.label = label[same:]
                upper.children[child.label[0]] = child
                node.children[tokens[at]] = upper
                child = upper
            node, at = child, at + same

    def search(self, tokens: list[int], member: int) -> None:
        """Links of a set to the tree's sets of other components; each link joins two components."""
        nx, have = len(tokens), set(tokens)
        stack = [(child, 0, 0) for child in self.root.children.values()]
        while stack:
            node, depth, met = stack.pop()
            longest = node.longest
            if 5 * longest < 4 * nx or 4 * node.shortest > 5 * nx or (node.one and self.find(node.rep) == self.find(member)):
                continue
            # shingles of the longest set below that may still be missed
            spare = longest - (4 * (nx + longest) + 8) // 9
            depth_missed, dead = depth - met, False
            for token in node.label:
                if token in have:
                    met += 1
                else:
                    depth_missed += 1
                    if depth_missed > spare:
                        dead = True
                        break
            if dead:
                continue
            depth += len(node.label)
            for other in node.members:
                if 9 * met >= 4 * (nx + depth) and self.find(other) != self.find(member):
                    self.links.append((member, other))
                    self.parents[self.find(other)] = self.find(member)
            for child in node.children.values():
                stack.append((child, depth, met))


def _linked(sets: list[tuple[int, bool, int | None, list[int]]]) -> list[tuple[int, int]]:
    """Links between sets ``(class, searches, known component, ordered tokens)``; those that do not search are only found.

    Among searching sets every pair is met once, the shorter set being in the tree first.
    """
    trie, known, names = Trie(), {}, []
    members = []
    for name, _, root, _ in sets:
        member = trie.member(known.get(root) if root is not None else None)
        if root is not None:
            known.setdefault(root, member)
        members.append(member)
        names.append(name)
    for k in [k for k, s in enumerate(sets) if not s[1]]:
        trie.insert(sets[k][3], members[k])
    for k in sorted((k for k, s in enumerate(sets) if s[1]), key=lambda k: (len(sets[k][3]), sets[k][0])):
        trie.search(sets[k][3], members[k])
        trie.insert(sets[k][3], members[k])
    return [(names[x], names[y]) for x, y in trie.links]


def _links(groups: DataFrame, order, size: int, bits: int) -> DataFrame:
    """Links ``u, v`` found in each group of rows ``cluster, part, a, searches, root, text``."""

    def run(group: pa.Table) -> pa.Table:
        texts = group.column("text").combine_chunks()
        tokens = (_ordered(s, order.value, bits).tolist() for s in shingle_sets(texts, size))
        links = _linked(list(zip(group.column("a").to_pylist(), group.column("searches").to_pylist(), group.column("root").to_pylist(), tokens, strict=True)))
        return pa.table({"u": pa.array([x for x, _ in links], pa.int64()), "v": pa.array([y for _, y in links], pa.int64())})

    return groups.groupBy("cluster", "part").applyInArrow(run, "u long, v long")


def _with_texts(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``a, n, text``: the text of one document of every wanted class (rows ``rep, a, n``).

    Texts travel instead of their sets: they compress, hashes do not. A class whose ids are all null has a null ``rep``
    and is found by it like any other.
    """
    only = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted.select(F.xxhash64("rep")), wanted.count()))

    def run(batches):
        bitmap, width = np.frombuffer(only.value[0], dtype=np.uint8), only.value[1]
        for batch in batches:
            batch = batch.filter(pa.array(_may_hold(bitmap, width, np.asarray(batch.column("h")).view(np.uint64))))
            marks = [_class_of(s) for s in shingle_sets(batch.column("text"), size)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(marks, pa.int64()), batch.column("text")], names=["id", "ia", "text"])

    texts = docs.select("id", "text", F.xxhash64("id").alias("h")).mapInArrow(tidied(run), "id long, ia long, text string")
    # joined by class alone, so that the same exchange serves to keep one row of each class
    same = F.coalesce(F.col("id").bitwiseXOR(F.col("rep")) == 0, F.col("id").isNull() & F.col("rep").isNull())
    here = texts.join(wanted, (F.col("ia") == F.col("a")) & same)
    return here.select("a", "n", "text").dropDuplicates(["a"])


def _edges(texts: DataFrame, order, size: int, bits: int) -> tuple[DataFrame, tuple[bytes, int]]:
    """Stored edges ``u, v`` of the classes of ``texts`` under an order, and the bitmap of the shingles that tie them."""
    spark = texts.sparkSession
    met = cut_lineage(_prefixes(texts, order, size, bits).groupBy("t").agg(F.min("a").alias("x"), F.max("a").alias("y")).filter("x <> y").select(F.col("t").alias("mt")))
    bitmap = _bitmap(met, met.count())
    wide = _prefixes(texts, order, size, bits, spark.sparkContext.broadcast(bitmap))
    shared = cut_lineage(wide.join(met, F.col("t") == F.col("mt")).select("t", "a", "n", "reach").distinct())
    edges = cut_lineage(_ties(shared))
    for old in (met, shared):
        remove_stored(old)
    return edges, bitmap


def _tied(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).distinct()


def _kept_texts(texts: DataFrame, nodes: DataFrame, count: int) -> DataFrame:
    """The rows of ``texts`` whose class is in ``nodes``, with the columns of both; texts the bitmap shuts out are not shuffled."""
    only = texts.sparkSession.sparkContext.broadcast(_bitmap(nodes.select("node"), count))

    def run(batches):
        bitmap, width = np.frombuffer(only.value[0], dtype=np.uint8), only.value[1]
        for batch in batches:
            yield batch.filter(pa.array(_may_hold(bitmap, width, np.asarray(batch.column("a")).view(np.uint64))))

    return texts.mapInArrow(tidied(run), texts.schema).join(nodes, F.col("a") == F.col("node")).drop("node")

def _cluster_links(sets: DataFrame, block_classes: int, block_shingles: int, order, size: int, bits: int) -> DataFrame:
    """All links that components need, from stored rows ``a, n, cluster, text``."""
    links_of = lambda groups: _links(groups, order, size, bits)
    none = F.lit(None).cast("long")
    sizes = sets.groupBy("cluster").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    sizes = sizes.withColumn("blocks", F.greatest(F.ceil(F.col("members") / block_classes), F.ceil(F.col("shingles") / block_shingles)).cast("int"))
    large = cut_lineage(sizes.filter((F.col("blocks") > 1) & (F.col("members") > 1)).select(F.col("cluster").alias("c"), "members", "blocks"))
    small = sets.join(large, F.col("cluster") == F.col("c"), "left_anti")
    columns = ["cluster", "part", "a", "searches", "root", "text"]
    # light clusters share tasks by hash; each is a group of its own
    links = cut_lineage(links_of(small.select("cluster", F.lit(0).alias("part"), "a", F.lit(True).alias("searches"), none.alias("root"), "text")))
    if large.isEmpty():
        return links
    placed = cut_lineage(sets.join(large, F.col("cluster") == F.col("c")).withColumn("part", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int")).drop("c"))
    ranks = placed.groupBy("cluster").agg(F.slice(F.sort_array(F.collect_set(F.when(F.pmod(F.xxhash64("a", F.lit(1)), F.greatest(F.lit(1), F.col("members") / (4 * PIVOTS)).cast("int")) == 0, F.col("a")))), 1, PIVOTS).alias("pivots"))
    pivots = placed.join(ranks.select("cluster", F.explode("pivots").alias("a")), ["cluster", "a"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    first = placed.select("cluster", "part", "a", F.lit(True).alias("searches"), none.alias("root"), "text")
    first = first.unionByName(pivots.select("cluster", "part", "a", F.lit(True).alias("searches"), none.alias("root"), "text")).dropDuplicates(["cluster", "part", "a"])
    inner = cut_lineage(links_of(first.select(*columns)))
    roots = cut_lineage(components(inner))
    known = cut_lineage(placed.join(roots, F.col("a") == F.col("node"), "left").withColumn("root", F.coalesce("root", "a")).drop("node"))
    counts = known.groupBy("cluster", "root").agg(F.count("*").alias("m"))
    main = cut_lineage(counts.groupBy("cluster").agg(F.max(F.struct("m", "root"))["root"].alias("main")).withColumnRenamed("cluster", "mc"))
    outside = known.join(main, F.col("cluster") == F.col("mc")).filter("root <> main").drop("mc", "main")
    # every set outside the main component searches every block; inside a block all pairs are already done
    chunks = outside.withColumn("chunk", F.floor(F.pmod(F.xxhash64("a", F.lit(2)), F.lit(1 << 20)) / F.lit((1 << 20)) * F.col("blocks")).cast("int"))
    used = cut_lineage(chunks.select("cluster", "chunk").distinct())
    pair = lambda block, chunk: (F.col(block) * F.lit(1 << 15) + F.col(chunk)).cast("int")
    found = known.join(used, "cluster").select("cluster", pair("part", "chunk").alias("part"), "a", F.lit(False).alias("searches"), "root", "text")
    asking = chunks.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cluster", pair("block", "chunk").alias("part"), "a", F.lit(True).alias("searches"), "root", "text")
    outer = links_of(found.unionByName(asking).select(*columns))
    return cut_lineage(links.unionByName(inner).unionByName(outer))


def _components_of(docs: DataFrame, key: str, text: str, size: int, sketch_bits: int, block_classes: int, block_shingles: int) -> DataFrame:
    """Stored rows ``id, a, n, root, component`` for every document: ``join``, and the class that stands for the component."""
    spark = docs.sparkSession
    with stored_frames(spark) as keep:
        rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
        scanned = cut_lineage(_scan(rows, size, sketch_bits))
        members = scanned.filter("block is null").select("id", "a", "n")
        classes = cut_lineage(members.filter("n > 0").groupBy("a").agg(F.min("id").alias("rep"), F.first("n").alias("n")))
        order = spark.sparkContext.broadcast((_order(scanned, sketch_bits), []))
        edges, bitmap = _edges(rows, order, size, sketch_bits)
        nodes, bitmaps = cut_lineage(_tied(edges)), [bitmap]
        left = nodes.count()
        texts = cut_lineage(_with_texts(rows, classes.join(nodes, F.col("a") == F.col("node")).select("rep", "a", "n"), size))
        for _ in range(ROUNDS - 1):
            if left <= block_classes and (texts.agg(F.sum("n")).first()[0] or 0) <= block_shingles:
                break  # one task holds them all
            before = left
            counts = _scan(texts.select(F.col("a").alias("id"), "text"), size, sketch_bits)
            order = spark.sparkContext.broadcast((_order(counts, sketch_bits), list(bitmaps)))
            edges, bitmap = _edges(texts, order, size, sketch_bits)
            nodes = cut_lineage(_tied(edges))
            left = nodes.count()
            if left > STILL_TIED * before:
                break
            bitmaps.append(bitmap)
            texts, old = cut_lineage(_kept_texts(texts, nodes, left)), texts
            remove_stored(old)
        clusters = cut_lineage(components(edges).select("node", F.col("root").alias("cluster")))
        texts, old = cut_lineage(_kept_texts(texts, clusters, left)), texts
        remove_stored(old)
        roots = cut_lineage(components(_cluster_links(texts, block_classes, block_shingles, order, size, sketch_bits)))
        linked = classes.join(roots, F.col("a") == F.col("node"))
        names = cut_lineage(linked.groupBy(F.col("root").alias("r")).agg(F.min("rep").alias("least")))
        named = linked.join(names, F.col("root") == F.col("r")).select(F.col("a").alias("k"), "root", "least")
        per_class = cut_lineage(classes.join(named, F.col("a") == F.col("k"), "left").select(F.col("a").alias("ca"), F.coalesce("root", "a").alias("root"), F.coalesce("least", "rep").alias("component")))
        out = members.join(per_class, F.col("a") == F.col("ca"), "left")
        return keep(cut_lineage(out.select("id", "a", "n", "root", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component"))))


def join(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = SIZE, sketch_bits: int = SKETCH_BITS, block_classes: int = BLOCK_CLASSES, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Stored rows ``id, a, n, component`` for every document: class, set size, smallest id reachable by links.

    Two documents link when their sets' Jaccard similarity is 0.8 or more; equal sets are one class and need no
    pairs. A text without words (null included) has n 0 and its own id as component. A
    null id links like any other, belongs to the component of its class and never names one (null if no other id is there).
    Repeated rows are one class; where unlike texts repeat an id, components may share their name. An empty table
    gives an empty result. Keys are integers. Columns of other names play no part.
    """
    return _components_of(docs, key, text, size, sketch_bits, block_classes, block_shingles).select("id", "a", "n", "component")


def one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = SIZE, sketch_bits: int = SKETCH_BITS, block_classes: int = BLOCK_CLASSES, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, one for each component: that of the smallest id.

    Rows without words are linked with nothing and all stay. Null ids yield to others; of several sets under the kept id the
    smallest class stays, of rows that repeat id and set one. Components count by their links alone: where unlike
    texts repeat an id, each keeps a row. An empty table gives an empty one.
    """
    found = _components_of(docs, key, text, size, sketch_bits, block_classes, block_shingles)
    best = found.filter("n > 0").groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "a")).alias("k"))
    kept = cut_lineage(best.select(F.col("k.id").alias("kid"), F.col("k.a").alias("ka")))
    names, mark = docs.columns, "_class"
    while mark.lower() in {c.lower() for c in names}:
        mark += "_"
    schema = T.StructType([*docs.schema.fields, T.StructField(mark, T.LongType())])

    def run(batches):
        for batch in batches:
            marks = [_class_of(s) if len(s) else None for s in shingle_sets(batch.column(text), size)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.int64())], names=[*names, mark])

    marked = docs.mapInArrow(tidied(run), schema)
    chosen = kept.select(F.col("kid").alias(f"{mark}_id"), F.col("ka").alias(f"{mark}_kept"))
    here = (F.col(mark) == F.col(f"{mark}_kept")) & F.col(f"`{key}`").cast("long").eqNullSafe(F.col(f"{mark}_id"))
    stay = marked.filter(F.col(mark).isNotNull()).join(chosen, here, "left_semi")
    # seen in the narrow table first: only rows that repeat an id and a text need another shuffle
    repeated = found.join(kept, (F.col("a") == F.col("ka")) & F.col("id").eqNullSafe(F.col("kid"))).groupBy("a").count().filter("count > 1")
    one = stay if repeated.isEmpty() else stay.dropDuplicates([mark])
    return one.unionByName(marked.filter(F.col(mark).isNull())).drop(mark)
