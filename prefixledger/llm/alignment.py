"""Alignment of two tokenizers by sparse matrix products over bytes.

The tokens of a text are rows of an incidence matrix over its bytes, held as CSR arrays made here. ``A B^T``, a Gustavson
row product, gives for each pair of tokens the number of bytes they share: the overlap links. Along these links, in
row order, both tokens advance exactly where both end, which cuts the text into groups. A second pair of incidence
matrices, tokens over groups, gives ``G_A G_B^T``: the shared-group links.

Texts of a batch stand side by side in one block-diagonal matrix of bounded size; one longer text is a block of its own, and products
are made for a bounded number of entries at a time.

Corpus counts: how many documents hold a pair of ids linked. Each document's distinct pairs are stored once with their
multiplicity; counts are one pre-aggregated shuffle. Counts of frequent pairs are broadcast (at most
``FREQUENT`` pairs; the threshold comes from a histogram of counts), and only pairs beyond them meet their counts in a join.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixledger.llm.bpe import byte_symbols
from prefixledger.llm.common import cut_lineage, worker_object

#: Bytes of text that one block-diagonal product takes, and entries a product expands at a time.
BLOCK_BYTES = 1 << 20
PRODUCT_ENTRIES = 1 << 22
FREQUENT = 1_000_000


#: Fixed value: how byte-level files of this kind split a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The faster library's look-ahead keeps a stack over white space; texts with longer runs go to the other one.
_LONG_GAP = re.compile(r"\s{500}")


class CSR(NamedTuple):
    """A sparse matrix: the columns of row i are ``indices[indptr[i]:indptr[i + 1]]``; all values are 1."""

    indptr: np.ndarray
    indices: np.ndarray
    width: int

    @property
    def rows(self) -> int:
        return len(self.indptr) - 1

    def transposed(self) -> CSR:
        counts = np.bincount(self.indices, minlength=self.width)
        row_of = np.repeat(np.arange(self.rows), np.diff(self.indptr))
        return CSR(np.concatenate([[0], np.cumsum(counts)]), row_of[np.argsort(self.indices, kind="stable")], self.rows)


def incidence(columns: np.ndarray, sizes: np.ndarray, width: int) -> CSR:
    """Rows with ``sizes`` entries each; ``columns`` lists their columns row after row."""
    return CSR(np.concatenate([[0], np.cumsum(sizes)]), columns, width)


def row_products(left: CSR, right: CSR, most: int = PRODUCT_ENTRIES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Gustavson's ``left right``: the rows of ``right`` that a row of ``left`` names are added up.

    Yields ``row, column, value`` of runs of whole rows, sorted; a run expands about ``most`` entries, one row at least.
    """
    wide = np.diff(right.indptr)
    entries = np.concatenate([[0], np.cumsum(wide[left.indices])])[left.indptr]  # expanded before each row
    row = 0
    while row < left.rows:
        stop = max(row + 1, int(np.searchsorted(entries, entries[row] + most, side="right")) - 1)
        stop = min(stop, left.rows)
        inner = left.indices[left.indptr[row] : left.indptr[stop]]
        of = np.repeat(np.arange(row, stop), np.diff(left.indptr[row : stop + 1]))
        sizes = wide[inner]
        begin = np.repeat(right.indptr[inner] - np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(inner) else np.zeros(0, np.int64), sizes)
        key = np.repeat(of, sizes) * np.int64(right.width) + right.indices[begin + np.arange(len(begin))]
        if len(key) > 1 and (key[1:] < key[:-1]).any():
            key.sort()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        value = np.diff(np.concatenate([first, [len(key)]]))
        key = key[first]
        yield key // max(1, right.width), key % max(1, right.width), value
        row = stop


class Block(NamedTuple):
    """Aligned documents side by side: token ids of both sides, their documents and groups, and the matrices over bytes."""

    a: np.ndarray
    b: np.ndarray
    a_doc: np.ndarray
    b_doc: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    a_bytes: CSR
    b_bytes: CSR


class Aligner:
    """Both tokenizers with the bytes of their tokens; A is a byte-level tokenizers file, B a sentencepiece model."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        value = {c: b for b, c in enumerate(byte_symbols())}
        special = {t["content"] for t in json.loads(self.a.to_str())["added_tokens"]}
        self.fast = self._by_ranks(value)
        spelled = {i: t.encode() if t in special else bytes(value[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
        self.b = SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in s], dtype=np.int64) for s in (self.a_bytes, self.b_bytes))
        # decimal text of an id with what follows it: a comma inside a group's side, else the mark that ends the side
        self.a_text = np.array([[f"{i},", f"{i}|"] for i in range(len(self.a_bytes))], dtype=object)
        self.b_text = np.array([[f"{i},", f"{i};"] for i in range(len(self.b_bytes))], dtype=object)

    def _by_ranks(self, value: dict[str, int]):
        """The same encoder in a faster library that merges by rank, or None where it might differ.

        It joins any two neighbours whose bytes make a token, the file only listed pairs. Where ids follow the merges
        and every token comes out of its own bytes, a state (x, y) of some text over the bytes of a token occurs when
        that token is merged alone too, so x and y are its listed pair, and both libraries do the same.
        """
        import tiktoken
        from tokenizers import models

        spec = json.loads(self.a.to_str())
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        plain = spec["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"]
        special = {t["content"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in model["vocab"].items() if t not in special}
        if not plain or any(vocab.get(x + y) != 256 + k for k, (x, y) in enumerate(merges)) or sorted(vocab.values()) != list(range(len(merges) + 256)):
            return None
        alone = models.BPE(vocab=model["vocab"], merges=merges)
        if any([x.id for x in alone.tokenize(t)] != [i] for t, i in vocab.items()):
            return None
        return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks={bytes(value[c] for c in t): i for t, i in vocab.items()}, special_tokens={})

    def _encode_a(self, texts: list[str]) -> list[list[int]]:
        slow = {k: t for k, t in enumerate(texts) if self.fast is None or _LONG_GAP.search(t)}
        out = [[] if k in slow else self.fast.encode_ordinary(t) for k, t in enumerate(texts)] if self.fast else [[] for _ in texts]
        for k, found in zip(slow, self.a.encode_batch_fast(list(slow.values()), add_special_tokens=False), strict=True):
            out[k] = found.ids
        return out

    def tokens(self, texts: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """Ids of both sides of each text; None where joined token bytes are not a space and the text."""
        spaced = [f" {t}" for t in texts]
        first = self._encode_a(spaced)
        second = self.b.encode(texts, num_threads=1)
        out: list[tuple[list[int], list[int]] | None] = []
        for text, x, y in zip(spaced, first, second, strict=True):
            raw = text.encode()
            fine = b"".join(map(self.a_bytes.__getitem__, x)) == raw and b"".join(map(self.b_bytes.__getitem__, y)) == raw
            out.append((x, y) if fine else None)
        return out

    def block(self, tokens: list[tuple[list[int], list[int]]]) -> Block:
        """Incidence matrices of documents side by side, and the groups their overlap links give."""
        a = np.fromiter((i for x, _ in tokens for i in x), dtype=np.int64)
        b = np.fromiter((i for _, y in tokens for i in y), dtype=np.int64)
        a_doc = np.repeat(np.arange(len(tokens)), [len(x) for x, _ in tokens])
        b_doc = np.repeat(np.arange(len(tokens)), [len(y) for _, y in tokens])
        sizes_a, sizes_b = self.a_sizes[a], self.b_sizes[b]
        width = int(sizes_a.sum())
        over_a, over_b = incidence(np.arange(width), sizes_a, width), incidence(np.arange(width), sizes_b, width)
        a_group, b_group = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        group, last = 0, (-1, -1)
        for row, column, _ in row_products(over_a, over_b.transposed()):
            # both sides advance from one overlap link to the next exactly where tokens of both end
            cut = (np.diff(row, prepend=last[0]) > 0) & (np.diff(column, prepend=last[1]) > 0)
            number = group + np.cumsum(cut)
            a_group[row], b_group[column] = number, number
            group, last = int(number[-1]), (int(row[-1]), int(column[-1]))
        return Block(a, b, a_doc, b_doc, a_group - 1, b_group - 1, over_a, over_b)

    def links(self, block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Shared-group links as token numbers of A and B, in runs of rows."""
        groups = int(block.a_group[-1]) + 1 if len(block.a) else 0
        over_a = incidence(block.a_group, np.ones(len(block.a), dtype=np.int64), groups)
        over_b = incidence(block.b_group, np.ones(len(block.b), dtype=np.int64), groups)
        for row, column, _ in row_products(over_a, over_b.transposed()):
            yield row, column

    def overlaps(self, block: Block) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Overlap links as token numbers of A and B with the bytes they share, in runs of rows."""
        return row_products(block.a_bytes, block.b_bytes.transposed())

    def spelled(self, block: Block, n: int) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each of ``n`` documents: ids of each group, A before B, in order."""
        ends_a = np.append(block.a_group[1:] != block.a_group[:-1], True).astype(np.int64) if len(block.a) else np.zeros(0, np.int64)
        ends_b = np.append(block.b_group[1:] != block.b_group[:-1], True).astype(np.int64) if len(block.b) else np.zeros(0, np.int64)
        words = np.concatenate([self.a_text[block.a, ends_a], self.b_text[block.b, ends_b]])
        side = np.concatenate([block.a_group * 2, block.b_group * 2 + 1])
        order = np.argsort(side, kind="stable")
        words = words[order].tolist()
        docs = np.concatenate([block.a_doc, block.b_doc])[order]
        stops = np.searchsorted(docs, np.arange(n + 1))
        return ["".join(words[x:y])[:-1] for x, y in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]


def aligner(path_a: str, path_b: str) -> Aligner:
    """The aligner of a worker process."""
    return worker_object(("alignment", path_a, path_b), lambda: Aligner(path_a, path_b))


def _slices(texts: pa.Array, most: int = BLOCK_BYTES):
    """Runs of rows with about ``most`` bytes of text, one row at least."""
    row, held, size = 0, [], 0
    for k, value in enumerate(texts):
        text = value.as_py() or ""
        if held and size + 4 * len(text) > most:
            yield row, held
            row, held, size = k, [], 0
        held.append(text)
        size += 4 * len(text) if len(text) > most // 4 else len(text.encode())
    if held:
        yield row, held


def _document_pairs(own: Aligner, block: Block, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct id pairs of each document (``A id << 32 | B id``), their multiplicity, and the pairs before each document."""
    docs, pairs, times = [], [], []
    for row, column in own.links(block):
        if not len(row):
            continue
        doc, pair = block.a_doc[row], (block.a[row] << 32) | block.b[column]
        order = np.lexsort((pair, doc))
        doc, pair = doc[order], pair[order]
        first = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])]))
        docs.append(doc[first])
        pairs.append(pair[first])
        times.append(np.diff(np.append(first, len(pair))))
    if len(docs) > 1:  # a document may go over several runs
        doc, pair, count = np.concatenate(docs), np.concatenate(pairs), np.concatenate(times)
        order = np.lexsort((pair, doc))
        doc, pair, count = doc[order], pair[order], count[order]
        first = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])]))
        docs, pairs, times = [doc[first]], [pair[first]], [np.add.reduceat(count, first)]
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    return pairs[0], times[0], np.searchsorted(docs[0], np.arange(n + 1))


_DIGESTS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def aligned(df: DataFrame, path_a: str, path_b: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``row, key`` and per document ``n_a, n_b, n_groups, n_links, groups_sha256, pairs, times`` (distinct linked id pairs), no shuffle.

    Null and empty texts, and texts that either tokenizer does not give back byte for byte, have no tokens: zeros,
    an empty digest and no pairs. Rows are independent, repeated ones are documents of their own.
    """
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    names = ["row", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]

    def run(batches):
        own = aligner(path_a, path_b)
        for batch in batches:
            for begin, texts in _slices(batch.column("text")):
                n = len(texts)
                found = own.tokens(texts)
                fine = [k for k in range(n) if texts[k] and found[k] is not None]
                block = own.block([found[k] for k in fine])
                spelled = own.spelled(block, len(fine))
                pairs, times, stops = _document_pairs(own, block, len(fine))
                place = np.full(n, -1)
                place[fine] = np.arange(len(fine))
                one = lambda counts: pa.array(np.where(place >= 0, np.append(counts, 0)[place], 0), pa.int64())
                firsts = np.concatenate([[True], np.diff(block.a_group) > 0])[: len(block.a)]
                sums = np.concatenate([[0], np.cumsum(times)])
                offsets = np.zeros(n + 1, dtype=np.int32)
                offsets[1:] = np.cumsum(np.where(place >= 0, np.append(np.diff(stops), 0)[place], 0))
                digest = ["" if p < 0 else hashlib.sha256(spelled[p].encode()).hexdigest() for p in place.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row").slice(begin, n),
                        batch.column("key").slice(begin, n),
                        one(np.bincount(block.a_doc, minlength=len(fine))),
                        one(np.bincount(block.b_doc, minlength=len(fine))),
                        one(np.bincount(block.a_doc[firsts], minlength=len(fine))),
                        one(sums[stops[1:]] - sums[stops[:-1]]),
                        pa.array(digest, pa.string()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(pairs, pa.int64())),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(times, pa.int32())),
                    ],
                    names=names,
                )

    return rows.mapInArrow(run, f"row long, key {kind}, {_DIGESTS}")


def pair_counts(stored: DataFrame) -> DataFrame:
    """``pair, count``: the documents that hold each id pair linked, from rows of ``aligned``."""
    return stored.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count"))


def _frequent(counts: DataFrame, most: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The least count whose pairs, with all of higher counts, are at most ``most``; those pairs, sorted, and their counts."""
    level = F.floor(F.log2(F.col("count").cast("double"))).cast("int")
    held = {r.level: r.n for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()}
    total, least = 0, None
    for k in sorted(held, reverse=True):
        total += held[k]
        if total > most:
            break
        least = 1 << k
    if least is None:
        return 1 << 62, np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = counts.filter(F.col("count") >= least).toArrow()
    pair, count = found.column("pair").to_numpy(), found.column("count").to_numpy()
    order = np.argsort(pair)
    return least, pair[order], count[order]


def digests(df: DataFrame, path_a: str, path_b: str, *, key: str = "doc_id", text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """``key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row, see ``aligned``.

    ``count_sum`` adds over all links the number of documents that hold the link's id pair; ``n_best`` counts links whose number
    is the highest of their A id, ties included. Of an empty table the result is empty; extra columns play no part.
    """
    spark = df.sparkSession
    stored = cut_lineage(aligned(df, path_a, path_b, key=key, text=text))
    counts = cut_lineage(pair_counts(stored))
    # one row for each id of the vocabulary at most
    best = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("count").alias("best")).toArrow()
    table = np.zeros(int(best.column("a").to_numpy().max()) + 1 if best.num_rows else 1, dtype=np.int64)
    table[best.column("a").to_numpy()] = best.column("best").to_numpy()
    least, pair, count = _frequent(counts, frequent)
    known = spark.sparkContext.broadcast((pair, count, table))
    names = ["row", "key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "rest", "rest_times"]

    def run(batches):
        pair, count, table = known.value
        for batch in batches:
            pairs, times = batch.column("pairs").flatten().to_numpy(), batch.column("times").flatten().to_numpy()
            stops = batch.column("pairs").offsets.to_numpy()
            stops = stops - stops[0]
            at = np.minimum(np.searchsorted(pair, pairs), max(0, len(pair) - 1))
            hit = pair[at] == pairs if len(pair) else np.zeros(len(pairs), dtype=bool)
            found = np.where(hit, count[at], 0) if len(pair) else np.zeros(len(pairs), dtype=np.int64)
            before = lambda values: np.concatenate([[0], np.cumsum(values)])[stops]
            best = np.diff(before(np.where(hit & (found == table[pairs >> 32]), times, 0)))
            sums = np.diff(before(found * times))
            offsets = pa.array(before(~hit).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in names[:6]],
                    pa.array(best, pa.int64()),
                    pa.array(sums, pa.int64()),
                    batch.column("groups_sha256"),
                    pa.ListArray.from_arrays(offsets, pa.array(pairs[~hit], pa.int64())),
                    pa.ListArray.from_arrays(offsets, pa.array(times[~hit], pa.int32())),
                ],
                names=names,
            )

    kind = stored.schema["key"].dataType.simpleString()
    schema = f"row long, key {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, rest array<long>, rest_times array<int>"
    first = stored.mapInArrow(run, schema)
    columns = [F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links"]
    rare = counts.filter(F.col("count") < least)
    if not rare.limit(1).count():
        return first.select(*columns, "n_best", "count_sum", "groups_sha256")
    first = cut_lineage(first)
    highest = spark.createDataFrame(best.to_pandas(), "a long, best long")
    asked = first.select("row", F.explode(F.arrays_zip("rest", "rest_times")).alias("z")).select("row", F.col("z.rest").alias("pair"), F.col("z.rest_times").alias("times"))
    met = asked.join(rare.withColumnRenamed("pair", "p"), F.col("pair") == F.col("p")).join(F.broadcast(highest), F.shiftright("pair", 32) == F.col("a"))
    more = met.groupBy(F.col("row").alias("r")).agg(F.sum(F.when(F.col("count") == F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("count") * F.col("times")).alias("more_sum"))
    out = first.join(more, F.col("row") == F.col("r"), "left")
    return out.select(*columns, (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups_sha256")
