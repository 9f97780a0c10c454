"""Token ids in binary files of compressed bit planes.

A file holds blocks of up to ``BLOCK_IDS`` ids. Bit j of every id of a block forms plane j, packed eight ids
to a byte; only as many planes are kept as the largest id of the block needs, each compressed
with zstandard on its own. A footer indexes the blocks (offset, ids, length of every plane) and the
documents (key, ids), so a reader can fetch any range of ids. Ids stand in ascending key order:
null keys first, equal keys by a hash of the text, over the files in the order of their first row.

Tasks write through the file system of the folder's URI under a name of their own, and the list of
files is what the tasks that succeeded return; a file of a lost attempt is never listed.

Layout: magic; planes of each block; footer (zstandard of four parts: JSON header, block table,
document table, all little-endian); length of the footer; magic.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefixledger.llm import bpe
from prefixledger.llm.common import cut_lineage, give_back, tidied
from prefixledger.session import stored_path

MAGIC = b"IDPLANE1"
BLOCK_IDS = 1 << 16
LEVEL = 3
#: Bytes of words that a writing worker caches (each of two generations): it holds one block of ids besides.
WORD_BYTES = 40 << 20
_DOC = np.dtype([("key", "<i8"), ("null", "u1"), ("ids", "<i8")])


def to_planes(ids: np.ndarray) -> list[bytes]:
    """Bit planes of a block, lowest bit first; as many as its largest id needs, at least one."""
    width = max(1, int(ids.max()).bit_length())
    ids = ids.astype("<u2" if width <= 16 else "<u4")
    of = ids.dtype.type
    return [np.packbits(((ids >> of(j)) & of(1)).astype(np.uint8), bitorder="little").tobytes() for j in range(width)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The ids of a block from its planes."""
    ids = np.zeros(n, dtype="<u4")
    for j, plane in enumerate(planes):
        ids |= np.unpackbits(np.frombuffer(plane, dtype=np.uint8), count=n, bitorder="little").astype("<u4") << np.uint32(j)
    return ids


class Writer:
    """Appends ids and document ends to one file; holds one block of ids and the index."""

    def __init__(self, stream, block_ids: int = BLOCK_IDS):
        self.stream, self.block_ids = stream, block_ids
        self.at, self.held, self.n_held = len(MAGIC), [], 0
        self.blocks: list[tuple[int, list[int]]] = []
        self.offsets: list[int] = []
        self.documents: list[tuple[int, int, int]] = []
        self.packer = zstandard.ZstdCompressor(level=LEVEL)
        stream.write(MAGIC)

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.documents.append((key or 0, key is None, len(ids)))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block_ids:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, dtype="<u4")
        stop = len(ids) if last else len(ids) - len(ids) % self.block_ids
        for begin in range(0, stop, self.block_ids):
            block = ids[begin : min(begin + self.block_ids, stop)]
            planes = [self.packer.compress(p) for p in to_planes(block)]
            self.offsets.append(self.at)
            self.blocks.append((len(block), [len(p) for p in planes]))
            for plane in planes:
                self.stream.write(plane)
                self.at += len(plane)
        self.held, self.n_held = [ids[stop:]], len(ids) - stop

    def close(self) -> None:
        self._flush(True)
        lengths = np.zeros((len(self.blocks), 34), dtype="<i8")
        for row, offset, (n, planes) in zip(lengths, self.offsets, self.blocks, strict=True):
            row[0], row[1] = offset, n
            row[2 : 2 + len(planes)] = planes
        documents = np.array(self.documents, dtype=_DOC)
        head = json.dumps({"blocks": len(self.blocks), "documents": len(documents), "block_ids": self.block_ids}).encode()
        footer = self.packer.compress(struct.pack("<q", len(head)) + head + lengths.tobytes() + documents.tobytes())
        self.stream.write(footer + struct.pack("<q", len(footer)) + MAGIC)


class Reader:
    """Index of one file and the ids of its blocks, one block at a time."""

    def __init__(self, source):
        self.source, size = source, source.size()
        source.seek(size - 16)
        length, magic = struct.unpack("<q8s", source.read(16))
        if magic != MAGIC:
            raise ValueError("not a file of id planes")
        source.seek(size - 16 - length)
        self.unpacker = zstandard.ZstdDecompressor()
        footer = self.unpacker.decompress(source.read(length))
        (n,) = struct.unpack_from("<q", footer)
        head = json.loads(footer[8 : 8 + n])
        self.block_ids = head["block_ids"]
        table = np.frombuffer(footer, dtype="<i8", count=head["blocks"] * 34, offset=8 + n)
        self.blocks = table.reshape(-1, 34)
        self.documents = np.frombuffer(footer, dtype=_DOC, count=head["documents"], offset=8 + n + table.nbytes)

    def block(self, k: int) -> np.ndarray:
        offset, n, lengths = int(self.blocks[k, 0]), int(self.blocks[k, 1]), [int(x) for x in self.blocks[k, 2:] if x]
        self.source.seek(offset)
        data, planes, at = self.source.read(sum(lengths)), [], 0
        for length in lengths:
            planes.append(self.unpacker.decompress(data[at : at + length]))
            at += length
        return from_planes(planes, n)

    def each(self):
        """Yields ``key, parts`` of every document in order; its ids are the parts put together."""
        k, block, at = -1, np.zeros(0, dtype="<u4"), 0
        for key, null, n in self.documents.tolist():
            parts, rest = [], n
            while rest:
                if at == len(block):
                    k, at = k + 1, 0
                    block = self.block(k)
                take = min(rest, len(block) - at)
                parts.append(block[at : at + take])
                at, rest = at + take, rest - take
            yield None if null else key, parts


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri)


_FILES = T.StructType([T.StructField(n, t) for n, t in (("file", T.StringType()), ("documents", T.LongType()), ("ids", T.LongType()), ("first_key", T.LongType()), ("first_hash", T.LongType()))])


def write(df: DataFrame, folder: str, path: str, *, key: str = "doc_id", text: str = "text", end_id: int = 1, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode and write all rows; returns the stored list of files with ``start``, the ids in the files before.

    Rows are dealt by ranges of (key, hash of text), so equal keys or null keys do not meet in one task. A null
    or empty text is a document of the end id alone. An empty table writes no file.
    """
    rows = df.select(F.col(key).cast("long").alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.withColumn("_hash", F.xxhash64("_text")).repartitionByRange("_key", "_hash").sortWithinPartitions("_key", "_hash")

    def run(batches):
        give_back()
        writer, own, first, total, documents = None, bpe.encoder(path, word_bytes=WORD_BYTES), None, 0, 0
        end = np.array([end_id], dtype="<u4")
        for part in (part for batch in batches for part in bpe.parts(batch, "_text", 2 << 20)):
            flat, at = own.encode_all(part.column("_text"))
            begins = at.tolist()
            for k, h, i, j in zip(part.column("_key"), part.column("_hash"), begins, begins[1:]):
                if writer is None:
                    name = f"{folder}/ids-{uuid.uuid4().hex}.planes"
                    files, place = _open(name)
                    files.create_dir(place.rsplit("/", 1)[0], recursive=True)
                    stream = files.open_output_stream(place)
                    writer, first = Writer(stream, block_ids), (k.as_py(), h.as_py())
                ids = np.concatenate([flat[i:j], end])
                writer.add(k.as_py(), ids)
                total, documents = total + len(ids), documents + 1
        if writer is not None:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_pylist([{"file": name, "documents": documents, "ids": total, "first_key": first[0], "first_hash": first[1]}], schema=pa.schema([("file", pa.string()), ("documents", pa.int64()), ("ids", pa.int64()), ("first_key", pa.int64()), ("first_hash", pa.int64())]))
        give_back()

    files = cut_lineage(rows.mapInArrow(run, _FILES))
    before = Window.orderBy(F.col("first_key").asc_nulls_first(), "first_hash").rowsBetween(Window.unboundedPreceding, -1)
    return cut_lineage(files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0))))


def read_digests(files: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """``key, start, n_tokens, ids_crc32`` of every document, read from the files, one task a few files."""
    schema = T.StructType([T.StructField(key, T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                system, place = _open(row["file"])
                with system.open_input_file(place) as source:
                    at, out = row["start"], []
                    for name, parts in Reader(source).each():
                        crc, n = 0, 0
                        for part in parts:
                            crc, n = zlib.crc32(part.tobytes(), crc), n + len(part)
                        out.append((name, at, n, crc))
                        at += n
                        if len(out) == 10_000:
                            yield _batch(out, key)
                            out = []
                    yield _batch(out, key)

    n = max(1, min(files.count(), 20_000))
    return files.select("file", "start").repartition(n).mapInArrow(tidied(run), schema)


def _batch(rows: list[tuple], key: str) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[key, "start", "n_tokens", "ids_crc32"])


def written_and_read(df: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", end_id: int = 1) -> DataFrame:
    """Write the files into the shared folder and return the digests read back from them."""
    return read_digests(write(df, stored_path(df.sparkSession), path, key=key, text=text, end_id=end_id), key=key)
