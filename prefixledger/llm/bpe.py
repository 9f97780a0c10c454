"""BPE encoding and decoding with forced boundaries, for a tokenizers file with a word-end suffix.

A byte pair that occurs inside no vocabulary token can never be merged, so the cut between its
bytes is certain: both sides encode independently and the ids are concatenated. White space is
in no token, which cuts texts into words; each distinct word of a batch is looked up once. Words the worker has
not met are split by the file's own normalizer and pre-tokenizer (all of a batch in one call; words of Latin letters
need no call where a probe shows what the file does with them), and the pieces are cut again at
every such pair. Fragments that end a piece are encoded by the file's model, the others by the same
merges without the word-end suffix, as the suffix belongs to the last symbol alone; each kind many to a call. Workers keep caches of
words, pieces and fragments, bounded in bytes, as bytes of little-endian unsigned 32-bit ids.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import itertools
import json
import operator
import os
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefixledger.llm.common import give_back, worker_object

#: Bytes of a worker's cached words (each of two generations), pieces and fragments, with what an entry costs besides its text.
WORD_BYTES = 28 << 20
PIECE_BYTES = 12 << 20
FRAGMENT_BYTES = 4 << 20
ENTRY_BYTES = 190
FRAGMENTS_A_CALL = 20_000
LONGEST_CACHED = 64
#: White space as the file's normalizer sees it (fixed values: the Unicode property).
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPLIT = re.compile(f"[{_WHITE}]+")
#: Latin letters, each one code point in normal form with a lower case of one code point, and a mark that may follow them.
_LATIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))
_MARKS = ".,;:!?"
#: By code point: 1 for these letters, 2 for these marks, 3 for a space, 0 for all others (the last entry).
_KIND = np.zeros(0x101, dtype=np.uint8)
_KIND[[ord(c) for c in _LATIN]], _KIND[[ord(c) for c in _MARKS]], _KIND[32] = 1, 2, 3
#: Above every byte symbol.
SYMBOLS = 512
#: str.split() also cuts at these, the normalizer does not.
_ODD = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _uncollected(fn):
    """``fn`` without runs of the cycle collector: it makes no cycles, and each run would go over the caches."""

    @functools.wraps(fn)
    def run(*args):
        on = gc.isenabled()
        gc.disable()
        try:
            return fn(*args)
        finally:
            if on:
                gc.enable()

    return run


class Encoder:
    """Encodes and decodes like the library with ``add_special_tokens=False`` and no truncation or padding."""

    def __init__(self, path: str, word_bytes: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.loads(Tokenizer.from_file(path).to_str())
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.path = path
        self.last = self._bare(self.library.model)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.held = self._held_pairs(model["vocab"])
        tokens = {i: t for t, i in self.library.get_vocab(with_added_tokens=True).items()}
        self.tokens = [tokens.get(i) for i in range(max(tokens) + 1)]
        self.ends_piece = np.array([bool(t and self.suffix and t.endswith(self.suffix)) for t in self.tokens])
        self.decimal = [str(i) for i in range(len(self.tokens))]
        self.plain_decoder = spec["decoder"] is None
        # two generations of words: a full one becomes the old one, from which words in use come back
        self.words, self.old_words = _Cache(word_bytes or WORD_BYTES), _Cache(0)
        self.pieces = _Cache(PIECE_BYTES)
        self.fragments = _Cache(FRAGMENT_BYTES)
        self.symbols = byte_symbols()
        self.spell = str.maketrans({c: "".join(self.symbols[b] for b in c.lower().encode()) for c in _LATIN})
        self.latin = self._latin_words_are_pieces()
        del spec, model
        give_back()

    @functools.cached_property
    def inner(self):
        """The same vocabulary and merges without the suffix, for fragments that do not end a piece."""
        from tokenizers import Tokenizer, models

        model = json.loads(Tokenizer.from_file(self.path).to_str())["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        return self._bare(models.BPE(vocab=model["vocab"], merges=merges))

    @staticmethod
    def _bare(model):
        """The model behind a split at white space alone, for many fragments in one call."""
        from tokenizers import Tokenizer, pre_tokenizers

        bare = Tokenizer(model)
        bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        return bare

    def _latin_words_are_pieces(self) -> bool:
        """Whether Latin letters side by side, in every pairing, make one lower-case piece, and a mark after them a second one."""
        every = "".join(x + y for k, x in enumerate(_LATIN) for y in _LATIN[k:]) + "".join(x + y for k, x in enumerate(_LATIN) for y in _LATIN[:k])
        probes = [every, *[x + m for x in _LATIN for m in _MARKS]]
        wants = [[every.translate(self.spell)], *[[x.translate(self.spell), m] for x in _LATIN for m in _MARKS]]
        cut = lambda word: [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(word))]
        return all(cut(probe) == want for probe, want in zip(probes, wants, strict=True))

    def _held_pairs(self, vocab: dict[str, int]) -> np.ndarray:
        """By ``SYMBOLS * first + second``: whether both stand side by side inside some token, the suffix left out."""
        pairs = set()
        for token in vocab:
            body = token[: -len(self.suffix)] if self.suffix and token.endswith(self.suffix) else token
            pairs.update(body[i : i + 2] for i in range(len(body) - 1))
        held = np.zeros(SYMBOLS * SYMBOLS, dtype=bool)
        held[[SYMBOLS * ord(x) + ord(y) for x, y in pairs if max(x, y) < chr(SYMBOLS)]] = True
        held.reshape(SYMBOLS, SYMBOLS)[32], held.reshape(SYMBOLS, SYMBOLS)[:, 32] = True, True
        return held

    def _fragments(self, texts: list[str], ends: bool) -> list[bytes]:
        """Ids of fragments, ``FRAGMENTS_A_CALL`` in one call of the library."""
        model, out = self.last if ends else self.inner, []
        for begin in range(0, len(texts), FRAGMENTS_A_CALL):
            part = texts[begin : begin + FRAGMENTS_A_CALL]
            # no byte symbol is white space, so each fragment is one word of this call
            text = " ".join(part)
            ids = np.array(model.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            # the last token of a piece shows by the suffix; where the tokens do not, the slower call says whose they are
            bounds = np.flatnonzero(self.ends_piece[ids]) + 1 if ends else ()
            if len(bounds) != len(part):
                made = model.encode(text, add_special_tokens=False)
                ids = np.array(made.ids, dtype="<u4")
                bounds = np.searchsorted(np.array(made.word_ids, dtype=np.int64), np.arange(1, len(part) + 1))
            data, bounds = ids.tobytes(), [0, *(bounds * 4).tolist()]
            out += [data[i:j] for i, j in zip(bounds, bounds[1:])]
        return out

    def _cut(self, pieces: list[str]) -> dict[str, list[str]]:
        """The fragments of those pieces that hold a pair that no token holds."""
        codes = _codes(" ".join(pieces)).astype(np.int64)
        # a space is no byte symbol: pairs with it count as held
        at = np.flatnonzero(~self.held[codes[:-1] * SYMBOLS + codes[1:]]) + 1
        if not len(at):
            return {}
        begins = np.cumsum([0, *[len(p) + 1 for p in pieces]])
        which = np.searchsorted(begins, at, side="right") - 1
        places: dict[str, list[int]] = {}
        for k, place in zip(which.tolist(), (at - begins[which]).tolist()):
            places.setdefault(pieces[k], [0]).append(place)
        return {piece: [piece[i:j] for i, j in zip(begin, [*begin[1:], len(piece)])] for piece, begin in places.items()}

    def _pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of distinct pre-tokens in byte symbols, cut at every pair that no token holds; without a cut a piece is one fragment."""
        known = self.pieces
        out = dict(zip(pieces, map(known.get, pieces)))
        new = [p for p in pieces if out[p] is None]
        if not new:
            return out
        cut = self._cut(new)
        if cut:
            begins = {f: self.fragments.get(f) for parts in cut.values() for f in parts[:-1]}
            unknown = [f for f, ids in begins.items() if ids is None]
            made = dict(zip(unknown, self._fragments(unknown, False)))
            self.fragments.keep(made)
            begins |= made
            new = [p for p in new if p not in cut]
            # fragments that end a piece are pieces themselves
            new += {parts[-1] for parts in cut.values() if out.get(parts[-1]) is None and known.get(parts[-1]) is None}.difference(new)
        made = dict(zip(new, self._fragments(new, True)))
        out |= made
        for piece, parts in cut.items():
            last = out.get(parts[-1]) or known[parts[-1]]
            made[piece] = out[piece] = b"".join([*map(begins.__getitem__, parts[:-1]), last])
        known.keep(made)
        return out

    def _are_latin(self, words: list[str]) -> list[bool]:
        """Which words are Latin letters, perhaps with one mark after them."""
        kind = _KIND[np.minimum(_codes(" ".join(words)), len(_KIND) - 1)]
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        begins = np.cumsum(sizes + 1) - sizes - 1
        others, marks = np.add.reduceat(kind == 0, begins, dtype=np.int64), np.add.reduceat(kind == 2, begins, dtype=np.int64)
        ends_in_mark = kind[begins + sizes - 1] == 2
        return ((others == 0) & ((marks == 0) | ((marks == 1) & ends_in_mark & (sizes > 1)))).tolist()

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct new words: normalized and split in one call, then all their pieces together."""
        out, latin, plain = {}, [], words
        if self.latin:
            are = self._are_latin(words)
            latin = list(itertools.compress(words, are))
            plain = list(itertools.compress(words, map(operator.not_, are)))
        joined = " ".join(plain)
        if any(s in joined for s in self.special):
            for word in [w for w in plain if any(s in w for s in self.special)]:
                out[word] = _packed(self.library.encode(word, add_special_tokens=False).ids)
            plain = [w for w in plain if w not in out]
            joined = " ".join(plain)
        # no word holds white space, so the spaces between them stay cuts through both steps
        text = self.library.normalizer.normalize_str(joined) if plain else ""
        cuts = self.library.pre_tokenizer.pre_tokenize_str(text) if plain else []
        spelled = " ".join(latin).translate(self.spell).split(" ") if latin else []
        marked = [word[-1] in _MARKS for word in spelled]
        letters = [word[:-1] if mark else word for word, mark in zip(spelled, marked)]
        ids_of = self._pieces(list({*letters, *[p for p, _ in cuts], *_MARKS}))
        of_mark = {mark: ids_of[mark] for mark in _MARKS}
        out |= {w: ids_of[x] + of_mark[w[-1]] if mark else ids_of[x] for w, x, mark in zip(latin, letters, marked)}
        if plain:
            ids = [ids_of[piece] for piece, _ in cuts]
            begins = [begin for _, (begin, _) in cuts]
            begins.append(len(text) + 2)
            at, end = 0, 0
            for word, normal in zip(plain, text.split(" "), strict=True):
                first, end = at, end + len(normal) + 1
                while begins[at] < end:
                    at += 1
                out[word] = ids[first] if at == first + 1 else b"".join(ids[first:at])
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, from the two generations of the cache or new; the empty one has none."""
        if self.words.full():
            self.words, self.old_words = _Cache(self.words.most), self.words
        found = list(map(self.words.get, words))
        new = [w for w, ids in zip(words, found) if ids is None]
        if new:
            made = {w: ids for w, ids in zip(new, map(self.old_words.get, new)) if ids is not None}
            unknown = [w for w in new if w and w not in made]
            if unknown:
                made |= self._learn(unknown)
            self.words.keep(made)
            made[""] = b""
            found = [made[w] if ids is None else ids for w, ids in zip(words, found)]
        return found

    @_uncollected
    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other as unsigned 32-bit integers, and where each text's begin (one more than texts).

        Each distinct word is looked up once, then the ids of all words are put in place together. Null and empty texts have none.
        """
        if pc.any(pc.match_substring_regex(texts, "[\x1c-\x1f]")).as_py():
            parts = pa.array([_SPLIT.split(t.as_py() or "") for t in texts], pa.list_(pa.string()))
        else:
            parts = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
        coded = parts.flatten().dictionary_encode()
        words = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
        # no word holds a space; one string cut anew is cheaper than a Python object made from each entry
        word_ids = self._words(pc.binary_join(words, " ")[0].as_py().split(" ") if len(coded.dictionary) else [])
        sizes = np.fromiter(map(len, word_ids), dtype=np.int64, count=len(word_ids)) >> 2
        data = np.frombuffer(b"".join(word_ids), dtype="<u4")
        place = coded.indices.to_numpy(zero_copy_only=False)
        each = sizes[place]
        ends = np.zeros(len(place) + 1, dtype=np.int64)
        np.cumsum(each, out=ends[1:])
        ids = data[np.repeat((np.cumsum(sizes) - sizes)[place] - ends[:-1], each) + np.arange(ends[-1])]
        rows = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False), out=rows[1:])
        return ids, ends[rows]

    def encode(self, text: str | None) -> np.ndarray:
        """Ids as unsigned 32-bit integers; null and empty texts have none."""
        return self.encode_all(pa.array([text], pa.string()))[0]

    def decode(self, ids: list[int]) -> str:
        """As the library's ``decode(ids, skip_special_tokens=False)``; unknown ids are left out."""
        if not self.plain_decoder:
            return self.library.decode(ids, skip_special_tokens=False)
        tokens = self.tokens
        try:
            return " ".join([tokens[i] for i in ids])
        except (IndexError, TypeError):
            return " ".join([t for i in ids if i < len(tokens) and (t := tokens[i]) is not None])


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Cache(dict):
    """Ids of short texts, at most so many bytes of them and what one call adds; starts anew when full."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.bytes = most, 0

    def full(self) -> bool:
        return self.bytes >= self.most

    def keep(self, found: dict[str, bytes]) -> None:
        if self.full():
            self.clear()
            self.bytes = 0
        before = len(self)
        self.update((t, ids) for t, ids in found.items() if len(t) <= LONGEST_CACHED)
        self.bytes += (len(self) - before) * ENTRY_BYTES


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4")


def encoder(path: str, word_bytes: int | None = None) -> Encoder:
    """The encoder of a worker process and file; ``word_bytes`` in place of ``WORD_BYTES`` for its words."""
    return worker_object(("bpe", path, word_bytes), lambda: Encoder(path, word_bytes))


def with_ids(df: DataFrame, path: str, *, text: str = "text", ids: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """``df`` with ``ids`` (array of int) and, if named, the ``decoded`` text. Columns of these names are replaced.

    Null and empty texts have no ids. Rows are independent: no shuffle, one Arrow batch at a time.
    """
    names = [c for c in df.columns if c not in (ids, decoded)]
    schema = T.StructType([*[df.schema[c] for c in names], T.StructField(ids, T.ArrayType(T.IntegerType()))])
    if decoded:
        schema = schema.add(decoded, T.StringType())

    def run(batches):
        give_back()
        own = encoder(path)
        for batch in batches:
            for part in parts(batch, text):
                flat, at = own.encode_all(part.column(text))
                columns = [part.column(c) for c in names] + [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.view("<i4"), pa.int32()))]
                if decoded:
                    columns.append(pa.array([own.decode(flat[i:j].tolist()) for i, j in zip(at.tolist(), at[1:].tolist())], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])
        give_back()

    return df.mapInArrow(run, schema)


def parts(batch: pa.RecordBatch, text: str, most: int = 1 << 20):
    """Slices of a batch that hold about ``most`` bytes of text, so ids of many long texts never stand together."""
    sizes = np.cumsum(pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False))
    row = 0
    while row < batch.num_rows:
        stop = max(row + 1, int(np.searchsorted(sizes, (sizes[row - 1] if row else 0) + most, side="right")))
        yield batch.slice(row, stop - row)
        row = stop


def digests(df: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256`` of every row: ids as the library gives them, text decoded from those ids."""
    rows = df.select(F.col(key).alias(key), F.col(text).alias("_text"))
    schema = T.StructType([rows.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches):
        own = encoder(path)
        decimal = own.decimal
        for batch in batches:
            counts, first, second = [], [], []
            for part in parts(batch, "_text"):
                flat, at = own.encode_all(part.column("_text"))
                for i, j in zip(at.tolist(), at[1:].tolist()):
                    ids = flat[i:j].tolist()
                    counts.append(len(ids))
                    first.append(hashlib.sha256(" ".join([decimal[i] for i in ids]).encode()).hexdigest())
                    second.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)
