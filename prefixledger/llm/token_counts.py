"""Token counts by a two-tier lookup on the map side.

First tier: a compact table of the lengths (in tokens) of frequent pre-tokens, broadcast to all workers;
its size is bounded by ``TABLE_ROWS``. Second tier: a worker's bounded cache, filled by encoding what it misses. Pre-tokens
are never shuffled: each task sends the most frequent ones it has met, and only these summaries are
added up. The table decides how fast a count is, never what it is.
"""

from __future__ import annotations

import functools
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLE_ROWS = 50_000
SUMMARY_ROWS = 20_000
SUMMARY_ROOM = 200_000
CACHE_ROWS = 400_000
LONGEST_CACHED = 64
#: The mark that the library writes for a space (fixed value).
MARK = "▁"


class Lengths(dict):
    """Length in tokens by pre-token; a missing one is encoded by the library and cached."""

    def __init__(self, measure, frequent: dict[str, int]):
        super().__init__(frequent)
        self.measure, self.fixed, self.most = measure, frequent, len(frequent) + CACHE_ROWS

    def __missing__(self, word: str) -> int:
        n = self.measure(word)
        if len(word) <= LONGEST_CACHED:
            if len(self) >= self.most:
                self.clear()
                self.update(self.fixed)
            self[word] = n
        return n


class Counts:
    """Counts tokens of texts. ``spaced`` has the words behind one space, ``other`` all other pre-tokens.

    The library puts a space before the text, merges only inside a run of spaces and the word that
    follows, and has no token with a line break, which it writes as one byte token.
    """

    def __init__(self, path: str, frequent: dict[str, int]):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.break_tokens = len(self.library.encode("\n"))
        self.spaced = Lengths(lambda w: len(self.library.encode(w)), frequent)
        # behind a line break, which merges with nothing, no space is added
        self.other = Lengths(lambda w: len(self.library.encode("\n" + w)) - self.break_tokens, {})

    def _line(self, parts: list[str], first: bool) -> int:
        """A line with runs of spaces: each run goes with the word behind it."""
        total, gap = 0, " " if first else ""
        for j, word in enumerate(parts):
            if j:
                gap += " "
            if word:
                total += self.spaced[word] if gap == " " else self.other[gap + word]
                gap = ""
        return total + (self.other[gap] if gap else 0)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if "\x00" in text or MARK in text:  # the mark itself in a text is a space to the library
            return len(self.library.encode(text))
        spaced, total = self.spaced.__getitem__, text.count("\n")
        for k, line in enumerate(text.split("\n")):
            parts = line.split(" ")
            if "" in parts:
                total += self._line(parts, not k)
            elif k:
                total += self.other[parts[0]] + sum(map(spaced, parts[1:]))
            else:
                total += sum(map(spaced, parts))
        return total


@functools.lru_cache(maxsize=1)
def _counts(path: str, words: str, lengths: tuple[int, ...]) -> Counts:
    return Counts(path, dict(zip(words.split("\n"), lengths, strict=True)) if lengths else {})


def _heavy(texts: DataFrame) -> DataFrame:
    """``word, n``: for every task, its most frequent pre-tokens (a bounded summary that drops the rarest when full)."""

    def run(batches):
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    seen.update(text.as_py().split(" "))
                if len(seen) > 2 * SUMMARY_ROOM:
                    seen = Counter(dict(seen.most_common(SUMMARY_ROOM)))
        top = [(w, n) for w, n in seen.most_common(SUMMARY_ROWS) if n > 1 and w and len(w) <= LONGEST_CACHED and "\n" not in w]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["word", "n"])

    return texts.mapInArrow(run, "word string, n long")


def frequent_lengths(df: DataFrame, path: str, *, text: str = "text", rows: int = TABLE_ROWS) -> tuple[str, list[int]]:
    """The most frequent pre-tokens, joined by line breaks, and their lengths: at most ``rows``, the size of the broadcast."""
    top = _heavy(df.select(F.col(text).alias("_text"))).groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(rows)
    measure = Counts(path, {}).spaced.measure
    found = [r.word for r in top.select("word").collect()]
    return "\n".join(found), [measure(w) for w in found]


def token_counts(df: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """``key, n_bytes`` (UTF-8), ``n_tokens, over_limit`` for every row; null and empty texts count 0.

    Counts equal the library's defaults without begin or end tokens. Repeated rows count alike; keys may be null.
    """
    shared = df.sparkSession.sparkContext.broadcast(frequent_lengths(df, path, text=text))
    rows = df.select(F.col(key).alias(key), F.col(text).alias("_text"))
    schema = T.StructType([rows.schema[key], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches):
        words, lengths = shared.value
        counts = _counts(path, words, tuple(lengths))
        for batch in batches:
            sizes = pc.binary_length(batch.column("_text")).fill_null(0).cast(pa.int64())
            tokens = [counts.count(t.as_py()) for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([batch.column(key), sizes, pa.array(tokens, pa.int64())], names=[key, "n_bytes", "n_tokens"])

    return rows.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
