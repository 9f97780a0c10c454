"""Disk of the n-gram join: clusters do not grow together by short common passages, and shuffle files go with their query."""

import random
import time

import pytest

pytest.importorskip("public_tokenizers")

from prefixledger import session  # noqa: E402
from prefixledger.llm import ngram_join  # noqa: E402


def test_passages_of_two_texts_do_not_tie_all_to_one_cluster(spark, monkeypatch):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(8))
    passages = [[word() for _ in range(20)] for _ in range(41)]
    # each text has a passage in common with the one before and one with the next; the last is a near copy of the first
    texts = [" ".join([*passages[k], *(word() for _ in range(160)), *passages[k + 1]]) for k in range(40)]
    texts.append(texts[0] + " end")
    seen = []
    inner = ngram_join._cluster_links
    monkeypatch.setattr(ngram_join, "_cluster_links", lambda sets, *rest: (seen.extend(r["count"] for r in sets.groupBy("cluster").count().collect()), inner(sets, *rest))[1])
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # 64 counters: the sketch tells little, as a full one of a large corpus
    got = {r.id: r.component for r in ngram_join.join(frame, sketch_bits=6, block_classes=10).collect()}
    assert got == {k: k for k in range(40)} | {40: 0}
    assert max(seen) <= 5


def _shuffle_files(spark):
    return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("/shuffle_")


def test_shuffle_files_go_with_the_query_that_wrote_them(spark):
    before = spark.conf.get(session.CLEAN_SHUFFLES, None)
    there = _shuffle_files(spark)
    with session.stored_frames(spark):
        for k in range(5):
            session.cut_lineage(spark.range(1000).selectExpr(f"id % {90 + k} as k").groupBy("k").count())
        until = time.time() + 20
        while _shuffle_files(spark) > there and time.time() < until:
            time.sleep(0.2)
        assert _shuffle_files(spark) <= there
    assert spark.conf.get(session.CLEAN_SHUFFLES, None) == before
