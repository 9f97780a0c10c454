"""The corpus queries: each applies its operator with production parameters to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from prefixledger.llm import (
    alignment,
    ball_tree,
    bpe,
    id_planes,
    merkle,
    mixing,
    ngram_join,
    permutation_index,
    pseudonyms,
    quality_cnn,
    quality_rules,
    token_counts,
    url_filters,
)
from prefixledger.llm.common import table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
PSEUDONYM_KEY = "corpus-key-1"

QUERIES, ORACLES = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_cnn(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality_cnn.score(docs, quality_cnn.fit(docs, table(spark, sf_dir, "labels")))


@query
def op2_id_planes(spark, sf_dir):
    return id_planes.written_and_read(table(spark, sf_dir, "documents"), WORD_BPE)


@query
def op3_bpe_round_trip(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"), WORD_BPE)


@query
def op4_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), PIECE_BPE)


@query
def op5_pseudonyms(spark, sf_dir):
    out = pseudonyms.pseudonymised(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)
    return out.select("row.doc_id", F.col("new_text").alias("text"), *[f"n_{k}" for k in pseudonyms.KINDS])


@query
def op6_quality_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"), keep={"doc_id": "doc_id"})


@query
def op7_source_mix(spark, sf_dir):
    rows = mixing.copies(table(spark, sf_dir, "documents"))
    return rows.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLES["op7_source_mix"] = mixing.ORACLE


@query
def op8_ngram_join(spark, sf_dir):
    out = ngram_join.join(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


@query
def op9_url_rules(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    rows = url_filters.judge(pages.select("page_id", "url"), url_filters.html_links(pages))
    return rows.select("row.page_id", "host", "path", "rule", "verdict")


ORACLES["op9_url_rules"] = url_filters.ORACLE


@query
def op10_top_k(spark, sf_dir):
    return ball_tree.top_k(table(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 50 == 0)


ORACLES["op10_top_k"] = ball_tree.ORACLE


@query
def op11_merkle(spark, sf_dir):
    return merkle.audited(table(spark, sf_dir, "documents"))


ORACLES["op11_merkle"] = merkle.ORACLE


@query
def op12_permutation_index(spark, sf_dir):
    return permutation_index.nearest(table(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 100 == 0)


@query
def op13_alignment(spark, sf_dir):
    return alignment.digests(table(spark, sf_dir, "documents"), BYTE_BPE, PIECE_BPE)
