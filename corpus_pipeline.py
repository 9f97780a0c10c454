"""A corpus pipeline over ``documents``: quality rules, near-duplicate join, pseudonyms, source mix, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prefixledger.llm import bpe, mixing, ngram_join, pseudonyms, quality_rules
from prefixledger.llm.registry import PSEUDONYM_KEY, WORD_BPE
from prefixledger.session import cut_lineage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outlier of their language and source."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of every group of near duplicates."""
    return ngram_join.one_of_each(docs)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal numbers and dates permuted within their formats; ``n_chars`` follows the text."""
    return pseudonyms.replace_text(docs, PSEUDONYM_KEY, n_chars="n_chars")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target weights of the sources ask for."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document taken, and the text they decode to."""
    return bpe.with_ids(docs, WORD_BPE, ids="token_ids", decoded="decoded")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("pseudonyms", pseudonymise), ("mix", mix), ("encode", encode)]

#: Concentration steps, tries and merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table, each written and read again before the next; the last as its plan."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
