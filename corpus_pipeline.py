"""From raw documents to token shards: quality, near duplicates, benchmark
passages, mixing, tokens. Each stage works on all rows that the stage before
it kept; all but the last return the columns of the documents, whatever
these are.

Defined cases: a null or empty text has no words, so it is no near duplicate
and not contaminated, has no part in the mix (a source's rate is still drawn
for it) and only the end id as tokens; null and repeated ids are rows of their
own in every stage; of rows equal in id and text near_duplicates keeps one; ties
go to the smallest id, then the smallest hash of the text; an empty table
gives an empty result; without usable ratings all documents pass quality."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from penmark.llm import mixing, ngram_join, ordinal, repair_ids, winnowing
from penmark.llm.common import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, fitted on the ratings, keeps."""
    return ordinal.select_good(docs, ordinal.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group (five words, similarity of 0.8 or more)."""
    return ngram_join.drop_near_duplicates(docs, n=5, num=4, den=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark passages."""
    return winnowing.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out to meet their sources' targets."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards on disk; per document what is read back from them."""
    import public_tokenizers

    return repair_ids.read_documents(repair_ids.write_shards(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("tokens", tokens),
]

#: The classifier and the tokenizer cannot be said in SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
