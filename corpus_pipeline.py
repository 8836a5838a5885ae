"""A corpus made ready for training, in five stages, each of them one operator of ``millrace.llm``.

A stage takes the documents that the one before it kept, and its decisions take effect: toxic
documents go, then poor ones, then all but one of each group of near duplicates; sources are
mixed to their target weights, where a document may be taken several times; and what is left
is encoded. All stages but the last return the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe, mixing, ngram_join, quality_rules, toxicity
from millrace.llm.queries import ship, vocabulary_text
from millrace.llm.store import written
from millrace.sources import tables

#: The stages learn from labels by methods that SQL cannot express; tests hold each of them
#: against a brute-force version instead.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return toxicity.drop_toxic(docs, tables.read(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality_rules.drop_poor(docs, tables.read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return ngram_join.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emit(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    found = bpe.encode_digests(docs.select("doc_id", "text"), vocabulary_text(), keep=["doc_id"])
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_poor),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
