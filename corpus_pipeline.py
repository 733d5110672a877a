"""The corpus pipeline: toxicity, quality, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and gives the next one's docs, written as Parquet and read again between stages. The
classifiers are fitted on the labelled rows among the documents they are given, and judge all of those.

Defined cases: a null text counts as empty in every stage, is judged like any text, and is packed as an empty document; rows with a
null doc_id have no labels, are judged, always stay in the near-duplicate stage and are packed; of repeated rows, which are one
group, the near-duplicate stage keeps one, the first of its smallest doc_id, and two texts under one doc_id are two documents; very long
texts are judged and packed whole; empty tables give empty results; other columns of documents, whatever their names, pass through
all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wayfowl.llm import packing, quality, simhash, toxicity
from wayfowl.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.only_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("packing", pack)]

#: The stages hold models trained in numpy, which SQL cannot express; tests compare run() with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
