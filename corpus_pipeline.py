"""A corpus pipeline of five stages over ``documents``; each stage's rows are written as Parquet and read by the next.

A stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns
of docs, whatever they are called; the last returns packed sequences. An empty
table gives an empty result in each. Null texts count as empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from leadlens.llm import decontaminate, line_dedup, packing, simhash, toxicity
from leadlens.llm.common import shared_dir, table


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model (fitted on labels) doesn't reject: each row by its own text, so null and empty texts stay and repeated rows share their fate."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that recur across them. Every row stays; rows without doc_id or text stay as they are, and a text may become empty."""
    return line_dedup.drop_lines(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest doc_id's, rows told apart by doc_id and text; texts without words are one group."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; of rows that share a doc_id all go if one holds an item, rows without doc_id stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in token sequences; an empty text is packed as its end, repeated rows each."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_filter),
    ("line_dedup", line_dedup_stage),
    ("simhash", simhash_dedup),
    ("decontamination", decontamination),
    ("packing", pack_sequences),
]

#: The first stage's model and the last stage's tokenizer can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline_{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{base}/{k}_{name}")
            docs = spark.read.parquet(f"{base}/{k}_{name}")
    return docs
