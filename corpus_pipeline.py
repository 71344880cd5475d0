"""Cleans `documents` and packs what is left: five stages, each on all that its predecessor kept.

toxicity removes documents that the classifier scores 0.3 or more; jaccard keeps one document of each group of near
duplicates (five-word shingles, similarity 0.8); suffix_dedup cuts passages of 50 bytes or more that an earlier document
also holds; decontaminate removes documents with a benchmark passage; packing returns the pieces of training sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factmill.llm import scratch
from factmill.llm.decontaminate import remove_contaminated
from factmill.llm.jaccard import keep_one
from factmill.llm.packing import pack_documents
from factmill.llm.queries import toxicity_model
from factmill.llm.substrings import remove_repeats
from factmill.llm.toxicity import remove_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_toxic(docs, toxicity_model(spark, sf_dir))


def jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_repeats(docs, count_col="n_chars")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("jaccard", jaccard), ("suffix_dedup", suffix_dedup), ("decontaminate", decontaminate), ("packing", packing)]

#: The classifier and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.written(docs, name)
    return docs
