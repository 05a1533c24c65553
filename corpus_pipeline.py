"""From raw documents to packed training sequences, in five stages of the training-data operators.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the
last return doc_id, text, lang, source, n_chars. Other columns of docs are not read. Null values,
empty texts, rows that repeat and empty tables have the results that the operators define: the
quality rules reject null and empty texts, of rows that repeat one stays, n_chars is the length of
the text as it then is where a stage changed texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import decontaminate, jaccard_join, packing, quality_rules, suffix_dedup
from tesserae.llm.common import stored

#: Bytes of a repeat: a passage of just over 50 words has about as many or more.
REPEATED = suffix_dedup.SHORT
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality rules reject, and frequent lines of the others."""
    return quality_rules.cleaned(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least id of each class of copies and near copies."""
    return jaccard_join.thinned(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes byte strings of REPEATED bytes that repeat out of the texts; documents of which no word is left go."""
    return suffix_dedup.cleaned(docs, REPEATED)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold items of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals every token of every document to training sequences."""
    return packing.packed(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("benchmark", benchmark), ("packing", packed)]
#: The third stage can't be said in SQL for whole texts; tests/llm hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
