"""The corpus pipeline: five stages over documents, each written as Parquet and reread as the next one's input.

Languages that can't be told go, one document of each near-duplicate group stays, contaminated documents go, personal
data is replaced in the texts, and what is left is packed into token windows. A stage takes (spark, docs, sf_dir) and
works on all that the one before it kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanescope.llm import decontaminate, jaccard, language, packing, personal
from lanescope.llm.common import scratch


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language can be told; learns from the input's own language marks.

    Null and empty texts go, as do texts without a letter. Rows that repeat an id, or have none, are judged one by one. Without
    any language marks nothing goes. Empty tables stay empty; other columns stay as they are, whatever their names.
    """
    return language.accepted(docs, language.train(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each group that links join.

    Null and empty texts link with nothing and stay, as do rows without an id. Of rows that repeat the least id of a group
    one stays. Empty tables stay empty; other columns stay as they are, whatever their names.
    """
    return jaccard.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents contaminated by the benchmark.

    Null and empty texts are clean. Rows that repeat an id, or have none, are judged one by one. An empty table stays empty; an empty benchmark drops nothing. Other columns stay as they are, whatever their names.
    """
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; every document stays, and n_chars follows the text.

    Null and empty texts stay. Rows that repeat an id, or have none, are redacted one by one. Empty tables stay empty; other
    columns stay as they are, whatever their names.
    """
    out = personal.redacted(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out.select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows.

    Null and empty texts are an end mark alone. Rows that repeat an id, or have none, are documents of their own. Empty
    tables give no pieces; other columns are ignored.
    """
    return packing.packed(docs)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]

#: Neither the classifier nor the tokenizer can be put in SQL: tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = scratch(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
