"""Corpus pipeline: quality rules, n-gram Jaccard join, suffix-array dedup, packing.

Each stage takes documents (doc_id, text, lang, source, n_chars) and returns what it keeps of them, with the same columns and
its changes to the texts made; the last returns the pieces of the packed sequences. No stage samples, caps or cuts off.
SQL can't express the last stage, so ORACLE_SQL is None; tests/llm compares the pipeline with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportloom.llm import jaccard, packing, quality, suffixes
from reportloom.llm.common import scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that are too frequent in their host.

    Lines are counted by distinct texts, not documents: copies are the next stage's, which leaves one of them.
    """
    ruled = quality.apply_rules(docs, count="texts").where("kept")
    changed = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return ruled.select(*[changed[c].alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 0.8 or more of their five-word shingles, that of the least id; null ids stay.

    Rows that repeat an id and a text are one document; texts without words are linked with nothing and stay.
    """
    return jaccard.one_of_each(docs, k=5, num=8, den=10)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 bytes or more that an earlier one has; those of which nothing is left go.

    A null or short text stays as it is; a null id comes after all others; rows of one id don't take from each other.
    """
    new = suffixes.dedup_texts(docs)
    return new.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else new


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 2048 tokens; a null or empty text is one token, each row an example of its own."""
    return packing.pack_documents(docs)


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", suffix_dedup), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(path := scratch(spark))
            docs = spark.read.parquet(path)
    return docs
