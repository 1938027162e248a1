"""The corpus pipeline: documents through five stages, each written out and read again.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), works on all documents its
predecessor kept, and returns what is left with the columns of documents: further columns are kept with their values,
whatever their names, and an empty table gives an empty one. Tables a stage needs besides (labels, benchmark) are read
from sf_dir.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.llm.decontaminate import remove_contaminated
from fieldbook.llm.line_dedup import dedup_lines
from fieldbook.llm.mixing import mix
from fieldbook.llm.near_dedup import drop_near_duplicates
from fieldbook.llm.quality import keep_quality
from fieldbook.llm.scratch import packed, unpacked, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier keeps; null and token-free texts go."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated three-line windows; one that thereby loses all its text goes.

    n_chars is counted anew where lines go; other columns keep their values. A null text stays.
    """
    roles = {"doc_id": "doc_id", "text": "text"}
    out = dedup_lines(packed(docs, **roles))
    gone = F.coalesce((F.col("n_removed") > 0) & (F.trim("text") == ""), F.lit(False))
    length = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("_fb_row").getField("n_chars"))
    return unpacked(out.where(~gone), docs.columns, roles, n_chars=length)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group of near copies (five words, similarity 0.8); null ids and texts stay."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word window of a benchmark item; null texts stay."""
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources meet their target weights; a null source is one, a source without words goes."""
    return mix(docs)


STAGES = [
    ("quality", quality),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: The first stage is a hashed model with a seeded sample, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
