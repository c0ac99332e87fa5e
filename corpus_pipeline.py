"""A corpus pipeline of five stages over ``documents``.

Each stage takes the documents that the one before it kept, with their columns, and works on all of them:

1. quality rules: documents that fail the base rules or lie beyond their group's robust distance go;
2. line dedup: lines that three or more documents share stay only in the one with the largest doc_id;
3. near-dedup: SimHash in clusters, confirmed exactly: of each component of texts with a Jaccard index of 0.8 or more on
   five-word shingles the smallest doc_id stays;
4. mixing: documents are taken 0, 1 or 2 times so that sources meet their target words;
5. best-fit packing: the token pieces of all taken documents, placed in sequences.

All stages take any columns beside doc_id, text, lang and source, whatever their names, and hand them on; repeated rows are
rows of their own. An empty table leads to an empty one. Every stage is written as Parquet and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitescope.llm import common, lines, mixing, near, packing, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts fail the base rules and go; null lang or source is a group of its own; very long texts are judged whole."""
    return quality.good_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts stay null, a document may become empty; rows without doc_id are left alone; ties go to the largest doc_id."""
    return lines.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are told apart by themselves: unrelated texts under null or repeated ids stay. Null and empty texts are copies of each other."""
    return near.first_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A null source is a source; null and empty texts count no words and are taken or left without weight; ties of the order go by doc_id."""
    return mixing.mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts are one end token; longer documents than a sequence are cut; a document that was taken twice is packed twice."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]

#: Fingerprints and tokens have no SQL: a test holds the stages against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.table(stage(spark, docs, sf_dir), name)
    return docs
