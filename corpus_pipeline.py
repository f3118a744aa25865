"""From raw documents to packed training batches: each stage is an operator of ``seismark.llm``.

Every stage gets the documents its predecessor kept and returns the columns of ``documents``; the last one returns the
placement of every piece in its batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from seismark.llm import decontamination, jaccard_join, packing, quality_rules, substring_dedup
from seismark.llm.common import packed_rows, unpacked_rows, written
from seismark.llm.registry import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the limits or the trees reject go."""
    trees = quality_rules.train(docs, table(spark, sf_dir, "labels"))
    judged = quality_rules.judge(packed_rows(docs), trees)
    return unpacked_rows(judged.where("kept"), docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id stays."""
    return jaccard_join.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that start earlier elsewhere go; documents of which nothing is left go. n_chars follows the new text, and a
    document without repeated passages keeps its text as it is."""
    return substring_dedup.cut(docs).where("text is not null and length(text) > 0").withColumn("n_chars", F.length("text").cast("long")).select(*[f"`{c}`" for c in docs.columns])


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document's pieces and their places in the batches."""
    return packing.pack(packing.word_lengths(docs))


STAGES = [("quality_rules", quality_stage), ("jaccard_join", near_duplicate_stage), ("substring_dedup", substring_stage),
          ("decontamination", benchmark_stage), ("packing", packing_stage)]
#: SQL cannot express the boosted trees of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
