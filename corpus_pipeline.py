"""A training corpus from raw documents: select, deduplicate, decontaminate, mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfold.llm import decontaminate, mixing, neardup, quality, suffixes
from rankfold.llm.queries import MIX_WEIGHTS
from rankfold.llm.shared import documents, kept

#: Passages of more than fifty words that repeat anywhere are cut, however short the words.
REPEATED_WORDS = 51


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that the importance resampling does not draw go."""
    return quality.quality_filtered(docs, documents(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: one document of each group of near-duplicates stays."""
    return neardup.deduplicated(docs, shingle=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: passages of more than fifty words that repeat anywhere are cut out of the texts."""
    return suffixes.without_repeats(docs, length=REPEATED_WORDS, unit="word")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents with a benchmark item go."""
    return decontaminate.decontaminated(docs, documents(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: each document as often as the mix takes it, with the number of the copy."""
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("document")
    mixed = mixing.mixture(docs.select("doc_id", "text", "source", whole), MIX_WEIGHTS, share=1.5, ceiling=2.0, keep=["document"])
    number = "copy" if "copy" not in docs.columns else "mix_copy"
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(number)
    return mixed.where("copies > 0").select("document", copies).select("document.*", number)


STAGES = [
    ("quality classifier", select_quality),
    ("near-duplicates", drop_near_duplicates),
    ("repeated strings", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("source mixing", mix_sources),
]

#: No SQL: the near-duplicate and resampling stages have none. tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; each result is written and read again as the next one's input."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
