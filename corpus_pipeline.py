"""Corpus pipeline: each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontamination, line_dedup, packing, shingle_simhash, toxicity
from lodestone.llm._common import store, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from all labels, scores as toxic go."""
    judged = toxicity.judge(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), lambda doc_id: F.lit(False))
    return judged.where(F.col("_score") < toxicity.THRESHOLD).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (SimHash of five-word shingles, similarity 0.8) stays."""
    return shingle_simhash.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that also occur earlier go; every document stays, with n_chars of what is left."""
    cut = line_dedup.remove_repeated_units(docs)
    changed = F.size("_spans") > 0
    return cut.withColumns({"text": F.col("_kept"), "n_chars": F.when(changed, F.length("_kept").cast("long")).otherwise(F.col("n_chars"))}).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, tokenised and packed into sequences: a row per piece."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxic), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontamination", decontaminate), ("packing", pack)]

#: A learned classifier, connected components and packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
