"""The corpus pipeline: quality, near-duplicates, benchmark passages, personal data, mix.

Each stage takes the documents that its predecessor kept and returns documents, with the columns doc_id, text,
lang, source and n_chars; the last adds nothing and repeats a document as often as the mix takes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import contamination, minhash, mixing, pii, quality
from barloom.llm.lineage import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling rejects go."""
    return quality.resampled(docs, _table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: shingles of five words, similarity of 0.8."""
    return minhash.deduplicated(docs, shingle=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage of ten words go."""
    return contamination.decontaminated(docs, _table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows."""
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in the proportions 3 : 1 : 2, 80 % of all words, no document twice."""
    return mixing.mixed(docs, weights=(3, 1, 2), share=0.8, epochs=1)


STAGES = [("quality", quality_stage), ("dedup", dedup_stage), ("decontamination", decontamination_stage), ("pii", pii_stage), ("mixing", mixing_stage)]

#: Hashed models, signatures and hash orders have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = stored(docs)
    return docs
