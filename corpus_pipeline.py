"""Corpus cleaning pipeline: each stage takes ``(spark, docs, sf_dir)`` and
returns a DataFrame, which is written as Parquet and read again as the next
stage's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingspark.llm import bpe, decontaminate, lang_id, line_dedup, near_dup
from ratingspark.llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go: no letter, no text, or a
    score below the language's least, found on held-out training rows. ``lang``
    becomes the predicted language."""
    machines = lang_id.train(docs, calibrated=True)
    kept = lang_id.identify(docs, machines).where(lang_id.certain(machines))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur across documents go from the texts."""
    done = line_dedup.drop_recurring_lines(docs, verified=True, short=True)
    return done.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (five-word shingles,
    similarity of 0.8 or more)."""
    return near_dup.deduplicated(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token count and digests of its ids and decoded text."""
    return bpe.round_trip(docs)


STAGES = [("language_id", language), ("line_dedup", lines), ("minhash_near_dedup", near_dedup),
          ("benchmark_decontamination", decontamination), ("bpe_round_trip", tokens)]

#: Signatures, fitted models and token ids have no DuckDB form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
