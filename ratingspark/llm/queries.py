"""The registered queries of this subpackage: each applies one operator, with
production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ratingspark.llm import (bpe, centroids, decontaminate, divergence, fingerprints, html_extract, lang_id, license_scan,
                             line_dedup, near_dup, secret_scan, sharding, warc)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return keep


@query("op2_superminhash")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of ``documents`` over two-word shingles."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_dup.near_duplicates(docs, width=2).select("doc_id", "n_shingles", "component_id", "kept")


@query("op7_trie_bpe")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the text decoded from them."""
    return bpe.round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query("op1_warc_archive", warc.ORACLE)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record of a content-addressed archive, read back."""
    return warc.page_digests(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query("op4_bottom_k")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints.edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query("op6_zstd_novelty")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secret_scan.span_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query("op8_hierarchical_svm")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    return lang_id.predictions(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query("op5_latent_semantic")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents leak."""
    return decontaminate.contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                                      spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op3_template_lines", line_dedup.ORACLE)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its recurring lines."""
    return line_dedup.line_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query("op9_label_propagation")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return sharding.shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query("op10_license_classifier")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families of the documents' paragraphs."""
    return license_scan.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query("op13_threshold_centroids", centroids.ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three exact k-means rounds over the quantised embeddings."""
    return centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op11_packed_divergence", divergence.ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each source's words differ from its language's other sources."""
    return divergence.audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query("op12_boosted_dom")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
