"""Registered queries of the corpus operators, with production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import clustering, embedding_dedup, licenses, mixing, packing, periodic_runs, quality_rules, sharding, simhash, token_counts, toxicity, warc, weak_quality
from tracewell.llm.common import table, word_count

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@register
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document by 64-bit SimHash over three-word shingles."""
    return simhash.simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register
def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and near-duplicate class of every vector at a cosine of 0.98 within its label."""
    return embedding_dedup.embedding_components(table(spark, sf_dir, "embeddings"))


ORACLES["op1_embedding_dedup"] = embedding_dedup.oracle()


@register
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, ratios and rule verdict of every document."""
    return quality_rules.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLES["op5_quality_rules"] = quality_rules.oracle()


@register
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources at weights 3, 1, 2 takes from every document."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mixing.mix(rows).select("doc_id", "size", "source_size", "target", "taken")


@register
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


@register
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a classifier trained on the labels that are not held out."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document by a scorer trained on weak labels of all documents."""
    return weak_quality.quality(table(spark, sf_dir, "documents"))


@register
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best find of every license in every document."""
    return licenses.license_scan(table(spark, sf_dir, "documents"))


@register
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact histogram of encoded lengths per source with its suffix sums."""
    histogram = token_counts.length_histogram(table(spark, sf_dir, "documents"), ["source"])
    return token_counts.suffix_sums(histogram, ["source"])


@register
def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion record of every page."""
    return warc.derivatives(warc.responses_from_pages(table(spark, sf_dir, "pages")))


@register
def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; every shard holds the mixture of all sources."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


ORACLES["op13_sharding"] = sharding.oracle()


@register
def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distance and inertia of every vector after three exact rounds over 16 centroids."""
    found = clustering.cluster(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", clustering.centroid_digest(F.col("centroid")).alias("centroid_sha256"))


ORACLES["op12_centroid_clustering"] = clustering.oracle()


@register
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all periodic runs of every document, some of which carry a planted one."""
    planted = periodic_runs.with_planted_runs(table(spark, sf_dir, "documents"))
    return periodic_runs.run_digests(periodic_runs.periodic_runs(planted))


ORACLES["op11_periodic_runs"] = periodic_runs.oracle()
