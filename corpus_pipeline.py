"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import mixing, packing, quality_rules, simhash, weak_quality
from tracewell.llm.common import prepared, staged, word_count

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; it learns from the documents given, not from labels.

    Every row is judged by its text alone: repeated rows share their fate, null and empty texts get
    the score of a text without features, null ids stay. An empty table stays empty.
    """
    prepared(spark)
    rows = docs.select(*COLUMNS)
    scorer, _ = weak_quality.train(rows)
    scored = weak_quality.scored(rows, scorer, score="_score")
    return scored.filter(F.col("_score") >= weak_quality.THRESHOLD).select(*COLUMNS)


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rule table. Null and empty texts fail; repeated rows share their fate."""
    prepared(spark)
    return quality_rules.passing(docs.select(*COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays: the one with the smallest doc_id, whatever its id.

    Rows are numbered in a staged copy, so that rows without an id and rows that share one are linked
    by their own text; rows without an id stand behind all others, and of equal ids the row with the
    smallest hash stays. A null text is an empty one.
    """
    prepared(spark)
    numbered = staged(docs.select(*COLUMNS, F.xxhash64("text", "source", "lang", "n_chars").alias("_hash"), F.monotonically_increasing_id().alias("_row")))
    classes = simhash.simhash_components(numbered.select("_row", "text"), doc_id="_row").select(F.col("doc_id").alias("_row"), "component_id")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_hash", "_row")
    kept = numbered.select("_row", "doc_id", "_hash").join(classes, "_row").groupBy("component_id").agg(F.min(place).alias("place")).select("place._row")
    return numbered.join(kept, "_row", "left_semi").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    Rows are numbered in a staged copy, so repeated rows and rows without an id are mixed like any
    other; a null source is a source of its own.
    """
    prepared(spark)
    numbered = staged(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")))
    sizes = numbered.select("doc_id", "source", word_count(F.col("text")).alias("size"), "_row")
    taken = mixing.mix(sizes, carry=["_row"]).filter("copies > 0").select("_row", F.col("copies").cast("int").alias("_copies"))
    repeated = numbered.join(taken, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return repeated.select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 1024 tokens; repeated rows are packed each."""
    prepared(spark)
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("quality_classifier", keep_good),
    ("quality_rules", keep_by_rules),
    ("simhash_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# a trained classifier, XXH64 fingerprints, random rounding and token ids are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each result written before the next stage reads it."""
    docs = prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
