"""Source trees, stored analysis results and audit logs as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.corpus import snapshot_digest
from tracewell.operators.runs import expire_retention, expired
from tracewell.operators.skew import prefix_sums


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root``: path relative to it, size, content and modification time."""
    base = root.rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    plain = F.regexp_replace("path", r"^[a-z0-9]+:/*(?=/)", "")
    start = F.instr(plain, base if base.startswith("/") else "/" + base)
    return raw.select(F.substring(plain, start + len(base), F.length(plain)).alias("path"), F.col("length").alias("size"), "content", "modificationTime")


def write_artifact(result: DataFrame, folder: str, key: str = "project_id") -> None:
    """Store one result per key; only the keys in ``result`` are replaced. Readers see whole partitions."""
    (result.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(folder))


def write_tombstones(spark: SparkSession, folder: str, key: str, now: Column) -> None:
    """Expire stored sessions in place: unprotected, terminal ones past expiry lose their body and keep their row.

    Only the partitions of ``key`` with a row to expire are rewritten, each as a whole, so a reader sees a partition
    before or after and a repeated run finds nothing left to do.
    """
    sessions = read_artifact(spark, folder)
    due = expired(now) & ~F.col("status").eqNullSafe("expired")
    touched = sessions.filter(due).select(key).distinct()
    kept = sessions.join(touched, sessions[key].eqNullSafe(touched[key]), "left_semi")
    write_artifact(expire_retention(kept, now), folder, key)


def read_artifact(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def artifact_revision(artifact: DataFrame) -> DataFrame:
    """Content digest of a stored manifest: equal content gives an equal revision."""
    return snapshot_digest(artifact).withColumnRenamed("digest", "revision")


def within_audit_quota(
    records: DataFrame, run: str, order: str, body: Column, block: Column, record_bytes: int = 4 * 1024 * 1024, run_bytes: int = 32 * 1024 * 1024
) -> DataFrame:
    """Records with their bytes and running bytes per run, and whether each may be appended."""
    sized = records.withColumn("bytes", F.octet_length(body).cast("long"))
    charged = F.when(F.col("bytes") <= record_bytes, F.col("bytes")).otherwise(0)
    summed = prefix_sums(sized, [run], block, [order], {"run_bytes_used": charged})
    return summed.withColumn("accepted", (F.col("bytes") <= record_bytes) & (F.col("run_bytes_used") <= run_bytes))


def append_audit(accepted: DataFrame, folder: str) -> None:
    accepted.write.mode("append").parquet(folder)


def read_audit(spark: SparkSession, folder: str, order: list[str]) -> DataFrame:
    return spark.read.parquet(folder).orderBy(*order)


def events_after(events: DataFrame, cursors: DataFrame) -> DataFrame:
    """Events of each run beyond that run's cursor (run_id, cursor)."""
    return events.join(cursors, "run_id").filter(F.col("sequence") > F.col("cursor")).drop("cursor")


def call_edges(callsites: DataFrame, legacy: DataFrame, project: str | None = None, salts: int = 256) -> DataFrame:
    """Call edges from call-site facts; the legacy graph of a project only where it has no facts at all, never a mix.

    ``project`` names a column of both tables; without it all rows are one project.
    The few projects are repeated per salt, so that the legacy edges of one spread over ``salts`` keys.
    """
    key = F.col(project) if project else F.lit(0)
    described = callsites.select(key.alias("_p")).distinct().select("_p", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    salted = legacy.withColumn("_p", key).withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    calls = salted.filter(F.col("relation").isin("calls", "instantiates")).join(described, ["_p", "_salt"], "left_anti")
    semantic = callsites.select("caller", "callsite_id", F.explode("targets").alias("t")).select(
        F.col("t.edge_id").alias("id"), F.col("caller").alias("source"), F.col("t.target").alias("target"), F.lit("calls").alias("relation"), F.col("t.dispatch").alias("dispatch"), "callsite_id")
    return semantic.unionByName(calls.select("id", "source", "target", "relation", "dispatch", F.lit(None).cast("string").alias("callsite_id")))


def fact_nodes(callables: DataFrame, legacy_nodes: DataFrame) -> DataFrame:
    """Declared callables first, legacy nodes only where no fact names them."""
    extra = legacy_nodes.join(callables.select("id").distinct(), "id", "left_anti")
    return callables.select("id", "kind", F.lit("semantic").alias("origin")).unionByName(extra.select("id", "kind", F.lit("legacy").alias("origin")))


def files_by_language(files: DataFrame) -> DataFrame:
    from tracewell.functions.ids import file_id

    return files.filter("lang <> '' and path <> ''").select(F.lower("lang").alias("language"), file_id("path").alias("path")).distinct()


def build_fact_tables(references: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(call sites, their distinct targets as flat rows, coverage).

    References without an edge stay as call sites without targets and keep their reason. Targets stay
    flat: a dispatch site may have any number of them.
    """
    targets = edges.select("callsite_id", "edge_id", "target", "dispatch").dropDuplicates(["callsite_id", "edge_id"])
    per_site = targets.groupBy("callsite_id").agg(F.count("*").alias("target_count"), F.min("edge_id").alias("first_edge"))
    sites = references.join(per_site, "callsite_id", "left").withColumn("target_count", F.coalesce("target_count", F.lit(0)))
    sites = sites.withColumn("unresolved_reason", F.when(F.col("target_count") == 0, F.coalesce("reason", F.lit("symbol_not_found")))).drop("reason")
    coverage = sites.agg(F.count("*").alias("callsites"), F.count_if(F.col("target_count") > 0).alias("resolved"), F.count_if(F.col("target_count") == 0).alias("unresolved"))
    return sites, targets, coverage


def add_value_slots(parameters: DataFrame, returns: DataFrame, results: DataFrame) -> DataFrame:
    """Slot rows (slot_id, owner, role, position, name) of parameters, returns and call results."""
    from tracewell.functions.ids import digest_id

    def slots(df, role):
        ident = digest_id("slot:", "owner", F.lit(role), F.col("position").cast("string"), "name")
        return df.select(ident.alias("slot_id"), "owner", F.lit(role).alias("role"), "position", "name")

    return slots(parameters, "parameter").unionByName(slots(returns, "return")).unionByName(slots(results, "call_result")).dropDuplicates(["slot_id"])


def lookup(facts: DataFrame, order: list[str], prefix: str = "", **keys) -> DataFrame:
    """Rows of a fact table by exact keys (and optionally a path prefix) in stable order."""
    for name, value in keys.items():
        facts = facts.filter(F.col(name) == value)
    if prefix:
        facts = facts.filter(F.col("path").startswith(prefix))
    return facts.orderBy(*order)


def unique_by(facts: DataFrame, name: str) -> DataFrame:
    """Rows whose name is unambiguous: counted by partial aggregation, then joined back."""
    single = facts.groupBy(name).agg(F.count("*").alias("_n")).filter("_n = 1").select(name)
    return facts.join(single, name, "left_semi")
