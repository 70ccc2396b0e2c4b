"""Streaming forms of the run operators.

Every stream keeps its place in a checkpoint below the shared folder, so a restarted query goes on
where it stopped. State is kept by built-in aggregates, which combine map-side: a run that sends a
third of all events costs one small state row, not one overloaded task.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.session import ensure_checkpoint_dir

TERMINAL = ("run.completed", "run.failed", "run.cancelled")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for one query's sink and checkpoint, in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, folder: str, table: str, schema: T.StructType) -> DataFrame:
    """Files of one table as an unbounded stream; the table is one file or a folder of part files."""
    files, place = _folder(spark, f"{folder}/{table}.parquet")
    if files.getFileStatus(place).isDirectory():
        return spark.readStream.schema(schema).parquet(f"{folder}/{table}.parquet")
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(folder)


def append_available(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """Deliver everything that has arrived since the checkpoint, then stop."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start(sink)
    query.awaitTermination()


def upsert_available(stream: DataFrame, sink: str, checkpoint: str, keys: Sequence[str] = (), compact_every: int = 16) -> None:
    """Deliver changed result rows; each micro-batch owns one partition, so a repeated batch replaces itself.

    With ``keys`` about ``compact_every`` batches stay: after every half of them the newest version of each row
    goes into the partition of that batch. What it replaces is removed one compaction later, so a reader that
    has listed the sink still finds its files, and sees the same rows before, during and after.
    """
    step = max(1, compact_every // 2)

    def write(batch: DataFrame, number: int) -> None:
        if keys and number and number % step == 0:
            spark, since = batch.sparkSession, number - step
            older = [n for n in finished_batches(spark, sink) if n < number]
            past = spark.read.option("basePath", sink).parquet(*[f"{sink}/batch={n}" for n in older if n >= since])
            values = [c for c in batch.columns if c not in keys]
            both = past.select(*keys, *values, "batch").unionByName(batch.select(*keys, *values).withColumn("batch", F.lit(number)))
            _newest(both, keys, values).write.mode("overwrite").parquet(f"{sink}/batch={number}")
            for n in older:
                if n < since:
                    remove_folder(spark, f"{sink}/batch={n}")
        else:
            batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("update").start()
    query.awaitTermination()


def latest_rows(spark: SparkSession, sink: str, keys: Sequence[str]) -> DataFrame:
    """Newest version of each result row of an ``upsert_available`` sink."""
    rows = spark.read.option("basePath", sink).parquet(sink)
    return _newest(rows, keys, [c for c in rows.columns if c not in (*keys, "batch")])


def _newest(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
    return newest.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values])


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def finished_batches(spark: SparkSession, sink: str) -> list[int]:
    """Numbers of the finished batches of a sink, on any storage that Spark reaches."""
    files, place = _folder(spark, sink)
    if not files.exists(place):
        return []
    names = [status.getPath() for status in files.listStatus(place)]
    done = [p for p in names if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in done if p.getName().startswith("batch="))


def remove_folder(spark: SparkSession, path: str) -> None:
    files, place = _folder(spark, path)
    files.delete(place, True)


def tail_events(events: DataFrame, terminal: Sequence[str] = TERMINAL) -> DataFrame:
    """The ordered feed: every event with whether it ends its run; the checkpoint replaces the cursor."""
    return events.withColumn("ends_run", F.col("event_type").isin(*terminal))


def event_micros() -> Column:
    return F.unix_micros(F.col("created_at").cast("timestamp"))


def run_state_parts() -> dict[str, tuple[str, Column]]:
    """Order-free ingredients of the run status: first start, first cancel request, first terminal event, last sign of life."""
    kind, seq = F.col("event_type"), F.col("sequence")
    return {
        "started_at": ("min", F.when(kind == "run.started", seq)), "cancel_at": ("min", F.when(kind == "run.cancel_requested", seq)),
        "terminal": ("min", F.when(kind.isin(*TERMINAL), F.struct(seq.alias("sequence"), kind.alias("event_type")))), "last_at": ("max", event_micros()),
    }


def run_state(per_run: DataFrame) -> DataFrame:
    """Status from the ingredients: a cancel request ends a queued run at once and is only noted on a running one."""
    before_start = F.col("cancel_at").isNotNull() & (F.col("started_at").isNull() | (F.col("cancel_at") < F.col("started_at")))
    ended = F.element_at(F.split("terminal.event_type", r"\."), -1)
    status = F.when(before_start, "cancelled").when(F.col("terminal").isNotNull(), ended).when(F.col("started_at").isNotNull(), "running").otherwise("queued")
    return per_run.select("run_id", status.alias("status"), (F.col("cancel_at").isNotNull() & ~before_start).alias("cancel_requested"))


def metric_parts() -> dict[str, tuple[str, Column]]:
    """Counters of a run that a stream can keep up to date."""
    kind = F.col("event_type")
    count = lambda name: ("sum", (kind == name).cast("long"))
    total = lambda name: ("sum", F.coalesce(F.when(kind == name, F.col("k")), F.lit(0)).cast("long"))
    return {
        "events": ("sum", F.lit(1).cast("long")), "model_requests": count("model.started"), "tool_calls": count("tool.requested"), "failures": count("run.failed"),
        "request_characters": total("model.started"), "response_characters": total("model.completed"), "last_sequence": ("max", F.col("sequence")), "last_at": ("max", event_micros()),
    }


def progress_parts() -> dict[str, tuple[str, Column]]:
    """Latest stage and counts of a request, with when it began and last moved."""
    return {"newest": ("max", F.struct("sequence", "stage", "status", "done")), "started_at": ("min", event_micros()), "updated_at": ("max", event_micros())}


def idle(last: str, micros: int, finished: Column | None = None):
    """Rows that leave a keyed state: ``last`` lies ``micros`` behind the newest event (and ``finished`` holds)."""
    return lambda clock: (F.col(last) < clock - micros) & (F.lit(True) if finished is None else finished)


def progress_snapshot(entries: DataFrame, now: Column, ttl_s: int = 600) -> DataFrame:
    """Visible entries: running ones never expire, others do after the time to live."""
    micros = F.unix_micros(now)
    alive = entries.filter((F.col("status") == "running") | (micros - F.col("updated_at") < ttl_s * 1_000_000))
    end = F.when(F.col("status").isin("completed", "failed"), F.col("updated_at")).otherwise(micros)
    return alive.withColumn("elapsed_s", F.round((end - F.col("started_at")) / 1_000_000, 1)).drop("started_at", "updated_at")


def admission(entries: DataFrame, user: str, per_user: int = 8, total: int = 4096) -> DataFrame:
    """Per user the active entries and whether one more may be created."""
    entries_in_all = entries.agg(F.count("*")).scalar()
    per = entries.groupBy(user).agg(F.count_if(F.col("status").isin("pending", "running")).alias("active"))
    return per.withColumn("may_create", (F.col("active") < per_user) & (entries_in_all < total))


def pair_stream(sent: DataFrame, resolved: DataFrame, bound: str, waits: DataFrame | None = None) -> DataFrame:
    """Send attempts joined to their outcome within ``bound`` of event time; an attempt without one is emitted once the watermark passes.

    ``waits`` (wait_of, waited_at, wait_ms; one per attempt) is a second outer join on the first: the retry wait that
    begins within twice the bound of a failed attempt is attached to it. Each stream has its watermark, and the state
    of both joins ends with it.
    """
    left = sent.withWatermark("sent_at", bound)
    right = resolved.withWatermark("resolved_at", bound)
    span = F.expr(f"INTERVAL {bound}")
    condition = (F.col("request_id") == F.col("answer_to")) & (F.col("resolved_at") >= F.col("sent_at")) & (F.col("resolved_at") <= F.col("sent_at") + span)
    paired = left.join(right, condition, "leftOuter")
    if waits is None:
        return paired.select("request_id", "run_id", "status")
    later = waits.withWatermark("waited_at", bound)
    condition = (F.col("request_id") == F.col("wait_of")) & (F.col("waited_at") >= F.col("sent_at")) & (F.col("waited_at") <= F.col("sent_at") + span + span)
    return paired.join(later, condition, "leftOuter").select("request_id", "run_id", "status", F.when(F.col("status") == "failed", F.col("wait_ms")).alias("wait_ms"))


def drain_pending(delivered: DataFrame, sent: DataFrame) -> DataFrame:
    """Delivered pairs plus the attempts that are still inside the watermark when the stream stops."""
    open_rows = sent.join(delivered.select("request_id").distinct(), "request_id", "left_anti").select("request_id", "run_id", F.lit(None).cast("string").alias("status"))
    return delivered.unionByName(open_rows).withColumn("status", F.coalesce("status", F.lit("pending")))


def seen_lines(shown: DataFrame, at: str | None = None, within: str | None = None) -> DataFrame:
    """Each (run, path, line) once, when it is first shown.

    With ``at`` and ``within`` a line is remembered for that long after it was first shown and then forgotten, so the
    state ends with the runs; a line shown again later comes again, and readers take the distinct rows.
    """
    if at is None:
        return shown.dropDuplicates(["run_id", "path", "line"])
    return shown.withWatermark(at, within).dropDuplicatesWithinWatermark(["run_id", "path", "line"])
