"""Streaming queries: the event table as a file stream, drained, then compared with the same result from SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.plans.registry import query
from tracewell.plans.runs import COOL
from tracewell.streaming import feeds
from tracewell.streaming.state import KeyedState, cooldown_available
from tracewell.views import Tables, with_views


_HOUR = 3_600_000_000


class _Stream(Tables):
    """The same tables and views, read as streams."""

    def __getattr__(self, name):
        if name.startswith("_"):
            raise AttributeError(name)
        schema = self.spark.read.parquet(f"{self.folder}/{name}.parquet").schema
        return feeds.table_stream(self.spark, self.folder, name, schema)


def _live(t):
    return _Stream(t.spark, t.folder)


def _kinds(events):
    """Some failures become completions and cancel requests, so that every state occurs."""
    k = F.col("k")
    kind = F.when((F.col("event_type") == "run.failed") & (k % 5 != 0), F.when(k % 5 == 1, "run.completed").when(k % 5 == 2, "run.cancel_requested").otherwise("note")).otherwise(F.col("event_type"))
    return events.withColumn("event_type", kind)


@query("st01_tail_events", with_views("run_events") + "SELECT run_id, sequence, event_type, event_type = 'run.failed' AS ends_run FROM run_events")
def st01(t):
    """Two drains with one checkpoint: the second finds nothing new, so nothing is delivered twice."""
    folder = feeds.scratch(t.spark, "tail")
    for _ in range(2):
        feed = feeds.tail_events(_live(t).run_events.select("run_id", "sequence", "event_type"))
        feeds.append_available(feed, f"{folder}/sink", f"{folder}/checkpoint")
    return t.spark.read.parquet(f"{folder}/sink")


_STATE = """ev AS (SELECT run_id, sequence, CASE WHEN event_type = 'run.failed' AND k % 5 <> 0 THEN CASE k % 5 WHEN 1 THEN 'run.completed' WHEN 2 THEN 'run.cancel_requested' ELSE 'note' END ELSE event_type END AS e FROM run_events),
 pr AS (SELECT run_id, min(sequence) FILTER (WHERE e = 'run.started') AS s, min(sequence) FILTER (WHERE e = 'run.cancel_requested') AS c, arg_min(e, sequence) FILTER (WHERE e IN ('run.completed', 'run.failed', 'run.cancelled')) AS t FROM ev GROUP BY run_id)"""


@query("st02_run_state", with_views("run_events", more=_STATE) + "SELECT run_id, CASE WHEN c IS NOT NULL AND (s IS NULL OR c < s) THEN 'cancelled' WHEN t IS NOT NULL THEN string_split(t, '.')[2] WHEN s IS NOT NULL THEN 'running' ELSE 'queued' END AS status, c IS NOT NULL AND NOT (s IS NULL OR c < s) AS cancel_requested FROM pr")
def st02(t):
    folder = feeds.scratch(t.spark, "state")
    state = KeyedState(_kinds(_live(t).run_events), folder, ["run_id"], feeds.run_state_parts(), feeds.event_micros(), feeds.idle("last_at", _HOUR, F.col("terminal").isNotNull()))
    return feeds.run_state(state.drain().rows(t.spark))


@query("st03_expire_leases_stream", with_views("run_events") + "SELECT run_id, CASE WHEN epoch_us(TIMESTAMP '2024-01-31 12:00:00') - max(epoch_us(created_at)) > 7200000000 THEN 'failed' ELSE 'running' END AS status FROM run_events GROUP BY run_id")
def st03_stream(t):
    folder = feeds.scratch(t.spark, "lease")
    state = KeyedState(_live(t).run_events, folder, ["run_id"], {"last_heartbeat": ("max", feeds.event_micros())}, feeds.event_micros(), feeds.idle("last_heartbeat", 2 * _HOUR))
    now = F.unix_micros(F.lit("2024-01-31 12:00:00").cast("timestamp"))
    last = state.drain().rows(t.spark)
    return last.select("run_id", F.when(now - F.col("last_heartbeat") > 7_200_000_000, "failed").otherwise("running").alias("status"))


_PROGRESS = """pg AS (SELECT run_id, run_id * 10 + sequence % 7 AS request_id, sequence, event_type AS stage, CASE event_type WHEN 'run.failed' THEN 'failed' WHEN 'tool.requested' THEN 'completed' WHEN 'run.started' THEN 'pending' ELSE 'running' END AS status, k AS done, epoch_us(created_at) AS at_us FROM run_events),
 en AS (SELECT run_id, request_id, arg_max(stage, sequence) AS stage, arg_max(status, sequence) AS status, arg_max(done, sequence) AS done, min(at_us) AS a, max(at_us) AS b FROM pg GROUP BY ALL), nw AS (SELECT epoch_us(TIMESTAMP '2024-01-30 00:00:00') AS now_us),
 al AS (SELECT en.*, now_us FROM en, nw WHERE status = 'running' OR now_us - b < 86400000000)"""


def _progress(t):
    folder = feeds.scratch(t.spark, "progress")
    kind = F.col("event_type")
    status = F.when(kind == "run.failed", "failed").when(kind == "tool.requested", "completed").when(kind == "run.started", "pending").otherwise("running")
    updates = _live(t).run_events.select("run_id", (F.col("run_id") * 10 + F.col("sequence") % 7).alias("request_id"), "sequence", "created_at", kind.alias("stage"), status.alias("status"), F.col("k").alias("done"))
    state = KeyedState(updates, folder, ["run_id", "request_id"], feeds.progress_parts(), feeds.event_micros(), feeds.idle("updated_at", 24 * _HOUR, F.col("newest.status") != "running"))
    entries = state.drain().rows(t.spark).select("run_id", "request_id", "newest.stage", "newest.status", "newest.done", "started_at", "updated_at")
    return feeds.progress_snapshot(entries, F.lit("2024-01-30 00:00:00").cast("timestamp"), 86_400)


@query("st04_progress_registry", with_views("run_events", more=_PROGRESS) + "SELECT run_id, request_id, stage, status, done, round((CASE WHEN status IN ('completed', 'failed') THEN b ELSE now_us END - a) / 1000000, 1) AS elapsed_s FROM al")
def st04(t):
    return _progress(t)


@query("st04_admission", with_views("run_events", more=_PROGRESS) + "SELECT run_id, count(*) FILTER (WHERE status IN ('pending', 'running')) AS active, count(*) FILTER (WHERE status IN ('pending', 'running')) < 5 AND (SELECT count(*) FROM al) < 1000000 AS may_create FROM al GROUP BY run_id")
def st04_admission(t):
    return feeds.admission(_progress(t), "run_id", 5, 1_000_000)


@query("st05_pair_requests_stream", """WITH s AS (SELECT event_id AS request_id, user_id AS run_id, ts FROM events WHERE event_type = 'view'), r AS (SELECT event_id - 1 AS a, ts, CASE event_type WHEN 'click' THEN 'response_received' ELSE 'failed' END AS status FROM events WHERE event_type IN ('click', 'error'))
 SELECT request_id, run_id, coalesce(status, 'pending') AS status FROM s LEFT JOIN r ON a = request_id AND r.ts >= s.ts AND r.ts <= s.ts + INTERVAL 10 MINUTE""")
def st05_stream(t):
    """Stream-stream outer join with a ten-minute bound, drained."""
    folder = feeds.scratch(t.spark, "pairs")
    live = _live(t).events
    sent = lambda e: e.filter("event_type = 'view'").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("sent_at"))
    resolved = live.filter("event_type in ('click', 'error')").select((F.col("event_id") - 1).alias("answer_to"), F.when(F.col("event_type") == "click", "response_received").otherwise("failed").alias("status"), F.col("ts").cast("timestamp").alias("resolved_at"))
    feeds.append_available(feeds.pair_stream(sent(live), resolved, "10 minutes"), f"{folder}/sink", f"{folder}/checkpoint")
    return feeds.drain_pending(t.spark.read.parquet(f"{folder}/sink"), sent(t.events))


@query("st06_incremental_run_metrics", with_views("run_events") + """SELECT run_id, count(*) AS events, count(*) FILTER (WHERE event_type = 'model.started') AS model_requests, count(*) FILTER (WHERE event_type = 'tool.requested') AS tool_calls, count(*) FILTER (WHERE event_type = 'run.failed') AS failures,
 CAST(coalesce(sum(k) FILTER (WHERE event_type = 'model.started'), 0) AS BIGINT) AS request_characters, CAST(coalesce(sum(k) FILTER (WHERE event_type = 'model.completed'), 0) AS BIGINT) AS response_characters, max(sequence) AS last_sequence FROM run_events GROUP BY run_id""")
def st06(t):
    folder = feeds.scratch(t.spark, "metrics")
    state = KeyedState(_live(t).run_events, folder, ["run_id"], feeds.metric_parts(), feeds.event_micros(), feeds.idle("last_at", 24 * _HOUR))
    return state.drain().rows(t.spark).drop("last_at")


@query("st07_cooldown_stream", "WITH RECURSIVE " + COOL + " SELECT user_id, event_id FROM g WHERE ok")
def st07_stream(t):
    """The events table as a stream: the state holds the last accepted event of each user for a day."""
    folder = feeds.scratch(t.spark, "cooldown")
    cooldown_available(_live(t).events, folder, "user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")), 24 * _HOUR, _HOUR)
    return t.spark.read.parquet(f"{folder}/sink").select("user_id", "event_id")


@query("st09_accumulate_seen_lines", """WITH x AS (SELECT conv_id, turn, unnest(range(turn * 2, turn * 2 + 5)) AS line FROM conversations), m AS (SELECT conv_id, max(turn) AS last_turn FROM conversations GROUP BY conv_id)
 SELECT x.conv_id AS run_id, concat('src/', x.conv_id) AS path, line, bool_or(turn = last_turn) AS in_last_request FROM x JOIN m ON m.conv_id = x.conv_id GROUP BY ALL""")
def st09(t):
    folder = feeds.scratch(t.spark, "seen")
    shown = lambda c: c.select(F.col("conv_id").alias("run_id"), "turn", F.concat(F.lit("src/"), F.col("conv_id").cast("string")).alias("path"), F.explode(F.sequence(F.col("turn") * 2, F.col("turn") * 2 + 4)).alias("line"))
    feeds.append_available(feeds.seen_lines(shown(_live(t).conversations)).select("run_id", "path", "line"), f"{folder}/sink", f"{folder}/checkpoint")
    last = t.conversations.groupBy(F.col("conv_id").alias("run_id")).agg(F.max("turn").alias("turn"))
    final = shown(t.conversations).join(last, ["run_id", "turn"], "left_semi").select("run_id", "path", "line", F.lit(True).alias("_final"))
    return t.spark.read.parquet(f"{folder}/sink").join(final, ["run_id", "path", "line"], "left").select("run_id", "path", "line", F.coalesce("_final", F.lit(False)).alias("in_last_request"))
