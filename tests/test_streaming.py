"""Streams in many small batches against the same result over all rows, and the size of their state."""

import os
import random

import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tracewell.operators import runs
from tracewell.streaming import feeds
from tracewell.streaming.state import KeyedState, cooldown_available


def in_batches(spark, folder, frames, schema):
    """One file per batch, delivered in this order."""
    os.makedirs(folder)
    for i, frame in enumerate(frames):
        pq.write_table(spark.createDataFrame(frame, schema).toArrow(), f"{folder}/{i:03d}.parquet")
        os.utime(f"{folder}/{i:03d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_finished_and_idle_keys_leave_the_state(spark, tmp_path):
    """Twelve batches of three runs each; one run ends in each, and one event comes long after its run left."""
    schema = "run_id int, at long, done boolean"
    frames = [[(3 * i + r, 100 * i + r, r == 0) for r in range(3)] for i in range(12)]
    frames[9].append((1, 5, False))
    stream = in_batches(spark, f"{tmp_path}/in", frames, schema)
    parts = {"n": ("sum", F.lit(1).cast("long")), "first": ("min", F.col("at")), "last": ("max", F.col("at")), "done": ("max", F.col("done"))}
    state = KeyedState(stream, f"{tmp_path}/out", ["run_id"], parts, F.col("at"), feeds.idle("last", 150))
    sizes, fold = [], state._fold

    def watched(batch, number):
        fold(batch, number)
        fold(batch, number)  # a repeated batch replaces itself
        sizes.append(state.open_rows(spark).count())

    state._fold = watched
    state.drain()
    want = {}
    for run, at, done in (row for frame in frames for row in frame):
        n, first, last, was = want.get(run, (0, at, at, False))
        want[run] = (n + 1, min(first, at), max(last, at), was or done)
    assert {r.run_id: (r.n, r.first, r.last, r.done) for r in state.rows(spark).collect()} == want
    assert len(sizes) == 12 and max(sizes) <= 9


def test_nothing_streamed(spark, tmp_path):
    stream = in_batches(spark, f"{tmp_path}/in", [], "k int, at long")
    state = KeyedState(stream, f"{tmp_path}/out", ["k"], {"n": ("sum", F.lit(1))}, F.col("at"), feeds.idle("n", 1)).drain()
    assert state.rows(spark).collect() == [] and state.open_rows(spark).collect() == []


def test_cooldown_stream_accepts_what_the_batch_accepts(spark, tmp_path):
    rnd = random.Random(1)
    events = sorted((rnd.randrange(600), i, rnd.choice(["a", "a", "b", None])) for i in range(120))
    rows = [(i, user, at) for at, i, user in events]
    schema = "event_id int, user string, at long"
    stream = in_batches(spark, f"{tmp_path}/in", [rows[i:i + 30] for i in range(0, 120, 30)] + [[(500, "a", 10), (501, "c", 2000)]], schema)
    cooldown_available(stream, f"{tmp_path}/out", "user", "event_id", F.col("at"), 50, 20)
    got = {r.event_id for r in spark.read.parquet(f"{tmp_path}/out/sink").collect()}
    every = spark.createDataFrame([r for r in rows if r[1]] + [(501, "c", 2000)], schema)
    assert got == {r.event_id for r in runs.cooldown_accept(every, "user", "event_id", F.col("at"), 50, 200).collect()}
    # every other cooldown is long over, and the late event is neither accepted nor kept
    held = spark.read.parquet(f"{tmp_path}/out/state/batch=4").filter("user is not null").collect()
    assert [(r.user, r._t) for r in held] == [("c", 2000)]


def test_waits_belong_to_failed_attempts(spark, tmp_path):
    """Three streams in two joins; an attempt whose outcome comes beyond the bound stays without one."""
    at = lambda minutes: pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=minutes)
    row = lambda kind, ident, minutes, status=None, wait=None: (kind, ident, at(minutes).to_pydatetime(), status, wait)
    frames = [
        [row("sent", 1, 0), row("sent", 2, 1), row("sent", 3, 2), row("sent", 4, 3)],
        [row("resolved", 1, 2, "failed"), row("resolved", 2, 3, "response_received"), row("wait", 1, 4, wait=700), row("wait", 2, 4, wait=900)],
        [row("resolved", 3, 30, "failed"), row("wait", 3, 31, wait=50)],
    ] + [[row("sent", 9 + i, m), row("resolved", 9 + i, m + 1, "failed"), row("wait", 9 + i, m + 2, wait=1)] for i, m in enumerate((200, 400, 600))]
    # later events of all three streams move the watermark
    live = in_batches(spark, f"{tmp_path}/in", frames, "kind string, id int, at timestamp, status string, wait_ms long")
    sent = live.filter("kind = 'sent'").select(F.col("id").alias("request_id"), F.lit(1).alias("run_id"), F.col("at").alias("sent_at"))
    resolved = live.filter("kind = 'resolved'").select(F.col("id").alias("answer_to"), "status", F.col("at").alias("resolved_at"))
    waits = live.filter("kind = 'wait'").select(F.col("id").alias("wait_of"), "wait_ms", F.col("at").alias("waited_at"))
    feeds.append_available(feeds.pair_stream(sent, resolved, "10 minutes", waits), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = {r.request_id: (r.status, r.wait_ms) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert {k: got.get(k) for k in (1, 2, 3, 4)} == {1: ("failed", 700), 2: ("response_received", None), 3: (None, None), 4: (None, None)}


def test_seen_lines_are_forgotten(spark, tmp_path):
    at = lambda minutes: (pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=minutes)).to_pydatetime()
    frames = [[(1, "p", 1, at(0)), (1, "p", 1, at(1)), (1, "p", 2, at(1))], [(1, "p", 1, at(5))], [(2, "p", 1, at(300))], [(2, "p", 1, at(300))], [(1, "p", 2, at(301))]]
    live = in_batches(spark, f"{tmp_path}/in", frames, "run_id int, path string, line int, at timestamp")
    feeds.append_available(feeds.seen_lines(live, "at", "10 minutes"), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = spark.read.parquet(f"{tmp_path}/out").select("run_id", "path", "line").collect()
    assert sorted(r[:] for r in got) == [(1, "p", 1), (1, "p", 2), (1, "p", 2), (2, "p", 1)]
