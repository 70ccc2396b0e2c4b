"""Run logs: event projection, metrics, durations, usage, pairing, windows over rounds, leases."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.json_rows import shown_requests, shown_responses
from tracewell.operators.fixpoint import NotConverged
from tracewell.operators.skew import prefix_sums, with_neighbour
from tracewell.session import pin

TERMINAL = ("run.completed", "run.failed", "run.cancelled")


def active_tasks(tasks: DataFrame, owner: str, states: Sequence[str]) -> DataFrame:
    """Tasks in a non-terminal state per owner."""
    return tasks.filter(F.col("status").isin(*states)).groupBy(owner).agg(F.count("*").alias("active"))


def project_event_payload(events: DataFrame, allowed: DataFrame) -> DataFrame:
    """Events of known types with only the payload keys that their type allows (event_type, keys)."""
    known = events.join(allowed, "event_type").withColumn("_p", F.from_json("payload", "map<string,string>"))
    kept = F.map_filter("_p", lambda k, v: F.array_contains(F.col("keys"), k))
    return known.withColumn("payload", F.to_json(kept)).drop("_p", "keys")


def run_metrics(events: DataFrame) -> DataFrame:
    """One pass over the log: counts per event kind, character sums, phases, models and observation windows per run.

    ``events``: run_id, sequence, event_type, chars, phase, model, compacted, omitted.
    """
    kind = lambda name: F.col("event_type") == name
    total = lambda name, value: F.coalesce(F.sum(F.when(kind(name), F.col(value))), F.lit(0))
    return events.groupBy("run_id").agg(
        F.count("*").alias("events"), F.count_if(kind("model.started")).alias("model_requests"), F.count_if(kind("tool.requested")).alias("tool_calls"),
        F.count_if(kind("run.failed")).alias("failures"), total("model.started", "chars").alias("request_characters"), total("model.completed", "chars").alias("response_characters"),
        F.count_if(kind("model.started") & (F.col("phase") == "report")).alias("report_requests"), F.countDistinct(F.when(kind("model.completed"), F.col("model"))).alias("actual_models"),
        F.coalesce(F.sum("compacted"), F.lit(0)).alias("observation_compactions"), F.coalesce(F.max("omitted"), F.lit(0)).alias("max_omitted"),
    )


def run_metric_counts(events: DataFrame) -> DataFrame:
    """Counters of a run whose keys are open: (run_id, section, key, n), one row per key that occurs.

    Sections: phase (requests by phase), model (completions by model that answered), finish (completions
    by how they ended), format (retries, rejections with their reason, and skips). ``events``: run_id,
    event_type, phase, model, finish_reason, response_status, reason.
    """
    kind = F.col("event_type")
    entry = lambda cond, section, key: F.when(cond & key.isNotNull(), F.struct(F.lit(section).alias("section"), key.alias("key")))
    done = kind == "model.completed"
    action = F.element_at(F.split(kind, r"\."), -1)
    reason = F.concat(action, F.coalesce(F.concat(F.lit(":"), F.col("reason")), F.lit("")))
    entries = F.array_compact(F.array(
        entry(kind == "model.started", "phase", F.coalesce("phase", F.lit("unknown"))), entry(done, "model", F.col("model")),
        entry(done, "finish", F.coalesce("finish_reason", "response_status", F.lit("unknown"))), entry(kind.startswith("report.format."), "format", reason),
    ))
    return events.select("run_id", F.explode(entries).alias("e")).groupBy("run_id", "e.section", "e.key").agg(F.count("*").alias("n"))


def run_durations(events: DataFrame, created: DataFrame) -> DataFrame:
    """Last start to last terminal event, and creation to that start, in milliseconds; never below zero.

    ``created``: run_id, created. Timestamps are compared in microseconds.
    """
    started = F.col("event_type") == "run.started"
    ended = F.col("event_type").isin(*TERMINAL)
    micros = F.unix_micros(F.col("created_at").cast("timestamp"))
    per = events.groupBy("run_id").agg(
        F.max_by(F.when(started, micros), F.when(started, F.col("sequence"))).alias("_s"), F.max_by(F.when(ended, micros), F.when(ended, F.col("sequence"))).alias("_e"))
    joined = per.join(created.select("run_id", F.unix_micros(F.col("created").cast("timestamp")).alias("_c")), "run_id", "left")
    span = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.greatest(F.lit(0.0), F.bround((F.col(b) - F.col(a)) / 1000, 2)))
    return joined.select("run_id", span("_s", "_e").alias("duration_ms"), span("_c", "_s").alias("queue_ms"))


def usage_status(usage: DataFrame, key: str = "run_id") -> DataFrame:
    """complete when every request has both counts, partial when anything is known, else unavailable; sums stay null when unknown.

    ``usage``: one row per request with input_tokens and output_tokens.
    """
    both = F.col("input_tokens").isNotNull() & F.col("output_tokens").isNotNull()
    any_known = F.col("input_tokens").isNotNull() | F.col("output_tokens").isNotNull()
    return usage.groupBy(key).agg(
        F.count("*").alias("requests"), F.count_if(both).alias("measured"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count_if(any_known).alias("_any"),
    ).withColumn("usage_status", F.when(F.col("measured") == F.col("requests"), "complete").when(F.col("_any") > 0, "partial").otherwise("unavailable")).drop("_any")


def network_accounting(attempts: DataFrame, durations: DataFrame, confirmed: Sequence[int] = (429,)) -> DataFrame:
    """Confirmed rejections before the model ran: attempts, excluded request and wait time, unknown timings.

    ``attempts``: run_id, status_code, error_type, elapsed_ms, wait_ms, waited_completely. The adjusted
    duration is given only when the excluded time is fully known and lies within the run.
    """
    excluded = F.coalesce(F.col("status_code").isin(*confirmed) & (F.col("error_type") == "HTTPError"), F.lit(False))
    usable = F.col("elapsed_ms").isNotNull() & (F.col("elapsed_ms") >= 0)
    per = attempts.groupBy("run_id").agg(
        F.count_if(excluded).alias("zero_token_attempts"), F.count_if(excluded & ~F.coalesce(usable, F.lit(False))).alias("unknown_rejection_timings"),
        F.coalesce(F.sum(F.when(excluded & usable, F.col("elapsed_ms"))), F.lit(0)).alias("excluded_request_ms"),
        F.coalesce(F.sum(F.when(excluded & (F.col("wait_ms") >= 0), F.col("wait_ms"))), F.lit(0)).alias("excluded_wait_ms"),
    ).join(durations.select("run_id", "duration_ms"), "run_id", "left")
    spent = F.col("excluded_request_ms") + F.col("excluded_wait_ms")
    sound = (F.col("unknown_rejection_timings") == 0) & (spent <= F.col("duration_ms"))
    return per.withColumn("adjusted_duration_ms", F.when(sound, F.bround(F.col("duration_ms") - spent, 2)))


def wire_usage(attempts: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Field totals per key; a single unknown attempt makes the total unknown."""
    return attempts.groupBy(key).agg(*[F.when(F.count("*") == F.count(f), F.sum(f)).alias(f) for f in fields])


def distinct_evidence(events: DataFrame) -> DataFrame:
    """Distinct (path, line, symbol) per run over the initial and the tool evidence arrays."""
    initial = F.transform("initial_evidence", lambda e: F.struct(e.alias("e"), F.lit(False).alias("tool")))
    found = F.transform("tool_evidence", lambda e: F.struct(e.alias("e"), F.lit(True).alias("tool")))
    rows = events.select("run_id", F.explode(F.concat(initial, found)).alias("x")).select("run_id", "x.e.*", "x.tool")
    keys = rows.groupBy("run_id", "path", "line", "symbol").agg(F.max("tool").alias("tool"), F.count_if(~F.col("tool")).alias("initial"))
    return keys.groupBy("run_id").agg(F.count("*").alias("evidence_count"), F.sum("initial").alias("initial_evidence_count"), F.count_if("tool").alias("tool_evidence_count"))


def history_metrics(events: DataFrame, runs: DataFrame) -> DataFrame:
    """Tool calls and distinct evidence of a batch of runs in one query."""
    part = events.join(runs.select("run_id").distinct(), "run_id", "left_semi")
    return part.groupBy("run_id").agg(F.count_if(F.col("event_type") == "tool.requested").alias("tool_calls"), F.countDistinct("evidence").alias("evidence_count"))


def budget_changed(events: DataFrame) -> DataFrame:
    """First configuration of each run and whether a later one differs (config, sequence)."""
    return events.groupBy("run_id").agg(F.min_by("config", "sequence").alias("first_config"), (F.min("config") != F.max("config")).alias("changed"))


def last_value_state(events: DataFrame, fields: dict[str, str], set_by: str, cleared_by: str) -> DataFrame:
    """Last payload per field (name -> event type), and whether a pending flag was set after it was last cleared."""
    last = [
        F.max_by(F.when(F.col("event_type") == kind, F.col("payload")), F.when(F.col("event_type") == kind, F.col("sequence"))).alias(name) for name, kind in fields.items()
    ]
    at = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("sequence")))
    per = events.groupBy("run_id").agg(*last, at(set_by).alias("_set"), at(cleared_by).alias("_clear"))
    return per.withColumn("pending", F.coalesce(F.col("_set") > F.coalesce("_clear", F.lit(-1)), F.lit(False))).drop("_set", "_clear")


def failure_diagnosis(states: DataFrame) -> DataFrame:
    """Derived class of a failed run: a tool finish without a tool call is named as such (status, tool_calls, finish_reason)."""
    empty = (F.col("status") == "failed") & (F.col("returned_tool_calls") == 0) & F.col("finish_reason").isin("tool_calls", "function_call")
    return states.withColumn("diagnosis", F.when(empty, "tool_finish_without_payload"))


def phase_timings(events: DataFrame, block: Column) -> DataFrame:
    """Milliseconds from each event of a run to the next; null for the last."""
    after = with_neighbour(events, ["run_id"], block, ["sequence"], ["created_at"], prefix="_next")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return after.withColumn("elapsed_ms", F.bround((micros(F.col("_next.created_at")) - micros(F.col("created_at"))) / 1000, 2)).drop("_next")


def retry_after(events: DataFrame, block: Column, cooldown_s: int) -> DataFrame:
    """Seconds an event would have to wait after the previous one of its run; null when none."""
    before = with_neighbour(events, ["run_id"], block, ["sequence"], ["created_at"], prefix="_prev", back=True)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    gap = micros(F.col("created_at")) - micros(F.col("_prev.created_at"))
    left = F.greatest(F.lit(1), F.ceil((F.lit(cooldown_s * 1_000_000) - gap) / 1_000_000))
    return before.withColumn("retry_after", F.when(gap < cooldown_s * 1_000_000, left)).drop("_prev")


def unique_line_allowance(reads: DataFrame, run: str, order: str, block: Column, budget: int) -> DataFrame:
    """Reads that a byte budget per run admits: each distinct (path, line) is charged at its first read; the first that does not fit ends the run."""
    first = reads.groupBy(run, "path", "line").agg(F.min(order).alias("_first"))
    marked = reads.join(first, [run, "path", "line"]).withColumn("charge", F.when(F.col(order) == F.col("_first"), F.col("bytes")).otherwise(0)).drop("_first")
    summed = prefix_sums(marked, [run], block, [order], {"charged_bytes": F.col("charge")})
    stop = summed.filter((F.col("charge") > 0) & (F.col("charged_bytes") > budget)).groupBy(run).agg(F.min(order).alias("_stop"))
    joined = summed.join(stop, run, "left")
    return joined.filter(F.col("_stop").isNull() | (F.col(order) < F.col("_stop"))).withColumn("run_stopped", F.col("_stop").isNotNull()).drop("_stop")


def latest_first_window(rounds: DataFrame, key: str, order: str, budget: int, block_width: int = 256, passes: int = 6) -> DataFrame:
    """Rounds of each conversation that a budget keeps, newest first.

    ``rounds`` has full_size and floor_size (the least a compacted round needs). Rounds are kept whole
    while they fit; the first that does not is compacted into what is left, or skipped when even its
    floor does not fit, and the search goes on with older rounds. Each pass settles all conversations
    at once with running sums over blocks, up to the next round that is skipped. What is still open
    after ``passes`` skips is read once in order, batch by batch, with the room left as only state.
    """
    pending = rounds.select(key, order, "full_size", "floor_size")
    room = pending.select(key).distinct().withColumn("_room", F.lit(budget))
    kept = []
    for _ in range(passes):
        eligible = pending.join(room, key).filter(F.col("floor_size") <= F.col("_room"))
        summed = pin(prefix_sums(eligible, [key], -F.floor(F.col(order) / block_width), [F.desc(order)], {"_sum": F.col("full_size")}))
        over = summed.filter(F.col("_sum") > F.col("_room")).groupBy(key).agg(F.max(F.struct(order, "floor_size")).alias("_o"))
        joined = summed.join(over, key, "left")
        whole = joined.filter(F.col("_o").isNull() | (F.col(order) > F.col(f"_o.{order}")))
        kept.append(whole.select(key, order, F.col("full_size").alias("size"), F.lit(False).alias("compacted")))
        spent = whole.groupBy(key).agg(F.sum("full_size").alias("_spent"))
        state = pin(over.select(key, F.col(f"_o.{order}").alias(order), F.col("_o.floor_size").alias("floor_size")).join(room, key).join(spent, key, "left").withColumn(
            "_left", F.col("_room") - F.coalesce("_spent", F.lit(0))))
        kept.append(state.filter("floor_size <= _left").select(key, order, F.col("_left").alias("size"), F.lit(True).alias("compacted")))
        open_keys = state.filter("floor_size > _left").select(key, F.col(order).alias("_cut"), F.col("_left").alias("_room"))
        if open_keys.isEmpty():
            return reduce(DataFrame.unionByName, kept)
        pending = summed.select(key, order, "full_size", "floor_size").join(open_keys.select(key, "_cut"), key).filter(F.col(order) < F.col("_cut")).drop("_cut")
        room = open_keys.select(key, F.col("_room").cast("int").alias("_room"))
    rest = pending.join(room, key).filter(F.col("floor_size") <= F.col("_room")).select(F.col(key).alias("k"), F.col(order).alias("o"), "full_size", "floor_size", F.col("_room").alias("room"))
    ordered = rest.withColumns({c: F.col(c).cast("long") for c in ("full_size", "floor_size", "room")}).repartition("k").sortWithinPartitions("k", F.desc("o"))
    kinds = {f.name: f.dataType.simpleString() for f in ordered.schema}
    taken = ordered.mapInArrow(_scan_windows, f"k {kinds['k']}, o {kinds['o']}, size long, compacted boolean")
    sizes = kept[0].schema["size"].dataType
    kept.append(taken.select(F.col("k").alias(key), F.col("o").alias(order), F.col("size").cast(sizes).alias("size"), "compacted"))
    return reduce(DataFrame.unionByName, kept)


def _scan_windows(batches):
    """Newest-first scan of sorted rounds; the state is the current conversation and its room."""
    import pyarrow as pa

    current, room = object(), 0
    for batch in batches:
        places, sizes, compacted = [], [], []
        columns = [batch.column(c).to_pylist() for c in ("k", "full_size", "floor_size", "room")]
        for place, (key, full, floor, start) in enumerate(zip(*columns)):
            if key != current:
                current, room = key, start
            if floor > room:
                continue
            places.append(place)
            sizes.append(min(full, room))
            compacted.append(full > room)
            # a compacted round takes all that is left
            room = room - full if full <= room else -1
        at = pa.array(places, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("k").take(at), batch.column("o").take(at), pa.array(sizes, pa.int64()), pa.array(compacted, pa.bool_())], names=["k", "o", "size", "compacted"])


def compact_text(rows: DataFrame, text: str, max_chars: int) -> DataFrame:
    """Whole lines of one observation while they fit, how many are left out, and where to go on."""
    lines = F.split(text, "\n")
    state = F.aggregate(lines, F.struct(F.lit(0).alias("used"), F.lit(0).alias("kept"), F.lit(True).alias("open")), lambda acc, line: F.when(
        acc["open"] & (acc["used"] + F.length(line) + 1 <= max_chars),
        F.struct((acc["used"] + F.length(line) + 1).alias("used"), (acc["kept"] + 1).alias("kept"), F.lit(True).alias("open")),
    ).otherwise(F.struct(acc["used"].alias("used"), acc["kept"].alias("kept"), F.lit(False).alias("open"))))
    work = rows.withColumn("_s", state)
    return (
        work.withColumn("kept_lines", F.col("_s.kept")).withColumn("omitted_lines", F.size(lines) - F.col("_s.kept"))
        .withColumn("next_start_line", F.when(F.col("omitted_lines") > 0, F.col("_s.kept") + 1)).withColumn("compacted", F.array_join(F.slice(lines, 1, F.col("_s.kept")), "\n")).drop("_s")
    )


def missing_jobs(runs: DataFrame, jobs: DataFrame, active: Sequence[str]) -> DataFrame:
    return runs.filter(F.col("status").isin(*active)).join(jobs.select("run_id").distinct(), "run_id", "left_anti")


def run_history(runs: DataFrame, jobs: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` newest runs with the default strategy or no job at all."""
    joined = runs.join(jobs.select("run_id", "strategy"), "run_id", "left").filter(F.col("strategy").isNull() | (F.col("strategy") == "default"))
    return joined.withColumn("strategy", F.coalesce("strategy", F.lit("default"))).orderBy(F.desc("created_at"), F.desc("run_id")).limit(max(1, limit))


def recent(rows: DataFrame, when: str, ident: str, n: int) -> DataFrame:
    """The ``n`` newest rows."""
    return rows.orderBy(F.desc(when), F.desc(ident)).limit(max(1, n))


def next_queued(tasks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Oldest queued task that was not cancelled, per queue."""
    open_tasks = tasks.filter((F.col("status") == "queued") & ~F.col("cancelled"))
    return open_tasks.groupBy(*by).agg(F.min(F.struct("created_at", "task_id")).alias("_m")).select(*by, "_m.task_id", "_m.created_at")


def comparison_history(comparisons: DataFrame, runs: DataFrame, reviews: DataFrame) -> DataFrame:
    """Comparisons with the status of both lanes and the review, if any (one per comparison)."""
    lane = lambda side: runs.select(F.col("run_id").alias(f"{side}_run_id"), F.col("status").alias(f"{side}_status"))
    review = reviews.groupBy("comparison_id").agg(F.min("preferred_lane").alias("preferred_lane"))
    joined = comparisons.join(lane("baseline"), "baseline_run_id", "left").join(lane("graph"), "graph_run_id", "left").join(review, "comparison_id", "left")
    return joined.withColumn("reviewed", F.col("preferred_lane").isNotNull())


def compare_lanes(pairs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Both lanes of each pair with the reasons why they may not be compared."""
    side = lambda p: metrics.select(*[F.col(c).alias(f"{p}_{c}") for c in metrics.columns])
    both = pairs.join(side("a"), F.col("left_run") == F.col("a_run_id"), "left").join(side("b"), F.col("right_run") == F.col("b_run_id"), "left")
    same = lambda c: F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    done = (F.col("a_status") == "completed") & (F.col("b_status") == "completed")
    known_models = F.col("a_model").isNotNull() & F.col("b_model").isNotNull()
    warnings = F.array_compact(F.array(
        F.when(~F.coalesce(done, F.lit(False)), "not_completed"), F.when(~(F.col("a_answer") == "complete") | ~(F.col("b_answer") == "complete"), "answer_incomplete"),
        F.when(~same("contract"), "contract_differs"), F.when(~same("window"), "window_differs"), F.when(~same("budget"), "budget_differs"), F.when(~same("policy"), "policy_differs"),
        F.when(known_models & ((F.col("a_model") != F.col("b_model")) | (F.col("a_models") != 1) | (F.col("b_models") != 1)), "model_differs"),
    ))
    return both.select("pair_id", F.array_join(warnings, ",").alias("warnings"), (F.size(warnings) == 0).alias("valid"))


def snapshot_fallback(events: DataFrame, records: DataFrame, runs: DataFrame) -> DataFrame:
    """First snapshot event of a run, else its first manifest record, else unavailable."""
    first = lambda df, order, value, name: df.groupBy("run_id").agg(F.min_by(value, order).alias(name))
    joined = runs.select("run_id").distinct().join(first(events, "sequence", "payload", "_e"), "run_id", "left").join(first(records, "record_id", "payload", "_r"), "run_id", "left")
    return joined.select("run_id", F.coalesce("_e", "_r").alias("snapshot"), F.when(F.col("_e").isNotNull(), "event").when(F.col("_r").isNotNull(), "manifest").otherwise("unavailable").alias("origin"))


def stale_operations(operations: DataFrame, projects: DataFrame, now: Column, max_age_s: int) -> DataFrame:
    """What to do with operations older than the limit, from the journal's identity and the project row."""
    old = operations.filter(F.unix_micros(now) - F.unix_micros(F.col("modified").cast("timestamp")) > max_age_s * 1_000_000)
    joined = old.join(projects.select("project_id", F.lit(True).alias("_has")).distinct(), "project_id", "left")
    action = (
        F.when(F.col("journal_owner").isNull(), "remove_operation").when(F.col("journal_owner") != F.col("owner"), "fail_identity_mismatch")
        .when(F.col("_has").isNull(), "remove_operation_and_project").otherwise("remove_operation")
    )
    return joined.withColumn("action", action).drop("_has")


def shown_coverage(requests: DataFrame, resolved: DataFrame, lines: DataFrame) -> DataFrame:
    """Unique lines shown in answered requests per run, their bytes and their share of the scope.

    ``requests``: run_id, request_id, path, line. ``lines``: path, line, bytes of the scope.
    """
    answered = requests.join(resolved.select("request_id").distinct(), "request_id", "left_semi").select("run_id", "path", "line").distinct()
    shown = answered.join(lines, ["path", "line"]).groupBy("run_id").agg(F.count("*").alias("lines_shown"), F.sum("bytes").alias("bytes_shown"))
    scope = lines.agg(F.sum("bytes")).scalar()
    return shown.withColumn("share", F.round(F.col("bytes_shown") / scope, 6))


def pair_requests(sent: DataFrame, resolved: DataFrame, waits: DataFrame) -> DataFrame:
    """Each send attempt with its outcome by id; open ones are pending; a retry wait belongs to the attempt it follows."""
    first = resolved.groupBy("request_id").agg(F.min_by("status", "sequence").alias("status"), F.min("sequence").alias("resolved_at"))
    wait = waits.groupBy("run_id", "attempt").agg(F.sum("wait_ms").alias("wait_ms"))
    joined = sent.join(first, "request_id", "left").join(wait, ["run_id", "attempt"], "left")
    return joined.withColumn("status", F.coalesce("status", F.lit("pending"))).withColumn("wait_ms", F.when(F.col("status") == "failed", F.col("wait_ms")))


def expire_leases(heartbeats: DataFrame, now: Column, lease_s: int) -> DataFrame:
    """Runs whose newest heartbeat is older than the lease."""
    last = heartbeats.groupBy("run_id").agg(F.max(F.unix_micros(F.col("created_at").cast("timestamp"))).alias("_last"))
    return last.withColumn("status", F.when(F.unix_micros(now) - F.col("_last") > lease_s * 1_000_000, "failed").otherwise("running")).drop("_last")


def dependents(roots: DataFrame, links: Sequence[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """Rows of dependent tables below a set of root ids: (table, id). ``links``: table, rows, parent column, id column, parents first."""
    parents, out = roots.select(F.col("id").alias("_p")).distinct(), []
    for name, rows, parent, ident in links:
        below = rows.join(parents.withColumnRenamed("_p", parent), parent, "left_semi").select(F.col(ident).alias("_p"))
        out.append(below.select(F.lit(name).alias("table"), F.col("_p").cast("string").alias("id")))
        parents = below.distinct()
    return reduce(DataFrame.unionByName, out)


def expired(now: Column) -> Column:
    """Whether a session may go: unprotected, terminal and past expiry. What is not known to be so stays."""
    return F.coalesce(~F.col("protected") & F.col("terminal") & (F.col("expires_at") < now), F.lit(False))


def expire_retention(sessions: DataFrame, now: Column) -> DataFrame:
    """Sessions with their bodies dropped where they are unprotected, terminal and past expiry; the rest unchanged."""
    gone = expired(now)
    return sessions.withColumn("body", F.when(~gone, F.col("body"))).withColumn("status", F.when(gone, "expired").otherwise(F.col("status")))


def audit_reservation(sessions: DataFrame, total_limit: int, requested: int) -> DataFrame:
    """Reserved bytes in all and whether another reservation fits."""
    return sessions.agg(F.coalesce(F.sum("reserved"), F.lit(0)).alias("reserved")).withColumn("fits", F.col("reserved") + requested <= total_limit)


def prompt_comparison(lanes: DataFrame) -> DataFrame:
    """Whether all experiments share one prompt: missing or inconsistent inside a pair beats everything (experiment, prompt)."""
    per = lanes.groupBy("experiment").agg(F.count("prompt").alias("n"), F.min("prompt").alias("a"), F.max("prompt").alias("b"))
    verdict = F.when(F.count_if((F.col("n") != 2) | (F.col("a") != F.col("b"))) > 0, "missing_or_inconsistent").when(F.min("a") == F.max("a"), "same_prompt").otherwise("different_prompts")
    return per.agg(F.count("*").alias("experiments"), F.count_if((F.col("n") != 2) | (F.col("a") != F.col("b"))).alias("unsound"), verdict.alias("verdict"))


def usage_from_response(payload: Column) -> Column:
    """Usage and finish state of a response in either protocol; only non-negative whole numbers count."""
    body = F.from_json(payload, "id string, status string, usage map<string,string>, choices array<struct<finish_reason:string,message:struct<refusal:string>>>, incomplete_details struct<reason:string>, output array<struct<type:string,content:array<struct<type:string>>>>")
    number = lambda text: F.when(text.rlike(r"^\d+$"), text).try_cast("bigint")
    both = lambda a, b: number(F.coalesce(body["usage"][a], body["usage"][b]))
    nested = lambda a, b, field: number(F.get_json_object(F.coalesce(body["usage"][a], body["usage"][b]), f"$.{field}"))
    choice = F.get(body["choices"], F.lit(0))
    refused = F.coalesce(choice["message"]["refusal"] != "", F.lit(False)) | F.coalesce(
        F.exists(body["output"], lambda o: F.coalesce(F.exists(o["content"], lambda c: F.coalesce(c["type"] == "refusal", F.lit(False))), F.lit(False))), F.lit(False))
    return F.struct(
        both("prompt_tokens", "input_tokens").alias("input_tokens"), both("completion_tokens", "output_tokens").alias("output_tokens"), number(body["usage"]["total_tokens"]).alias("total_tokens"),
        nested("prompt_tokens_details", "input_tokens_details", "cached_tokens").alias("cached_input_tokens"), nested("completion_tokens_details", "output_tokens_details", "reasoning_tokens").alias("reasoning_tokens"),
        choice["finish_reason"].alias("finish_reason"), body["status"].alias("response_status"), body["incomplete_details"]["reason"].alias("incomplete_reason"), refused.alias("refused"),
    )


def channel_sizes(payload: Column) -> Column:
    """Per message of a chat response: UTF-8 bytes and the presence and length of its text channels."""
    messages = F.transform(F.from_json(payload, "choices array<struct<message:string>>")["choices"], lambda c: c["message"])
    field = lambda m, n: F.get_json_object(m, f"$.{n}")
    return F.transform(messages, lambda m: F.struct(F.octet_length(m).alias("message_bytes"), *[
        part for n in ("content", "reasoning_content", "thinking") for part in (field(m, n).isNotNull().alias(f"has_{n}"), F.length(field(m, n)).alias(f"{n}_characters"))]))


def visible_request(payload: Column) -> Column:
    """Requests with the allowed fields only, messages, content parts and tool calls included; secrets in any string are masked."""
    return shown_requests(payload)


def visible_response(payload: Column) -> Column:
    """Responses with choices, output items, end state and usage; hidden reasoning is gone and secrets are masked."""
    return shown_responses(payload)


def extract_references(pages: DataFrame, keys: Sequence[str], body: str) -> DataFrame:
    """Evidence references of delivered tool pages: id, representation, section, offset and the hash of the page."""
    parsed = pages.select(*keys, F.col(body).alias("_b"), F.from_json(body, "kind string, view string, id string, section string, offset int, has_more boolean, items array<struct<id:string,kind:string>>").alias("p"))
    parsed = parsed.filter("p.kind = 'static_security_evidence'").withColumn("body_sha256", F.sha2("_b", 256))
    single = F.col("p.view").isin("detail", "coverage") & F.col("p.id").isNotNull()
    section = parsed.filter(single).select(*keys, F.col("p.id").alias("id"), F.lit("section_page").alias("representation"), F.coalesce("p.section", F.lit("overview")).alias("section"), F.col("p.offset").alias("offset"), "body_sha256")
    rows = parsed.filter(~single).select(*keys, F.explode("p.items").alias("i"), "body_sha256").filter("i.id is not null")
    return section.unionByName(rows.select(
        *keys, F.col("i.id").alias("id"), F.when(F.col("i.kind") == "path_group", "family_summary").otherwise("route_navigation").alias("representation"),
        F.lit(None).cast("string").alias("section"), F.lit(None).cast("int").alias("offset"), "body_sha256"))


def assess_answer(answer: Column, finish_reason: Column, sections: Sequence[str], end_mark: str) -> Column:
    """complete / incomplete / unknown from section order, non-empty sections, end mark and how the transport ended."""
    names = F.regexp_extract_all(answer, F.lit(r"(?m)^##\s+(.+?)\s*$"), F.lit(1))
    trimmed = F.regexp_replace(answer, r"\s+\z", "")
    ended = trimmed.endswith(end_mark)
    inner = F.when(ended, F.substring(trimmed, F.lit(1), F.length(trimmed) - len(end_mark))).otherwise(trimmed)
    parts = F.split(inner, r"(?m)^##\s+.+?\s*$")
    bodies = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    filled = ~F.exists(bodies, lambda b: F.trim(F.regexp_replace(b, r"\s+", "")) == "")
    whole = (names == F.array(*[F.lit(s) for s in sections])) & ended & filled
    transport = F.when(finish_reason.isin("length", "content_filter", "tool_calls", "function_call"), False).when(finish_reason == "stop", True)
    known_bad = F.coalesce(~transport, F.lit(False)) | (F.trim(answer) == "") | ~whole
    return F.when(known_bad, "incomplete").when(F.coalesce(transport, F.lit(False)), "complete").otherwise("unknown")




def cooldown_accept(events: DataFrame, key: str, order: str, at: Column, cooldown: int, block_width: int, max_rounds: int = 64) -> DataFrame:
    """Events that a per-key cooldown accepts: the first, then each first one at least a cooldown after the last accepted one.

    Every event links to the first event a cooldown later, found by an ordered merge over time blocks.
    Acceptance then spreads along these links with doubling jumps, so n accepted events need log2(n)
    rounds and no key is scanned in one task. ``at`` and the widths share one unit.
    """
    from pyspark.sql.window import Window

    rows = events.select(key, F.col(order).alias("o"), at.alias("t"))
    event = F.struct(F.col("t").alias("t"), F.col("o").alias("o"))
    points = rows.select(key, "o", "t", F.lit(1).alias("is_event")).unionByName(rows.select(key, "o", (F.col("t") + cooldown).alias("t"), F.lit(0).alias("is_event")))
    points = points.withColumn("_b", F.floor(F.col("t") / block_width)).withColumn("_e", F.when(F.col("is_event") == 1, event))
    edges = points.groupBy(key, "_b").agg(F.min("_e").alias("_edge"))
    later = Window.partitionBy(key).orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    edges = edges.select(key, "_b", F.first("_edge", ignorenulls=True).over(later).alias("_beyond"))
    inner = Window.partitionBy(key, "_b").orderBy("t", "is_event", "o").rowsBetween(0, Window.unboundedFollowing)
    linked = points.join(edges, [key, "_b"]).withColumn("_n", F.coalesce(F.first("_e", ignorenulls=True).over(inner), F.col("_beyond")))
    jump = pin(linked.filter("is_event = 0 and _n is not null").select(key, "o", F.col("_n.o").alias("to")))
    accepted = pin(rows.groupBy(key).agg(F.min(event).alias("_m")).select(key, F.col("_m.o").alias("o")))
    for _ in range(max_rounds):
        fresh = pin(accepted.join(jump, [key, "o"]).select(key, F.col("to").alias("o")).join(accepted, [key, "o"], "left_anti").distinct())
        if fresh.isEmpty():
            return accepted.withColumnRenamed("o", order)
        accepted = pin(accepted.unionByName(fresh))
        jump = pin(jump.join(jump.select(key, F.col("o").alias("to"), F.col("to").alias("_far")), [key, "to"]).select(key, "o", F.col("_far").alias("to")))
    raise NotConverged("cooldown links did not end")
