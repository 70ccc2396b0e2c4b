"""Run-log queries: one run per user of the event table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracewell.operators import evaluation, runs
from tracewell.plans.registry import query
from tracewell.session import ensure_checkpoint_dir
from tracewell.sources.files import read_artifact, write_artifact, write_tombstones
from tracewell.views import with_views


def r2(micros: str) -> str:
    """SQL: microseconds as milliseconds, rounded half-even to two places."""
    return f"(({micros}) // 10 + CASE WHEN ({micros}) % 10 > 5 OR (({micros}) % 10 = 5 AND (({micros}) // 10) % 2 = 1) THEN 1 ELSE 0 END) / 100.0"


def _txt(*cols):
    return F.concat(*[F.lit(c) if isinstance(c, str) else c.cast("string") for c in cols])


@query("flt01_project_event_payload", with_views("run_events") + """SELECT sequence, event_type, CASE WHEN event_type = 'model.started' THEN '{}' ELSE concat('{"k":"', k, '"}') END AS payload FROM run_events WHERE event_type IN ('run.started', 'model.started', 'tool.requested')""")
def flt01(t):
    allowed = t.spark.createDataFrame([("run.started", ["k"]), ("model.started", ["step"]), ("tool.requested", ["k", "name"])], "event_type string, keys array<string>")
    return runs.project_event_payload(t.run_events, allowed).select("sequence", "event_type", "payload")


@query("flt02_visible_request", """SELECT conv_id, turn, CAST(to_json({'model': concat('m', conv_id % 3), 'messages': [{'role': role, 'content': text}], 'max_tokens': turn + 10}) AS VARCHAR) AS visible FROM conversations""")
def flt02(t):
    message = F.struct("role", F.col("text").alias("content"), F.col("text").alias("reasoning_content"))
    hidden = F.struct(F.lit("x").alias("role"), F.lit("y").alias("content"), F.lit("z").alias("reasoning_content"), F.lit("reasoning").alias("type"))
    raw = F.to_json(F.struct(_txt("m", F.col("conv_id") % 3).alias("model"), F.array(F.struct(message["role"].alias("role"), message["content"].alias("content"), message["reasoning_content"].alias("reasoning_content"), F.lit(None).cast("string").alias("type")), hidden).alias("messages"),
                             (F.col("turn") + 10).alias("max_tokens"), F.lit("secret").alias("api_key")))
    return t.conversations.select("conv_id", "turn", runs.visible_request(raw).alias("visible"))


@query("flt02_visible_response", """SELECT conv_id, turn, CAST(to_json({'id': concat('r', turn), 'status': 'completed', 'choices': [{'finish_reason': 'stop', 'message': {'role': role, 'content': text}}]}) AS VARCHAR) AS visible FROM conversations""")
def flt02_response(t):
    message = F.struct("role", F.col("text").alias("content"), F.col("text").alias("thinking"))
    raw = F.to_json(F.struct(_txt("r", F.col("turn")).alias("id"), F.lit("completed").alias("status"), F.array(F.struct(F.lit("stop").alias("finish_reason"), message.alias("message"))).alias("choices"), F.lit("hidden").alias("provider_items")))
    return t.conversations.select("conv_id", "turn", runs.visible_response(raw).alias("visible"))


_PAGES = """pg AS (SELECT doc_id, concat('{"kind":"', CASE WHEN doc_id % 5 = 0 THEN 'other' ELSE 'static_security_evidence' END, '","view":"', CASE WHEN doc_id % 2 = 0 THEN 'detail' ELSE 'groups' END, '","id":"e', doc_id, '","section":"flow","offset":', doc_id % 7, ',"items":[{"id":"a', doc_id, '","kind":"path_group"},{"id":"b', doc_id, '","kind":"route"}]}') AS body FROM documents)"""


@query("flt13_extract_references", "WITH " + _PAGES + """ SELECT doc_id, concat('e', doc_id) AS id, 'section_page' AS representation, 'flow' AS section, CAST(doc_id % 7 AS INT) AS "offset", sha256(body) AS body_sha256 FROM pg WHERE doc_id % 5 <> 0 AND doc_id % 2 = 0
 UNION ALL SELECT doc_id, concat('a', doc_id), 'family_summary', NULL, NULL, sha256(body) FROM pg WHERE doc_id % 5 <> 0 AND doc_id % 2 = 1 UNION ALL SELECT doc_id, concat('b', doc_id), 'route_navigation', NULL, NULL, sha256(body) FROM pg WHERE doc_id % 5 <> 0 AND doc_id % 2 = 1""")
def flt13(t):
    d = F.col("doc_id")
    body = _txt('{"kind":"', F.when(d % 5 == 0, "other").otherwise("static_security_evidence"), '","view":"', F.when(d % 2 == 0, "detail").otherwise("groups"), '","id":"e', d, '","section":"flow","offset":', d % 7,
                ',"items":[{"id":"a', d, '","kind":"path_group"},{"id":"b', d, '","kind":"route"}]}')
    return runs.extract_references(t.documents.select("doc_id", body.alias("body")), ["doc_id"], "body")


def _log(t):
    k, kind = F.col("k"), F.col("event_type")
    tool = kind == "tool.requested"
    return t.run_events.select("run_id", "sequence", "event_type", "created_at", "k", k.alias("chars"), F.when(k % 5 == 0, "report").otherwise("investigate").alias("phase"), _txt("m", k % 3).alias("model"),
                               F.when(tool, k % 4).alias("compacted"), F.when(tool, k % 7).alias("omitted"))


@query("agg12_run_metrics", with_views("run_events") + """SELECT run_id, count(*) AS events, count(*) FILTER (WHERE event_type = 'model.started') AS model_requests, count(*) FILTER (WHERE event_type = 'tool.requested') AS tool_calls, count(*) FILTER (WHERE event_type = 'run.failed') AS failures,
 CAST(coalesce(sum(k) FILTER (WHERE event_type = 'model.started'), 0) AS BIGINT) AS request_characters, CAST(coalesce(sum(k) FILTER (WHERE event_type = 'model.completed'), 0) AS BIGINT) AS response_characters, count(*) FILTER (WHERE event_type = 'model.started' AND k % 5 = 0) AS report_requests,
 count(DISTINCT CASE WHEN event_type = 'model.completed' THEN k % 3 END) AS actual_models, CAST(coalesce(sum(CASE WHEN event_type = 'tool.requested' THEN k % 4 END), 0) AS BIGINT) AS observation_compactions, coalesce(max(CASE WHEN event_type = 'tool.requested' THEN k % 7 END), 0) AS max_omitted FROM run_events GROUP BY run_id""")
def agg12(t):
    return runs.run_metrics(_log(t))


@query("agg12_run_metric_counts", with_views("run_events") + """SELECT run_id, section, key, count(*) AS n FROM (SELECT run_id, 'phase' AS section, CASE WHEN k % 5 = 0 THEN 'report' WHEN k % 5 = 1 THEN 'unknown' ELSE 'investigate' END AS key FROM run_events WHERE event_type = 'model.started'
 UNION ALL SELECT run_id, 'model', concat('m', k % 3) FROM run_events WHERE event_type = 'model.completed' UNION ALL SELECT run_id, 'finish', CASE WHEN k % 4 = 0 THEN 'stop' WHEN k % 4 = 1 THEN 'incomplete' ELSE 'unknown' END FROM run_events WHERE event_type = 'model.completed'
 UNION ALL SELECT run_id, 'format', CASE k % 3 WHEN 0 THEN 'retry' WHEN 1 THEN concat('rejected:r', k % 2) ELSE 'skipped' END FROM run_events WHERE event_type = 'run.failed') x GROUP BY ALL""")
def agg12_counts(t):
    k, kind = F.col("k"), F.col("event_type")
    form = F.when(k % 3 == 0, "report.format.retry").when(k % 3 == 1, "report.format.rejected").otherwise("report.format.skipped")
    events = t.run_events.select(
        "run_id", F.when(kind == "run.failed", form).otherwise(kind).alias("event_type"), F.when(k % 5 == 0, "report").when(k % 5 > 1, "investigate").alias("phase"), _txt("m", k % 3).alias("model"),
        F.when(k % 4 == 0, "stop").alias("finish_reason"), F.when(k % 4 == 1, "incomplete").alias("response_status"), F.when((kind == "run.failed") & (k % 3 == 1), _txt("r", k % 2)).alias("reason"))
    return runs.run_metric_counts(events)


_DUR = f"""dd AS (SELECT run_id, arg_max(epoch_us(created_at), sequence) FILTER (WHERE event_type = 'run.started') AS s, arg_max(epoch_us(created_at), sequence) FILTER (WHERE event_type = 'run.failed') AS e, min(epoch_us(created_at)) AS c FROM run_events GROUP BY run_id),
 dur AS (SELECT run_id, CASE WHEN e < s THEN 0.0 WHEN e >= s THEN {r2('e - s')} END AS duration_ms, CASE WHEN s >= c THEN {r2('s - c')} END AS queue_ms FROM dd)"""


def _durations(t):
    created = t.run_events.groupBy("run_id").agg(F.min("created_at").alias("created"))
    return runs.run_durations(t.run_events, created)


@query("agg13_run_durations", with_views("run_events", more=_DUR) + "SELECT run_id, CAST(duration_ms AS DOUBLE) AS duration_ms, CAST(queue_ms AS DOUBLE) AS queue_ms FROM dur")
def agg13(t):
    return _durations(t)


@query("agg14_usage_status", with_views("run_events") + """SELECT run_id, count(*) AS requests, count(*) FILTER (WHERE i IS NOT NULL AND o IS NOT NULL) AS measured, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens,
 CASE WHEN count(*) FILTER (WHERE i IS NOT NULL AND o IS NOT NULL) = count(*) THEN 'complete' WHEN count(*) FILTER (WHERE i IS NOT NULL OR o IS NOT NULL) > 0 THEN 'partial' ELSE 'unavailable' END AS usage_status
 FROM (SELECT run_id, CASE WHEN k % 7 <> 0 AND run_id % 10 <> 0 THEN k END AS i, CASE WHEN k % 11 <> 0 AND run_id % 10 <> 0 THEN 2 * k END AS o FROM run_events WHERE event_type = 'model.completed') x GROUP BY run_id""")
def agg14(t):
    k, known = F.col("k"), F.col("run_id") % 10 != 0
    rows = t.run_events.filter("event_type = 'model.completed'").select("run_id", F.when(known & (k % 7 != 0), k).alias("input_tokens"), F.when(known & (k % 11 != 0), 2 * k).alias("output_tokens"))
    return runs.usage_status(rows)


@query("agg15_network_accounting", with_views("run_events", more=_DUR + """, a AS (SELECT run_id, k % 3 = 0 AND k % 5 <> 0 AS ex, CASE WHEN k % 13 <> 0 THEN k * 10 END AS el, k AS w FROM run_events WHERE event_type = 'run.failed'),
 n AS (SELECT run_id, count(*) FILTER (WHERE ex) AS z, count(*) FILTER (WHERE ex AND el IS NULL) AS u, CAST(coalesce(sum(el) FILTER (WHERE ex), 0) AS BIGINT) AS r, CAST(coalesce(sum(w) FILTER (WHERE ex), 0) AS BIGINT) AS w FROM a GROUP BY run_id)""") + """SELECT n.run_id, z AS zero_token_attempts, u AS unknown_rejection_timings, r AS excluded_request_ms, w AS excluded_wait_ms, CAST(duration_ms AS DOUBLE) AS duration_ms,
 CAST(CASE WHEN u = 0 AND r + w <= duration_ms THEN round(duration_ms - (r + w), 2) END AS DOUBLE) AS adjusted_duration_ms FROM n LEFT JOIN dur USING (run_id)""")
def agg15(t):
    k = F.col("k")
    attempts = t.run_events.filter("event_type = 'run.failed'").select(
        "run_id", F.when(k % 3 == 0, 429).when(k % 3 == 1, 500).alias("status_code"), F.when(k % 5 == 0, "Timeout").otherwise("HTTPError").alias("error_type"), F.when(k % 13 != 0, k * 10).alias("elapsed_ms"), k.alias("wait_ms"))
    return runs.network_accounting(attempts, _durations(t))


@query("agg16_wire_usage", "SELECT l_orderkey, CAST(CASE WHEN count(*) = count(i) THEN sum(i) END AS BIGINT) AS input_tokens, CAST(sum(l_suppkey) AS BIGINT) AS output_tokens FROM (SELECT *, CASE WHEN l_partkey % 7 <> 0 THEN l_linenumber END AS i FROM lineitem) x GROUP BY l_orderkey")
def agg16(t):
    rows = t.lineitem.select("l_orderkey", F.when(F.col("l_partkey") % 7 != 0, F.col("l_linenumber")).alias("input_tokens"), F.col("l_suppkey").alias("output_tokens"))
    return runs.wire_usage(rows, "l_orderkey", ["input_tokens", "output_tokens"])


@query("agg17_distinct_evidence", """WITH x AS (SELECT l_orderkey AS run_id, concat('p', l_partkey % 5) AS path, l_suppkey % 3 AS line, 's' AS symbol, 0 AS tool FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT l_orderkey, concat('p', l_partkey % 5), l_suppkey % 4, 's', 1 FROM lineitem UNION ALL SELECT l_orderkey, 'q', l_linenumber % 2, 't', 1 FROM lineitem),
 d AS (SELECT run_id, path, line, symbol, max(tool) AS tool, count(*) FILTER (WHERE tool = 0) AS n FROM x GROUP BY ALL) SELECT run_id, count(*) AS evidence_count, CAST(sum(n) AS BIGINT) AS initial_evidence_count, count(*) FILTER (WHERE tool = 1) AS tool_evidence_count FROM d GROUP BY run_id""")
def agg17(t):
    item = lambda path, line, symbol: F.struct(path.alias("path"), line.cast("long").alias("line"), F.lit(symbol).alias("symbol"))
    part, supplier = _txt("p", F.col("l_partkey") % 5), F.col("l_suppkey")
    initial = F.filter(F.array(F.when(F.col("l_linenumber") == 1, item(part, supplier % 3, "s"))), lambda x: x.isNotNull())
    rows = t.lineitem.select(F.col("l_orderkey").alias("run_id"), initial.alias("initial_evidence"), F.array(item(part, supplier % 4, "s"), item(F.lit("q"), F.col("l_linenumber") % 2, "t")).alias("tool_evidence"))
    return runs.distinct_evidence(rows)


@query("agg18_history_metrics", with_views("run_events") + "SELECT run_id, count(*) FILTER (WHERE event_type = 'tool.requested') AS tool_calls, count(DISTINCT k) AS evidence_count FROM run_events GROUP BY run_id")
def agg18(t):
    batch = t.events.select(F.col("user_id").alias("run_id")).distinct()
    return runs.history_metrics(t.run_events.withColumnRenamed("k", "evidence"), batch)


@query("agg19_budget_changed", with_views("run_events") + "SELECT run_id, arg_min(concat('c', k // 60), sequence) AS first_config, min(k // 60) <> max(k // 60) AS changed FROM run_events WHERE event_type = 'model.started' GROUP BY run_id")
def agg19(t):
    rows = t.run_events.filter("event_type = 'model.started'").select("run_id", "sequence", _txt("c", F.floor(F.col("k") / 60)).alias("config"))
    return runs.budget_changed(rows)


@query("win13_phase_timings", with_views("run_events", more="g AS (SELECT sequence, lead(epoch_us(created_at)) OVER (PARTITION BY run_id ORDER BY sequence) - epoch_us(created_at) AS us FROM run_events)") + f"SELECT sequence, CAST({r2('us')} AS DOUBLE) AS elapsed_ms FROM g")
def win13(t):
    return runs.phase_timings(t.run_events, F.floor(F.col("sequence") / 500)).select("sequence", "elapsed_ms")


_LAST = """st AS (SELECT run_id, arg_max(payload, sequence) FILTER (WHERE event_type = 'model.completed') AS ledger, arg_max(payload, sequence) FILTER (WHERE event_type = 'tool.requested') AS audit,
 coalesce(max(sequence) FILTER (WHERE event_type = 'model.started') > coalesce(max(sequence) FILTER (WHERE event_type = 'model.completed'), -1), false) AS pending FROM run_events GROUP BY run_id)"""


@query("win14_last_value_state", with_views("run_events", more=_LAST) + "SELECT * FROM st")
def win14(t):
    return runs.last_value_state(t.run_events, {"ledger": "model.completed", "audit": "tool.requested"}, "model.started", "model.completed")


@query("fn28_failure_diagnosis", with_views("run_events", more=_LAST) + """SELECT run_id, CASE WHEN k % 3 <> 1 AND k % 2 = 0 AND k % 5 < 2 THEN 'tool_finish_without_payload' END AS diagnosis FROM (SELECT run_id, CAST(json_extract_string(ledger, '$.k') AS BIGINT) AS k FROM st) x""")
def fn28(t):
    last = runs.last_value_state(t.run_events, {"ledger": "model.completed"}, "model.started", "model.completed")
    k = F.get_json_object("ledger", "$.k").cast("long")
    states = last.select("run_id", F.when(k % 3 == 1, "completed").otherwise("failed").alias("status"), (k % 2).alias("returned_tool_calls"),
                         F.when(k % 5 == 0, "tool_calls").when(k % 5 == 1, "function_call").otherwise("stop").alias("finish_reason"))
    return runs.failure_diagnosis(states).select("run_id", "diagnosis")


@query("fn36_retry_after", with_views("run_events", more="g AS (SELECT sequence, epoch_us(created_at) - lag(epoch_us(created_at)) OVER (PARTITION BY run_id ORDER BY sequence) AS us FROM run_events)") + "SELECT sequence, CASE WHEN us < 3600000000 THEN greatest(1, CAST(ceil((3600000000 - us) / 1000000.0) AS BIGINT)) END AS retry_after FROM g")
def fn36(t):
    return runs.retry_after(t.run_events, F.floor(F.col("sequence") / 500), 3600).select("sequence", "retry_after")


@query("fn37_usage_from_response", """SELECT conv_id, turn, CASE WHEN conv_id % 5 <> 0 THEN length(text) END AS input_tokens, turn AS output_tokens, CASE WHEN turn % 2 = 0 THEN turn + 1 END AS cached_input_tokens, CASE WHEN turn % 2 = 0 THEN 'stop' END AS finish_reason, CASE WHEN turn % 2 = 1 THEN 'completed' END AS response_status, turn % 2 = 1 AND conv_id % 3 = 0 AS refused FROM conversations""")
def fn37(t):
    size = F.when(F.col("conv_id") % 5 == 0, F.lit(-1)).otherwise(F.length("text"))
    chat = F.to_json(F.struct(F.struct(size.alias("prompt_tokens"), F.col("turn").alias("completion_tokens"), F.struct((F.col("turn") + 1).alias("cached_tokens")).alias("prompt_tokens_details")).alias("usage"),
                              F.array(F.struct(F.lit("stop").alias("finish_reason"), F.struct(F.col("text").alias("content")).alias("message"))).alias("choices")))
    kind = F.when(F.col("conv_id") % 3 == 0, "refusal").otherwise("output_text")
    other = F.to_json(F.struct(F.struct(size.alias("input_tokens"), F.col("turn").alias("output_tokens")).alias("usage"), F.lit("completed").alias("status"),
                               F.array(F.struct(F.lit("message").alias("type"), F.array(F.struct(kind.alias("type"))).alias("content"))).alias("output")))
    parsed = t.conversations.select("conv_id", "turn", runs.usage_from_response(F.when(F.col("turn") % 2 == 0, chat).otherwise(other)).alias("u"))
    return parsed.select("conv_id", "turn", "u.input_tokens", "u.output_tokens", "u.cached_input_tokens", "u.finish_reason", "u.response_status", "u.refused")


@query("fn38_channel_sizes", """SELECT conv_id, turn, strlen(CAST(to_json({'role': role, 'content': text}) AS VARCHAR)) AS message_bytes, true AS has_content, CAST(length(text) AS INT) AS content_characters, false AS has_thinking FROM conversations""")
def fn38(t):
    payload = F.to_json(F.struct(F.array(F.struct(F.struct("role", F.col("text").alias("content")).alias("message"))).alias("choices")))
    rows = t.conversations.select("conv_id", "turn", F.explode(runs.channel_sizes(payload)).alias("m"))
    return rows.select("conv_id", "turn", F.col("m.message_bytes").cast("long").alias("message_bytes"), "m.has_content", "m.content_characters", "m.has_thinking")


@query("fn41_progress_percent", with_views("run_events") + "SELECT run_id, CAST(CASE WHEN tot > 0 THEN greatest(0, least(100, floor(d * 100.0 / tot + 0.5))) END AS BIGINT) AS percent FROM (SELECT run_id, count(*) FILTER (WHERE event_type = 'model.completed') AS d, count(*) FILTER (WHERE event_type = 'model.started') AS tot FROM run_events GROUP BY run_id) x")
def fn41(t):
    per = t.run_events.groupBy("run_id").agg(F.count_if(F.col("event_type") == "model.completed").alias("d"), F.count_if(F.col("event_type") == "model.started").alias("t"))
    return per.select("run_id", evaluation.progress_percent(F.col("d"), F.col("t")).cast("long").alias("percent"))


@query("fn26_assess_answer", r"""SELECT conv_id, turn, CASE WHEN text IS NULL OR NOT regexp_matches(text, '\S') OR conv_id % 4 IN (1, 2) OR turn % 3 = 1 THEN 'incomplete' WHEN turn % 3 = 0 THEN 'complete' ELSE 'unknown' END AS status FROM conversations""")
def fn26(t):
    tail = F.when(F.col("conv_id") % 4 == 1, "").otherwise("\n<!-- END -->\n")
    second = F.when(F.col("conv_id") % 4 == 2, "\n \n").otherwise("\nscope\n")
    answer = F.concat(F.lit("## Result\n"), F.coalesce("text", F.lit("")), F.lit("\n## Limits"), second, tail)
    finish = F.when(F.col("turn") % 3 == 0, "stop").when(F.col("turn") % 3 == 1, "length")
    return t.conversations.select("conv_id", "turn", runs.assess_answer(answer, finish, ["Result", "Limits"], "<!-- END -->").alias("status"))


_READS = r"""rd AS (SELECT project_id, path, line, strlen(text) AS bytes, CAST(regexp_extract(path, '/([0-9]+)\.', 1) AS BIGINT) AS doc FROM v_lines), rr AS (SELECT *, doc * 1000 + line AS seq FROM rd UNION ALL SELECT *, doc * 1000 + line + 1000000000000 FROM rd WHERE doc % 2 = 0),
 ch AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY project_id, path, line ORDER BY seq) = 1 THEN bytes ELSE 0 END AS charge FROM rr), cs AS (SELECT *, CAST(sum(charge) OVER (PARTITION BY project_id ORDER BY seq) AS BIGINT) AS charged FROM ch),
 sp AS (SELECT project_id, min(seq) AS stop FROM cs WHERE charge > 0 AND charged > 60000 GROUP BY project_id)"""


@query("win07_unique_line_allowance", with_views("v_lines", more=_READS) + "SELECT cs.project_id, seq, charged AS charged_bytes, stop IS NOT NULL AS run_stopped FROM cs LEFT JOIN sp ON sp.project_id = cs.project_id WHERE stop IS NULL OR seq < stop")
def win07(t):
    lines = t.v_files.select("project_id", "path", "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    read = lines.select("project_id", "path", (F.col("pos") + 1).alias("line"), F.octet_length("text").cast("long").alias("bytes"), "doc_id", (F.col("doc_id") * 1000 + F.col("pos") + 1).alias("seq"))
    reads = read.unionByName(read.filter("doc_id % 2 = 0").withColumn("seq", F.col("seq") + 1_000_000_000_000)).drop("doc_id")
    kept = runs.unique_line_allowance(reads, "project_id", "seq", F.floor(F.col("seq") / 20_000), 60_000)
    return kept.select("project_id", "seq", F.col("charged_bytes").cast("long").alias("charged_bytes"), "run_stopped")


_ROUNDS = """rd AS (SELECT conv_id, turn, strlen(text) AS full_size, least(strlen(text), 30 + strlen(text) // 4) AS floor_size, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations),
 g AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS rn, CAST(1500 AS BIGINT) AS room, CAST(-1 AS BIGINT) AS turn, CAST(0 AS BIGINT) AS size, false AS kept, false AS compacted FROM rd UNION ALL
 SELECT g.conv_id, r.rn, CASE WHEN full_size <= room THEN room - full_size WHEN floor_size <= room THEN 0 ELSE room END, r.turn, CASE WHEN full_size <= room THEN full_size ELSE room END, floor_size <= room, full_size > room FROM g JOIN rd r ON r.conv_id = g.conv_id AND r.rn = g.rn + 1)"""


@query("win09_latest_first_window", "WITH RECURSIVE " + _ROUNDS + " SELECT conv_id, turn, size, compacted FROM g WHERE kept")
def win09(t):
    size = F.octet_length("text").cast("long")
    rounds = t.conversations.select("conv_id", "turn", size.alias("full_size"), F.least(size, 30 + F.floor(size / 4)).alias("floor_size"))
    kept = runs.latest_first_window(rounds, "conv_id", "turn", 1500)
    return kept.select("conv_id", "turn", F.col("size").cast("long").alias("size"), "compacted")


@query("win11_compact_text", """WITH l AS (SELECT conv_id, turn, string_split(text, chr(10)) AS ls FROM conversations), n AS (SELECT conv_id, turn, ls, coalesce(list_max(list_filter(range(1, len(ls) + 1), lambda i: list_sum(list_transform(ls[1:i], lambda s: length(s) + 1)) <= 300)), 0) AS k FROM l)
 SELECT conv_id, turn, CAST(k AS INT) AS kept_lines, CAST(len(ls) - k AS INT) AS omitted_lines, CAST(CASE WHEN len(ls) > k THEN k + 1 END AS INT) AS next_start_line, array_to_string(ls[1:k], chr(10)) AS compacted FROM n""")
def win11(t):
    return runs.compact_text(t.conversations.select("conv_id", "turn", "text"), "text", 300).drop("text")


@query("join28_missing_jobs", "SELECT o_orderkey AS run_id FROM orders WHERE o_orderstatus = 'O' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')")
def join28(t):
    return runs.missing_jobs(t.orders.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status")), t.lineitem.filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("run_id")), ["O"]).select("run_id")


@query("join29_run_history", "SELECT o_orderkey AS run_id, 'default' AS strategy FROM orders WHERE NOT (o_orderkey % 2 = 0 AND o_orderpriority <> '1-URGENT') ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def join29(t):
    history = t.orders.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("created_at"))
    jobs = t.orders.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "default").otherwise("graph").alias("strategy"))
    return runs.run_history(history, jobs, 50).select("run_id", "strategy")


@query("join30_comparison_history", """SELECT o_orderkey AS comparison_id, a.c_mktsegment AS baseline_status, b.c_mktsegment AS graph_status, r.q AS preferred_lane, r.q IS NOT NULL AS reviewed FROM orders LEFT JOIN customer a ON a.c_custkey = o_custkey LEFT JOIN customer b ON b.c_custkey = o_orderkey % 2000 LEFT JOIN (SELECT doc_id, min(quality) AS q FROM labels GROUP BY doc_id) r ON r.doc_id = o_orderkey""")
def join30(t):
    comparisons = t.orders.select(F.col("o_orderkey").alias("comparison_id"), F.col("o_custkey").alias("baseline_run_id"), (F.col("o_orderkey") % 2000).alias("graph_run_id"))
    reviews = t.labels.select(F.col("doc_id").alias("comparison_id"), F.col("quality").alias("preferred_lane"))
    return runs.comparison_history(comparisons, t.customer.select(F.col("c_custkey").alias("run_id"), F.col("c_mktsegment").alias("status")), reviews).select("comparison_id", "baseline_status", "graph_status", "preferred_lane", "reviewed")


_CITED = """mani AS (SELECT path, max(line) AS lines FROM v_lines GROUP BY path), ct AS (SELECT concat(path, '#', line) AS answer_id, path AS real, line, CASE line % 7 WHEN 1 THEN regexp_replace(path, '^[^/]+/', '') WHEN 2 THEN concat('/', path) WHEN 3 THEN concat('zz/', path) WHEN 6 THEN regexp_replace(path, '^.*/', '') ELSE path END AS cited_path,
 line AS start_line, CASE line % 7 WHEN 4 THEN line + 9999 WHEN 5 THEN line - 1 ELSE line + line % 2 END AS end_line FROM v_lines),
 sh AS (SELECT path, line, line % 2 = 0 AS final FROM v_lines WHERE line % 3 <> 0),
 vd AS (SELECT ct.*, mani.lines, CASE line % 7 WHEN 2 THEN 'path_outside_snapshot' WHEN 3 THEN 'path_not_in_snapshot' WHEN 5 THEN 'invalid_line_range' END AS early, (SELECT count(*) FROM sh WHERE sh.path = ct.real AND sh.line BETWEEN start_line AND end_line) AS seen, (SELECT count(*) FROM sh WHERE sh.path = ct.real AND sh.final AND sh.line BETWEEN start_line AND end_line) AS fin FROM ct JOIN mani ON mani.path = ct.real),
 rs AS (SELECT *, coalesce(early, CASE WHEN end_line > lines THEN 'line_out_of_range' WHEN seen < end_line - start_line + 1 THEN 'source_not_shown' END) AS reason FROM vd)"""


@query("join31_check_citations", with_views("v_lines", more=_CITED) + """SELECT answer_id, cited_path, start_line, end_line, CASE WHEN line % 7 NOT IN (2, 3) THEN real END AS path, line % 7 IN (1, 6) AS abbreviated, reason, CASE WHEN reason IS NULL THEN CASE WHEN fin = end_line - start_line + 1 THEN 'final_request' ELSE 'earlier_request' END END AS exposure FROM rs""")
def join31(t):
    line, path = F.col("line"), F.col("path")
    cited = F.when(line % 7 == 1, F.regexp_replace(path, "^[^/]+/", "")).when(line % 7 == 2, F.concat(F.lit("/"), path)).when(line % 7 == 3, F.concat(F.lit("zz/"), path)).when(line % 7 == 6, F.regexp_replace(path, "^.*/", "")).otherwise(path)
    end = F.when(line % 7 == 4, line + 9999).when(line % 7 == 5, line - 1).otherwise(line + line % 2)
    citations = t.v_lines.select(F.concat_ws("#", path, line.cast("string")).alias("answer_id"), cited.alias("cited_path"), line.cast("long").alias("start_line"), end.cast("long").alias("end_line"))
    manifest = t.v_lines.groupBy("path").agg(F.max("line").alias("lines"))
    shown = t.v_lines.filter("line % 3 <> 0").select("path", F.col("line").cast("long").alias("line"), (line % 2 == 0).alias("final"))
    return evaluation.check_citations(citations, manifest, shown, "answer_id")


@query("join31_citation_receipts", with_views("v_lines", more=_CITED) + """SELECT answer_id, cited_path, start_line, end_line, r AS request_id, exposure = 'earlier_request' AS notice FROM (SELECT answer_id, real, cited_path, start_line, end_line, CASE WHEN fin = end_line - start_line + 1 THEN 'final_request' ELSE 'earlier_request' END AS exposure FROM rs WHERE reason IS NULL) a
 JOIN (SELECT DISTINCT path, line, line % 2 AS r FROM sh UNION SELECT path, line, 7 FROM sh WHERE line % 5 = 0) q ON q.path = a.real AND q.line BETWEEN start_line AND end_line GROUP BY ALL""")
def join31_receipts(t):
    """Requests 0 and 1 showed the even and odd lines, request 7 every fifth one again."""
    checked = join31(t)
    line = F.col("line").cast("long")
    base = t.v_lines.filter("line % 3 <> 0")
    shown = base.select("path", line.alias("line"), (line % 2).alias("request_id")).unionByName(base.filter("line % 5 = 0").select("path", line.alias("line"), F.lit(7).cast("long").alias("request_id")))
    return evaluation.citation_receipts(checked, shown, "answer_id")


_SHOWN = r"""ln AS (SELECT path, line, strlen(text) AS bytes, CAST(regexp_extract(path, '/([0-9]+)\.', 1) AS BIGINT) AS doc FROM v_lines), rq AS (SELECT conv_id, turn, unnest(range(turn * 2 + 1, turn * 2 + 5)) AS line FROM conversations WHERE turn % 3 <> 2)"""


@query("join32_shown_coverage", with_views("v_lines", more=_SHOWN) + "SELECT run_id, count(*) AS lines_shown, CAST(sum(bytes) AS BIGINT) AS bytes_shown, round(sum(bytes) / (SELECT sum(bytes) FROM ln), 6) AS share FROM (SELECT DISTINCT conv_id AS run_id, path, ln.line, bytes FROM rq JOIN ln ON ln.doc = conv_id AND ln.line = rq.line) x GROUP BY run_id")
def join32(t):
    lines = t.v_lines.select("path", "line", F.octet_length("text").cast("long").alias("bytes"))
    paths = t.v_files.select(F.col("doc_id").alias("conv_id"), "path")
    turns = t.conversations.select("conv_id", "turn", (F.col("conv_id") * 100 + F.col("turn")).alias("request_id"))
    first = (F.col("turn") * 2 + 1).cast("int")
    requests = turns.join(paths, "conv_id").select(F.col("conv_id").alias("run_id"), "request_id", "path", F.explode(F.sequence(first, first + 3)).alias("line"))
    return runs.shown_coverage(requests, turns.filter("turn % 3 <> 2"), lines)


_LANES = """m AS (SELECT run_id, CASE WHEN run_id % 7 = 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN run_id % 11 = 0 THEN 'unknown' ELSE 'complete' END AS answer, concat('c', run_id % 20 // 10) AS contract, min(k) AS win, max(k) // 50 AS budget, CASE WHEN run_id % 3 = 0 THEN 'p' END AS pol, count(DISTINCT k % 2) AS models, concat('m', min(k % 2)) AS model FROM run_events GROUP BY run_id),
 pr AS (SELECT DISTINCT run_id // 2 AS pair_id, run_id // 2 * 2 AS l, run_id // 2 * 2 + 1 AS r FROM run_events)"""


@query("join39_compare_lanes", with_views("run_events", more=_LANES) + """SELECT pair_id, concat_ws(',', CASE WHEN NOT coalesce(a.status = 'completed' AND b.status = 'completed', false) THEN 'not_completed' END, CASE WHEN a.answer <> 'complete' OR b.answer <> 'complete' THEN 'answer_incomplete' END, CASE WHEN a.contract IS DISTINCT FROM b.contract THEN 'contract_differs' END,
 CASE WHEN a.win IS DISTINCT FROM b.win THEN 'window_differs' END, CASE WHEN a.budget IS DISTINCT FROM b.budget THEN 'budget_differs' END, CASE WHEN a.pol IS DISTINCT FROM b.pol THEN 'policy_differs' END, CASE WHEN a.model IS NOT NULL AND b.model IS NOT NULL AND (a.model <> b.model OR a.models <> 1 OR b.models <> 1) THEN 'model_differs' END) AS warnings FROM pr LEFT JOIN m a ON a.run_id = l LEFT JOIN m b ON b.run_id = r""")
def join39(t):
    run, k = F.col("run_id"), F.col("k")
    metrics = t.run_events.groupBy("run_id").agg(F.min("k").alias("window"), F.floor(F.max("k") / 50).alias("budget"), F.countDistinct(k % 2).alias("models"), _txt("m", F.min(k % 2)).alias("model"))
    metrics = metrics.select("run_id", F.when(run % 7 == 0, "failed").otherwise("completed").alias("status"), F.when(run % 11 == 0, "unknown").otherwise("complete").alias("answer"), _txt("c", F.floor(run % 20 / 10)).alias("contract"),
                             "window", "budget", F.when(run % 3 == 0, "p").alias("policy"), "models", "model")
    pairs = t.events.select(F.floor(F.col("user_id") / 2).alias("pair_id")).distinct().select("pair_id", (F.col("pair_id") * 2).alias("left_run"), (F.col("pair_id") * 2 + 1).alias("right_run"))
    return runs.compare_lanes(pairs, metrics).select("pair_id", "warnings")


@query("join40_snapshot_fallback", with_views("run_events") + """SELECT r.run_id, coalesce(e.p, c.p) AS snapshot, CASE WHEN e.p IS NOT NULL THEN 'event' WHEN c.p IS NOT NULL THEN 'manifest' ELSE 'unavailable' END AS origin FROM (SELECT DISTINCT run_id FROM run_events) r LEFT JOIN (SELECT run_id, arg_min(payload, sequence) AS p FROM run_events WHERE event_type = 'run.started' AND k < 4 GROUP BY run_id) e USING (run_id) LEFT JOIN (SELECT run_id, arg_min(payload, sequence) AS p FROM run_events WHERE event_type = 'model.completed' AND k > 90 GROUP BY run_id) c USING (run_id)""")
def join40(t):
    records = t.run_events.filter("event_type = 'model.completed' and k > 90").select("run_id", F.col("sequence").alias("record_id"), "payload")
    return runs.snapshot_fallback(t.run_events.filter("event_type = 'run.started' and k < 4"), records, t.run_events)


@query("join41_stale_operations", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'remove_operation' WHEN o_orderkey % 7 = 0 THEN 'fail_identity_mismatch' WHEN o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN 'remove_operation_and_project' ELSE 'remove_operation' END AS action FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'""")
def join41(t):
    key = F.col("o_orderkey")
    operations = t.orders.select("o_orderkey", F.col("o_custkey").alias("project_id"), F.col("o_orderdate").alias("modified"), F.lit("me").alias("owner"), F.when(key % 5 == 0, None).when(key % 7 == 0, "you").otherwise("me").alias("journal_owner"))
    projects = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("project_id"))
    return runs.stale_operations(operations, projects, F.lit("1999-01-01 00:00:00").cast("timestamp"), 0).select("o_orderkey", "action")


@query("set08_dependents", """WITH o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)) SELECT 'run' AS "table", CAST(o_orderkey AS VARCHAR) AS id FROM o UNION ALL SELECT 'event', concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)""")
def set08(t):
    roots = t.customer.filter("c_nationkey = 3").select(F.col("c_custkey").alias("id"))
    event = F.concat_ws("/", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    return runs.dependents(roots, [("run", t.orders, "o_custkey", "o_orderkey"), ("event", t.lineitem.withColumn("event_id", event), "l_orderkey", "event_id")])


@query("srt06_recent", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 500")
def srt06(t):
    return runs.recent(t.orders, "o_orderdate", "o_orderkey", 500).select("o_orderkey")


@query("srt07_next_queued", "SELECT o_orderpriority AS queue, arg_min(o_orderkey, o_orderdate * 1) AS task_id FROM (SELECT o_orderpriority, o_orderkey, epoch_us(o_orderdate) * 1000000::HUGEINT + o_orderkey AS o_orderdate FROM orders WHERE o_orderstatus = 'P' AND o_custkey % 4 <> 0) x GROUP BY 1")
def srt07(t):
    tasks = t.orders.select(F.col("o_orderpriority").alias("queue"), F.col("o_orderkey").alias("task_id"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "P", "queued").otherwise("done").alias("status"), (F.col("o_custkey") % 4 == 0).alias("cancelled"))
    return runs.next_queued(tasks, ["queue"]).select("queue", "task_id")


@query("agg34_audit_reservation", "SELECT CAST(sum(strlen(text)) AS BIGINT) AS reserved, sum(strlen(text)) + 1000 <= 1073741824 AS fits FROM conversations")
def agg34(t):
    return runs.audit_reservation(t.conversations.select(F.octet_length("text").cast("long").alias("reserved")), 1024**3, 1000)


@query("agg35_prompt_comparison", """WITH l AS (SELECT user_id // 2 AS experiment, user_id % 2 AS lane, sha256(CAST(max(event_type) AS VARCHAR)) AS prompt FROM events GROUP BY ALL), p AS (SELECT experiment, count(prompt) AS n, min(prompt) AS a, max(prompt) AS b FROM l GROUP BY experiment)
 SELECT count(*) AS experiments, count(*) FILTER (WHERE n <> 2 OR a <> b) AS unsound, CASE WHEN count(*) FILTER (WHERE n <> 2 OR a <> b) > 0 THEN 'missing_or_inconsistent' WHEN min(a) = max(a) THEN 'same_prompt' ELSE 'different_prompts' END AS verdict FROM p""")
def agg35(t):
    lanes = t.events.groupBy(F.floor(F.col("user_id") / 2).alias("experiment"), (F.col("user_id") % 2).alias("lane")).agg(F.sha2(F.max("event_type"), 256).alias("prompt"))
    return runs.prompt_comparison(lanes)


@query("st03_expire_leases", with_views("run_events") + "SELECT run_id, CASE WHEN epoch_us(TIMESTAMP '2024-01-31 12:00:00') - max(epoch_us(created_at)) > 7200000000 THEN 'failed' ELSE 'running' END AS status FROM run_events GROUP BY run_id")
def st03(t):
    return runs.expire_leases(t.run_events, F.lit("2024-01-31 12:00:00").cast("timestamp"), 7200)


@query("st05_pair_requests", """WITH s AS (SELECT event_id AS request_id, user_id AS run_id, CAST(event_id % 4 AS INT) AS attempt FROM events WHERE event_type = 'view'), r AS (SELECT event_id // 3 * 3 AS request_id, CASE event_type WHEN 'click' THEN 'response_received' ELSE 'failed' END AS status, event_id AS sequence FROM events WHERE event_type IN ('click', 'error')),
 f AS (SELECT request_id, arg_min(status, sequence) AS status, min(sequence) AS resolved_at FROM r GROUP BY request_id), w AS (SELECT user_id AS run_id, CAST(event_id % 4 AS INT) AS attempt, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS wait_ms FROM events WHERE event_type = 'signup' GROUP BY ALL)
 SELECT request_id, s.run_id, s.attempt, coalesce(f.status, 'pending') AS status, resolved_at, CASE WHEN f.status = 'failed' THEN wait_ms END AS wait_ms FROM s LEFT JOIN f USING (request_id) LEFT JOIN w ON w.run_id = s.run_id AND w.attempt = s.attempt""")
def st05(t):
    e = t.events
    sent = e.filter("event_type = 'view'").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("run_id"), (F.col("event_id") % 4).cast("int").alias("attempt"))
    resolved = e.filter("event_type in ('click', 'error')").select((F.floor(F.col("event_id") / 3) * 3).alias("request_id"), F.when(F.col("event_type") == "click", "response_received").otherwise("failed").alias("status"), F.col("event_id").alias("sequence"))
    waits = e.filter("event_type = 'signup'").select(F.col("user_id").alias("run_id"), (F.col("event_id") % 4).cast("int").alias("attempt"), F.get_json_object("props", "$.k").cast("long").alias("wait_ms"))
    return runs.pair_requests(sent, resolved, waits).select("request_id", "run_id", "attempt", "status", "resolved_at", "wait_ms")


COOL = """ev AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
 g AS (SELECT user_id, event_id, rn, t AS last_t, true AS ok FROM ev WHERE rn = 1 UNION ALL SELECT e.user_id, e.event_id, e.rn, CASE WHEN e.t - g.last_t >= 86400000000 THEN e.t ELSE g.last_t END, e.t - g.last_t >= 86400000000 FROM g JOIN ev e ON e.user_id = g.user_id AND e.rn = g.rn + 1)"""


@query("st07_cooldown", "WITH RECURSIVE " + COOL + " SELECT user_id, event_id FROM g WHERE ok")
def st07(t):
    day = 86_400_000_000
    return runs.cooldown_accept(t.events, "user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")), day, 4 * day)


_RETENTION = "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' AND o_orderpriority <> '1-URGENT' AND o_orderdate < TIMESTAMP '1999-01-01' THEN NULL ELSE o_totalprice END AS body, CASE WHEN o_orderstatus <> 'O' AND o_orderpriority <> '1-URGENT' AND o_orderdate < TIMESTAMP '1999-01-01' THEN 'expired' ELSE o_orderstatus END AS status FROM orders"


def _sessions(t):
    return t.orders.select("o_orderkey", F.col("o_totalprice").alias("body"), F.col("o_orderstatus").alias("status"), (F.col("o_orderpriority") == "1-URGENT").alias("protected"), (F.col("o_orderstatus") != "O").alias("terminal"), F.col("o_orderdate").alias("expires_at"))


@query("st08_expire_retention", _RETENTION)
def st08(t):
    return runs.expire_retention(_sessions(t), F.lit("1999-01-01 00:00:00").cast("timestamp")).select("o_orderkey", "body", "status")


@query("st08_stored_tombstones", _RETENTION)
def st08_stored(t):
    """The same in place: sessions stored by month, the months with expired ones rewritten, read back."""
    folder, now = f"{ensure_checkpoint_dir(t.spark)}/sessions-{uuid.uuid4().hex}", F.lit("1999-01-01 00:00:00").cast("timestamp")
    write_artifact(_sessions(t).withColumn("month", F.date_format("expires_at", "yyyyMM").cast("int")).hint("rebalance", "month"), folder, "month")
    write_tombstones(t.spark, folder, "month", now)
    return read_artifact(t.spark, folder).select("o_orderkey", "body", "status")
