"""Identities, paths, masking, answers and usage on hand-written rows."""

import hashlib
import json

from pyspark.sql import functions as F

from tracewell.functions import ids, redact, text, verdicts
from tracewell.operators import evaluation, runs
from tracewell.sources.documents import sanitize_json_column


def column(spark, values, expr, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}").select("i", expr.alias("x")).orderBy("i")
    return [r.x for r in df.collect()]


def test_file_identity(spark):
    raw = ["./a/b.py", "a\\b.py", "././a//b.py", "a/./b/", "/x/y", "", ".", "./", "a/../b"]
    assert column(spark, raw, ids.file_id("v")) == ["a/b.py", "a/b.py", "a/b.py", "a/b", "/x/y", "", ".", "", "a/../b"]


def test_location_identity_matches_the_documented_digest(spark):
    got = column(spark, ["./p.py"], ids.location_id("v", F.lit(3), F.lit(-1), F.lit(4), F.lit(0)))[0]
    material = "\x1f".join(["p.py", "3", "0", "4", "0"])
    assert got == "location:" + hashlib.sha256(material.encode()).hexdigest()[:24]


def test_safe_paths(spark):
    raw = ["/etc/x", "C:/x", "a/../b", "..", "a\\b", " a//b ", "", None, "a..b/c"]
    assert column(spark, raw, ids.safe_relative_path("v")) == [None, None, None, None, "a/b", "a/b", None, None, "a..b/c"]


def test_positive_int(spark):
    assert column(spark, ["3", " 7 ", "0", "-2", "1.5", "x", None], ids.positive_int("v")) == [3, 7, None, None, None, None, None]


def test_masking_keeps_structure(spark):
    source = [
        'token: str = "abc"', "def f(password: str) -> None:", 'api_key = "s3cr3t"\r\nnext = 1', "secret = '''one\n  two'''", "x = sk-abcdefghijklmnop",
        "-----BEGIN PRIVATE KEY-----\nAAA\nBBB\n-----END PRIVATE KEY-----\nafter", "password=hunter2",
    ]
    got = column(spark, source, redact.redact_source("v", F.lit("a.py")))
    assert got[0] == source[0] and got[1] == source[1]
    assert got[2] == 'api_key = "[REDACTED]"\r\nnext = 1'
    assert got[3] == "secret = '''[REDACTED]\n[REDACTED]'''"
    assert got[4] == "x = [REDACTED]"
    assert got[5] == "[REDACTED]\n[REDACTED]\n[REDACTED]\n[REDACTED]\nafter"
    assert got[6] == source[6]
    assert column(spark, [source[6]], redact.redact_source("v", F.lit("conf/.env.local"))) == ["password=[REDACTED]"]
    assert column(spark, got, redact.redact_source("v", F.lit("a.py"))) == got


def test_documents_are_masked_at_any_depth(spark):
    document = {"a": [{"password": "x", "keep": 'token = "abc"'}, {"type": "reasoning", "b": 1}], "reasoning_content": "no", "deep": {"deeper": {"Secret": "s", "n": 3}}}
    got = json.loads(column(spark, [json.dumps(document)], sanitize_json_column("v"))[0])
    assert got == {"a": [{"password": "[REDACTED]", "keep": 'token = "[REDACTED]"'}], "deep": {"deeper": {"Secret": "[REDACTED]", "n": 3}}}


def test_access_paths(spark):
    raw = ["a", "a.b", 'a.b[0]["k.x"].c']
    assert column(spark, raw, text.access_parent("v")) == ["", "a", 'a.b[0]["k.x"]']
    assert column(spark, raw, F.size(text.access_segments("v"))) == [1, 2, 5]


def test_graph_scope(spark):
    raw = ["<BUILTIN>::len", "<stdlib>::os", "<external>::x", "a.py::f"]
    assert column(spark, raw, verdicts.graph_scope("v", F.lit("function"))) == ["builtin", "stdlib", "external", "project"]


def test_answer_completeness(spark):
    body = "## A\none\n## B\ntwo\nEND"
    check = lambda answer, reason: column(spark, [answer], runs.assess_answer(F.col("v"), F.lit(reason).cast("string"), ["A", "B"], "END"))[0]
    assert [check(body, "stop"), check(body, None), check(body, "length"), check(body[:-3], "stop"), check("## A\n\n## B\ntwo\nEND", "stop")] == ["complete", "unknown", "incomplete", "incomplete", "incomplete"]


def test_usage_zero_is_not_missing(spark):
    chat = {"usage": {"prompt_tokens": 123, "completion_tokens": 40, "total_tokens": 163, "prompt_tokens_details": {"cached_tokens": 0}, "completion_tokens_details": {"reasoning_tokens": 31}}, "choices": [{"finish_reason": "stop", "message": {"content": "x"}}]}
    df = spark.createDataFrame([(json.dumps(chat),), ("{}",)], "v string").select(runs.usage_from_response(F.col("v")).alias("u")).select("u.*")
    first, second = df.collect()
    assert first[:5] == (123, 40, 163, 0, 31) and not first.refused
    assert second[:5] == (None,) * 5


def test_ledger_rules(spark):
    finding = {"root_cause": "r", "behavior_status": "observed", "chain": {"status": "closed", "scope": "local_segment", "start": {"kind": "internal_parameter"}, "end": {"kind": "sensitive_operation"}},
               "impact": {"status": "established", "scope": "external"}, "unresolved_conditions": [], "status": "source_supported_risk", "exclusion_reason": ""}
    rows = [(1, json.dumps(finding)), (2, "{"), (3, json.dumps(finding | {"impact": {"status": "conditional", "scope": "local"}}))]
    got = {(r.k, r.rule) for r in evaluation.validate_ledger(spark.createDataFrame(rows, "k int, b string"), "k", "b").collect()}
    assert got == {(1, "external_impact_needs_closed_chain"), (2, "not_valid_json"), (3, "conditional_without_conditions")}


def test_masking_does_not_look_matches_up_by_text(spark):
    source = ['xtoken="""a"""\ntoken="""a"""\ntoken="""a"""', "token='''x'''\n" * 3 + "end", "-----BEGIN PRIVATE KEY-----\nA\n-----END PRIVATE KEY-----\nA\n-----BEGIN PRIVATE KEY-----\nA"]
    got = column(spark, source, redact.redact_source("v", F.lit("a.py")))
    assert got == [
        'xtoken="""a"""\ntoken="""[REDACTED]"""\ntoken="""[REDACTED]"""', "token='''[REDACTED]'''\n" * 3 + "end",
        "[REDACTED]\n[REDACTED]\n[REDACTED]\nA\n[REDACTED]\n[REDACTED]",
    ]


def test_flat_rows_build_the_same_document():
    from tracewell.functions import json_rows

    document = {"a": [1, {"b": [], "c": {}}, [[None, "x"]]], "": {"0": [True]}, "z": 1.5}
    assert json_rows.built(json_rows.flat(document)) == document
    assert json_rows.built(json_rows.flat([])) == [] and json_rows.built(json_rows.flat("s")) == "s"


def test_shown_lines_of_all_contexts(spark):
    from tracewell.sources.documents import visible_lines

    hit = lambda path, **more: {"path": path, "text": "one\ntwo", **more}
    messages = [
        {"role": "tool", "content": json.dumps({"deep": [hit("a", start_line=5, end_line=90)], "code": json.dumps(hit("fake", line=1))})},
        {"role": "tool", "content": [{"type": "text", "text": "x"}, hit("b", line=3), json.dumps(hit("c", line=4))]},
        {"type": "function_call_output", "output": "STATIC_SECURITY_EVIDENCE\n" + json.dumps([{"path": "d\\e", "text": "7:x\n8: [REDACTED]\n9:y [line exceeds the snippet budget]\n10:z"}])},
        {"role": "user", "content": "APPLICATION_BATCH_EVIDENCE\n" + json.dumps(hit("f", line=1))},
        {"role": "user", "content": "ask\n\nTRUSTED_STATIC_CONTEXT\nFULL_SOURCE_CONTEXT\n" + json.dumps(hit("g", line=2))},
        {"role": "user", "content": "ask\n\nTRUSTED_STATIC_CONTEXT\nSTATIC_SECURITY_EVIDENCE\n" + json.dumps(hit("h", line=2))},
        {"role": "user", "content": "ask\n\nTRUSTED_STATIC_CONTEXT\nother\n" + json.dumps(hit("i", line=2))},
        {"role": "user", "content": [hit("j", line=1)]}, {"role": "assistant", "content": json.dumps(hit("k", line=1))}, "text", None, {"role": "tool"}, {"role": "tool", "content": "no json"},
    ]
    rows = [(1, json.dumps({"messages": messages})), (2, None), (3, json.dumps({"input": messages[1:2]})), (4, "[]")]
    got = visible_lines(spark.createDataFrame(rows, "k int, p string"), ["k"], "p").collect()
    want = {("a", 5), ("a", 6), ("b", 3), ("c", 4), ("d/e", 7), ("d/e", 10), ("f", 1), ("g", 2), ("h", 2)}
    assert {(r.path, r.line) for r in got if r.k == 1} == want
    assert {(r.path, r.line) for r in got if r.k == 3} == {("b", 3), ("c", 4)} and not [r for r in got if r.k in (2, 4)]


def test_requests_and_responses_show_allowed_fields_only(spark):
    secret, clean = 'token = "abc"', 'token = "[REDACTED]"'
    message = {"role": "user", "content": [{"type": "text", "text": secret, "x": 1}, {"type": "image", "url": "u"}, "s"], "thinking": "t", "tool_calls": [{"id": "1", "type": "function", "function": {"name": "f", "arguments": secret, "x": 1}}, "no"]}
    shown = {"role": "user", "content": [{"type": "text", "text": clean}], "tool_calls": [{"id": "1", "type": "function", "function": {"name": "f", "arguments": clean}}]}
    request = {"model": "m", "api_key": "k", "input": [message, {"type": "reasoning", "content": "r"}, "no", {"role": "tool", "content": secret}], "tools": [{"function": {"name": "f", "password": "p"}}], "stream": True}
    response = {"id": "r", "provider_items": 1, "output": [{"type": "message", **message}, {"type": "reasoning"}, {"type": "function_call", "arguments": secret}], "incomplete_details": {"reason": "x"}, "choices": [{"finish_reason": "stop", "message": message, "x": 1}, 3], "usage": {"total_tokens": 3}}
    get = lambda value, expr: json.loads(column(spark, [json.dumps(value)], expr)[0])
    assert get(request, runs.visible_request(F.col("v"))) == {"model": "m", "input": [shown, {"role": "tool", "content": clean}], "tools": [{"function": {"name": "f", "password": "[REDACTED]"}}], "stream": True}
    assert get(response, runs.visible_response(F.col("v"))) == {"id": "r", "output": [{"type": "message", **shown}, {"type": "function_call", "arguments": clean}], "incomplete_details": {"reason": "x"}, "choices": [{"finish_reason": "stop", "message": shown}], "usage": {"total_tokens": 3}}


def test_long_quoted_secrets(spark):
    long = "x" * 200_000
    source = [f'token = "{long}" end', f"token = '{long}\\'{long}' end", f'token = "{long}', 'password: "a\'b\\"c" x', "secret = 'it\\'s \"q\"' y"]
    got = column(spark, source, redact.redact_source("v", F.lit("a.py")))
    assert got == ['token = "[REDACTED]" end', "token = '[REDACTED]' end", source[2], 'password: "[REDACTED]" x', "secret = '[REDACTED]' y"]
    from tracewell.functions.json_rows import masked

    assert [masked(x) for x in source] == got
