"""Scalar, string, JSON, array and date functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions import ids, redact, text, verdicts
from tracewell.operators import corpus
from tracewell.operators.skew import with_neighbour, with_totals
from tracewell.plans.registry import query
from tracewell.views import with_views

SHA = "substr(sha256(concat_ws(chr(31), {})), 1, 24)"
NORM = "array_to_string(list_filter(string_split(regexp_replace(replace(raw, '\\', '/'), '^(\\./)+', ''), '/'), lambda x: x NOT IN ('', '.')), '/')"
RAW = "CASE doc_id % 4 WHEN 0 THEN concat('./././', path) WHEN 1 THEN replace(path, '/', '\\') WHEN 2 THEN replace(path, '/', '//') ELSE concat('./', path, '/./') END"


def _raw_paths(t):
    path, key = F.col("path"), F.col("doc_id") % 4
    raw = (
        F.when(key == 0, F.concat(F.lit("./././"), path)).when(key == 1, F.replace(path, F.lit("/"), F.lit("\\")))
        .when(key == 2, F.replace(path, F.lit("/"), F.lit("//"))).otherwise(F.concat(F.lit("./"), path, F.lit("/./")))
    )
    return t.v_files.withColumn("raw", raw)


@query("fn01_file_id", with_views("v_files") + f"SELECT doc_id, raw, {NORM} AS file_id FROM (SELECT doc_id, {RAW} AS raw FROM v_files) t")
def fn01(t):
    return _raw_paths(t).select("doc_id", "raw", ids.file_id("raw").alias("file_id"))


@query("fn02_symbol_id", with_views("v_files") + f"SELECT doc_id, concat({NORM}, '::', lang, '::f', CAST(doc_id % 7 AS VARCHAR)) AS symbol_id FROM (SELECT doc_id, lang, {RAW} AS raw FROM v_files) t")
def fn02(t):
    name = F.concat(F.lit("f"), (F.col("doc_id") % 7).cast("string"))
    return _raw_paths(t).select("doc_id", ids.symbol_id("raw", "lang", name).alias("symbol_id"))


_LOC = SHA.format("concat('p/', CAST(l_orderkey AS VARCHAR)), CAST(l_linenumber AS VARCHAR), CAST(greatest(0, CAST(l_suppkey AS BIGINT) - 50) AS VARCHAR), CAST(l_linenumber + 1 AS VARCHAR), CAST(l_partkey % 5 AS VARCHAR)")


def _spots(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.concat(F.lit("p/"), F.col("l_orderkey").cast("string")).alias("path"),
        (F.col("l_suppkey") - 50).alias("col"), (F.col("l_linenumber") + 1).alias("end_line"), (F.col("l_partkey") % 5).alias("end_col"),
    )


@query("fn03_location_id", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat('location:', {_LOC}) AS location_id, concat('callsite:', {_LOC}) AS callsite_id FROM lineitem")
def fn03(t):
    spot = ("path", "l_linenumber", "col", "end_line", "end_col")
    return _spots(t).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                            ids.location_id(*spot).alias("location_id"), ids.callsite_id(*spot).alias("callsite_id"))


@query("fn04_declaration_id", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_suppkey > 50 AND l_partkey % 5 > 0 AND l_linenumber > 0 THEN concat('declaration:', {SHA.format("concat('o/', CAST(l_orderkey AS VARCHAR)), concat('v', CAST(l_partkey AS VARCHAR)), 'local', concat('location:', " + _LOC + ")")}) ELSE '' END AS declaration_id FROM lineitem""")
def fn04(t):
    return _spots(t).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        ids.declaration_id(F.concat(F.lit("o/"), F.col("l_orderkey").cast("string")), F.concat(F.lit("v"), F.col("l_partkey").cast("string")),
                           F.lit("local"), "path", "l_linenumber", "col", "end_line", "end_col").alias("declaration_id"))


@query("fn05_derived_ids", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
 concat('ref:', {SHA.format("CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), 'calls', l_returnflag")}) AS edge_id,
 concat('fact:', {SHA.format("concat('location:', " + _LOC + "), 'sink', l_linestatus, CAST(l_partkey AS VARCHAR), l_returnflag")}) AS fact_id,
 concat('pathgroup:', substr(sha256(concat(CAST(l_orderkey AS VARCHAR), '|', CAST(l_suppkey AS VARCHAR))), 1, 24)) AS path_group_id FROM lineitem""")
def fn05(t):
    group = F.sha2(F.concat_ws("|", F.col("l_orderkey").cast("string"), F.col("l_suppkey").cast("string")), 256)
    return (
        t.lineitem.withColumn("path", F.concat(F.lit("p/"), F.col("l_orderkey").cast("string")))
        .select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            ids.digest_id("ref:", "l_orderkey", "l_partkey", "l_suppkey", F.lit("calls"), "l_returnflag").alias("edge_id"),
            ids.fact_id(ids.location_id("path", "l_linenumber", F.col("l_suppkey") - 50, F.col("l_linenumber") + 1, F.col("l_partkey") % 5),
                        F.lit("sink"), "l_linestatus", "l_partkey", "l_returnflag").alias("fact_id"),
            F.concat(F.lit("pathgroup:"), F.substring(group, 1, 24)).alias("path_group_id"),
        ))


@query("fn06_json_digest", """SELECT s_suppkey, sha256(concat('{"key":', s_suppkey, ',"name":"', s_name, '","nation":', s_nationkey, '}')) AS digest FROM supplier""")
def fn06(t):
    return t.supplier.select("s_suppkey", ids.json_digest(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")).alias("digest"))


_BADRAW = "CASE doc_id % 6 WHEN 0 THEN concat('/', path) WHEN 1 THEN concat('C:/', path) WHEN 2 THEN concat('a/../', path) WHEN 3 THEN concat('  ./', replace(path, '/', '\\'), ' ') WHEN 4 THEN '' ELSE path END"


@query("fn07_safe_relative_path", with_views("v_files") + f"SELECT doc_id, CASE WHEN doc_id % 6 IN (0, 1, 2, 4) THEN NULL ELSE {NORM.replace('raw', 'trim(raw)')} END AS safe_path FROM (SELECT doc_id, {_BADRAW} AS raw FROM v_files) t")
def fn07(t):
    path, key = F.col("path"), F.col("doc_id") % 6
    raw = (
        F.when(key == 0, F.concat(F.lit("/"), path)).when(key == 1, F.concat(F.lit("C:/"), path)).when(key == 2, F.concat(F.lit("a/../"), path))
        .when(key == 3, F.concat(F.lit("  ./"), F.replace(path, F.lit("/"), F.lit("\\")), F.lit(" "))).when(key == 4, "").otherwise(path)
    )
    return t.v_files.select("doc_id", ids.safe_relative_path(raw).alias("safe_path"))


@query("fn08_clean_text", """SELECT page_id, substr(regexp_replace(concat('  ', url, chr(9)), '^\\s+|\\s+$', '', 'g'), 1, 30) AS clean,
 CASE WHEN regexp_extract(url, '/([0-9]+)', 1) <> '' AND CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) > 400 THEN CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) END AS positive FROM (SELECT page_id, url FROM pages) t""".replace("> 400", "> 0"))
def fn08(t):
    number = F.regexp_extract("url", r"/([0-9]+)", 1)
    return t.pages.select(
        "page_id", ids.clean_text(F.concat(F.lit("  "), "url", F.lit("\t")), 30).alias("clean"),
        ids.positive_int(F.concat(F.lit(" "), number)).alias("positive"))


@query("fn09_graph_scope", with_views("g_nodes") + "SELECT id, CASE WHEN id LIKE 'order/%' AND name LIKE '1-%' THEN 'builtin' WHEN level = 'module' THEN 'stdlib' WHEN level = 'external' THEN 'external' ELSE 'project' END AS scope FROM g_nodes")
def fn09(t):
    marked = F.when(F.col("id").startswith("order/") & F.col("name").startswith("1-"), F.concat(F.lit("<BUILTIN>"), "id")).otherwise(F.col("id"))
    level = F.when(F.col("level") == "module", "stdlib_module").otherwise(F.col("level"))
    return t.g_nodes.select("id", verdicts.graph_scope(marked, level).alias("scope"))


@query("fn10_connection_status", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
 CASE WHEN l_linestatus = 'O' AND l_linenumber = 7 THEN 'unresolved' WHEN l_returnflag = 'A' AND l_linenumber < 4 AND l_tax < 0.05 THEN 'modelled' ELSE 'possible' END AS status,
 l_returnflag = 'R' OR l_linenumber = 5 AS speculative FROM lineitem""")
def fn10(t):
    certainty = F.when((F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 7), "unresolved").when(F.col("l_returnflag") == "A", "must").otherwise("may")
    confidence = F.when(F.col("l_linenumber") < 4, "high").otherwise("medium")
    reason = F.when(F.col("l_tax") >= 0.05, "no_compiler")
    dispatch = F.when(F.col("l_returnflag") == "R", "virtual").otherwise("direct")
    method = F.when(F.col("l_linenumber") == 5, "name_heuristic").otherwise("import_binding")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        verdicts.connection_status(certainty, confidence, False, None, reason).alias("status"),
        verdicts.is_speculative(dispatch, method).alias("speculative"))


@query("fn11_normalise_certainty", """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'must' WHEN '2-HIGH' THEN 'may' ELSE 'unresolved' END AS certainty,
 CASE o_orderstatus WHEN 'F' THEN 'high' WHEN 'O' THEN 'medium' ELSE 'low' END AS confidence FROM orders""")
def fn11(t):
    raw = F.when(F.col("o_orderpriority") == "1-URGENT", "must").when(F.col("o_orderpriority") == "2-HIGH", "may").when(F.col("o_orderpriority") == "3-MEDIUM", "perhaps")
    level = F.when(F.col("o_orderstatus") == "F", "high").when(F.col("o_orderstatus") == "O", "medium").otherwise("weird")
    return t.orders.select("o_orderkey", verdicts.normalise_certainty(raw).alias("certainty"), verdicts.normalise_confidence(level).alias("confidence"))


@query("fn12_conditions_match", with_views("run_events") + """SELECT sequence, CASE WHEN k % 4 < 2 THEN NULL WHEN k % 4 = 2 AND k >= 50 THEN false ELSE event_type LIKE '%started%' END AS matched FROM run_events""")
def fn12(t):
    k = F.col("k")
    literal = T.StructType([T.StructField("literal", T.StringType()), T.StructField("is_literal", T.BooleanType())])
    cell = lambda value, known: F.struct(value.alias("literal"), known.alias("is_literal"))
    first = F.when(k < 50, "small").otherwise("large")
    # k % 4: 0 = argument is no literal, 1 = argument missing and the keywords are open, 2 = literal, 3 = default used
    arguments = F.when(k % 4 == 0, F.array(cell(F.lit(None).cast("string"), F.lit(False)))).when(k % 4 == 2, F.array(cell(first, F.lit(True)))).otherwise(
        F.array().cast(T.ArrayType(literal)))
    keywords = F.create_map(F.lit("kind"), cell(F.col("event_type"), F.lit(True)))
    cond = lambda position, keyword, operator, values, default: F.struct(
        F.lit(position).cast("int").alias("position"), F.lit(keyword).cast("string").alias("keyword"), F.lit(operator).alias("operator"),
        F.array(*[F.lit(v) for v in values]).alias("values"), F.lit(default is not None).alias("has_default"), F.lit(default).cast("string").alias("default"))
    conditions = F.array(cond(0, "size", "equals", ["small"], "small"), cond(None, "kind", "contains_any", ["started"], None))
    return t.run_events.select("sequence", verdicts.conditions_match(arguments, keywords, k % 4 == 1, conditions).alias("matched"))


@query("fn13_call_shape", """SELECT doc_id, CASE WHEN text LIKE 'A%' THEN 'literal' WHEN text LIKE 'E%' THEN 'formatted' ELSE 'dynamic' END AS query_shape,
 CASE WHEN lang = 'en' THEN true WHEN lang = 'fr' THEN false END AS shell, n_chars > 1000 AS parameter_present, CASE WHEN lang = 'de' THEN 'w' ELSE 'r' END AS file_mode,
 len(string_split(regexp_extract(text, '^[^.]*'), ',')) AS argument_count FROM documents""")
def fn13(t):
    from tracewell.operators.rules import call_shape

    arguments = F.split(F.regexp_extract("text", r"^[^.]*", 0), ",")
    first = F.when(F.col("text").startswith("A"), "'x'").when(F.col("text").startswith("E"), "f'x'").otherwise("x")
    shaped = t.documents.select(
        "doc_id",
        call_shape(
            first_text=first, first_is_literal=F.col("text").startswith("A"), arguments=arguments,
            shell_keyword=F.when(F.col("lang") == "en", "true").when(F.col("lang") == "fr", "false"),
            parameter_present=F.col("n_chars") > 1000, mode_literal=F.when(F.col("lang") == "de", "w")).alias("s"))
    return shaped.select("doc_id", "s.*")


@query("fn14_redact_source", with_views("v_files") + r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '((?i)token = )"[^"\r\n]+"', '\1"[REDACTED]"', 'g'), '\bsk-[A-Za-z0-9_-]{12,}\b', '[REDACTED]', 'g')) AS redacted,
 regexp_matches(text, 'token = "') AS had_secret FROM v_files""")
def fn14(t):
    return t.v_files.select("doc_id", F.sha2(redact.redact_source("text", "path"), 256).alias("redacted"), F.col("text").rlike('token = "').alias("had_secret"))


@query("fn15_sanitize_json", """SELECT conv_id, turn, concat('{"content":{"note":"plain"},"password":"[REDACTED]","role":"', role, '"}') AS clean FROM conversations""")
def fn15(t):
    from tracewell.sources.documents import sanitize_json_column

    raw = F.to_json(F.struct(
        F.struct(F.lit("plain").alias("note"), F.col("text").alias("reasoning_content")).alias("content"), F.col("text").alias("password"),
        F.array(F.struct(F.lit("reasoning").alias("type"), F.col("text").alias("body"))).alias("provider_items"), F.col("role")))
    return t.conversations.select("conv_id", "turn", sanitize_json_column(raw).alias("clean"))


@query("fn16_code_entrypoints", with_views("v_files") + """SELECT path, 'python_main' AS kind, 'Python module entry' AS name, 1 AS line FROM v_files WHERE lang = 'en'
 UNION ALL SELECT path, 'go_main', 'Go main', 2 FROM v_files WHERE lang = 'de'""")
def fn16(t):
    head = F.when(F.col("lang") == "en", "if __name__ == '__main__':\n").when(F.col("lang") == "de", "package main\n  func main() {\n").otherwise("")
    files = t.v_files.select("path", F.concat(head, "text").alias("text"))
    return corpus.code_entrypoints(files).select("path", "kind", "name", "line")


_DEPLOY = """SELECT doc_id, CASE lang WHEN 'en' THEN 'Dockerfile' WHEN 'fr' THEN 'Procfile' WHEN 'de' THEN 'app.service' ELSE 'compose.yml' END AS name"""


def _deploy_files(t):
    key = F.col("doc_id").cast("string")
    name = F.when(F.col("lang") == "en", "Dockerfile").when(F.col("lang") == "fr", "Procfile").when(F.col("lang") == "de", "app.service").otherwise("compose.yml")
    head = (
        F.when(F.col("lang") == "en", F.concat(F.lit('FROM base\nCMD run --id '), key, F.lit(' && echo\n\nENTRYPOINT ["serve", "all"]\n')))
        .when(F.col("lang") == "fr", F.concat(F.lit("web: gunicorn app"), key, F.lit("\nclock: tick\n")))
        .when(F.col("lang") == "de", F.concat(F.lit("[Service]\nExecStart = /usr/bin/app "), key, F.lit("\n")))
        .otherwise(F.concat(F.lit('services:\n  a:\n    command: "start '), key, F.lit('" # note\n')))
    )
    body = F.when(F.col("lang") == "fr", F.regexp_replace("text", ":", " ")).otherwise(F.col("text"))
    return t.documents.select("doc_id", F.concat(key, F.lit("/"), name).alias("path"), F.concat(head, body).alias("text"))


@query("fn17_deployment_commands", """SELECT concat(doc_id, '/Dockerfile') AS path, 'dockerfile_entrypoint' AS source_kind, 'CMD' AS label, concat('run --id ', doc_id, ' && echo') AS command, 2 AS line, 'serve' AS purpose, true AS shell_interpreted FROM documents WHERE lang = 'en'
 UNION ALL SELECT concat(doc_id, '/Dockerfile'), 'dockerfile_entrypoint', 'ENTRYPOINT', '["serve", "all"]', 3, 'serve', false FROM documents WHERE lang = 'en'
 UNION ALL SELECT concat(doc_id, '/Procfile'), 'procfile', 'web', concat('gunicorn app', doc_id), 1, 'serve', true FROM documents WHERE lang = 'fr'
 UNION ALL SELECT concat(doc_id, '/Procfile'), 'procfile', 'clock', 'tick', 2, 'worker', true FROM documents WHERE lang = 'fr'
 UNION ALL SELECT concat(doc_id, '/app.service'), 'systemd_unit', 'ExecStart', concat('/usr/bin/app ', doc_id), 2, 'serve', false FROM documents WHERE lang = 'de'
 UNION ALL SELECT concat(doc_id, '/compose.yml'), 'compose_command', 'command', concat('start ', doc_id), 3, 'serve', true FROM documents WHERE lang NOT IN ('en', 'fr', 'de')""")
def fn17(t):
    return corpus.deployment_commands(_deploy_files(t))


@query("fn18_package_scripts", """SELECT concat('p', o_orderkey, '/package.json') AS path, script, concat(script, ' ', o_orderpriority) AS command,
 CASE script WHEN 'start' THEN 'serve' WHEN 'dev' THEN 'run' WHEN 'build' THEN 'build' WHEN 'test:unit' THEN 'test' ELSE 'unknown' END AS purpose, script IN ('start', 'dev') AS is_entrypoint,
 concat('npm run ', script) AS suggested_command FROM (SELECT o_orderkey, o_orderpriority, unnest(['start', 'dev', 'build', 'test:unit', 'lint']) AS script FROM orders) t""")
def fn18(t):
    names = ("start", "dev", "build", "test:unit", "lint")
    scripts = F.create_map(*[x for n in names for x in (F.lit(n), F.concat(F.lit(n + " "), "o_orderpriority"))])
    packages = t.orders.select(F.concat(F.lit("p"), F.col("o_orderkey").cast("string"), F.lit("/package.json")).alias("path"),
                               F.to_json(F.struct(scripts.alias("scripts"))).alias("text"))
    return corpus.package_scripts(packages)


@query("fn19_command_fact", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'python|run job.py|' || o_custkey WHEN 1 THEN 'make|all|;|true' WHEN 2 THEN '/usr/bin/node|a b' ELSE '' END AS argv,
 CASE o_orderkey % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'make' WHEN 2 THEN 'node' END AS launcher, o_orderkey % 4 = 1 AS shell_interpreted FROM orders""")
def fn19(t):
    key = F.col("o_orderkey") % 4
    raw = (
        F.when(key == 0, F.concat(F.lit("python 'run job.py' "), F.col("o_custkey").cast("string"))).when(key == 1, " make all ; true")
        .when(key == 2, '["/usr/bin/node", "a b"]').otherwise("echo 'open")
    )
    return t.orders.select("o_orderkey", corpus.command_fact(raw).alias("f")).select(
        "o_orderkey", F.array_join("f.argv", "|").alias("argv"), "f.launcher", "f.shell_interpreted")


@query("fn20_line_of", """SELECT doc_id, 1 + length(substr(text, 1, CAST(n_chars // 2 AS BIGINT))) - length(replace(substr(text, 1, CAST(n_chars // 2 AS BIGINT)), chr(10), '')) AS line FROM documents""")
def fn20(t):
    return t.documents.select("doc_id", text.line_of("text", F.floor(F.col("n_chars") / 2).cast("int")).cast("long").alias("line"))


_ANSWERS = """answers AS (SELECT path, line, concat('see [', path, ':', line, '-', line + 1, '] and [', path, ':L', line, '] or [same: 12x] again [', path, ':', line, '-', line + 1, ']') AS answer FROM v_lines)"""


def _answers(t):
    n, p = F.col("line").cast("string"), F.col("path")
    both = F.concat(p, F.lit(":"), n, F.lit("-"), (F.col("line") + 1).cast("string"))
    return t.v_lines.select(
        "path", "line", F.concat(F.lit("see ["), both, F.lit("] and ["), p, F.lit(":L"), n, F.lit("] or [same: 12x] again ["), both, F.lit("]")).alias("answer"))


@query("fn21_parse_citations", with_views("v_lines", more=_ANSWERS) + """SELECT concat(path, '#', line) AS answer_id, path AS cited_path, line AS start_line, line + 1 AS end_line, false AS malformed FROM answers
 UNION ALL SELECT concat(path, '#', line), path, line, line, false FROM answers UNION ALL SELECT concat(path, '#', line), 'same: 12x', NULL, NULL, true FROM answers""")
def fn21(t):
    from tracewell.operators.evaluation import parse_citations

    answers = _answers(t).select(F.concat_ws("#", "path", F.col("line").cast("string")).alias("answer_id"), "answer")
    return parse_citations(answers, "answer_id", "answer")


@query("fn22_visible_lines", """SELECT conv_id, turn, concat('src/', conv_id, '.txt') AS path, line FROM (SELECT conv_id, turn, unnest(generate_series(CASE WHEN role = 'user' THEN turn * 10 + 1 ELSE turn + 1 END,
 CASE WHEN role = 'user' THEN turn * 10 + len(string_split(text, chr(10))) ELSE turn + 1 END)) AS line FROM conversations WHERE text <> '') t""")
def fn22(t):
    from tracewell.sources.documents import visible_lines

    path = F.concat(F.lit("src/"), F.col("conv_id").cast("string"), F.lit(".txt"))
    ranged = F.struct(path.alias("path"), F.col("text"), (F.col("turn") * 10 + 1).alias("start_line"), (F.col("turn") * 10 + 9999).alias("end_line"))
    single = F.struct(path.alias("path"), F.col("text"), (F.col("turn") + 1).alias("line"))
    shown = F.when(F.col("role") == "user", F.to_json(F.struct(F.array(ranged).alias("files")))).otherwise(F.to_json(F.struct(single.alias("hit"))))
    payload = F.to_json(F.struct(F.array(F.struct(F.lit("tool").alias("role"), shown.alias("content"))).alias("messages")))
    return visible_lines(t.conversations.select("conv_id", "turn", payload.alias("payload")), ["conv_id", "turn"], "payload")


@query("fn23_access_path", """SELECT page_id, seg AS path, len(string_split(seg, '.')) AS depth, array_to_string(list_slice(string_split(seg, '.'), 1, len(string_split(seg, '.')) - 1), '.') AS parent,
 len(string_split(seg, '.')) > 2 AND string_split(seg, '.')[1] = 'blog' AS below_blog FROM (SELECT page_id, replace(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '-', '_') AS seg FROM pages) t""")
def fn23(t):
    host = F.replace(text.url_host("url"), F.lit("-"), F.lit("_"))
    return t.pages.select("page_id", host.alias("path")).select(
        "page_id", "path", F.size(text.access_segments("path")).cast("long").alias("depth"), text.access_parent("path").alias("parent"),
        text.is_descendant(F.col("path"), F.lit("blog")).alias("below_blog"))


@query("fn24_estimate_tokens", "SELECT doc_id, strlen(text) AS utf8_tokens, CAST(ceil(n_chars / 4.0) AS BIGINT) AS legacy_tokens FROM documents")
def fn24(t):
    return t.documents.select("doc_id", text.count_tokens("text").alias("utf8_tokens"), text.count_tokens("text", "legacy").alias("legacy_tokens"))


@query("fn25_preview", r"""SELECT doc_id, CASE WHEN length(c) <= 120 THEN c ELSE concat(substr(c, 1, 119), '…') END AS preview FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS c FROM documents) t""")
def fn25(t):
    return t.documents.select("doc_id", text.preview("text").alias("preview"))


@query("fn34_display_name", with_views("v_files") + """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN string_split(path, '/')[-1] WHEN 1 THEN 'run' ELSE concat(lang, '.run') END AS display_name FROM v_files""")
def fn34(t):
    key = F.col("doc_id") % 3
    symbol = F.when(key == 0, F.col("path")).when(key == 1, F.concat("path", F.lit("::run"))).otherwise(F.concat("path", F.lit("::Outer::"), "lang", F.lit("::run")))
    return t.v_files.select("doc_id", text.display_name(symbol).alias("display_name"))


@query("fn35_value_identity", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 5 = 0 THEN concat('object:', l_orderkey, '.f') WHEN l_partkey % 5 = 1 THEN concat('value:', l_suppkey) WHEN l_partkey % 5 < 4 THEN concat('declaration:', l_suppkey, '.f[0]') ELSE concat('lexical:v', l_partkey % 9, '.f[0]') END AS identity FROM lineitem""")
def fn35(t):
    part, key = F.col("l_partkey") % 5, lambda c: F.col(c).cast("string")
    name = F.concat(F.lit("v"), (F.col("l_partkey") % 9).cast("string"), F.lit(".f[0]"))
    empty = F.create_map().cast("map<string,string>")
    slots = F.when(part == 0, F.create_map(name, F.concat(F.lit("object:"), key("l_orderkey"), F.lit(".f")))).otherwise(empty)
    explicit = F.when(part <= 1, F.create_map(name, F.concat(F.lit("value:"), key("l_suppkey")))).otherwise(empty)
    declared = F.when(part < 4, F.create_map(F.concat(F.lit("v"), (F.col("l_partkey") % 9).cast("string")), F.concat(F.lit("declaration:"), key("l_suppkey")))).otherwise(empty)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.value_identity(name, slots, explicit, declared).alias("identity"))


@query("ext04_token_counter", "SELECT doc_id, len(string_split(text, ' ')) AS tokens FROM documents")
def ext04(t):
    """A counter of one's own, registered by name."""
    text.register_counter("blanks", lambda c: F.size(F.split(c if not isinstance(c, str) else F.col(c), " ")).cast("long"))
    return t.documents.select("doc_id", text.count_tokens("text", "blanks").alias("tokens"))
