"""Rule queries: calls, accesses and functions of the tables against rule rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions.text import url_host
from tracewell.operators import rules
from tracewell.plans.registry import query
from tracewell.views import with_views

_CALLS = """calls AS (SELECT sequence AS callsite_id, CASE WHEN run_id % 2 = 0 THEN 'python' ELSE 'go' END AS language, CASE event_type WHEN 'run.started' THEN 'subprocess.run' WHEN 'model.started' THEN 'a.b.cursor.execute' WHEN 'model.completed' THEN 'os.system' WHEN 'tool.requested' THEN 'open' ELSE 'db.query' END AS name,
 CASE WHEN k % 2 = 0 THEN 'conn' ELSE '' END AS receiver_type, k % 3 = 0 AS has_header, k % 10 = 0 AS project_defined, k % 17 = 0 AS shadowed, CASE k % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'false' ELSE 'true' END AS state FROM run_events)"""


def _calls(t):
    kind, k = F.col("event_type"), F.col("k")
    name = (
        F.when(kind == "run.started", "subprocess.run").when(kind == "model.started", "a.b.cursor.execute").when(kind == "model.completed", "os.system")
        .when(kind == "tool.requested", "open").otherwise("db.query")
    )
    return t.run_events.select(
        F.col("sequence").alias("callsite_id"), F.when(F.col("run_id") % 2 == 0, "python").otherwise("go").alias("language"), name.alias("name"),
        F.col("run_id").cast("string").alias("symbol"), F.when(k % 2 == 0, "conn").otherwise("").alias("receiver_type"),
        F.when(k % 3 == 0, F.array(F.lit("stdio.h"), F.lit("x.h"))).otherwise(F.array(F.lit("x.h"))).alias("headers"), (k % 10 == 0).alias("project_defined"),
        (k % 17 == 0).alias("shadowed"), F.when(k % 4 == 0, "unknown").when(k % 4 == 1, "false").otherwise("true").alias("conditions_state"))


_RULE_SCHEMA = ("rule_id string, pack string, language string, name string, match_suffix boolean, receiver_types array<string>, required_headers array<string>, "
                "conditional boolean, fact_kind string, category string")


def call_rule_rows(spark):
    """A built-in pack as rows."""
    return spark.createDataFrame([
        ("PY-EXEC", "core/1", "python", "subprocess.run", False, [], [], True, "sink", "process_execution"),
        ("PY-SQL", "core/1", "python", "cursor.execute", True, ["conn"], [], False, "sink", "sql_execution"),
        ("PY-SYS", "core/1", "python", "system", True, [], ["stdio.h"], False, "sink", "shell_execution"),
        ("PY-QUERY", "core/1", "python", "query", False, [], [], False, "sink", "sql_execution"),
        ("GO-OPEN", "core/1", "go", "open", False, [], [], False, "source", "file_read"),
    ], _RULE_SCHEMA)


_HITS = """hits AS (SELECT callsite_id, 'PY-EXEC' AS rule_id, 'sink' AS fact_kind, 'process_execution' AS category, 'exact_name' AS basis FROM calls WHERE NOT shadowed AND language = 'python' AND name = 'subprocess.run' AND state = 'true'
 UNION ALL SELECT callsite_id, 'PY-SQL', 'sink', 'sql_execution', 'name_suffix' FROM calls WHERE NOT shadowed AND language = 'python' AND name = 'a.b.cursor.execute' AND receiver_type = 'conn'
 UNION ALL SELECT callsite_id, 'PY-SYS', 'sink', 'shell_execution', 'name_suffix' FROM calls WHERE NOT shadowed AND language = 'python' AND name = 'os.system' AND has_header AND NOT project_defined
 UNION ALL SELECT callsite_id, 'GO-OPEN', 'source', 'file_read', 'exact_name' FROM calls WHERE NOT shadowed AND language = 'go' AND name = 'open')"""


@query("join14_match_call_rules", with_views("run_events", more=_CALLS + "," + _HITS) + "SELECT * FROM hits")
def join14(t):
    hits, _ = rules.match_call_rules(_calls(t), call_rule_rows(t.spark))
    return hits.select("callsite_id", "rule_id", "fact_kind", "category", "basis")


@query("join14_rule_failures", with_views("run_events", more=_CALLS) + """SELECT callsite_id, 'api_name_shadowed' AS reason, CAST(NULL AS VARCHAR) AS rule_id FROM calls WHERE shadowed
 UNION ALL SELECT callsite_id, 'api_header_not_visible', 'PY-SYS' FROM calls WHERE NOT shadowed AND language = 'python' AND name = 'os.system' AND NOT has_header AND NOT project_defined
 UNION ALL SELECT callsite_id, 'rule_condition_unresolved', NULL FROM calls WHERE NOT shadowed AND language = 'python' AND name = 'subprocess.run' AND state = 'unknown'""")
def join14_failures(t):
    return rules.match_call_rules(_calls(t), call_rule_rows(t.spark))[1]


@query("ext01_custom_rule_pack", with_views("run_events", more=_CALLS + "," + _HITS) + "SELECT * FROM hits UNION ALL SELECT callsite_id, 'MY-QUERY', 'sink', 'custom', 'name_suffix' FROM calls WHERE NOT shadowed AND language = 'go' AND name = 'db.query'")
def ext01(t):
    """A third party adds rules by adding rows."""
    custom = t.spark.createDataFrame([("MY-QUERY", "mine/1", "go", "query", True, [], [], False, "sink", "custom")], _RULE_SCHEMA)
    hits, _ = rules.match_call_rules(_calls(t), call_rule_rows(t.spark).unionByName(custom))
    return hits.select("callsite_id", "rule_id", "fact_kind", "category", "basis")


@query("join15_match_access_rules", with_views("run_events") + """SELECT sequence AS access_id, 'ENV-READ' AS rule_id, 'source' AS fact_kind, 'environment' AS category FROM run_events WHERE event_type = 'model.started' AND k % 2 = 0 AND run_id % 2 = 0
 UNION ALL SELECT sequence, 'DOM-WRITE', 'sink', 'html_output' FROM run_events WHERE event_type = 'tool.requested' AND run_id % 2 = 1""")
def join15(t):
    k = F.col("k")
    accesses = t.run_events.select(
        F.col("sequence").alias("access_id"), F.when(F.col("run_id") % 2 == 0, "python").otherwise("javascript").alias("language"),
        F.when(F.col("event_type") == "model.started", "os.environ").when(F.col("event_type") == "tool.requested", "el.innerHTML").otherwise("x.y").alias("qualified_name"),
        F.when(k % 2 == 0, "read").otherwise("write").alias("access_kind"))
    table = t.spark.createDataFrame([
        ("ENV-READ", "python", "os.environ", ["read"], "source", "environment"), ("DOM-WRITE", "javascript", "el.innerHTML", ["write", "read"], "sink", "html_output"),
    ], "rule_id string, language string, name string, access_kinds array<string>, fact_kind string, category string")
    return rules.match_access_rules(accesses, table)


_RULE = {
    "decorator_methods": ("get", "post", "websocket"), "owner_methods": {"doGet": "get", "doPost": "post"}, "owner_suffixes": ("HttpServlet",),
    "registration_methods": {"add_get": "get"}, "dependency_suffixes": ("Depends",), "excluded_annotations": ("BackgroundTasks",),
    "annotation_categories": (("Body", "request_body"), ("Request", "request_object")), "default_category": "framework_parameter", "websocket_methods": ("websocket",),
}
_FUNCS = r"""f AS (SELECT page_id AS symbol, CASE WHEN page_id % 5 = 0 THEN 'doGet' ELSE concat('h', page_id) END AS name, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS file, regexp_extract(url, '^[a-z]+://[^/?#]+/([^?#]*)', 1) AS p FROM pages),
 r AS (SELECT symbol, CASE WHEN symbol % 3 = 0 AND file NOT LIKE 'spam%' THEN CASE WHEN symbol % 2 = 0 THEN 'websocket' ELSE 'get' END WHEN symbol % 5 = 0 THEN 'get' WHEN symbol % 4 = 1 THEN 'get' END AS method,
 CASE WHEN symbol % 3 = 0 AND file NOT LIKE 'spam%' THEN CASE WHEN symbol % 9 = 0 THEN '<dynamic>' ELSE p END WHEN symbol % 5 = 0 THEN '<container-mapped>' WHEN symbol % 4 = 1 THEN concat('/api/', p) END AS route,
 CASE WHEN symbol % 3 = 0 AND file NOT LIKE 'spam%' THEN 'decorator' WHEN symbol % 5 = 0 THEN 'owned_method' WHEN symbol % 4 = 1 THEN 'registration' END AS basis FROM f)"""


def _routes(t):
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]+/([^?#]*)", 1)
    base = t.pages.select(F.col("page_id").alias("symbol"), F.when(F.col("page_id") % 5 == 0, "doGet").otherwise(F.concat(F.lit("h"), F.col("page_id").cast("string"))).alias("name"),
                          url_host("url").alias("file"), path.alias("p"))
    key = F.col("symbol")
    functions = base.select("symbol", "name", "file", F.when(key % 5 == 0, "javax.HttpServlet").otherwise("").alias("owner_type"))
    decorators = base.filter(key % 3 == 0).select("symbol", F.lit(0).alias("position"), F.when(key % 2 == 0, "app.websocket").otherwise("app.get").alias("qualified_name"),
                                                  F.when(key % 9 != 0, F.col("p")).alias("literal"))
    registrations = base.filter(key % 4 == 1).select("file", F.lit("web.router.add_get").alias("name"), F.col("name").alias("handler"), F.col("p").alias("literal"), F.lit("/api/").alias("prefix"))
    factories = base.filter("file not like 'spam%'").select("file", F.lit("app").alias("target"))
    return functions, rules.match_entrypoints(functions, decorators, registrations, factories, _RULE)


@query("join16_match_entrypoints", "WITH " + _FUNCS + " SELECT * FROM r WHERE method IS NOT NULL")
def join16(t):
    return _routes(t)[1].select("symbol", "method", "route", "basis")


@query("join16_entrypoint_parameters", "WITH " + _FUNCS + """, p AS (SELECT symbol, 'q' AS name, CASE symbol % 4 WHEN 0 THEN 'Request' WHEN 1 THEN 'Body[x]' WHEN 2 THEN 'str' ELSE 'BackgroundTasks' END AS annotation, symbol % 7 = 0 AS dep FROM f)
 SELECT symbol, name, CASE WHEN dep THEN 'guard' ELSE 'source' END AS fact_kind, CASE WHEN dep THEN 'framework_dependency' WHEN annotation = 'Request' THEN 'request_object' WHEN annotation = 'Body[x]' THEN 'request_body' WHEN method = 'websocket' THEN 'websocket_input' ELSE 'framework_parameter' END AS category
 FROM p JOIN r USING (symbol) WHERE method IS NOT NULL AND annotation <> 'BackgroundTasks'""")
def join16_parameters(t):
    functions, routes = _routes(t)
    key = F.col("symbol")
    annotation = F.when(key % 4 == 0, "Request").when(key % 4 == 1, "Body[x]").when(key % 4 == 2, "str").otherwise("BackgroundTasks")
    default = F.when(key % 7 == 0, "fastapi.Depends").otherwise("")
    parameters = functions.select("symbol", F.explode(F.array(F.lit("self"), F.lit("q"))).alias("name"), annotation.alias("annotation"), default.alias("default_call"))
    return rules.entrypoint_parameters(routes, parameters, _RULE)


@query("join17_header_guard", with_views("run_events", more=_CALLS) + "SELECT callsite_id, CASE WHEN has_header THEN 'stdio.h' ELSE '' END AS visible_headers, CASE WHEN project_defined THEN 'project_defined' WHEN NOT has_header THEN 'api_header_not_visible' ELSE 'applies' END AS verdict FROM calls")
def join17(t):
    guarded = rules.header_guard(_calls(t), ["stdio.h", "stdlib.h"])
    return guarded.select("callsite_id", F.array_join("visible_headers", ",").alias("visible_headers"), "verdict")


def _rule_table(t):
    """Rules derived from parts: brand as pack, type as category, size as languages."""
    size = F.col("p_size")
    return t.part.select(
        F.col("p_partkey").alias("rule_id"), F.col("p_brand").alias("pack"), F.when(size % 2 == 0, F.array(F.lit("python"), F.lit("go"))).otherwise(F.array(F.lit("go"))).alias("languages"),
        F.when(size % 3 == 0, "call").when(size % 3 == 1, "access").otherwise("entrypoint").alias("rule_type"),
        F.when(size % 5 < 3, "sink").otherwise("source").alias("fact_kind"), F.col("p_type").alias("category"))


@query("src12_load_rules", "SELECT p_partkey AS rule_id, p_brand AS pack, p_type AS category FROM part WHERE p_size % 2 = 0")
def src12(t):
    return rules.load_rules(_rule_table(t), "python").select("rule_id", "pack", "category")


@query("agg07_rule_coverage", """SELECT p_brand AS pack, language, count(*) FILTER (WHERE p_size % 3 = 0) AS call_rules, count(*) FILTER (WHERE p_size % 3 = 1) AS access_rules, count(*) FILTER (WHERE p_size % 3 = 2) AS entrypoint_rules,
 count(DISTINCT CASE WHEN p_size % 5 >= 3 THEN p_type END) AS source_categories, count(DISTINCT CASE WHEN p_size % 5 < 3 THEN p_type END) AS sink_categories
 FROM (SELECT *, unnest(CASE WHEN p_size % 2 = 0 THEN ['python', 'go'] ELSE ['go'] END) AS language FROM part) x GROUP BY p_brand, language""")
def agg07(t):
    return rules.rule_coverage(_rule_table(t))


@query("fn43_check_slot_proposals", """WITH s AS (SELECT l_orderkey AS call, count(*) AS n FROM lineitem GROUP BY l_orderkey), e AS (SELECT l_orderkey AS call, l_linenumber % 4 AS component, l_linenumber AS argument, l_partkey % 9 AS cond FROM lineitem), r AS (SELECT e.*, n FROM e JOIN s USING (call))
 SELECT DISTINCT call, 'duplicate_slot' AS reason FROM (SELECT call, component FROM e GROUP BY ALL HAVING count(*) > 1) x UNION ALL SELECT DISTINCT call, 'component_out_of_range' FROM r WHERE n % 3 > 0 AND component >= n % 3
 UNION ALL SELECT DISTINCT call, 'argument_out_of_range' FROM r WHERE argument >= n UNION ALL SELECT DISTINCT call, 'condition_slot_out_of_range' FROM r WHERE cond >= n""")
def fn43(t):
    effects = t.lineitem.select(F.col("l_orderkey").alias("call"), (F.col("l_linenumber") % 4).alias("component"), F.lit("").alias("member"), F.col("l_linenumber").alias("argument"), (F.col("l_partkey") % 9).alias("condition_index"))
    per_order = t.lineitem.groupBy(F.col("l_orderkey").alias("call")).agg(F.count("*").alias("argument_count"))
    signatures = per_order.withColumn("return_count", F.when(F.col("argument_count") % 3 > 0, F.col("argument_count") % 3))
    return rules.check_slot_proposals(effects, signatures)
