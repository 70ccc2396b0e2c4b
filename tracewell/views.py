"""Stand-in views: the given tables seen as files, graphs, flow graphs, runs and facts.

``Tables`` gives the Spark form. ``with_views`` gives the same views as SQL common table
expressions, so that every query has a counterpart written without this library.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.skew import prefix_sums

EXT_OF_LANG = {"en": ".py", "fr": ".js", "de": ".go"}

VIEW_SQL: dict[str, str] = {
    "v_files": """SELECT concat(source, '/', lang, '/', CAST(doc_id AS VARCHAR(20)), CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.js' WHEN 'de' THEN '.go' ELSE '.java' END) AS path, source AS project_id, lang, text, n_chars, doc_id FROM documents""",
    "v_lines": """SELECT path, project_id, generate_subscripts(string_split(text, chr(10)), 1) AS line, unnest(string_split(text, chr(10))) AS text FROM v_files""",
    "g_nodes": """SELECT concat('region/', CAST(r_regionkey AS VARCHAR(20))) AS id, r_name AS name, 'module' AS level FROM region UNION ALL
SELECT concat('nation/', CAST(n_nationkey AS VARCHAR(20))), n_name, 'class' FROM nation UNION ALL
SELECT concat('customer/', CAST(c_custkey AS VARCHAR(20))), c_name, 'function' FROM customer UNION ALL
SELECT concat('supplier/', CAST(s_suppkey AS VARCHAR(20))), s_name, 'external' FROM supplier UNION ALL
SELECT concat('order/', CAST(o_orderkey AS VARCHAR(20))), o_orderpriority, 'method' FROM orders""",
    "g_edges": """SELECT concat('e1/', CAST(n_nationkey AS VARCHAR(20))) AS id, concat('region/', CAST(n_regionkey AS VARCHAR(20))) AS source, concat('nation/', CAST(n_nationkey AS VARCHAR(20))) AS target, 'contains' AS relation, '' AS dispatch FROM nation UNION ALL
SELECT concat('e2/', CAST(c_custkey AS VARCHAR(20))), concat('nation/', CAST(c_nationkey AS VARCHAR(20))), concat('customer/', CAST(c_custkey AS VARCHAR(20))), 'contains', '' FROM customer UNION ALL
SELECT concat('e3/', CAST(o_orderkey AS VARCHAR(20))), concat('customer/', CAST(o_custkey AS VARCHAR(20))), concat('order/', CAST(o_orderkey AS VARCHAR(20))), 'calls', 'direct' FROM orders UNION ALL
SELECT concat('e4/', CAST(l_orderkey AS VARCHAR(20)), '/', CAST(l_linenumber AS VARCHAR(20)), '/', CAST(l_partkey AS VARCHAR(20)), '/', CAST(l_suppkey AS VARCHAR(20))), concat('order/', CAST(l_orderkey AS VARCHAR(20))), concat('supplier/', CAST(l_suppkey AS VARCHAR(20))), 'calls', CASE WHEN l_returnflag = 'R' THEN 'virtual' ELSE 'direct' END FROM lineitem""",
    "g_calls": """SELECT source, target, 1 AS weight, certainty FROM (SELECT c_custkey AS source, c_custkey // 2 AS target, 'must' AS certainty FROM customer UNION ALL SELECT c_custkey, c_custkey // 3, 'may' FROM customer WHERE c_custkey // 3 <> c_custkey // 2
 UNION ALL SELECT c_custkey, c_custkey * 2, 'may' FROM customer WHERE c_custkey % 100 = 99) e WHERE source <> target AND target IN (SELECT c_custkey FROM customer)""",
    "cfg_nodes": """SELECT user_id AS fn, event_id AS node, event_type AS kind, CAST(event_id % 3 AS INT) AS var, rn FROM (
 SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) t""",
    "cfg_edges": """SELECT a.fn, a.node AS source, b.node AS target, CASE WHEN a.kind = 'signup' THEN 'true' ELSE 'normal' END AS branch FROM cfg_nodes a JOIN cfg_nodes b ON a.fn = b.fn AND b.rn = a.rn + 1 UNION ALL
SELECT a.fn, a.node, b.node, 'false' FROM cfg_nodes a JOIN cfg_nodes b ON a.fn = b.fn AND b.rn = a.rn + 2 WHERE a.kind = 'signup' UNION ALL
SELECT a.fn, a.node, b.node, 'back' FROM cfg_nodes a JOIN cfg_nodes b ON a.fn = b.fn AND b.rn = a.rn - 3 WHERE a.kind = 'error'""",
    "run_events": """SELECT user_id AS run_id, event_id AS sequence, CASE event_type WHEN 'signup' THEN 'run.started' WHEN 'view' THEN 'model.started' WHEN 'click' THEN 'model.completed' WHEN 'purchase' THEN 'tool.requested' ELSE 'run.failed' END AS event_type, ts AS created_at, value, props AS payload, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""",
    "facts": """SELECT concat('src/', c_custkey) AS fact_id, 'source' AS fact_kind, concat('customer/', c_custkey) AS symbol, c_mktsegment AS category, 'medium' AS severity, concat('mod/', c_nationkey, '.py') AS path, CAST(c_custkey % 60 + 1 AS INT) AS line, 'r1' AS rule_id FROM customer UNION ALL
SELECT concat('snk/', s_suppkey), 'sink', concat('supplier/', s_suppkey), 'supplier', CASE WHEN s_acctbal > 5000 THEN 'high' ELSE 'low' END, concat('mod/', s_nationkey, '.py'), CAST(s_suppkey % 40 + 1 AS INT), concat('r', s_suppkey % 3) FROM supplier UNION ALL
SELECT concat('grd/', o_orderkey), CASE WHEN o_orderpriority = '1-URGENT' THEN 'guard' ELSE 'sanitizer' END, concat('order/', o_orderkey), o_orderstatus, 'informational', concat('ord/', o_orderkey % 97, '.py'), CAST(o_orderkey % 80 + 1 AS INT), 'r9' FROM orders WHERE o_orderpriority = '1-URGENT' OR (o_orderpriority = '5-LOW' AND o_orderstatus = 'F')""",
    "g_paths": """SELECT source AS s, target AS t, [source, target] AS nodes, certainty AS worst, 1 AS hops FROM g_calls
  UNION ALL
  SELECT p.s, g.target, list_append(p.nodes, g.target), CASE WHEN p.worst = 'may' OR g.certainty = 'may' THEN 'may' ELSE 'must' END, p.hops + 1
  FROM g_paths p JOIN g_calls g ON g.source = p.t WHERE p.hops < 3 AND NOT list_contains(p.nodes, g.target)""",
    "candidates": """SELECT DISTINCT concat('candidate:', substr(sha256(concat_ws(chr(31), src, snk, concat(e1, ',', e2), 'structural')), 1, 24)) AS candidate_id, concat('pathgroup:', substr(sha256(concat(src, '|', snk)), 1, 24)) AS path_group_id, * FROM (
 SELECT concat('src/', c_custkey) AS src, concat('snk/', s_suppkey) AS snk, concat('customer/', c_custkey) AS s, concat('order/', o_orderkey) AS mid, concat('supplier/', s_suppkey) AS t, concat('e3/', o_orderkey) AS e1, concat('e4/', l_orderkey, '/', l_linenumber, '/', l_partkey, '/', l_suppkey) AS e2,
 CASE WHEN l_returnflag = 'R' THEN 'virtual' ELSE 'direct' END AS dispatch, CASE WHEN l_tax >= 0.08 THEN 'unresolved' WHEN l_discount >= 0.05 THEN 'may' ELSE 'must' END AS certainty, CASE WHEN s_acctbal > 5000 THEN 'high' ELSE 'low' END AS severity, c_mktsegment AS category,
 concat('mod/', s_nationkey, '.py') AS path, CAST(s_suppkey % 40 + 1 AS INT) AS line, l_linenumber AS col, CASE WHEN l_returnflag = 'A' THEN 'propagation_path' ELSE 'structural_lead' END AS kind, CASE WHEN l_linestatus = 'O' THEN 'unknown' WHEN l_linenumber = 1 THEN 'satisfiable_under_model' ELSE 'not_checked' END AS condition_status,
 l_linenumber = 7 AS truncated FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey) x""",
    "flows": """SELECT candidate_id, s, mid, t, path, truncated, list_transform(range(1, col * 2 + 2), lambda i: {'ord': i, 'kind': CASE WHEN i = 1 THEN 'source' WHEN i = col * 2 + 1 THEN 'sink' WHEN i % 3 = 2 THEN 'call' WHEN i % 3 = 0 THEN 'return' ELSE 'assign' END, 'symbol': CASE WHEN i <= col THEN s WHEN i <= col + 2 THEN mid ELSE t END, 'path': CASE WHEN i = 4 THEN concat('out/', col, '.py') ELSE path END, 'line': i}) AS steps FROM candidates""",
}

VIEW_NEEDS = {
    "v_lines": ["v_files"],
    "cfg_edges": ["cfg_nodes"],
    "g_paths": ["g_calls"],
    "flows": ["candidates"],
}


def with_views(*names: str, more: str = "") -> str:
    """``WITH`` clause that defines the named views (and their needs) plus ``more``."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in VIEW_NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    parts = [f"{name} AS ({VIEW_SQL[name]})" for name in order]
    if more:
        parts.append(more)
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


class Tables:
    """The given tables and the stand-in views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def v_files(self) -> DataFrame:
        ext = F.lit(".java")
        for lang, suffix in EXT_OF_LANG.items():
            ext = F.when(F.col("lang") == lang, suffix).otherwise(ext)
        return self.documents.select(
            F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), ext).alias("path"),
            F.col("source").alias("project_id"), "lang", "text", "n_chars", "doc_id",
        )

    @cached_property
    def v_lines(self) -> DataFrame:
        return self.v_files.select(
            "path", "project_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")
        ).select("path", "project_id", (F.col("pos") + 1).alias("line"), "text")

    @cached_property
    def g_nodes(self) -> DataFrame:
        def layer(df, prefix, key, name, level):
            return df.select(
                F.concat(F.lit(prefix + "/"), F.col(key).cast("string")).alias("id"),
                F.col(name).alias("name"), F.lit(level).alias("level"),
            )

        return (
            layer(self.region, "region", "r_regionkey", "r_name", "module")
            .unionByName(layer(self.nation, "nation", "n_nationkey", "n_name", "class"))
            .unionByName(layer(self.customer, "customer", "c_custkey", "c_name", "function"))
            .unionByName(layer(self.supplier, "supplier", "s_suppkey", "s_name", "external"))
            .unionByName(layer(self.orders, "order", "o_orderkey", "o_orderpriority", "method"))
        )

    @cached_property
    def g_edges(self) -> DataFrame:
        def ref(prefix, key):
            return F.concat(F.lit(prefix + "/"), F.col(key).cast("string"))

        def edges(df, ident, source, target, relation, dispatch):
            return df.select(
                ident.alias("id"), source.alias("source"), target.alias("target"),
                F.lit(relation).alias("relation"), dispatch.alias("dispatch"),
            )

        line_id = F.concat_ws(
            "/", F.lit("e4"), *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
        )
        return (
            edges(self.nation, ref("e1", "n_nationkey"), ref("region", "n_regionkey"), ref("nation", "n_nationkey"), "contains", F.lit(""))
            .unionByName(edges(self.customer, ref("e2", "c_custkey"), ref("nation", "c_nationkey"), ref("customer", "c_custkey"), "contains", F.lit("")))
            .unionByName(edges(self.orders, ref("e3", "o_orderkey"), ref("customer", "o_custkey"), ref("order", "o_orderkey"), "calls", F.lit("direct")))
            .unionByName(edges(self.lineitem, line_id, ref("order", "l_orderkey"), ref("supplier", "l_suppkey"), "calls",
                               F.when(F.col("l_returnflag") == "R", "virtual").otherwise("direct")))
        )

    @cached_property
    def g_calls(self) -> DataFrame:
        """Customers call those with half and a third of their key, a few also one with twice: shared callees and cycles, in step with the table."""
        key = F.col("c_custkey")
        call = lambda cond, target, certainty: F.when(cond, F.struct(target.alias("target"), F.lit(certainty).alias("certainty")))
        half, third = F.floor(key / 2), F.floor(key / 3)
        calls = F.array_compact(F.array(call(half != key, half, "must"), call((third != half) & (third != key), third, "may"), call(key % 100 == 99, key * 2, "may")))
        wanted = self.customer.select(key.alias("source"), F.explode(calls).alias("c")).select("source", "c.target", F.lit(1).alias("weight"), "c.certainty")
        return wanted.join(self.customer.select(key.alias("target")), "target", "left_semi").select("source", "target", "weight", "certainty")

    @cached_property
    def cfg_nodes(self) -> DataFrame:
        events = self.events.select("user_id", "event_id", "event_type", "ts")
        placed = prefix_sums(events, ["user_id"], F.to_date("ts"), ["ts", "event_id"], {"rn": F.lit(1)})
        return placed.select(
            F.col("user_id").alias("fn"), F.col("event_id").alias("node"), F.col("event_type").alias("kind"),
            (F.col("event_id") % 3).cast("int").alias("var"), F.col("rn").cast("long").alias("rn"),
        )

    @cached_property
    def cfg_edges(self) -> DataFrame:
        nodes = self.cfg_nodes
        target = nodes.select("fn", F.col("node").alias("target"), "rn")
        hops = nodes.select(
            "fn", F.col("node").alias("source"),
            F.explode(F.array(
                F.struct((F.col("rn") + 1).alias("rn"),
                         F.when(F.col("kind") == "signup", "true").otherwise("normal").alias("branch")),
                F.struct(F.when(F.col("kind") == "signup", F.col("rn") + 2).alias("rn"), F.lit("false").alias("branch")),
                F.struct(F.when(F.col("kind") == "error", F.col("rn") - 3).alias("rn"), F.lit("back").alias("branch")),
            )).alias("hop"),
        ).select("fn", "source", "hop.rn", "hop.branch").filter("rn is not null")
        return hops.join(target, ["fn", "rn"]).select("fn", "source", "target", "branch")

    @cached_property
    def run_events(self) -> DataFrame:
        kind = F.lit("run.failed")
        for raw, name in (("signup", "run.started"), ("view", "model.started"), ("click", "model.completed"), ("purchase", "tool.requested")):
            kind = F.when(F.col("event_type") == raw, name).otherwise(kind)
        return self.events.select(
            F.col("user_id").alias("run_id"), F.col("event_id").alias("sequence"), kind.alias("event_type"),
            F.col("ts").alias("created_at"), "value", F.col("props").alias("payload"),
            F.get_json_object("props", "$.k").cast("long").alias("k"),
        )

    @cached_property
    def facts(self) -> DataFrame:
        """Sources, sinks and checks, each at a node of the property graph."""
        def fact(df, prefix, kind, key, node, category, severity, path, line, rule):
            text = F.col(key).cast("string")
            return df.select(
                F.concat(F.lit(prefix + "/"), text).alias("fact_id"), kind.alias("fact_kind"), F.concat(F.lit(node + "/"), text).alias("symbol"),
                category.alias("category"), severity.alias("severity"), path.alias("path"), (F.col(key) % line + 1).cast("int").alias("line"), rule.alias("rule_id"),
            )

        file = lambda folder, col: F.concat(F.lit(folder + "/"), col.cast("string"), F.lit(".py"))
        checks = self.orders.filter("o_orderpriority = '1-URGENT' or (o_orderpriority = '5-LOW' and o_orderstatus = 'F')")
        return (
            fact(self.customer, "src", F.lit("source"), "c_custkey", "customer", F.col("c_mktsegment"), F.lit("medium"),
                 file("mod", F.col("c_nationkey")), 60, F.lit("r1"))
            .unionByName(fact(self.supplier, "snk", F.lit("sink"), "s_suppkey", "supplier", F.lit("supplier"), F.when(F.col("s_acctbal") > 5000, "high").otherwise("low"),
                              file("mod", F.col("s_nationkey")), 40, F.concat(F.lit("r"), (F.col("s_suppkey") % 3).cast("string"))))
            .unionByName(fact(checks, "grd", F.when(F.col("o_orderpriority") == "1-URGENT", "guard").otherwise("sanitizer"), "o_orderkey", "order",
                              F.col("o_orderstatus"), F.lit("informational"), file("ord", F.col("o_orderkey") % 97), 80, F.lit("r9")))
        )

    @cached_property
    def g_paths(self) -> DataFrame:
        """Simple paths of one to three call edges, with the weakest certainty on the way."""
        calls = self.g_calls.select("source", "target", F.col("certainty").alias("step"))
        level = calls.select(
            F.col("source").alias("s"), F.col("target").alias("t"), F.array("source", "target").alias("nodes"), F.col("step").alias("worst"),
            F.lit(1).alias("hops"),
        )
        paths = level
        for hops in (2, 3):
            level = (
                level.join(calls, F.col("t") == F.col("source"))
                .filter(~F.array_contains("nodes", F.col("target")))
                .select("s", F.col("target").alias("t"), F.array_append("nodes", F.col("target")).alias("nodes"),
                        F.when((F.col("worst") == "may") | (F.col("step") == "may"), "may").otherwise("must").alias("worst"),
                        F.lit(hops).alias("hops"))
            )
            paths = paths.unionByName(level)
        return paths

    @cached_property
    def candidates(self) -> DataFrame:
        """Routes source customer -> order -> supplier: one per order line, so their number grows with the data."""
        from tracewell.functions.ids import digest_id

        ref = lambda prefix, *cols: F.concat_ws("/", F.lit(prefix), *[F.col(c).cast("string") for c in cols])
        # lines meet suppliers while they are narrowest; equal rows go where the join has placed them by order; ids and texts are made last
        lines = self.lineitem.select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_returnflag") == "R").alias("virtual"), (F.col("l_returnflag") == "A").alias("flow"), (F.col("l_linestatus") == "O").alias("open"),
            F.when(F.col("l_tax") >= 0.08, 2).when(F.col("l_discount") >= 0.05, 1).otherwise(0).cast("byte").alias("doubt"),
        ).fillna(False, ["virtual", "flow", "open"])
        callers = self.orders.select("o_orderkey", "o_custkey").join(self.customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey")
        called = self.supplier.select("s_suppkey", "s_nationkey", F.coalesce(F.col("s_acctbal") > 5000, F.lit(False)).alias("rich")).distinct()
        rows = (
            lines.join(called, F.col("l_suppkey") == F.col("s_suppkey")).drop("s_suppkey").join(callers, F.col("l_orderkey") == F.col("o_orderkey")).distinct()
            .select(
                ref("src", "c_custkey").alias("src"), ref("snk", "l_suppkey").alias("snk"), ref("customer", "c_custkey").alias("s"), ref("order", "o_orderkey").alias("mid"),
                ref("supplier", "l_suppkey").alias("t"), ref("e3", "o_orderkey").alias("e1"), ref("e4", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("e2"),
                F.when(F.col("virtual"), "virtual").otherwise("direct").alias("dispatch"),
                F.when(F.col("doubt") == 2, "unresolved").when(F.col("doubt") == 1, "may").otherwise("must").alias("certainty"),
                F.when(F.col("rich"), "high").otherwise("low").alias("severity"), F.col("c_mktsegment").alias("category"),
                F.concat(F.lit("mod/"), F.col("s_nationkey").cast("string"), F.lit(".py")).alias("path"), (F.col("l_suppkey") % 40 + 1).cast("int").alias("line"),
                F.col("l_linenumber").alias("col"), F.when(F.col("flow"), "propagation_path").otherwise("structural_lead").alias("kind"),
                F.when(F.col("open"), "unknown").when(F.col("l_linenumber") == 1, "satisfiable_under_model").otherwise("not_checked").alias("condition_status"),
                (F.col("l_linenumber") == 7).alias("truncated"),
            )
        )
        group = F.concat(F.lit("pathgroup:"), F.substring(F.sha2(F.concat_ws("|", "src", "snk"), 256), 1, 24))
        ident = digest_id("candidate:", "src", "snk", F.concat_ws(",", "e1", "e2"), F.lit("structural"))
        return rows.select(ident.alias("candidate_id"), group.alias("path_group_id"), "*")

    @cached_property
    def flows(self) -> DataFrame:
        """Ordered steps of each route, made row by row."""
        last = F.col("col") * 2 + 1

        def step(n):
            kind = F.when(n == 1, "source").when(n == last, "sink").when(n % 3 == 2, "call").when(n % 3 == 0, "return").otherwise("assign")
            symbol = F.when(n <= F.col("col"), F.col("s")).when(n <= F.col("col") + 2, F.col("mid")).otherwise(F.col("t"))
            path = F.when(n == 4, F.concat(F.lit("out/"), F.col("col").cast("string"), F.lit(".py"))).otherwise(F.col("path"))
            return F.struct(n.alias("ord"), kind.alias("kind"), symbol.alias("symbol"), path.alias("path"), n.alias("line"))

        return self.candidates.select("candidate_id", "s", "mid", "t", "path", "truncated", F.transform(F.sequence(F.lit(1), last), step).alias("steps"))
