"""Graph queries over the stand-in property graph and call graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import verdicts
from tracewell.operators import graphs
from tracewell.plans.registry import query
from tracewell.views import with_views

BAD_EDGES = """bad_edges AS (SELECT * FROM g_edges UNION ALL
 SELECT concat('bad/', id), CASE WHEN id LIKE '%1' THEN '' ELSE source END, CASE WHEN id LIKE '%2' THEN source WHEN id LIKE '%3' THEN concat('lost/', target) ELSE target END, relation, dispatch FROM g_edges WHERE id LIKE 'e3/%')"""


def _bad_edges(t):
    ident = F.col("id")
    bad = t.g_edges.filter(ident.startswith("e3/")).select(
        F.concat(F.lit("bad/"), ident).alias("id"), F.when(ident.endswith("1"), "").otherwise(F.col("source")).alias("source"),
        F.when(ident.endswith("2"), F.col("source")).when(ident.endswith("3"), F.concat(F.lit("lost/"), "target")).otherwise(F.col("target")).alias("target"),
        "relation", "dispatch")
    return t.g_edges.unionByName(bad)


@query("join25_drop_dangling", with_views("g_nodes", "g_edges", more=BAD_EDGES) + """SELECT reason, count(*) AS edges FROM (SELECT CASE WHEN source = '' OR target = '' THEN 'invalid' WHEN source = target THEN 'self_loop'
 WHEN source NOT IN (SELECT id FROM g_nodes) OR target NOT IN (SELECT id FROM g_nodes) THEN 'dangling' END AS reason FROM bad_edges) t WHERE reason IS NOT NULL GROUP BY reason""")
def join25(t):
    return graphs.drop_dangling(_bad_edges(t), t.g_nodes)[1]


@query("join27_validate_graph", with_views("g_nodes", "g_edges", more=BAD_EDGES + """, nn AS (SELECT id FROM g_nodes UNION ALL SELECT id FROM g_nodes WHERE level = 'external'),
 ee AS (SELECT * FROM bad_edges UNION ALL SELECT * FROM g_edges WHERE relation = 'contains')""") + """SELECT 'duplicate_node' AS code, id AS node_id, CAST(NULL AS VARCHAR) AS edge_id, count(*) - 1 AS occurrences FROM nn GROUP BY id HAVING count(*) > 1
 UNION ALL SELECT 'duplicate_edge', NULL, id, count(*) - 1 FROM ee GROUP BY id HAVING count(*) > 1
 UNION ALL SELECT 'dangling_edge', NULL, id, count(*) FROM (SELECT id, unnest([source, target]) AS e FROM ee) x WHERE e NOT IN (SELECT id FROM nn) GROUP BY id""")
def join27(t):
    nodes = t.g_nodes.unionByName(t.g_nodes.filter("level = 'external'"))
    edges = _bad_edges(t).unionByName(t.g_edges.filter("relation = 'contains'"))
    return graphs.validate_graph(nodes, edges)


@query("ext02_graph_view_contract", with_views("g_nodes", "g_calls") + """SELECT 'dangling_edge' AS code, CAST(NULL AS VARCHAR) AS node_id, concat(source, '>', target) AS edge_id, CAST(2 AS BIGINT) AS occurrences FROM g_calls""")
def ext02(t):
    """A view without the usual names: call pairs as edges, checked against nodes they do not know."""
    edges = t.g_calls.select(F.concat_ws(">", "source", "target").alias("id"), F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"))
    return graphs.validate_graph(t.g_nodes, edges)


_DEG = "deg AS (SELECT id, count(*) AS degree, count(*) FILTER (WHERE o = 1) AS out_degree, count(*) FILTER (WHERE o = 0) AS in_degree FROM (SELECT source AS id, 1 AS o FROM g_edges UNION ALL SELECT target, 0 FROM g_edges) x GROUP BY id)"


@query("agg03_graph_summary", with_views("g_nodes", "g_edges", more=_DEG) + """SELECT 'count' AS section, 'nodes' AS key, count(*) AS value FROM g_nodes UNION ALL SELECT 'count', 'edges', count(*) FROM g_edges
 UNION ALL SELECT 'relation', relation, count(*) FROM g_edges GROUP BY relation UNION ALL SELECT * FROM (SELECT 'central', id, degree FROM deg ORDER BY degree DESC, id LIMIT 20) c""")
def agg03(t):
    return graphs.graph_summary(t.g_nodes, t.g_edges)


@query("agg04_exchange_summary", with_views("g_nodes", "g_edges", more=_DEG + ", full_nodes AS (SELECT n.*, coalesce(d.degree, 0) AS degree FROM g_nodes n LEFT JOIN deg d USING (id))") + """SELECT 'level' AS section, level AS key, count(*) AS value FROM g_nodes GROUP BY level
 UNION ALL SELECT 'scope', CASE WHEN level = 'external' THEN 'external' ELSE 'project' END, count(*) FROM g_nodes GROUP BY 2 UNION ALL SELECT 'relation', relation, count(*) FROM g_edges GROUP BY relation
 UNION ALL SELECT 'summary', 'edge_count', count(*) FROM g_edges UNION ALL SELECT 'summary', 'node_count', count(*) FROM g_nodes UNION ALL SELECT 'summary', 'max_degree', max(degree) FROM full_nodes
 UNION ALL SELECT 'summary', 'min_degree', min(degree) FROM full_nodes UNION ALL SELECT 'summary', 'truncated', CAST(0 AS BIGINT)""")
def agg04(t):
    return graphs.exchange_summary(t.g_nodes, t.g_edges, verdicts.graph_scope("id", "level"))


@query("agg04_node_degrees", with_views("g_nodes", "g_edges", more=_DEG) + "SELECT n.id, n.name, n.level, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) AS out_degree, coalesce(degree, 0) AS degree FROM g_nodes n LEFT JOIN deg USING (id)")
def agg04_nodes(t):
    return graphs.node_degrees(t.g_nodes, t.g_edges)


@query("agg05_merge_parallel_edges", with_views("g_edges") + "SELECT source, target, relation, dispatch, min(id) AS id, count(*) AS occurrence_count FROM g_edges GROUP BY ALL")
def agg05(t):
    return graphs.merge_parallel_edges(t.g_edges)


@query("srt01_central_nodes", with_views("g_edges", more=_DEG) + "SELECT id, degree FROM deg ORDER BY degree DESC, id LIMIT 20")
def srt01(t):
    return graphs.central_nodes(t.g_edges)


_FILTER = """ge AS MATERIALIZED (SELECT * FROM g_edges), c AS MATERIALIZED (SELECT * FROM g_nodes WHERE level IN ('module', 'class', 'function', 'method', 'external_module') AND id <> 'nation/3'),
 k AS MATERIALIZED (SELECT * FROM ge WHERE source IN (SELECT id FROM c) AND target IN (SELECT id FROM c)),
 d AS MATERIALIZED (SELECT id, count(*) AS n FROM (SELECT source AS id FROM k UNION ALL SELECT target FROM k) x GROUP BY id),
 v AS MATERIALIZED (SELECT c.* FROM c LEFT JOIN d USING (id) WHERE level = 'module' OR coalesce(n, 0) >= 2)"""


@query("flt06_filter_graph_nodes", with_views("g_nodes", "g_edges", more=_FILTER) + "SELECT * FROM v")
def flt06_nodes(t):
    levels, relations, threshold = graphs.VIEW_PRESETS["core"]
    return graphs.filter_graph(t.g_nodes, t.g_edges, levels, relations, threshold, hidden=["nation/3"])[0]


@query("flt06_filter_graph_edges", with_views("g_nodes", "g_edges", more=_FILTER) + "SELECT * FROM ge WHERE source IN (SELECT id FROM v) AND target IN (SELECT id FROM v)")
def flt06_edges(t):
    levels, relations, threshold = graphs.VIEW_PRESETS["core"]
    return graphs.filter_graph(t.g_nodes, t.g_edges, levels, relations, threshold, hidden=["nation/3"])[1]


@query("flt06_focus_view", with_views("g_nodes", "g_edges", more="f AS (SELECT target AS id FROM g_edges WHERE source = 'nation/7' UNION SELECT source FROM g_edges WHERE target = 'nation/7' UNION SELECT 'nation/7')") + "SELECT * FROM g_edges WHERE source IN (SELECT id FROM f) AND target IN (SELECT id FROM f)")
def flt06_focus(t):
    return graphs.filter_graph(t.g_nodes, t.g_edges, None, None, 0, selected="nation/7", focus=True)[1]


@query("gr05_neighbours", with_views("g_nodes", "g_edges", more="w AS (SELECT id FROM g_nodes WHERE level IN ('class', 'function'))") + """SELECT e.source AS node, 'outgoing' AS direction, e.relation, e.id AS edge_id, e.target AS neighbour, n.name, n.level FROM g_edges e JOIN w ON w.id = e.source LEFT JOIN g_nodes n ON n.id = e.target
 UNION ALL SELECT e.target, 'incoming', e.relation, e.id, e.source, n.name, n.level FROM g_edges e JOIN w ON w.id = e.target LEFT JOIN g_nodes n ON n.id = e.source""")
def gr05(t):
    return graphs.neighbours(t.g_nodes, t.g_edges, t.g_nodes.filter("level in ('class', 'function')"))


@query("srt08_cap_with_flag", with_views("g_nodes") + "SELECT id, name, level, (SELECT count(*) FROM g_nodes) - 500 AS omitted, true AS truncated FROM g_nodes ORDER BY id LIMIT 500")
def srt08(t):
    return graphs.cap_with_flag(t.g_nodes, ["id"], 500)


@query("join36_remap_aggregated_edges", with_views("g_edges") + "SELECT id, min(id) OVER (PARTITION BY source, target, relation, dispatch) AS retained_id FROM g_edges")
def join36(t):
    return graphs.remap_aggregated_edges(t.g_edges, graphs.merge_parallel_edges(t.g_edges))


@query("join35_restore_edges", with_views("g_edges") + """SELECT source AS route_id, id, position, CASE WHEN id LIKE 'gone/%' THEN true ELSE false END AS missing, relation FROM (
 SELECT source, id, 0 AS position, relation FROM g_edges WHERE id LIKE 'e4/%' UNION ALL SELECT source, concat('gone/', id), 1, NULL FROM g_edges WHERE id LIKE 'e4/%') x""")
def join35(t):
    calls = t.g_edges.filter("id like 'e4/%'")
    routes = calls.select(F.col("source").alias("route_id"), F.array("id", F.concat(F.lit("gone/"), "id")).alias("edge_ids"))
    known = t.g_edges.select("id", "relation").dropDuplicates(["id"])
    return graphs.restore_edges(routes, known).select("route_id", "id", "position", "missing", "relation")


@query("gr01_reachable", with_views("g_edges", more="r AS (SELECT id AS seed, id AS node FROM (SELECT DISTINCT source AS id FROM g_edges WHERE source LIKE 'region/%') s UNION SELECT r.seed, e.target FROM r JOIN g_edges e ON e.source = r.node)") + "SELECT seed, node FROM r")
def gr01(t):
    seeds = t.region.select(F.concat(F.lit("region/"), F.col("r_regionkey").cast("string")).alias("seed"))
    return graphs.reachable(t.g_edges, seeds)


@query("gr01_reachable_backward", with_views("g_calls", more="r AS (SELECT target AS seed, target AS node FROM g_calls UNION SELECT r.seed, e.source FROM r JOIN g_calls e ON e.target = r.node)") + "SELECT seed, node FROM r")
def gr01_back(t):
    return graphs.reachable(t.g_calls, t.g_calls.select(F.col("target").alias("seed")).distinct(), "backward")


_PATHS = """p AS (SELECT source AS s, target AS t, [CAST(source AS VARCHAR), CAST(target AS VARCHAR)] AS nodes, [concat(source, '>', target)] AS ids FROM g_calls
 UNION ALL SELECT p.s, g.target, list_append(p.nodes, CAST(g.target AS VARCHAR)), list_append(p.ids, concat(g.source, '>', g.target)) FROM p JOIN g_calls g ON g.source = p.t WHERE len(p.ids) < {depth} AND NOT list_contains(p.nodes, CAST(g.target AS VARCHAR)))"""


def _call_edges(t):
    s, d = F.col("source").cast("string"), F.col("target").cast("string")
    return t.g_calls.select(F.concat_ws(">", s, d).alias("id"), s.alias("source"), d.alias("target"), "certainty")


@query("gr02_shortest_path", with_views("g_calls", more=_PATHS.format(depth=6)) + "SELECT CAST(s AS VARCHAR) AS s, CAST(t AS VARCHAR) AS node, min_by(array_to_string(ids, ','), nodes) AS edge_ids, CAST(min(len(ids)) AS INT) AS hops FROM (SELECT *, min(len(ids)) OVER (PARTITION BY s, t) AS best FROM p) q WHERE len(ids) = best GROUP BY s, t")
def gr02(t):
    edges = _call_edges(t)
    found = graphs.shortest_paths(edges, edges.select(F.col("source").alias("s")).distinct())
    return found.select("s", "node", F.array_join("steps.edge", ",").alias("edge_ids"), F.size("steps").alias("hops"))


@query("gr03_path_variants", with_views("g_calls", more=_PATHS.format(depth=4)) + "SELECT CAST(s AS VARCHAR) AS s, CAST(t AS VARCHAR) AS t, array_to_string(nodes, '>') AS nodes, array_to_string(ids, ',') AS edge_ids FROM p")
def gr03(t):
    edges = pin_calls(t)
    ends = edges.select(F.col("source").alias("s")).distinct()
    targets = edges.select(F.col("target").alias("t")).distinct()
    found = graphs.path_variants(edges, ends, targets, max_depth=4, max_variants=None, max_states=None).filter("hops > 0")
    return found.select("s", "t", F.array_join("nodes", ">").alias("nodes"), F.array_join("edge_ids", ",").alias("edge_ids"))


def pin_calls(t):
    from tracewell.session import pin

    return pin(_call_edges(t))


@query("gr03_path_variants_budget", with_views("g_calls", more=_PATHS.format(depth=4)) + "SELECT CAST(s AS VARCHAR) AS s, CAST(t AS VARCHAR) AS t, array_to_string(ids, ',') AS edge_ids FROM (SELECT *, row_number() OVER (PARTITION BY s, t ORDER BY len(ids), ids) AS rn FROM p) q WHERE rn <= 2")
def gr03_budget(t):
    edges = pin_calls(t)
    ends = edges.select(F.col("source").alias("s")).distinct()
    targets = edges.select(F.col("target").alias("t")).distinct()
    found = graphs.path_variants(edges, ends, targets, max_depth=4, max_variants=2, max_states=2048).filter("hops > 0")
    return found.select("s", "t", F.array_join("edge_ids", ",").alias("edge_ids"))


@query("gr04_incoming_context", with_views("g_edges", more="""t0 AS (SELECT concat('supplier/', CAST(s_suppkey AS VARCHAR)) AS id FROM supplier),
 r1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY id) AS turn FROM g_edges WHERE target IN (SELECT id FROM t0)) a WHERE turn <= 8),
 f1 AS (SELECT DISTINCT source AS id FROM r1 WHERE source NOT IN (SELECT id FROM t0)),
 r2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY id) AS turn FROM g_edges WHERE target IN (SELECT id FROM f1)) a WHERE turn <= 8)""") + "SELECT id, source, target, CAST(turn AS INT) AS turn, 1 AS round FROM r1 UNION ALL SELECT id, source, target, CAST(turn AS INT), 2 FROM r2")
def gr04(t):
    targets = t.supplier.select(F.concat(F.lit("supplier/"), F.col("s_suppkey").cast("string")).alias("id"))
    found = graphs.incoming_context(t.g_edges, targets, depth=2, per_target=8)
    return found.select("id", "source", "target", "turn", "round")


@query("win04_fair_neighbours", with_views("g_edges") + """SELECT id, source, target, CAST(turn AS INT) AS turn, greatest(0, available - 5) AS omitted_for_target FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY id) AS turn, count(*) OVER (PARTITION BY target) AS available
 FROM g_edges WHERE id LIKE 'e4/%') a WHERE turn <= 5""")
def win04(t):
    found = graphs.fair_neighbours(t.g_edges.filter("id like 'e4/%'"), "target", ["id"], per_target=5)
    return found.select("id", "source", "target", "turn", "omitted_for_target")


@query("win04_fair_neighbours_budget", with_views("g_edges") + """SELECT id, source, target, CAST(turn AS INT) AS turn, greatest(0, available - 5) AS omitted_for_target FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY id) AS turn, count(*) OVER (PARTITION BY target) AS available
 FROM g_edges WHERE id LIKE 'e4/%') a WHERE turn <= 5 ORDER BY turn, target, id LIMIT 300""")
def win04_budget(t):
    found = graphs.fair_neighbours(t.g_edges.filter("id like 'e4/%'"), "target", ["id"], per_target=5, max_edges=300)
    return found.select("id", "source", "target", "turn", "omitted_for_target")


_ALIAS = "alias AS (SELECT p_partkey AS id, p_partkey - 1 AS a FROM part WHERE p_partkey % 11 <> 0)"


@query("gr06_canonical", with_views(more=_ALIAS).replace("RECURSIVE ", "") + "SELECT id, greatest(id - 8, id - id % 11) AS canonical FROM alias")
def gr06(t):
    aliases = t.part.filter("p_partkey % 11 <> 0").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") - 1).alias("alias"))
    return graphs.canonical(aliases)


def _bases(t):
    ref = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return (
        t.customer.select(ref("c/", "c_custkey").alias("type"), ref("n/", "c_nationkey").alias("base"))
        .unionByName(t.supplier.select(ref("s/", "s_suppkey").alias("type"), ref("n/", "s_nationkey").alias("base")))
        .unionByName(t.nation.select(ref("n/", "n_nationkey").alias("type"), ref("r/", "n_regionkey").alias("base")))
        .unionByName(t.nation.filter("n_nationkey % 5 <> n_regionkey").select(ref("n/", "n_nationkey").alias("type"), F.concat(F.lit("i/"), (F.col("n_nationkey") % 5).cast("string")).alias("base")))
    )


_BASES = """bases AS (SELECT concat('c/', c_custkey) AS type, concat('n/', c_nationkey) AS base FROM customer UNION ALL SELECT concat('s/', s_suppkey), concat('n/', s_nationkey) FROM supplier
 UNION ALL SELECT concat('n/', n_nationkey), concat('r/', n_regionkey) FROM nation UNION ALL SELECT concat('n/', n_nationkey), concat('i/', n_nationkey % 5) FROM nation WHERE n_nationkey % 5 <> n_regionkey),
 up AS (SELECT type, base AS ancestor, 1 AS level FROM bases UNION SELECT u.type, b.base, u.level + 1 FROM up u JOIN bases b ON b.type = u.ancestor)"""


@query("gr07_ancestors", with_views(more=_BASES) + "SELECT type, ancestor, min(level) AS level FROM up GROUP BY type, ancestor")
def gr07(t):
    return graphs.ancestors(_bases(t))


@query("gr09_nearest_declaring_ancestor", with_views(more=_BASES + """, members AS (SELECT DISTINCT ancestor AS type, 'name' AS member FROM up WHERE ancestor LIKE 'r/%' OR ancestor LIKE 'i/%' UNION ALL SELECT concat('n/', n_nationkey), 'name' FROM nation WHERE n_nationkey % 4 = 0
 UNION ALL SELECT concat('c/', c_custkey), 'name' FROM customer WHERE c_custkey % 10 = 0), own AS (SELECT type, 'name' AS member, type AS owner, 0 AS level FROM (SELECT DISTINCT type FROM bases) b WHERE type IN (SELECT type FROM members)),
 cand AS (SELECT u.type, 'name' AS member, u.ancestor AS owner, min(u.level) AS level FROM up u JOIN members m ON m.type = u.ancestor WHERE u.type NOT IN (SELECT type FROM own) AND u.ancestor NOT LIKE 'i/%' GROUP BY u.type, u.ancestor),
 best AS (SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM cand d JOIN up x ON x.type = d.owner WHERE d.type = c.type AND x.ancestor = c.owner)), allrows AS (SELECT * FROM own UNION ALL SELECT * FROM best)""") + """SELECT type, member, owner, level, count(*) OVER (PARTITION BY type, member) AS owners, count(*) OVER (PARTITION BY type, member) > 1 AS ambiguous FROM allrows""")
def gr09(t):
    from tracewell.session import pin

    bases = pin(_bases(t))
    up = pin(graphs.ancestors(bases))
    name = F.lit("name").alias("member")
    members = (
        up.filter("ancestor like 'r/%' or ancestor like 'i/%'").select(F.col("ancestor").alias("type"), name).distinct()
        .unionByName(t.nation.filter("n_nationkey % 4 = 0").select(F.concat(F.lit("n/"), F.col("n_nationkey").cast("string")).alias("type"), name))
        .unionByName(t.customer.filter("c_custkey % 10 = 0").select(F.concat(F.lit("c/"), F.col("c_custkey").cast("string")).alias("type"), name))
    )
    types = bases.select(F.explode(F.array("type", "base")).alias("type")).distinct()
    kinds = types.withColumn("kind", F.when(F.col("type").startswith("i/"), "interface").otherwise("class"))
    lookups = bases.select("type", name).distinct()
    return graphs.nearest_declaring_ancestor(lookups, members, up, kinds)
