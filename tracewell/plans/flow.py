"""Flow queries: the event stream of each user as a flow graph, and orders as call levels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewell.operators import evidence, flow, graphs
from tracewell.plans.registry import query
from tracewell.session import pin, stored
from tracewell.views import with_views


def _txt(*cols):
    return F.concat(*[F.lit(c) if isinstance(c, str) else c.cast("string") for c in cols])


_STEPS = """st AS (SELECT run_id AS fn, CAST(sequence AS VARCHAR) AS node, CASE event_type WHEN 'run.started' THEN 'branch' WHEN 'run.failed' THEN 'loop' ELSE CASE WHEN k = 9 THEN 'return' ELSE 'plain' END END AS kind, row_number() OVER (PARTITION BY run_id ORDER BY sequence) AS pos, count(*) OVER (PARTITION BY run_id) AS last FROM run_events)"""


@query("gr11_sequence_graph", with_views("run_events", more=_STEPS) + """SELECT fn, '<entry>' AS source, node AS target, 'normal' AS branch FROM st WHERE pos = 1 UNION ALL SELECT fn, node, '<exit>', 'normal' FROM st WHERE kind = 'return' OR pos = last
 UNION ALL SELECT a.fn, a.node, b.node, CASE WHEN a.kind = 'branch' THEN 'true' ELSE 'normal' END FROM st a JOIN st b ON b.fn = a.fn AND b.pos = a.pos + 1 WHERE a.kind <> 'return' UNION ALL SELECT a.fn, a.node, b.node, 'false' FROM st a JOIN st b ON b.fn = a.fn AND b.pos = a.pos + 2 WHERE a.kind = 'branch'
 UNION ALL SELECT a.fn, a.node, b.node, 'back' FROM st a JOIN st b ON b.fn = a.fn AND b.pos = a.pos - 3 WHERE a.kind = 'loop'""")
def gr11(t):
    kind = F.when(F.col("event_type") == "run.started", "branch").when(F.col("event_type") == "run.failed", "loop").when(F.col("k") == 9, "return").otherwise("plain")
    steps = t.run_events.select(F.col("run_id").alias("fn"), F.col("sequence").alias("node"), kind.alias("kind"))
    return flow.sequence_graph(steps, ["node"], F.floor(F.col("node") / 2000))


_NESTED = """nn AS (SELECT fn, CAST(node AS VARCHAR) AS node, rn, rn // 4 AS up, max(rn) OVER (PARTITION BY fn) AS last, node AS ident FROM cfg_nodes),
 ns AS (SELECT n.fn, n.node, n.rn, p.node AS parent, CASE WHEN 4 * n.rn <= n.last THEN CASE n.ident % 3 WHEN 0 THEN 'if' WHEN 1 THEN 'loop' ELSE 'try' END ELSE CASE n.ident % 5 WHEN 0 THEN 'break' WHEN 1 THEN 'continue' WHEN 2 THEN 'return' WHEN 3 THEN 'raise' ELSE 'plain' END END AS kind,
  CASE WHEN p.ident % 3 = 0 AND n.rn % 4 = 3 THEN 'else' WHEN p.ident % 3 = 2 AND n.rn % 4 = 3 THEN 'handler' ELSE 'body' END AS part FROM nn n LEFT JOIN nn p ON p.fn = n.fn AND p.rn = n.up),
 nb AS (SELECT s.*, q.kind AS above, lead(s.node) OVER (PARTITION BY s.fn, s.parent, s.part ORDER BY s.rn) AS next FROM ns s LEFT JOIN ns q ON q.fn = s.fn AND q.node = s.parent), hd AS (SELECT fn, parent AS node, part, arg_min(node, rn) AS head FROM nb GROUP BY ALL),
 fo AS (SELECT fn, node, node AS cur FROM nb UNION ALL SELECT f.fn, f.node, b.parent FROM fo f JOIN nb b ON b.fn = f.fn AND b.node = f.cur WHERE b.next IS NULL AND b.parent IS NOT NULL AND b.above <> 'loop'),
 fw AS (SELECT f.fn, f.node, coalesce(b.next, CASE WHEN b.parent IS NULL THEN '<exit>' ELSE b.parent END) AS follow FROM fo f JOIN nb b ON b.fn = f.fn AND b.node = f.cur WHERE b.next IS NOT NULL OR b.parent IS NULL OR b.above = 'loop'),
 an AS (SELECT fn, node, node AS cur, 0 AS d FROM nb UNION ALL SELECT a.fn, a.node, b.parent, d + 1 FROM an a JOIN nb b ON b.fn = a.fn AND b.node = a.cur WHERE b.parent IS NOT NULL),
 lp AS (SELECT a.fn, a.node, arg_min(b.parent, d) AS loop FROM an a JOIN nb b ON b.fn = a.fn AND b.node = a.cur WHERE b.above = 'loop' GROUP BY ALL),
 ca AS (SELECT a.fn, a.node, arg_min(h.head, d) AS caught FROM an a JOIN nb b ON b.fn = a.fn AND b.node = a.cur JOIN hd h ON h.fn = b.fn AND h.node = b.parent AND h.part = 'handler' WHERE b.above = 'try' AND b.part = 'body' GROUP BY ALL),
 al AS (SELECT nb.fn, nb.node, kind, fw.follow, lp.loop, ca.caught, lf.follow AS after_loop, h1.head AS body, h2.head AS other, h3.head AS handler FROM nb JOIN fw ON fw.fn = nb.fn AND fw.node = nb.node LEFT JOIN lp ON lp.fn = nb.fn AND lp.node = nb.node LEFT JOIN ca ON ca.fn = nb.fn AND ca.node = nb.node
  LEFT JOIN fw lf ON lf.fn = lp.fn AND lf.node = lp.loop LEFT JOIN hd h1 ON h1.fn = nb.fn AND h1.node = nb.node AND h1.part = 'body' LEFT JOIN hd h2 ON h2.fn = nb.fn AND h2.node = nb.node AND h2.part = 'else' LEFT JOIN hd h3 ON h3.fn = nb.fn AND h3.node = nb.node AND h3.part = 'handler')"""


@query("gr11_structured_graph", with_views("cfg_nodes", more=_NESTED) + """SELECT fn, '<entry>' AS source, head AS target, 'normal' AS branch FROM hd WHERE node IS NULL UNION ALL SELECT fn, node, coalesce(body, follow), 'true' FROM al WHERE kind = 'if' UNION ALL SELECT fn, node, coalesce(other, follow), 'false' FROM al WHERE kind = 'if'
 UNION ALL SELECT fn, node, coalesce(body, node), 'true' FROM al WHERE kind = 'loop' UNION ALL SELECT fn, node, follow, 'false' FROM al WHERE kind = 'loop' UNION ALL SELECT fn, node, coalesce(body, follow), 'normal' FROM al WHERE kind = 'try' UNION ALL SELECT fn, node, handler, 'exception' FROM al WHERE kind = 'try' AND handler IS NOT NULL
 UNION ALL SELECT fn, node, coalesce(after_loop, '<exit>'), 'normal' FROM al WHERE kind = 'break' UNION ALL SELECT fn, node, coalesce(loop, '<exit>'), 'normal' FROM al WHERE kind = 'continue' UNION ALL SELECT fn, node, '<exit>', 'normal' FROM al WHERE kind = 'return' UNION ALL SELECT fn, node, coalesce(caught, '<exit>'), 'exception' FROM al WHERE kind = 'raise' UNION ALL SELECT fn, node, follow, 'normal' FROM al WHERE kind = 'plain'""")
def gr11_structured(t):
    """Events of a run as nested blocks: the n-th event holds the four that start at position 4n."""
    nodes = t.cfg_nodes.select("fn", "node", "rn")
    last = nodes.groupBy("fn").agg(F.max("rn").alias("last"))
    up = nodes.select("fn", F.col("rn").alias("up"), F.col("node").alias("parent"))
    rows = nodes.join(last, "fn").withColumn("up", F.floor(F.col("rn") / 4)).join(up, ["fn", "up"], "left")
    pick = lambda names: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("node") % len(names) + 1).cast("int"))
    kind = F.when(4 * F.col("rn") <= F.col("last"), pick(["if", "loop", "try"])).otherwise(pick(["break", "continue", "return", "raise", "plain"]))
    part = F.when(F.col("rn") % 4 == 3, F.when(F.col("parent") % 3 == 0, "else").when(F.col("parent") % 3 == 2, "handler")).otherwise("body")
    return flow.structured_graph(rows.select("fn", "node", "parent", F.coalesce(part, F.lit("body")).alias("part"), F.col("rn").alias("ord"), kind.alias("kind")))


_FIN = """ev AS (SELECT fn, concat('t', node) AS t, concat('s', node) AS s, concat('h', node) AS h, concat('f', node) AS f, node % 2 = 0 AS caught, CASE kind WHEN 'purchase' THEN 'return' WHEN 'error' THEN 'raise' ELSE 'plain' END AS k, coalesce(lead(concat('t', node)) OVER (PARTITION BY fn ORDER BY rn), '<exit>') AS nx, rn FROM cfg_nodes)"""


@query("gr11_final_blocks", with_views("cfg_nodes", more=_FIN) + """SELECT fn, '<entry>' AS source, t AS target, 'normal' AS branch, CAST(NULL AS VARCHAR) AS push, CAST(NULL AS VARCHAR) AS pop FROM ev WHERE rn = 1 UNION ALL SELECT fn, t, s, 'normal', NULL, NULL FROM ev
 UNION ALL SELECT fn, t, CASE WHEN caught THEN h ELSE f END, 'exception', CASE WHEN NOT caught THEN concat(t, ':raise') END, NULL FROM ev UNION ALL SELECT fn, s, CASE WHEN k = 'raise' AND caught THEN h ELSE f END, CASE WHEN k = 'raise' THEN 'exception' ELSE 'normal' END, CASE WHEN k = 'plain' THEN concat(t, ':normal') WHEN k = 'return' OR NOT caught THEN concat(t, ':', k) END, NULL FROM ev
 UNION ALL SELECT fn, h, f, 'normal', concat(t, ':normal'), NULL FROM ev WHERE caught UNION ALL SELECT fn, f, nx, 'normal', NULL, concat(t, ':normal') FROM ev WHERE caught OR k = 'plain' UNION ALL SELECT fn, f, '<exit>', 'normal', NULL, concat(t, ':return') FROM ev WHERE k = 'return' UNION ALL SELECT fn, f, '<exit>', 'normal', NULL, concat(t, ':raise') FROM ev WHERE NOT caught""")
def gr11_final(t):
    """Each event is a try with a final block, every other one with a handler; its body goes on, returns or raises."""
    node, kind = F.col("node").cast("string"), F.col("kind")
    name = lambda letter: F.concat(F.lit(letter), node)
    step = lambda letter, parent, part, order, kind: F.struct(name(letter).alias("node"), parent.alias("parent"), F.lit(part).alias("part"), order.alias("ord"), kind.alias("kind"))
    one, plain = F.lit(1), F.lit("plain")
    body = F.when(kind == "purchase", "return").when(kind == "error", "raise").otherwise("plain")
    base = F.array(step("t", F.lit(None).cast("string"), "body", F.col("rn").cast("int"), F.lit("try")), step("s", name("t"), "body", one, body), step("f", name("t"), "final", one, plain))
    steps = F.when(F.col("node") % 2 == 0, F.array_append(base, step("h", name("t"), "handler", one, plain))).otherwise(base)
    return flow.structured_graph(t.cfg_nodes.select("fn", F.explode(steps).alias("s")).select("fn", "s.*"), completions=True)


_DOM = """ent AS (SELECT fn, node FROM cfg_nodes WHERE rn = 1), av AS (SELECT n.fn, n.node AS x, e.node AS v FROM cfg_nodes n JOIN ent e ON e.fn = n.fn WHERE n.node <> e.node UNION SELECT av.fn, av.x, g.target FROM av JOIN cfg_edges g ON g.fn = av.fn AND g.source = av.v WHERE g.target <> av.x),
 dom AS (SELECT n.fn, x.node AS u, n.node AS v FROM cfg_nodes n JOIN cfg_nodes x ON x.fn = n.fn AND x.node <> n.node LEFT JOIN av ON av.fn = n.fn AND av.x = x.node AND av.v = n.node WHERE av.v IS NULL),
 dep AS (SELECT fn, v, count(*) AS d FROM dom GROUP BY fn, v), idom AS (SELECT dom.fn, dom.v AS node, arg_max(u, coalesce(d, 0)) AS idom FROM dom LEFT JOIN dep ON dep.fn = dom.fn AND dep.v = dom.u GROUP BY dom.fn, dom.v)"""
_PDOM = """ext AS (SELECT fn, arg_max(node, rn) AS node FROM cfg_nodes GROUP BY fn), pav AS (SELECT n.fn, n.node AS x, e.node AS v FROM cfg_nodes n JOIN ext e ON e.fn = n.fn WHERE n.node <> e.node UNION SELECT pav.fn, pav.x, g.source FROM pav JOIN cfg_edges g ON g.fn = pav.fn AND g.target = pav.v WHERE g.source <> pav.x),
 pdom AS (SELECT n.fn, x.node AS u, n.node AS v FROM cfg_nodes n JOIN cfg_nodes x ON x.fn = n.fn AND x.node <> n.node LEFT JOIN pav ON pav.fn = n.fn AND pav.x = x.node AND pav.v = n.node WHERE pav.v IS NULL),
 pdep AS (SELECT fn, v, count(*) AS d FROM pdom GROUP BY fn, v), ipdom AS (SELECT pdom.fn, pdom.v AS node, arg_max(u, coalesce(d, 0)) AS ipdom FROM pdom LEFT JOIN pdep ON pdep.fn = pdom.fn AND pdep.v = pdom.u GROUP BY pdom.fn, pdom.v UNION ALL SELECT fn, node, -1 FROM ext)"""


def _ends(t):
    entry = t.cfg_nodes.filter("rn = 1").select("fn", F.col("node").alias("root"))
    exits = t.cfg_nodes.groupBy("fn").agg(F.max_by("node", "rn").alias("node"))
    return entry, exits


@query("gr12_dominators", with_views("cfg_nodes", "cfg_edges", more=_DOM) + "SELECT * FROM idom")
def gr12(t):
    return flow.immediate_dominators(t.cfg_edges, _ends(t)[0])


@query("gr12_post_dominators", with_views("cfg_nodes", "cfg_edges", more=_PDOM) + "SELECT * FROM ipdom")
def gr12_post(t):
    return flow.post_dominators(t.cfg_edges, t.cfg_nodes, _ends(t)[1])


@query("gr13_control_dependence", with_views("cfg_nodes", "cfg_edges", more=_PDOM + """, ps AS (SELECT fn, u, v FROM pdom UNION ALL SELECT fn, node, node FROM cfg_nodes)""") + """SELECT DISTINCT e.fn, e.source, e.branch, b.u AS target FROM cfg_edges e JOIN ipdom i ON i.fn = e.fn AND i.node = e.source JOIN ps b ON b.fn = e.fn AND b.v = e.target LEFT JOIN ps s ON s.fn = e.fn AND s.v = i.ipdom AND s.u = b.u WHERE s.u IS NULL""")
def gr13(t):
    ipdom = flow.post_dominators(t.cfg_edges, t.cfg_nodes, _ends(t)[1])
    return flow.control_dependence(t.cfg_edges, ipdom)


_RD = """defs AS (SELECT fn, node, CAST(var AS VARCHAR) AS var, node % 5 <> 0 AS certain FROM cfg_nodes WHERE kind IN ('click', 'view')), uses AS (SELECT fn, node, CAST(var AS VARCHAR) AS var FROM cfg_nodes WHERE kind = 'purchase' UNION ALL SELECT fn, node, CAST((var + 1) % 3 AS VARCHAR) FROM cfg_nodes WHERE kind = 'view'),
 ee AS (SELECT DISTINCT fn, source, target, branch = 'normal' AND source % 11 = 0 AS bw FROM cfg_edges),
 rd AS (SELECT d.fn, d.node AS def, d.var, d.certain, e.target AS p FROM defs d JOIN ee e ON e.fn = d.fn AND e.source = d.node AND NOT e.bw UNION SELECT s.fn, s.def, s.var, s.certain, e.target FROM rd s JOIN ee e ON e.fn = s.fn AND e.source = s.p LEFT JOIN defs k ON k.fn = s.fn AND k.node = s.p AND k.var = s.var AND k.certain WHERE e.bw OR k.node IS NULL OR s.p = s.def),
 du AS (SELECT rd.fn, rd.def AS source, rd.p AS target, rd.var, CASE WHEN certain AND count(*) OVER (PARTITION BY rd.fn, rd.p, rd.var) = 1 THEN 'must' ELSE 'may' END AS certainty FROM rd JOIN uses u ON u.fn = rd.fn AND u.node = rd.p AND u.var = rd.var)"""


def _defs_uses(t):
    nodes, var = t.cfg_nodes, F.col("var")
    defs = nodes.filter("kind in ('click', 'view')").select("fn", "node", var.cast("string").alias("var"), (F.col("node") % 5 != 0).alias("certain"))
    uses = nodes.filter("kind = 'purchase'").select("fn", "node", var.cast("string").alias("var")).unionByName(nodes.filter("kind = 'view'").select("fn", "node", ((var + 1) % 3).cast("string").alias("var")))
    edges = t.cfg_edges.select("fn", "source", "target", ((F.col("branch") == "normal") & (F.col("source") % 11 == 0)).alias("before_write")).distinct()
    return edges, defs, uses


def _def_use(t):
    return flow.reaching_definitions(*_defs_uses(t))


@query("gr14_reaching_definitions", with_views("cfg_nodes", "cfg_edges", more=_RD) + "SELECT * FROM du")
def gr14(t):
    return _def_use(t)


_VF = """, tr AS (SELECT fn, node, CAST((var + 1) % 3 AS VARCHAR) AS in_var, CAST(var AS VARCHAR) AS out_var FROM cfg_nodes WHERE kind = 'view' AND node % 11 <> 0), nd AS (SELECT fn, node, count(*) AS n FROM defs GROUP BY ALL),
 vf AS (SELECT DISTINCT du.fn, source, target, du.var AS source_var, CASE WHEN tr.node IS NOT NULL AND target % 7 <> 0 THEN tr.out_var WHEN nd.n IS NULL OR tr.node IS NOT NULL THEN du.var ELSE d.var END AS target_var, CASE WHEN tr.node IS NOT NULL AND target % 7 <> 0 THEN 'copy' WHEN nd.n IS NULL OR tr.node IS NOT NULL THEN 'passthrough' WHEN target % 2 = 0 THEN 'call_result' ELSE 'assignment' END AS kind, certainty FROM du LEFT JOIN tr ON tr.fn = du.fn AND tr.node = du.target LEFT JOIN nd ON nd.fn = du.fn AND nd.node = du.target LEFT JOIN defs d ON d.fn = du.fn AND d.node = du.target),
 ve AS (SELECT fn, source, target, source_var, target_var, kind, CASE WHEN certainty = 'may' OR kind = 'call_result' THEN 'may' ELSE 'must' END AS certainty, concat('value-flow:', substr(sha256(concat_ws(chr(31), CAST(source AS VARCHAR), CAST(target AS VARCHAR), source_var, target_var, kind, source_var)), 1, 24)) AS edge_id FROM vf)"""


def _value_edges(t):
    nodes, var = t.cfg_nodes, F.col("var")
    transfers = nodes.filter("kind = 'view' and node % 11 <> 0").select("fn", "node", ((var + 1) % 3).cast("string").alias("in_var"), var.cast("string").alias("out_var"), F.lit("copy").alias("kind"), F.lit("must").alias("certainty"),
                                                                      F.when(F.col("node") % 7 == 0, "address").otherwise("value").alias("storage_mode"))
    calls = nodes.filter("node % 2 = 0").select("fn", "node")
    return flow.value_flow_edges(stored(_def_use(t)), transfers, _defs_uses(t)[1], calls)


@query("gr15_value_flow_edges", with_views("cfg_nodes", "cfg_edges", more=_RD + _VF) + "SELECT * FROM ve")
def gr15(t):
    return _value_edges(t)


_VP = """, pt AS (SELECT fn, source AS n0, source_var AS v0, target AS n, target_var AS v, [edge_id] AS ids, [concat(source, '|', source_var), concat(target, '|', target_var)] AS seen FROM ve WHERE source IN (SELECT node FROM cfg_nodes WHERE kind = 'click')
 UNION ALL SELECT p.fn, n0, v0, e.target, e.target_var, list_append(ids, e.edge_id), list_append(seen, concat(e.target, '|', e.target_var)) FROM pt p JOIN ve e ON e.fn = p.fn AND e.source = p.n AND e.source_var = p.v WHERE len(ids) < 4 AND NOT list_contains(seen, concat(e.target, '|', e.target_var)))"""


@query("gr17_value_paths", with_views("cfg_nodes", "cfg_edges", more=_RD + _VF + _VP) + "SELECT concat_ws('|', fn, n0, v0) AS s, concat_ws('|', pt.fn, n, v) AS t, array_to_string(ids, ',') AS edge_ids FROM pt WHERE n IN (SELECT node FROM cfg_nodes WHERE kind = 'purchase') AND concat(n, '|', v) IN (SELECT concat(node, '|', var) FROM cfg_nodes)")
def gr17(t):
    nodes = t.cfg_nodes.select("fn", "node", F.col("var").cast("string").alias("var"), "kind")
    found = flow.value_paths(stored(_value_edges(t)), nodes.filter("kind = 'click'"), nodes.filter("kind = 'purchase'"), max_depth=4, limit=None, max_states=None)
    return found.select("s", "t", F.array_join("edge_ids", ",").alias("edge_ids"))


_BO = """, cp AS (SELECT fn, node, CAST((var + 1) % 3 AS VARCHAR) AS i, CAST(var AS VARCHAR) AS o FROM cfg_nodes WHERE kind = 'view'), bo AS (SELECT fn, node AS use_node, CAST(var AS VARCHAR) AS use_var, node, CAST(var AS VARCHAR) AS var FROM cfg_nodes WHERE kind = 'purchase' UNION SELECT b.fn, use_node, use_var, cp.node, cp.i FROM bo b JOIN du ON du.fn = b.fn AND du.target = b.node AND du.var = b.var JOIN cp ON cp.fn = du.fn AND cp.node = du.source AND cp.o = du.var),
 og AS (SELECT DISTINCT b.fn, use_node, use_var, du.source AS origin, du.var AS origin_var FROM bo b JOIN du ON du.fn = b.fn AND du.target = b.node AND du.var = b.var LEFT JOIN cp ON cp.fn = du.fn AND cp.node = du.source AND cp.o = du.var WHERE cp.node IS NULL UNION SELECT DISTINCT b.fn, use_node, use_var, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR) FROM bo b LEFT JOIN du ON du.fn = b.fn AND du.target = b.node AND du.var = b.var WHERE du.source IS NULL)"""


def _origins(t, **how):
    nodes, var = t.cfg_nodes, F.col("var")
    copies = nodes.filter("kind = 'view'").select("fn", "node", ((var + 1) % 3).cast("string").alias("in_var"), var.cast("string").alias("out_var"))
    uses = nodes.filter("kind = 'purchase'").select("fn", "node", var.cast("string").alias("var"))
    return flow.backward_origins(uses, stored(_def_use(t)), copies, **how)


@query("gr26_backward_origins", with_views("cfg_nodes", "cfg_edges", more=_RD + _BO) + "SELECT * FROM og")
def gr26(t):
    return _origins(t)


_BO_DEPTH = """, bd AS (SELECT fn, node AS use_node, CAST(var AS VARCHAR) AS use_var, node, CAST(var AS VARCHAR) AS var, 0 AS d FROM cfg_nodes WHERE kind = 'purchase' UNION SELECT b.fn, use_node, use_var, cp.node, cp.i, d + 1 FROM bd b JOIN du ON du.fn = b.fn AND du.target = b.node AND du.var = b.var JOIN cp ON cp.fn = du.fn AND cp.node = du.source AND cp.o = du.var WHERE d < 2),
 bm AS (SELECT fn, use_node, use_var, node, var, min(d) AS d FROM bd GROUP BY ALL)"""


@query("gr26_backward_origins_depth", with_views("cfg_nodes", "cfg_edges", more=_RD + _BO + _BO_DEPTH) + """SELECT DISTINCT b.fn, use_node, use_var, du.source AS origin, du.var AS origin_var FROM bm b JOIN du ON du.fn = b.fn AND du.target = b.node AND du.var = b.var LEFT JOIN cp ON cp.fn = du.fn AND cp.node = du.source AND cp.o = du.var WHERE d < 2 AND cp.node IS NULL
 UNION SELECT DISTINCT b.fn, use_node, use_var, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR) FROM bm b LEFT JOIN du ON du.fn = b.fn AND du.target = b.node AND du.var = b.var WHERE d = 2 OR du.source IS NULL""")
def gr26_depth(t):
    return _origins(t, max_depth=1)


@query("gr16_constant_keys", with_views("cfg_nodes", "cfg_edges", more=_RD + _BO + """, lv AS (SELECT og.*, CASE WHEN n.node IS NOT NULL THEN concat('k', n.node % 4) END AS value FROM og LEFT JOIN cfg_nodes n ON n.fn = og.fn AND n.node = og.origin AND n.kind = 'click'),
 ck AS (SELECT fn, use_node, use_var, count(DISTINCT value) AS c, count(*) FILTER (WHERE value IS NULL) AS o, min(value) AS one FROM lv GROUP BY ALL), cc AS (SELECT *, CASE WHEN o > 0 OR c > 2 THEN 'unknown' WHEN c = 1 THEN 'exact' ELSE 'finite' END AS kind FROM ck)""") + "SELECT fn, use_node, use_var, kind, CASE WHEN kind = 'exact' THEN one END AS value, CASE WHEN kind <> 'unknown' THEN c END AS \"values\" FROM cc")
def gr16(t):
    literals = t.cfg_nodes.filter("kind = 'click'").select("fn", "node", F.col("var").cast("string").alias("var"), _txt("k", F.col("node") % 4).alias("value"))
    return flow.constant_keys(_origins(t), literals, 2)


_REF = """al AS (SELECT fn, node, concat('v', var) AS name, concat('a', node) AS alloc, node % 5 <> 0 AS certain FROM cfg_nodes WHERE kind = 'click'), cp AS (SELECT fn, node, concat('v', (var + 1) % 3) AS src, concat('v', var) AS dst FROM cfg_nodes WHERE kind = 'view'), ee AS (SELECT DISTINCT fn, source, target FROM cfg_edges),
 ar AS (SELECT al.fn, al.node AS a, ee.target AS p FROM al JOIN ee ON ee.fn = al.fn AND ee.source = al.node UNION SELECT ar.fn, a, ee.target FROM ar JOIN ee ON ee.fn = ar.fn AND ee.source = ar.p), bn AS (SELECT fn, node, name, alloc FROM al UNION ALL SELECT al.fn, node, name, 'unknown' FROM al JOIN ar ON ar.fn = al.fn AND ar.a = al.node AND ar.p = al.node),
 st AS (SELECT bn.fn, ee.target AS p, name, alloc FROM bn JOIN ee ON ee.fn = bn.fn AND ee.source = bn.node UNION SELECT * FROM (SELECT s.fn, ee.target AS p, unnest(list_filter([CASE WHEN (k.node IS NULL OR k.name <> s.name) AND (c.node IS NULL OR c.dst <> s.name) THEN s.name END, CASE WHEN c.src = s.name THEN c.dst END], lambda x: x IS NOT NULL)) AS name, s.alloc FROM st s JOIN ee ON ee.fn = s.fn AND ee.source = s.p LEFT JOIN al k ON k.fn = s.fn AND k.node = s.p AND k.certain LEFT JOIN cp c ON c.fn = s.fn AND c.node = s.p) z)"""


def _objects(t):
    nodes, var = t.cfg_nodes, F.col("var")
    allocs = nodes.filter("kind = 'click'").select("fn", "node", _txt("v", var).alias("name"), _txt("a", F.col("node")).alias("alloc"), (F.col("node") % 5 != 0).alias("certain"))
    copies = nodes.filter("kind = 'view'").select("fn", "node", _txt("v", (var + 1) % 3).alias("src"), _txt("v", var).alias("dst"), F.lit(True).alias("certain"))
    return allocs, copies


@query("gr22_may_refer", with_views("cfg_nodes", "cfg_edges", more=_REF) + "SELECT fn, p AS \"place\", name, alloc FROM st")
def gr22(t):
    allocs, copies = _objects(t)
    return flow.may_refer(t.cfg_edges, allocs, copies)[0].withColumnRenamed("at", "place")


@query("gr22_may_refer_fields")
def gr22_fields(t):
    """With field stores and loads; mutual growth of names and cells is tested against brute force."""
    nodes, var = t.cfg_nodes, F.col("var")
    stores = nodes.filter("kind = 'purchase'").select("fn", "node", _txt("v", var).alias("base"), F.lit("f").alias("field"), _txt("v", (var + 2) % 3).alias("value"))
    loads = nodes.filter("kind = 'signup'").select("fn", "node", F.lit("v0").alias("dst"), F.lit("v1").alias("base"), F.lit("f").alias("field"))
    return flow.may_refer(t.cfg_edges, *_objects(t), stores, loads)[0].withColumnRenamed("at", "place")


# behind a failing node references to the allocation two nodes before it are unknown, behind every 13th node all are
_INV = _REF.replace("st AS (", """iv AS (SELECT fn, node, concat('a', node - 2) AS alloc FROM cfg_nodes WHERE kind = 'error' UNION ALL SELECT fn, node, '*' FROM cfg_nodes WHERE node % 13 = 0),
 st AS (""", 1).replace("s.alloc FROM st s", "CASE WHEN s.alloc <> 'unknown' AND EXISTS (SELECT 1 FROM iv WHERE iv.fn = s.fn AND iv.node = s.p AND iv.alloc IN ('*', s.alloc)) THEN 'unknown' ELSE s.alloc END FROM st s")


@query("gr22_may_refer_invalidated", with_views("cfg_nodes", "cfg_edges", more=_INV) + "SELECT DISTINCT fn, p AS \"place\", name, alloc FROM st")
def gr22_invalidated(t):
    nodes = t.cfg_nodes
    invalid = nodes.filter("kind = 'error'").select("fn", "node", _txt("a", F.col("node") - 2).alias("alloc")).unionByName(nodes.filter("node % 13 = 0").select("fn", "node", F.lit("*").alias("alloc")))
    return flow.may_refer(t.cfg_edges, *_objects(t), invalidations=invalid)[0].withColumnRenamed("at", "place")


# a reference that more than three copies have touched gives its function up
_ALIAS = _REF + """, aa AS (SELECT cp.fn, ee.target AS p, dst AS name, cp.node AS alias FROM cp JOIN ee ON ee.fn = cp.fn AND ee.source = cp.node UNION SELECT * FROM (SELECT s.fn, ee.target AS p, unnest(list_filter([CASE WHEN (k.node IS NULL OR k.name <> s.name) AND (c.node IS NULL OR c.dst <> s.name) THEN s.name END, CASE WHEN c.src = s.name THEN c.dst END], lambda x: x IS NOT NULL)) AS name, s.alias FROM aa s JOIN ee ON ee.fn = s.fn AND ee.source = s.p LEFT JOIN al k ON k.fn = s.fn AND k.node = s.p AND k.certain LEFT JOIN cp c ON c.fn = s.fn AND c.node = s.p) z),
 gu AS (SELECT DISTINCT fn FROM (SELECT fn, p, name FROM aa WHERE (fn, p, name) IN (SELECT (fn, p, name) FROM st) GROUP BY ALL HAVING count(*) > 3) x)"""


@query("gr22_may_refer_aliases", with_views("cfg_nodes", "cfg_edges", more=_ALIAS) + "SELECT fn, p AS \"place\", name, alloc, false AS given_up FROM st WHERE fn NOT IN (SELECT fn FROM gu) UNION ALL SELECT fn, NULL, NULL, NULL, true FROM gu")
def gr22_aliases(t):
    return flow.may_refer(t.cfg_edges, *_objects(t), max_aliases=3)[0].withColumnRenamed("at", "place")


@query("gr27_prefer_complete_group", with_views("cfg_nodes") + "SELECT fn, node, CASE WHEN fn % 3 <> 0 AND fn % 5 <> 0 AND fn % 7 <> 0 THEN 'external' ELSE 'local' END AS origin FROM cfg_nodes WHERE NOT (fn % 3 <> 0 AND fn % 5 <> 0 AND fn % 7 <> 0) OR node % 2 = 0")
def gr27(t):
    return _complete(t)[0].select("fn", "node", "origin")


def _complete(t):
    local = t.cfg_nodes.select("fn", "node")
    external = local.filter("fn % 3 <> 0 and node % 2 = 0")
    fn = t.cfg_nodes.select("fn").distinct().filter("fn % 3 <> 0")
    check = lambda number, reason, ok: F.struct(F.lit(number).alias("ord"), F.lit(reason).alias("reason"), ok.alias("ok"))
    checks = fn.select("fn", F.inline(F.array(check(1, "location_mismatch", F.col("fn") % 5 != 0), check(2, "operation_unsupported", F.col("fn") % 7 != 0))))
    return flow.prefer_complete_group(external, local, checks, "fn")


@query("gr27_group_choice", with_views("cfg_nodes") + "SELECT DISTINCT fn, fn % 3 <> 0 AND fn % 5 <> 0 AND fn % 7 <> 0 AS \"external\", CASE WHEN fn % 3 = 0 THEN 'no_external_group' WHEN fn % 5 = 0 THEN 'location_mismatch' WHEN fn % 7 = 0 THEN 'operation_unsupported' END AS reason FROM cfg_nodes")
def gr27_choice(t):
    return _complete(t)[1]


def _compiler_values(t):
    """Each click or view writes a value; a purchase reads a merge of the values one and two steps before it."""
    nodes = t.cfg_nodes.select("fn", "node", "kind", "rn", _txt("v", F.col("var")).alias("name"))
    rn, none = F.col("rn"), F.array().cast("array<string>")
    span = lambda line, end, col, end_col: [F.lit("src.py").alias("path"), line.alias("line"), F.lit(col).alias("col"), end.alias("end_line"), F.lit(end_col).alias("end_col")]
    last = nodes.groupBy("fn").agg(F.max("rn").alias("rn"))
    local = last.select("fn", *span(F.lit(1), rn, 1, 90))
    native = last.select("fn", *span(F.lit(1), rn + F.when(F.col("fn") % 5 == 0, 1).otherwise(0), 1, 90))
    writes, reads = F.col("kind").isin("click", "view"), F.col("kind") == "purchase"
    operations = nodes.select("fn", "node", *span(rn, rn, 1, 80), F.when(reads, F.array("name")).otherwise(none).alias("uses"), F.when(writes, F.array("name")).otherwise(none).alias("defs"))
    value = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    row = lambda df, number, opcode, result, name, operands: df.select(
        "fn", (rn * 3 + number).alias("ord"), F.lit(opcode).alias("opcode"), F.lit(None).cast("string").alias("operator"), F.lit(None).cast("string").alias("invocation"), result.cast("string").alias("result"), name.cast("string").alias("name"),
        operands.alias("operands"), *span(rn, rn, 5, 9))
    null = F.lit(None)
    instructions = (
        row(nodes.filter(writes), 0, "DebugRef", null, F.col("name"), F.array(value("t", rn)))
        .unionByName(row(nodes.filter(reads & (F.col("node") % 97 != 0)), 0, "DebugRef", null, F.col("name"), F.array(value("p", rn))))
        .unionByName(row(nodes.filter(reads), 1, "Phi", value("p", rn), null, F.array(value("t", rn - 1), value("c", rn - 2))))
        .unionByName(row(nodes, 2, "Convert", value("c", rn), null, F.array(value("t", rn))))
        .unionByName(row(nodes.filter("fn % 7 = 0 and rn = 2"), 1, "Store", null, null, none))
    )
    return flow.compiler_values(local, native, operations, instructions)


_CV = """bad AS (SELECT fn, min(concat('v', var)) AS name FROM cfg_nodes WHERE kind = 'purchase' AND node % 97 = 0 GROUP BY fn),
 vd AS (SELECT DISTINCT n.fn, CASE WHEN n.fn % 5 = 0 THEN 'location_mismatch' WHEN n.fn % 7 = 0 AND x.rn >= 2 THEN 'operation_unsupported:Store' WHEN bad.fn IS NOT NULL THEN concat('read_not_mapped:', bad.name) END AS reason
  FROM cfg_nodes n JOIN (SELECT fn, max(rn) AS rn FROM cfg_nodes GROUP BY fn) x ON x.fn = n.fn LEFT JOIN bad ON bad.fn = n.fn)"""


@query("gr27_compiler_values", with_views("cfg_nodes", more=_CV) + """SELECT r.fn, w.node AS source, r.node AS target, concat('v', r.var) AS name FROM cfg_nodes r JOIN cfg_nodes w ON w.fn = r.fn AND w.rn IN (r.rn - 1, r.rn - 2) AND w.kind IN ('click', 'view') JOIN vd ON vd.fn = r.fn AND vd.reason IS NULL WHERE r.kind = 'purchase'""")
def gr27_values(t):
    return _compiler_values(t)[0]


@query("gr27_compiler_verdicts", with_views("cfg_nodes", more=_CV) + "SELECT fn, reason FROM vd")
def gr27_verdicts(t):
    return _compiler_values(t)[1]


_PRED = """pr AS (SELECT concat(run_id, '/', sequence // 400) AS path, concat('v', sequence % 3) AS var, CASE WHEN k % 10 = 0 THEN '==' WHEN event_type = 'run.started' THEN '>' WHEN event_type = 'model.started' THEN '<' WHEN event_type = 'model.completed' THEN '!=' WHEN event_type = 'tool.requested' THEN '>=' WHEN k % 9 = 0 THEN 'matches' ELSE '<=' END AS op, k AS value FROM run_events)"""
_FEAS = """, {p}b AS (SELECT path, var, max(CASE op WHEN '>=' THEN value WHEN '==' THEN value WHEN '>' THEN value + 1 END) AS lo, min(CASE op WHEN '<=' THEN value WHEN '==' THEN value WHEN '<' THEN value - 1 END) AS hi FROM {p} GROUP BY path, var),
 {p}h AS (SELECT b.path, b.var, count(DISTINCT p.value) AS n FROM {p}b b JOIN {p} p ON p.path = b.path AND p.var = b.var AND p.op = '!=' AND p.value BETWEEN lo AND hi GROUP BY b.path, b.var),
 {p}f AS (SELECT p.path, CASE WHEN p.path IN (SELECT b.path FROM {p}b b LEFT JOIN {p}h h ON h.path = b.path AND h.var = b.var WHERE lo > hi OR coalesce(n, 0) >= hi - lo + 1) THEN 'infeasible_under_model' WHEN bool_or(op = 'matches') THEN 'unknown' ELSE 'satisfiable_under_model' END AS status FROM {p} p GROUP BY p.path)"""


def _predicates(t):
    k, kind = F.col("k"), F.col("event_type")
    op = (
        F.when(k % 10 == 0, "==").when(kind == "run.started", ">").when(kind == "model.started", "<").when(kind == "model.completed", "!=").when(kind == "tool.requested", ">=")
        .when(k % 9 == 0, "matches").otherwise("<=")
    )
    return t.run_events.select(_txt("", F.col("run_id"), "/", F.floor(F.col("sequence") / 400)).alias("path"), _txt("v", F.col("sequence") % 3).alias("var"), op.alias("op"), k.alias("value"), F.lit(None).cast("string").alias("text"))


@query("gr28_branch_feasibility", with_views("run_events", more=_PRED + _FEAS.format(p="pr")) + "SELECT path, status FROM prf")
def gr28(t):
    return flow.branch_feasibility(_predicates(t))


@query("gr29_implies", with_views("run_events", more=_PRED + _FEAS.format(p="pr") + ", ng AS (SELECT * FROM pr UNION ALL SELECT DISTINCT path, 'v0', '>=', 60 FROM pr)" + _FEAS.format(p="ng")) + """SELECT path, CASE WHEN prf.status <> 'satisfiable_under_model' THEN 'unknown' WHEN ngf.status = 'infeasible_under_model' THEN 'implied_under_model' WHEN ngf.status = 'satisfiable_under_model' THEN 'counterexample_under_model' ELSE 'unknown' END AS status FROM prf JOIN ngf USING (path)""")
def gr29(t):
    predicates = _predicates(t)
    required = predicates.select("path").distinct().select("path", F.lit("v0").alias("var"), F.lit("<").alias("op"), F.lit(60).cast("long").alias("value"))
    return flow.implies(predicates, required)


# lines of an order in a row: each compares its name with that of the line before, and some with that of the first
_LINE = """ln AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus, l_tax) AS rn FROM lineitem)"""
_NAMES = _LINE + """, st AS (SELECT *, sum(CASE WHEN rn > 1 AND l_returnflag = 'A' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY rn) AS strict FROM ln),
 nf AS (SELECT concat('o', l_orderkey) AS path, bool_or(rn > 1 AND l_linestatus = 'O' AND strict > CAST(l_quantity AS BIGINT) % 3) AS bad, max(CASE WHEN rn = 3 THEN strict END) > 0 AS third FROM st GROUP BY l_orderkey)"""


def _lines(t):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", "l_tax")
    return t.lineitem.select("l_orderkey", "l_quantity", "l_returnflag", "l_linestatus", "l_tax", F.row_number().over(order).alias("rn"))


def _named_predicates(t):
    rn, flag, name = F.col("rn"), F.col("l_returnflag"), lambda n: F.concat(F.lit("l"), n.cast("string"))
    term = lambda op, other, value: F.struct(op.alias("op"), other.alias("other"), value.cast("long").alias("value"))
    before = term(F.when(flag == "A", ">").when(flag == "R", ">=").otherwise("=="), name(rn - 1), F.lit(0))
    first = term(F.lit("<="), F.lit("l1"), F.col("l_quantity").cast("long") % 3)
    terms = F.when(rn == 1, F.array(term(F.lit(">="), F.lit(None).cast("string"), F.lit(0)))).when(F.col("l_linestatus") == "O", F.array(before, first)).otherwise(F.array(before))
    rows = _lines(t).select(_txt("o", F.col("l_orderkey")).alias("path"), name(rn).alias("var"), F.explode(terms).alias("t"))
    return rows.select("path", "var", "t.op", "t.value", F.lit(None).cast("string").alias("text"), "t.other")


@query("gr28_branch_names", "WITH " + _NAMES + " SELECT path, CASE WHEN bad THEN 'infeasible_under_model' ELSE 'satisfiable_under_model' END AS status FROM nf")
def gr28_names(t):
    return flow.branch_feasibility(_named_predicates(t))


@query("gr29_implies_names", "WITH " + _NAMES + " SELECT path, CASE WHEN bad THEN 'unknown' WHEN third THEN 'implied_under_model' ELSE 'counterexample_under_model' END AS status FROM nf")
def gr29_names(t):
    predicates = stored(_named_predicates(t))
    required = predicates.select("path").distinct().select("path", F.lit("l3").alias("var"), F.lit(">").alias("op"), F.lit(0).cast("long").alias("value"), F.lit("l1").alias("other"))
    return flow.implies(predicates, required)


# every frame takes its name from the frame before it and from one shared by the whole route
@query("gr30_compose_route_names", "WITH " + _LINE + """ SELECT l_orderkey AS route, count(*) AS parts, CASE WHEN bool_or(l_tax >= 0.08) THEN 'unknown' WHEN max(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS BIGINT) END) > min(CASE WHEN l_returnflag <> 'A' THEN CAST(l_quantity AS BIGINT) + 20 END) THEN 'infeasible_under_model' ELSE 'satisfiable_under_model' END AS status FROM ln GROUP BY l_orderkey""")
def gr30_names(t):
    lines = _lines(t).select(F.col("l_orderkey").alias("route"), F.col("rn").alias("frame"), F.col("l_quantity").cast("long").alias("q"), (F.col("l_returnflag") == "A").alias("least"), "l_tax")
    parts = lines.select("route", F.col("frame").alias("part"), "frame", F.lit(False).alias("gap"))
    predicates = lines.select("route", "frame", F.lit("v").alias("var"), F.when(F.col("least"), ">=").otherwise("<=").alias("op"), F.when(F.col("least"), F.col("q")).otherwise(F.col("q") + 20).alias("value"), F.lit(None).cast("string").alias("text"))
    bind = lambda frame, name: F.struct(frame.alias("source_frame"), F.lit(name).alias("source_name"))
    sources = F.when(F.col("frame") > 1, F.array(bind(F.col("frame") - 1, "v"), bind(F.lit(0), "shared"))).otherwise(F.array(bind(F.lit(0), "shared")))
    bindings = lines.select("route", "frame", F.lit("v").alias("name"), F.explode(sources).alias("s"), (F.col("l_tax") < 0.08).alias("exact")).select("route", "frame", "name", "s.*", "exact")
    return flow.compose_route(parts, predicates, bindings)


_ROUTE = """pt AS (SELECT run_id AS route, sequence // 2500 AS part, bool_or(k = 50) AS gap FROM run_events GROUP BY ALL), rp AS (SELECT run_id AS path, CASE WHEN sequence % 2 = 0 THEN 'v0' ELSE concat('v1|', sequence // 2500) END AS var, CASE WHEN event_type IN ('run.started', 'model.started') THEN '>=' WHEN event_type = 'model.completed' THEN '<=' ELSE '!=' END AS op, CASE WHEN event_type IN ('run.started', 'model.started') THEN k % 45 WHEN event_type = 'model.completed' THEN 44 + k ELSE k END AS value FROM run_events)"""


@query("gr30_compose_route", with_views("run_events", more=_ROUTE + _FEAS.format(p="rp")) + "SELECT route, count(*) AS parts, CASE WHEN bool_or(gap) OR count(*) > 32 OR (max(part) > 0 AND route % 5 = 0) THEN 'unknown' ELSE max(status) END AS status FROM pt LEFT JOIN rpf ON rpf.path = route GROUP BY route")
def gr30(t):
    part, k, kind = F.floor(F.col("sequence") / 2500), F.col("k"), F.col("event_type")
    parts = t.run_events.groupBy(F.col("run_id").alias("route"), part.alias("part")).agg(F.bool_or(k == 50).alias("gap")).withColumn("frame", F.col("part"))
    low, high = kind.isin("run.started", "model.started"), kind == "model.completed"
    predicates = t.run_events.select(F.col("run_id").alias("route"), part.alias("frame"), F.when(F.col("sequence") % 2 == 0, "v0").otherwise("v1").alias("var"), F.when(low, ">=").when(high, "<=").otherwise("!=").alias("op"),
                                     F.when(low, k % 45).when(high, 44 + k).otherwise(k).alias("value"), F.lit(None).cast("string").alias("text"))
    # every frame takes v0 from the frame before it that the route has, its first one from frame 0: numbers without a part make no rows
    before = F.lag("frame", 1, 0).over(Window.partitionBy("route").orderBy("frame"))
    frames = parts.select("route", "frame", before.alias("source_frame")).filter("frame > 0")
    bindings = frames.select("route", "frame", F.lit("v0").alias("name"), "source_frame", F.lit("v0").alias("source_name"), (F.col("route") % 5 != 0).alias("exact"))
    return flow.compose_route(parts, predicates, bindings)


_SPANS = """sp AS (SELECT run_id, min(sequence) AS lo, max(sequence) AS hi FROM run_events GROUP BY run_id), rg AS (SELECT concat('w/', run_id) AS region, run_id, lo AS a, hi AS b FROM sp UNION ALL SELECT concat('h/', run_id), run_id, lo, (lo + hi) // 2 FROM sp UNION ALL SELECT concat('q/', run_id), run_id, (lo + hi) // 4, (lo + hi) // 3 FROM sp)"""


def _regions(t):
    spans = t.run_events.groupBy("run_id").agg(F.min("sequence").alias("lo"), F.max("sequence").alias("hi"))
    both = F.col("lo") + F.col("hi")
    part = lambda tag, a, b: F.struct(_txt(tag, F.col("run_id")).alias("region"), a.alias("line"), b.alias("end_line"))
    rows = spans.select("run_id", F.inline(F.array(part("w/", F.col("lo"), F.col("hi")), part("h/", F.col("lo"), F.floor(both / 2)), part("q/", F.floor(both / 4), F.floor(both / 3)))))
    return rows.select("region", F.col("run_id").alias("path"), "line", F.lit(1).alias("col"), "end_line", F.lit(1).alias("end_col"), F.col("run_id").alias("fn"))


@query("join18_locate", with_views("run_events", more=_SPANS) + "SELECT id, region FROM (SELECT sequence AS id, region, row_number() OVER (PARTITION BY sequence ORDER BY b - a, region) AS rn FROM run_events e JOIN rg ON rg.run_id = e.run_id AND sequence BETWEEN a AND b) x WHERE rn = 1")
def join18(t):
    points = t.run_events.select(F.col("sequence").alias("id"), F.col("run_id").alias("path"), F.col("sequence").alias("line"), F.lit(1).alias("col"))
    return flow.locate(points, _regions(t))


@query("join19_match_location", """SELECT concat_ws('/', a.l_orderkey, a.l_linenumber, a.l_partkey, a.l_suppkey) AS query_id, concat_ws('/', b.l_orderkey, b.l_linenumber, b.l_partkey, b.l_suppkey) AS call_id FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber AND b.l_returnflag = 'A' AND (a.l_partkey % 3 = 0 OR a.l_partkey % 3 = b.l_suppkey % 3)""")
def join19(t):
    ident = F.concat_ws("/", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    place = lambda col: [F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("line"), col.alias("col"), F.lit(0).alias("end_line"), F.lit(0).alias("end_col"), F.lit("").alias("location_id")]
    queries = t.lineitem.select(ident.alias("query_id"), *place(F.col("l_partkey") % 3))
    calls = t.lineitem.filter("l_returnflag = 'A'").select(ident.alias("call_id"), *place(F.col("l_suppkey") % 3))
    return flow.match_location(queries, calls)


_BIND = """ar AS (SELECT concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS aid, l_orderkey AS call, concat('t', l_orderkey % 50) AS target, CASE WHEN l_orderkey % 2 = 0 THEN 'python' ELSE 'go' END AS lang, CASE WHEN l_linenumber <> 5 THEN l_linenumber - 1 END AS pos, CASE WHEN l_linenumber = 5 THEN concat('k', l_partkey % 3) END AS kw, concat('v', l_partkey) AS value, l_linenumber = 4 AND l_partkey % 5 = 0 AS spread FROM lineitem),
 pm AS (SELECT target, unnest([0, 1, 2, 3, 10, 11]) AS position, unnest(['p0', 'p1', 'p2', 'p3', 'k0', 'k1']) AS name, unnest([NULL, NULL, NULL, 'd3', 'd0', NULL]) AS dflt FROM (SELECT DISTINCT concat('t', o_orderkey % 50) AS target FROM orders) z),
 sp AS (SELECT call, min(pos) FILTER (WHERE spread) AS stop, bool_or(spread) AS any_spread FROM ar GROUP BY call), wk AS (SELECT ar.*, stop, any_spread, pos + CASE WHEN lang = 'go' THEN 1 ELSE 0 END AS slot FROM ar JOIN sp USING (call)),
 bd AS (SELECT w.call, w.target, p.name AS parameter, value, 'positional' AS how FROM wk w JOIN pm p ON p.target = w.target AND p.position = w.slot WHERE NOT spread AND (stop IS NULL OR pos < stop) UNION ALL SELECT w.call, w.target, concat('rest[', w.slot - 4, ']'), value, 'variadic' FROM wk w WHERE NOT spread AND (stop IS NULL OR pos < stop) AND slot >= 4 AND CAST(substr(w.target, 2) AS INT) % 2 = 0
  UNION ALL SELECT w.call, w.target, kw, value, 'keyword' FROM wk w JOIN pm p ON p.target = w.target AND p.name = w.kw WHERE lang = 'python')"""


def _bound(t, languages):
    key = F.col("l_orderkey")
    arguments = t.lineitem.select(key.alias("call"), _txt("t", key % 50).alias("target"), F.when(key % 2 == 0, "python").otherwise("go").alias("language"), F.when(F.col("l_linenumber") != 5, F.col("l_linenumber") - 1).alias("position"),
                                  F.when(F.col("l_linenumber") == 5, _txt("k", F.col("l_partkey") % 3)).alias("keyword"), _txt("v", F.col("l_partkey")).alias("value"), ((F.col("l_linenumber") == 4) & (F.col("l_partkey") % 5 == 0)).alias("spread"))
    cell = lambda position, name, default: F.struct(F.lit(position).alias("position"), F.lit(name).alias("name"), F.lit(name == "rest").alias("variadic"), F.lit(default).cast("string").alias("default"))
    cells = [cell(0, "p0", None), cell(1, "p1", None), cell(2, "p2", None), cell(3, "p3", "d3"), cell(10, "k0", "d0"), cell(11, "k1", None), cell(4, "rest", None)]
    targets = t.orders.select((F.col("o_orderkey") % 50).alias("n")).distinct()
    parameters = targets.select("n", F.inline(F.array(*cells))).filter("not variadic or n % 2 = 0").select(_txt("t", F.col("n")).alias("target"), "position", "name", "variadic", "default")
    policies = t.spark.createDataFrame(languages, "language string, positional boolean, by_keyword boolean, receiver_offset int")
    return flow.bind_arguments(arguments, parameters, policies)


@query("join20_bind_arguments", "WITH " + _BIND + """ SELECT call, target, parameter, value, how FROM bd UNION ALL SELECT c.call, c.target, p.name, p.dflt, 'default' FROM (SELECT DISTINCT call, target FROM wk WHERE NOT any_spread) c JOIN pm p ON p.target = c.target AND p.dflt IS NOT NULL WHERE NOT EXISTS (SELECT 1 FROM bd WHERE bd.call = c.call AND bd.parameter = p.name)""")
def join20(t):
    return _bound(t, [("python", True, True, 0), ("go", True, False, 1)]).select("call", "target", "parameter", "value", "how")


@query("ext03_binding_policy", "WITH " + _BIND + " SELECT call, target, kw AS parameter, value, 'keyword' AS how FROM wk w JOIN pm p USING (target) WHERE p.name = kw AND lang = 'python'")
def ext03(t):
    """Another language binding is another policy row: here one that binds keywords only."""
    bound = _bound(t, [("python", False, True, 0), ("go", False, False, 0)])
    return bound.filter("how <> 'default'").select("call", "target", "parameter", "value", "how")


@query("join38_bind_value_boundaries", with_views("run_events") + """SELECT e.sequence AS id, e.run_id AS source_fn, e.sequence AS source_node, f.run_id AS target_fn, f.sequence AS target_node FROM run_events e JOIN run_events f ON f.sequence = e.sequence + 1 WHERE e.event_type = 'tool.requested' AND f.event_type IN ('model.completed', 'model.started') AND e.sequence % 13 <> 0 AND f.sequence % 13 <> 0""")
def join38(t):
    e = t.run_events
    var = lambda c: _txt("v", c % 3)
    none = F.array().cast("array<string>")
    nodes = e.select(F.col("run_id").alias("fn"), F.col("sequence").alias("node"), F.col("run_id").alias("path"), F.col("sequence").alias("line"), F.when(F.col("event_type") == "tool.requested", F.array(var(F.col("sequence")))).otherwise(none).alias("uses"),
                     F.when(F.col("event_type").isin("model.completed", "model.started"), F.array(var(F.col("sequence")))).otherwise(none).alias("defs"))
    after = e.select((F.col("sequence") - 1).alias("sequence"), F.col("run_id").alias("target_path"), F.col("sequence").alias("target_line"), F.array(var(F.col("sequence"))).alias("target_names"))
    sent = e.filter("event_type = 'tool.requested'").select("sequence", F.col("run_id").alias("source_path"), F.col("sequence").alias("source_line"), F.array(var(F.col("sequence"))).alias("source_names"))
    spans = e.groupBy("run_id").agg(F.min("sequence").alias("line"), F.max("sequence").alias("end_line"))
    functions = spans.select(F.col("run_id").alias("region"), F.col("run_id").alias("path"), "line", F.lit(1).alias("col"), "end_line", F.lit(1).alias("end_col"))
    boundaries = sent.join(after, "sequence").withColumnRenamed("sequence", "id")
    return flow.bind_value_boundaries(boundaries, functions, nodes, nodes.filter("node % 13 <> 0").select("fn", "node"))


def _program_tables(t):
    """Customers call orders, orders call suppliers; values go down as arguments and come back as results."""
    # equal rows go once and while they are narrow
    keys, yes = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), lambda cond: F.coalesce(cond, F.lit(False))
    line = stored(t.lineitem.select(*keys, yes(F.col("l_discount") >= 0.05).alias("doubted"), yes(F.col("l_returnflag") == "R").alias("virtual")).distinct())
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").distinct()
    customer, supplier, lid = t.customer.select("c_custkey").distinct(), t.supplier.select("s_suppkey").distinct(), F.concat_ws("/", F.lit("k2"), *[F.col(c).cast("string") for c in keys])
    k1, c, order, s = _txt("k1/", F.col("o_orderkey")), _txt("c/", F.col("o_custkey")), _txt("o/", F.col("o_orderkey")), _txt("s/", F.col("s_suppkey"))
    row = lambda df, fn, var, kind, ident, name, certainty: df.select(fn.alias("fn"), F.lit(var).alias("var"), F.lit(kind).alias("use_kind"), ident.alias("use_id"), F.lit(name).alias("name"), certainty.alias("certainty"))
    must = F.lit("must")
    local = (
        row(o, c, "x", "call", k1, "a", must).unionByName(row(customer, _txt("c/", F.col("c_custkey")), "res", "sink", _txt("usec/", F.col("c_custkey")), "res", must))
        .unionByName(row(line, _txt("o/", F.col("l_orderkey")), "p", "call", lid, "b", F.when(F.col("doubted"), "may").otherwise("must")))
        .unionByName(row(o.filter("o_orderstatus <> 'P'"), order, "r", "return", F.lit("ret"), "r", must))
        .unionByName(row(supplier, s, "q", "sink", _txt("uses/", F.col("s_suppkey")), "q", must)).unionByName(row(supplier.filter("s_suppkey % 2 = 0"), s, "q", "return", F.lit("ret"), "q", must))
        .unionByName(row(t.nation.select("n_nationkey").distinct(), _txt("n/", F.col("n_nationkey")), "z", "sink", _txt("usen/", F.col("n_nationkey")), "z", must))
    )
    calls = o.select(k1.alias("call_id"), c.alias("caller"), order.alias("callee"), must.alias("certainty")).unionByName(
        line.select(lid.alias("call_id"), _txt("o/", F.col("l_orderkey")).alias("caller"), _txt("s/", F.col("l_suppkey")).alias("callee"), F.when(F.col("virtual"), "may").otherwise("must").alias("certainty")))
    bindings = o.filter("o_orderpriority <> '4-NOT SPECIFIED'").select(k1.alias("call_id"), F.lit("a").alias("name"), F.lit("p").alias("param")).unionByName(line.select(lid.alias("call_id"), F.lit("b").alias("name"), F.lit("q").alias("param")))
    results = o.select(k1.alias("call_id"), F.lit("res").alias("result")).unionByName(line.select(lid.alias("call_id"), F.lit("r").alias("result")))
    sinks = local.filter("use_kind = 'sink'").select("use_id", F.concat(F.lit("snk:"), "use_id").alias("snk"))
    sources = customer.select(_txt("src/", F.col("c_custkey")).alias("src"), _txt("c/", F.col("c_custkey")).alias("fn"), F.lit("x").alias("var"))
    return sources, local, calls, bindings, results, sinks


_TAINT = """ln AS (SELECT DISTINCT concat('src/', c_custkey) AS src, c_custkey, o_orderkey, o_orderstatus, l_suppkey, s_nationkey, concat_ws('/', 'k2', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k2, l_returnflag, l_discount, l_tax FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE o_orderpriority <> '4-NOT SPECIFIED'),
 tf AS (SELECT src, concat('snk:uses/', l_suppkey) AS snk, concat('call:k1/', o_orderkey, ',call:', k2) AS steps, CASE WHEN l_returnflag = 'R' OR l_discount >= 0.05 THEN 'may' ELSE 'must' END AS certainty FROM ln UNION ALL SELECT src, concat('snk:usec/', c_custkey), concat('call:k1/', o_orderkey, ',call:', k2, ',return:', k2, ',return:k1/', o_orderkey), CASE WHEN l_returnflag = 'R' OR l_discount >= 0.05 THEN 'may' ELSE 'must' END FROM ln WHERE l_suppkey % 2 = 0 AND o_orderstatus <> 'P')"""


@query("gr18_propagate_taint", "WITH " + _TAINT + " SELECT * FROM tf")
def gr18(t):
    flows, _ = flow.propagate_taint(*_program_tables(t), max_states=None, max_variants=None)
    return flows.select("src", "snk", F.array_join("steps", ",").alias("steps"), "certainty")


@query("gr18_propagate_taint_budget", "WITH " + _TAINT + " SELECT src, snk, steps, certainty FROM (SELECT *, row_number() OVER (PARTITION BY src, snk ORDER BY len(string_split(steps, ',')), string_split(steps, ',')) AS rn FROM tf) x WHERE rn <= 2")
def gr18_budget(t):
    flows, _ = flow.propagate_taint(*_program_tables(t), max_states=2048, max_variants=2)
    return flows.select("src", "snk", F.array_join("steps", ",").alias("steps"), "certainty")


@query("gr19_taint_frontier", "WITH " + _TAINT + " SELECT src, k2 AS call_id, 'external_api_semantics_unknown' AS reason, concat('call:k1/', o_orderkey) AS known_prefix, 0 AS omitted_steps FROM ln WHERE l_tax >= 0.08")
def gr19(t):
    tables = _program_tables(t)
    _, states = flow.propagate_taint(*tables, max_states=None, max_variants=None)
    lid = F.concat_ws("/", F.lit("k2"), *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    unresolved = t.lineitem.filter("l_tax >= 0.08").select(lid.alias("call_id"), F.lit("external_api_semantics_unknown").alias("reason")).distinct()
    met = flow.taint_frontier(states, tables[1], unresolved)
    return met.select("src", "call_id", "reason", F.array_join("known_prefix", ",").alias("known_prefix"), "omitted_steps")


@query("gr20_cross_boundaries", "WITH " + _TAINT + " SELECT src, concat('snk:usen/', s_nationkey) AS snk, concat('call:k1/', o_orderkey, ',call:', k2, ',boundary:b', l_suppkey) AS steps, 'may' AS certainty FROM ln")
def gr20(t):
    boundaries = t.supplier.select(_txt("b", F.col("s_suppkey")).alias("boundary_id"), _txt("s/", F.col("s_suppkey")).alias("fn"), F.lit("q").alias("var"), _txt("n/", F.col("s_nationkey")).alias("to_fn"), F.lit("z").alias("to_var"))
    flows, _ = flow.propagate_taint(*_program_tables(t), boundaries=boundaries, max_states=None, max_variants=None)
    return flows.filter("snk like 'snk:usen/%'").select("src", "snk", F.array_join("steps", ",").alias("steps"), "certainty")


_ROLES = """r0 AS (SELECT concat('c/', c_custkey) AS fn, 'a' AS param, c_mktsegment AS role, [] :: VARCHAR[] AS route FROM customer), r1 AS (SELECT concat('o/', o_orderkey) AS fn, 'b' AS param, role, [concat('k1/', o_orderkey)] AS route FROM r0 JOIN orders ON concat('c/', o_custkey) = r0.fn),
 r2 AS (SELECT concat('s/', l_suppkey) AS fn, 'd' AS param, role, min(list_append(route, concat('k2/', l_orderkey, '/', l_linenumber))) AS route FROM r1 JOIN lineitem ON concat('o/', l_orderkey) = r1.fn GROUP BY ALL HAVING true), al AS (SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2), n AS (SELECT fn, param, count(*) AS roles FROM al GROUP BY ALL)"""
_ROLES = _ROLES.replace("GROUP BY ALL HAVING true", "GROUP BY 1, 2, 3")


def _roles(t):
    parameters = t.customer.select(_txt("c/", F.col("c_custkey")).alias("fn"), F.lit("a").alias("param"), F.col("c_mktsegment").alias("role"))
    passes = t.orders.select(_txt("c/", F.col("o_custkey")).alias("fn"), F.lit("a").alias("param"), _txt("k1/", F.col("o_orderkey")).alias("call"), _txt("o/", F.col("o_orderkey")).alias("target"), F.lit("b").alias("target_param")).unionByName(
        t.lineitem.select(_txt("o/", F.col("l_orderkey")).alias("fn"), F.lit("b").alias("param"), _txt("k2/", F.col("l_orderkey"), "/", F.col("l_linenumber")).alias("call"), _txt("s/", F.col("l_suppkey")).alias("target"), F.lit("d").alias("target_param")))
    return flow.forward_roles(parameters, passes)


@query("gr21_forward_roles", "WITH " + _ROLES + " SELECT fn, param, role, array_to_string(route, ',') AS route FROM al WHERE (fn, param) IN (SELECT (fn, param) FROM n WHERE roles = 1)")
def gr21(t):
    return _roles(t)[0].select("fn", "param", "role", F.array_join("route", ",").alias("route"))


@query("gr21_ambiguous_roles", "WITH " + _ROLES + " SELECT fn, param, roles FROM n WHERE roles > 1")
def gr21_ambiguous(t):
    return _roles(t)[1]


_EG = """op AS (SELECT concat('supplier/', s_suppkey) AS id FROM supplier), ca AS (SELECT * FROM g_edges WHERE relation = 'calls'),
 c1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY id) AS rn FROM ca WHERE target IN (SELECT id FROM op)) z WHERE rn <= 3), c2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY id) AS rn FROM ca WHERE target IN (SELECT source FROM c1)) z WHERE rn <= 3),
 us AS (SELECT DISTINCT * FROM g_edges WHERE id IN (SELECT e1 FROM candidates UNION SELECT e2 FROM candidates UNION SELECT id FROM c1 UNION SELECT id FROM c2))"""


def _evidence_graph(t):
    routes = t.candidates.select(F.col("candidate_id").alias("route"), F.array("s", "mid", "t").alias("nodes"), F.array("e1", "e2").alias("edge_ids"))
    operations = t.supplier.select(_txt("supplier/", F.col("s_suppkey")).alias("id"))
    return flow.evidence_graph(routes, operations, t.g_edges, per_target=3)


@query("gr31_evidence_graph_edges", with_views("candidates", "g_edges", more=_EG) + "SELECT source, target, relation, dispatch, min(id) AS id, count(*) AS occurrence_count FROM us GROUP BY ALL")
def gr31(t):
    return _evidence_graph(t)[1]


@query("gr31_evidence_graph_nodes", with_views("candidates", "g_edges", more=_EG) + "SELECT id, CASE min(o) WHEN 0 THEN 'route' WHEN 1 THEN 'operation' ELSE 'context' END AS role FROM (SELECT unnest([s, mid, t]) AS id, 0 AS o FROM candidates UNION ALL SELECT id, 1 FROM op UNION ALL SELECT source, 2 FROM c1 UNION ALL SELECT source, 2 FROM c2) x GROUP BY id")
def gr31_nodes(t):
    return _evidence_graph(t)[0]


_BC = """ul AS (SELECT concat('u/', l_orderkey, '/', l_linenumber, '/', l_partkey, '/', l_suppkey) AS id, concat('order/', l_orderkey) AS symbol FROM lineitem WHERE l_tax >= 0.06), rk AS (SELECT *, CASE WHEN kind = 'propagation_path' THEN 1 ELSE 2 END AS phase, concat(e1, ',', e2) AS edge_key, row_number() OVER (PARTITION BY src, snk, kind ORDER BY col, concat(e1, ',', e2)) AS variant_no FROM candidates),
 ch AS (SELECT * FROM rk), mk AS (SELECT *, concat('candidate:', substr(sha256(concat_ws(chr(31), src, snk, edge_key, CASE WHEN phase = 1 THEN concat('flow/', e2) ELSE 'structural' END)), 1, 24)) AS cid FROM ch)"""


@query("gr32_build_candidates", with_views("candidates", "facts", more=_BC) + """SELECT cid AS candidate_id, path_group_id, src, snk, phase, CAST(variant_no AS INT) AS variant_no, kind, (SELECT count(*) FROM facts f WHERE f.symbol = mid AND fact_kind = 'guard') AS guards, (SELECT count(*) FROM facts f WHERE f.symbol = mid AND fact_kind = 'sanitizer') AS sanitizers, (SELECT count(*) FROM ul WHERE ul.symbol = mid) AS unresolved FROM mk""")
def gr32(t):
    rows = t.candidates.select("src", "snk", F.array("s", "mid", "t").alias("nodes"), F.array("e1", "e2").alias("edge_ids"), F.concat_ws(",", "e1", "e2").alias("edge_key"), F.col("col").alias("steps"), "kind", F.concat(F.lit("flow/"), "e2").alias("flow_id"))
    flows = rows.filter("kind = 'propagation_path'").drop("kind")
    leads = rows.filter("kind <> 'propagation_path'").drop("kind").withColumn("flow_id", F.lit(None).cast("string"))
    unresolved = t.lineitem.filter("l_tax >= 0.06").select(F.concat_ws("/", F.lit("u"), *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("id"), _txt("order/", F.col("l_orderkey")).alias("symbol"))
    made = flow.build_candidates(flows, leads, t.facts, unresolved)
    return made.select("candidate_id", "path_group_id", "src", "snk", "phase", "variant_no", "kind", "guards", "sanitizers", "unresolved")
