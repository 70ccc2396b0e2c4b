"""Corpus queries: files, lines, search, snippets, stacks and stored results."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracewell.functions import redact
from tracewell.functions.text import url_host
from tracewell.operators import corpus, graphs
from tracewell.operators.skew import with_neighbour
from tracewell.plans.registry import query
from tracewell.session import ensure_checkpoint_dir
from tracewell.sources import documents, files
from tracewell.views import with_views

LANG = "CASE lang WHEN 'en' THEN 'python' WHEN 'fr' THEN 'javascript' WHEN 'de' THEN 'go' ELSE 'java' END"


@query("src01_scan_corpus", with_views("v_files") + f"SELECT path, {LANG} AS language, CASE WHEN doc_id % 8 = 3 THEN 'metadata_unavailable' WHEN n_chars > 2000 THEN 'file_too_large' END AS reason FROM v_files WHERE doc_id % 8 IN (3, 5, 6, 7)")
def src01(t):
    key, path = F.col("doc_id") % 8, F.col("path")
    noisy = (
        F.when(key == 0, F.concat(F.lit("node_modules/"), path)).when(key == 1, F.concat(F.lit("a/.hidden/"), path)).when(key == 2, F.concat(path, F.lit(".min.js")))
        .when(key == 4, F.concat(path, F.lit(".txt"))).otherwise(path)
    )
    tree = t.v_files.select(noisy.alias("path"), F.when(key != 3, F.col("n_chars")).alias("size"))
    kept, skipped = corpus.scan_corpus(tree, max_bytes=2000)
    return kept.select("path", "language", F.lit(None).cast("string").alias("reason")).unionByName(skipped.select("path", "language", "reason"))


_HEAD = "h AS (SELECT doc_id, concat('d/', doc_id // 3, CASE doc_id % 3 WHEN 0 THEN '.h' WHEN 1 THEN CASE WHEN doc_id % 2 = 0 THEN '.cpp' ELSE '.txt' END ELSE CASE WHEN doc_id % 5 < 2 THEN '.c' ELSE '.go' END END) AS path, CASE WHEN lang = 'en' THEN concat('class ', text) ELSE text END AS text, doc_id // 3 AS stem FROM documents)"


@query("src02_detect_language", "WITH " + _HEAD + r""" SELECT path, CASE WHEN path LIKE '%.cpp' THEN 'cpp' WHEN path LIKE '%.c' THEN 'c' WHEN path LIKE '%.go' THEN 'go' WHEN path LIKE '%.txt' THEN NULL
 WHEN EXISTS (SELECT 1 FROM h x WHERE x.path = concat('d/', h.stem, '.cpp')) THEN 'cpp' WHEN EXISTS (SELECT 1 FROM h x WHERE x.path = concat('d/', h.stem, '.c')) THEN 'c'
 WHEN regexp_matches(substr(text, 1, 65536), 'namespace |class |template<|template <|public:|private:|protected:|::|virtual |operator|nullptr') THEN 'cpp' ELSE 'c' END AS language FROM h""")
def src02(t):
    key = F.col("doc_id")
    ext = (
        F.when(key % 3 == 0, ".h").when(key % 3 == 1, F.when(key % 2 == 0, ".cpp").otherwise(".txt")).otherwise(F.when(key % 5 < 2, ".c").otherwise(".go"))
    )
    tree = t.documents.select(F.concat(F.lit("d/"), F.floor(key / 3).cast("string"), ext).alias("path"), F.when(F.col("lang") == "en", F.concat(F.lit("class "), "text")).otherwise(F.col("text")).alias("text"))
    return corpus.detect_language(tree).select("path", "language")


def _entries(t):
    key, path = F.col("doc_id") % 9, F.col("path")
    name = (
        F.when(key == 0, F.concat(F.lit("Build/"), path)).when(key == 1, F.concat(F.lit("x/.env.local"))).when(key == 2, F.concat(path, F.lit(".ZIP")))
        .when(key == 3, F.lit("y/id_rsa")).otherwise(path)
    )
    return t.v_files.select("project_id", "doc_id", name.alias("path"), F.col("n_chars").alias("size"), (key == 4).alias("is_link"))


@query("src03_sanitize_corpus", with_views("v_files") + """SELECT project_id, count(*) FILTER (WHERE r <> 'noise') AS scanned_files, count(*) FILTER (WHERE r NOT IN ('noise', 'kept')) AS filtered_out_files, count(*) FILTER (WHERE r = 'sensitive') AS removed_sensitive_files,
 count(*) FILTER (WHERE r = 'forbidden') AS removed_forbidden_files, count(*) FILTER (WHERE r = 'big') AS removed_oversized_files, count(*) FILTER (WHERE r = 'link') AS removed_links, count(*) FILTER (WHERE r = 'noise') AS removed_noise_entries,
 CAST(coalesce(sum(n_chars) FILTER (WHERE r NOT IN ('noise', 'link')), 0) AS BIGINT) AS total_bytes, coalesce(sum(n_chars) FILTER (WHERE r NOT IN ('noise', 'link')), 0) <= 60000 AS within_policy
 FROM (SELECT *, CASE doc_id % 9 WHEN 0 THEN 'noise' WHEN 1 THEN 'sensitive' WHEN 2 THEN 'forbidden' WHEN 3 THEN 'sensitive' WHEN 4 THEN 'link' ELSE CASE WHEN n_chars > 5000 THEN 'big' ELSE 'kept' END END AS r FROM v_files) x GROUP BY project_id""")
def src03(t):
    return corpus.sanitize_corpus(_entries(t), max_total_bytes=60_000, max_file_bytes=5000, per=["project_id"])


_ARCH = """e AS (SELECT project_id, doc_id, n_chars, CASE WHEN doc_id % 11 = 0 THEN 'unsafe_path' WHEN doc_id % 11 = 1 THEN 'special_file' WHEN n_chars / greatest(1 + doc_id % 50, 1) > 200 THEN 'compression_ratio' WHEN doc_id % 11 = 2 THEN 'link_skipped' END AS v FROM v_files),
 s AS (SELECT *, CAST(sum(CASE WHEN v IS NULL THEN n_chars ELSE 0 END) OVER (PARTITION BY project_id ORDER BY doc_id) AS BIGINT) AS total FROM e)"""


@query("src04_audit_archive_entries", with_views("v_files", more=_ARCH) + "SELECT project_id, doc_id AS idx, total AS extracted_bytes, coalesce(CASE WHEN v IS NULL AND total > 30000 THEN 'total_size' END, v, 'ok') AS verdict FROM s")
def src04(t):
    key, path = F.col("doc_id") % 11, F.col("path")
    name = F.when(key == 0, F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("a/../"), path)).otherwise(F.concat(F.lit("C:\\"), path))).otherwise(path)
    mode = F.when(key == 1, 0o060644).when(key == 2, 0o120777).otherwise(0o100644)
    entries = t.v_files.select("project_id", F.col("doc_id").alias("idx"), name.alias("name"), F.col("n_chars").alias("size"), (F.col("doc_id") % 50 + 1).alias("compressed"), mode.alias("mode"))
    audited = corpus.audit_archive_entries(entries, "project_id", max_total=30_000, block_size=64)
    return audited.select("project_id", "idx", F.col("extracted_bytes").cast("long").alias("extracted_bytes"), "verdict")


@query("src05_explode_lines", with_views("v_files") + """SELECT path, CAST(generate_subscripts(string_split(b, chr(10)), 1) AS INT) AS line, unnest(string_split(b, chr(10))) AS text FROM (SELECT path, regexp_replace(text, '\\n$', '') AS b FROM v_files WHERE doc_id % 10 > 1 AND text <> '') x""")
def src05(t):
    key = F.col("doc_id") % 10
    raw = F.encode("text", "UTF-8")
    content = F.when(key == 0, F.concat(F.unhex(F.lit("00")), raw)).when(key == 1, F.concat(raw, F.unhex(F.lit("FF")))).otherwise(raw)
    return corpus.explode_lines(t.v_files.select("path", content.alias("content")))


_NODELINK = """l AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders)"""


def _node_link(t):
    order = F.concat(F.lit("order/"), F.col("o_orderkey").cast("string"))
    customer = F.concat(F.lit("customer/"), F.col("o_custkey").cast("string"))
    nodes = F.array(F.create_map(F.lit("id"), order, F.lit("kind"), F.lit("method")), F.create_map(F.lit("id"), customer, F.lit("type"), F.lit("class")))
    legacy = F.to_json(F.struct(nodes.alias("nodes"), F.array(F.struct(F.struct(customer.alias("id")).alias("source"), order.alias("target"), F.lit("calls").alias("type"))).alias("edges")))
    current = F.to_json(F.struct(nodes.alias("nodes"), F.array(F.struct(F.concat(F.lit("e/"), order).alias("id"), customer.alias("source"), order.alias("target"), F.col("o_orderpriority").alias("relation"))).alias("links")))
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", legacy).otherwise(current).alias("body"))
    return documents.load_node_link(rows, "o_orderkey", "body")


@query("src06_load_node_link_edges", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN concat('dependency-view-edge:', substr(sha256(concat_ws(chr(31), concat('customer/', o_custkey), concat('order/', o_orderkey), 'calls', '0')), 1, 24)) ELSE concat('e/order/', o_orderkey) END AS id,
 concat('customer/', o_custkey) AS source, concat('order/', o_orderkey) AS target, CASE WHEN o_orderstatus = 'P' THEN 'calls' ELSE o_orderpriority END AS relation FROM orders""")
def src06(t):
    return _node_link(t)[1].select("o_orderkey", "id", "source", "target", "relation")


@query("src06_load_node_link_nodes", "SELECT o_orderkey, concat('order/', o_orderkey) AS id, 'method' AS kind FROM orders UNION ALL SELECT o_orderkey, concat('customer/', o_custkey), 'class' FROM orders")
def src06_nodes(t):
    return _node_link(t)[0].select("o_orderkey", "id", "kind")


def _program(t):
    key = F.col("o_orderkey").cast("string")
    node = lambda kind, defs, uses: F.struct(F.lit(kind).alias("kind"), defs.alias("definitions"), uses.alias("uses"), F.array().cast("array<string>").alias("calls"))
    none = F.array().cast("array<string>")
    nodes = F.create_map(F.lit("n0"), node("entry", none, none), F.lit("n1"), node("assignment", F.array("o_orderpriority"), none), F.lit("n2"), node("return", none, F.array("o_orderpriority")))
    edge = lambda a, b, branch: F.struct(F.concat(key, F.lit(f":{a}{b}")).alias("edge_id"), F.lit(f"n{a}").alias("source"), F.lit(f"n{b}").alias("target"), F.lit("cfg").alias("kind"), branch.alias("branch"))
    body = F.to_json(F.struct(F.create_map(F.concat(F.lit("f/"), key), F.struct(nodes.alias("nodes"), F.array(edge(0, 1, F.lit("normal")), edge(1, 2, F.col("o_orderstatus"))).alias("edges"))).alias("functions")))
    return documents.load_program_graph(t.orders.select(body.alias("body")), "body")


@query("src07_load_program_graph_edges", "SELECT concat('f/', o_orderkey) AS fn, concat(o_orderkey, ':01') AS edge_id, 'n0' AS source, 'n1' AS target, 'cfg' AS kind, 'normal' AS branch FROM orders UNION ALL SELECT concat('f/', o_orderkey), concat(o_orderkey, ':12'), 'n1', 'n2', 'cfg', o_orderstatus FROM orders")
def src07(t):
    return _program(t)[2]


@query("src07_load_program_graph_nodes", "SELECT concat('f/', o_orderkey) AS fn, 'n0' AS node, 'entry' AS kind, '' AS definitions, '' AS uses FROM orders UNION ALL SELECT concat('f/', o_orderkey), 'n1', 'assignment', o_orderpriority, '' FROM orders UNION ALL SELECT concat('f/', o_orderkey), 'n2', 'return', '', o_orderpriority FROM orders")
def src07_nodes(t):
    return _program(t)[1].select("fn", "node", "kind", F.array_join("definitions", ",").alias("definitions"), F.array_join("uses", ",").alias("uses"))


def _callsites(t):
    ids = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    site = F.concat_ws("/", F.lit("c"), *ids)
    target = lambda kind, ident, dispatch: F.struct(F.concat_ws("/", F.lit(kind), *ids).alias("edge_id"), ident.alias("target"), F.lit(dispatch).alias("dispatch"))
    supplier = target("s", F.concat(F.lit("supplier/"), F.col("l_suppkey").cast("string")), "direct")
    part = target("p", F.concat(F.lit("part/"), F.col("l_partkey").cast("string")), "virtual")
    return t.lineitem.select(F.concat(F.lit("order/"), F.col("l_orderkey").cast("string")).alias("caller"), site.alias("callsite_id"),
                             F.array_compact(F.array(F.when(F.col("l_returnflag") != "N", supplier), F.when(F.col("l_returnflag") == "R", part))).alias("targets"))


_SITES = "concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey)"


@query("src08_call_edges", f"""SELECT concat('s/', {_SITES}) AS id, concat('order/', l_orderkey) AS source, concat('supplier/', l_suppkey) AS target, 'calls' AS relation, 'direct' AS dispatch, concat('c/', {_SITES}) AS callsite_id FROM lineitem WHERE l_returnflag <> 'N'
 UNION ALL SELECT concat('p/', {_SITES}), concat('order/', l_orderkey), concat('part/', l_partkey), 'calls', 'virtual', concat('c/', {_SITES}) FROM lineitem WHERE l_returnflag = 'R'""")
def src08(t):
    return files.call_edges(_callsites(t), t.g_edges)


@query("src08_edges_by_project", f"""SELECT concat('s/', {_SITES}) AS id, concat('order/', l_orderkey) AS source, concat('supplier/', l_suppkey) AS target, 'calls' AS relation, 'direct' AS dispatch, concat('c/', {_SITES}) AS callsite_id FROM lineitem WHERE l_returnflag <> 'N' AND l_orderkey % 5 <> 0
 UNION ALL SELECT concat('p/', {_SITES}), concat('order/', l_orderkey), concat('part/', l_partkey), 'calls', 'virtual', concat('c/', {_SITES}) FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey % 5 <> 0
 UNION ALL SELECT concat('e4/', {_SITES}), concat('order/', l_orderkey), concat('supplier/', l_suppkey), 'calls', CASE WHEN l_returnflag = 'R' THEN 'virtual' ELSE 'direct' END, NULL FROM lineitem WHERE l_orderkey % 5 = 0""")
def src08_projects(t):
    """One project in five has no call-site facts and keeps its legacy edges."""
    project = lambda col: F.regexp_extract(col, r"/(\d+)", 1).cast("long") % 5
    sites = _callsites(t).withColumn("project", project("caller")).filter("project <> 0")
    legacy = t.g_edges.filter("source like 'order/%'").withColumn("project", project("source"))
    return files.call_edges(sites, legacy, "project")


@query("src08_legacy_edges", with_views("g_edges") + "SELECT id, source, target, relation, dispatch, CAST(NULL AS VARCHAR) AS callsite_id FROM g_edges WHERE relation = 'calls'")
def src08_legacy(t):
    return files.call_edges(_callsites(t).filter(F.lit(False)), t.g_edges)


@query("src08_fact_nodes", with_views("g_nodes") + "SELECT id, level AS kind, CASE WHEN level = 'function' THEN 'semantic' ELSE 'legacy' END AS origin FROM g_nodes")
def src08_nodes(t):
    nodes = t.g_nodes.select("id", F.col("level").alias("kind"))
    return files.fact_nodes(nodes.filter("kind = 'function'"), nodes)


@query("src08_files_by_language", with_views("v_files") + "SELECT lang AS language, path FROM v_files")
def src08_files(t):
    return files.files_by_language(t.v_files)


_MANIFEST = "m AS (SELECT path, project_id, sha256(text) AS sha256, strlen(text) AS bytes, 1 + length(text) - length(replace(text, chr(10), '')) AS lines FROM v_files)"
_TREE = """, l0 AS (SELECT substr(sha256(path), 1, 6) AS b, sha256(concat('{"path":"', path, '","sha256":"', sha256, '","bytes":', bytes, ',"lines":', lines, '}')) AS h FROM m), l1 AS (SELECT substr(b, 1, 3) AS b, sha256(string_agg(h, '' ORDER BY h)) AS h FROM l0 GROUP BY l0.b),
 l2 AS (SELECT substr(b, 1, 1) AS b, sha256(string_agg(h, '' ORDER BY h)) AS h FROM l1 GROUP BY l1.b), l3 AS (SELECT sha256(string_agg(h, '' ORDER BY h)) AS h FROM l2 GROUP BY l2.b)"""


@query("src09_artifact_round_trip", with_views("v_files", more=_MANIFEST) + "SELECT path, project_id, sha256, bytes, lines FROM m")
def src09(t):
    """Store one result per project in the shared folder, then read it back."""
    folder = f"{ensure_checkpoint_dir(t.spark)}/artifact-{uuid.uuid4().hex}"
    manifest = corpus.snapshot_manifest(t.v_files).join(t.v_files.select("path", "project_id"), "path")
    files.write_artifact(manifest, folder)
    return files.read_artifact(t.spark, folder).select("path", F.col("project_id").cast("string").alias("project_id"), "sha256", "bytes", "lines")


@query("src09_artifact_revision", with_views("v_files", more=_MANIFEST + _TREE) + "SELECT sha256(string_agg(h, '' ORDER BY h)) AS revision FROM l3")
def src09_revision(t):
    return files.artifact_revision(corpus.snapshot_manifest(t.v_files))


@query("src10_events_after", with_views("run_events") + "SELECT run_id, sequence, event_type FROM run_events WHERE sequence > run_id * 40")
def src10(t):
    cursors = t.events.select(F.col("user_id").alias("run_id"), (F.col("user_id") * 40).alias("cursor")).distinct()
    return files.events_after(t.run_events, cursors).select("run_id", "sequence", "event_type")


_AUDIT = """a AS (SELECT conv_id, turn, strlen(text) AS bytes, strlen(text) <= 900 AS small FROM conversations), b AS (SELECT *, CAST(sum(CASE WHEN small THEN bytes ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS used FROM a)"""


@query("src11_audit_quota", "WITH " + _AUDIT + " SELECT conv_id, turn, bytes, used AS run_bytes_used, small AND used <= 2000 AS accepted FROM b")
def src11(t):
    rows = files.within_audit_quota(t.conversations, "conv_id", "turn", F.col("text"), F.floor(F.col("turn") / 4), record_bytes=900, run_bytes=2000)
    return rows.select("conv_id", "turn", "bytes", F.col("run_bytes_used").cast("long").alias("run_bytes_used"), "accepted")


@query("src11_append_and_read", "WITH " + _AUDIT + " SELECT conv_id, turn, bytes FROM b WHERE small AND used <= 2000")
def src11_append(t):
    folder = f"{ensure_checkpoint_dir(t.spark)}/audit-{uuid.uuid4().hex}"
    rows = files.within_audit_quota(t.conversations, "conv_id", "turn", F.col("text"), F.floor(F.col("turn") / 4), record_bytes=900, run_bytes=2000)
    files.append_audit(rows.filter("accepted").select("conv_id", "turn", "role", "text", "bytes"), folder)
    return files.read_audit(t.spark, folder, ["conv_id", "turn"]).select("conv_id", "turn", "bytes")


_CODE = "c AS (SELECT path, line, concat(text, ' import mod', line % 3, ' ; def f', line, '(x): g', line % 5, '(h(1))') AS text FROM v_lines)"


@query("src13_scan_code_facts", with_views("v_lines", more=_CODE) + r"""SELECT path, CAST(line AS INT) AS line, fact, name, CAST(position AS INT) AS position FROM (
 SELECT path, line, 'definition' AS fact, unnest(d) AS name, unnest(range(1, len(d) + 1)) AS position FROM (SELECT path, line, regexp_extract_all(text, '\b(?:def|func|function|class|fn)\s+([A-Za-z_]\w*)', 1) AS d FROM c) x
 UNION ALL SELECT path, line, 'import', unnest(d), unnest(range(1, len(d) + 1)) FROM (SELECT path, line, regexp_extract_all(text, '(?:^|\s)(?:import|from|require|use)\s+([A-Za-z_][\w./]*)', 1) AS d FROM c) x
 UNION ALL SELECT path, line, 'call', unnest(d), unnest(range(1, len(d) + 1)) FROM (SELECT path, line, list_transform(list_filter(regexp_extract_all(text, '(?:\b(?:def|func|fn) )?\b[A-Za-z_]\w*\('), lambda x: NOT regexp_matches(x, '^(def|func|fn) ')), lambda x: x[:-2]) AS d FROM c) x) y""")
def src13(t):
    n = F.col("line")
    code = F.concat("text", F.lit(" import mod"), (n % 3).cast("string"), F.lit(" ; def f"), n.cast("string"), F.lit("(x): g"), (n % 5).cast("string"), F.lit("(h(1))"))
    return corpus.scan_code_facts(t.v_lines.select("path", "line", code.alias("text")))


@query("src14_project_inventory", """SELECT source AS project_id, true AS workspace_exists, count(l.doc_id) > 0 AS artifact_exists, CAST(sum(strlen(text)) AS BIGINT) AS workspace_bytes, CAST(coalesce(sum(CASE WHEN l.doc_id IS NOT NULL THEN n_chars END), 0) AS BIGINT) AS artifact_bytes,
 CAST(sum(strlen(text)) + coalesce(sum(CASE WHEN l.doc_id IS NOT NULL THEN n_chars END), 0) AS BIGINT) AS total_bytes, coalesce(bool_or(l.toxic = 1), false) AS active_tasks FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source""")
def src14(t):
    docs = t.documents.select("doc_id", F.col("source").alias("project_id"), F.octet_length("text").alias("bytes"), "n_chars")
    labelled = docs.join(t.labels, "doc_id")
    return corpus.project_inventory(docs.select("project_id").distinct(), docs, labelled.select("project_id", F.col("n_chars").alias("bytes")), labelled.select("project_id", (F.col("toxic") == 1).alias("active")))


@query("src15_snapshot_manifest", with_views("v_files", more=_MANIFEST) + "SELECT path, sha256, bytes, lines FROM m")
def src15(t):
    return corpus.snapshot_manifest(t.v_files)


@query("src15_snapshot_digest", with_views("v_files", more=_MANIFEST + _TREE) + "SELECT sha256(string_agg(h, '' ORDER BY h)) AS digest FROM l3")
def src15_digest(t):
    return corpus.snapshot_digest(corpus.snapshot_manifest(t.v_files))


def _fact_tables(t):
    sites = _callsites(t)
    references = sites.select("callsite_id", "caller", F.lit("excluded_scope").alias("reason"))
    edges = sites.select("callsite_id", F.explode("targets").alias("t")).select("callsite_id", "t.*")
    return files.build_fact_tables(references.dropDuplicates(["callsite_id"]), edges.unionByName(edges))


@query("src16_callsites", f"SELECT DISTINCT concat('c/', {_SITES}) AS callsite_id, concat('order/', l_orderkey) AS caller, CAST(CASE l_returnflag WHEN 'N' THEN 0 WHEN 'R' THEN 2 ELSE 1 END AS BIGINT) AS target_count, CASE l_returnflag WHEN 'N' THEN NULL WHEN 'R' THEN concat('p/', {_SITES}) ELSE concat('s/', {_SITES}) END AS first_edge, CASE l_returnflag WHEN 'N' THEN 'excluded_scope' END AS unresolved_reason FROM lineitem")
def src16(t):
    return _fact_tables(t)[0]


@query("src16_coverage", f"SELECT count(*) AS callsites, count(*) FILTER (WHERE f <> 'N') AS resolved, count(*) FILTER (WHERE f = 'N') AS unresolved FROM (SELECT {_SITES} AS s, max(l_returnflag) AS f FROM lineitem GROUP BY 1) x")
def src16_coverage(t):
    return _fact_tables(t)[2]


_SLOT = "concat('slot:', substr(sha256(concat_ws(chr(31), owner, role, CAST(position AS VARCHAR), name)), 1, 24)) AS slot_id, owner, role, position, name"


@query("src17_add_value_slots", f"""SELECT DISTINCT {_SLOT} FROM (SELECT concat('order/', l_orderkey) AS owner, 'parameter' AS role, l_linenumber AS position, concat('p', l_partkey) AS name FROM lineitem UNION ALL SELECT concat('order/', o_orderkey), 'return', 0, o_orderstatus FROM orders
 UNION ALL SELECT concat('order/', l_orderkey), 'call_result', l_linenumber, concat('supplier/', l_suppkey) FROM lineitem) x""")
def src17(t):
    owner = lambda c: F.concat(F.lit("order/"), F.col(c).cast("string")).alias("owner")
    parameters = t.lineitem.select(owner("l_orderkey"), F.col("l_linenumber").alias("position"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("name"))
    returns = t.orders.select(owner("o_orderkey"), F.lit(0).alias("position"), F.col("o_orderstatus").alias("name"))
    results = t.lineitem.select(owner("l_orderkey"), F.col("l_linenumber").alias("position"), F.concat(F.lit("supplier/"), F.col("l_suppkey").cast("string")).alias("name"))
    return files.add_value_slots(parameters, returns, results)


WORDS = ("QUE", "tion", "Der ", "asci")
_HITS = "h AS (SELECT path, line, concat_ws(',', CASE WHEN contains(lower(text), 'que') THEN '0' END, CASE WHEN contains(lower(text), 'tion') THEN '1' END, CASE WHEN contains(lower(text), 'der ') THEN '2' END, CASE WHEN contains(lower(text), 'asci') THEN '3' END) AS query_indices FROM v_lines)"


@query("flt03_search_literals", with_views("v_lines", more=_HITS) + "SELECT path, CAST(line AS INT) AS line, query_indices FROM h WHERE query_indices <> ''")
def flt03(t):
    hits = corpus.search_literals(t.v_lines, WORDS)
    return hits.select("path", "line", F.array_join(F.col("query_indices").cast("array<string>"), ",").alias("query_indices"))


@query("flt03_hit_previews", with_views("v_lines") + r"""SELECT path, CAST(line AS INT) AS line, substr(m, 1, 40) AS preview, length(m) > 40 AS shortened FROM (SELECT path, line, regexp_replace(regexp_replace(concat('token = "', text, '" sk-abcdefghijklmnop ', line), '((?i)token = )"[^"\\\r\n]+"', '\1"[REDACTED]"', 'g'), '\bsk-[A-Za-z0-9_-]{12,}\b', '[REDACTED]', 'g') AS m FROM v_lines) x WHERE m IS NOT NULL""")
def flt03_previews(t):
    """Every line as a secret that a search finds: none is shown in clear."""
    rows = t.v_lines.select("path", "line", F.concat(F.lit('token = "'), "text", F.lit('" sk-abcdefghijklmnop '), F.col("line").cast("string")).alias("text"))
    return corpus.hit_previews(corpus.search_literals(rows, ["TOKEN"]), 40).select("path", "line", "preview", "shortened")


@query("flt03_query_hit_counts", with_views("v_lines", more=_HITS) + "SELECT CAST(i AS INT) AS query_index, count(*) AS hits FROM (SELECT unnest(string_split(query_indices, ',')) AS i FROM h WHERE query_indices <> '') x GROUP BY 1")
def flt03_counts(t):
    hits = corpus.search_literals(t.v_lines, WORDS)
    return hits.select(F.explode("query_indices").alias("query_index")).groupBy("query_index").agg(F.count("*").alias("hits"))


@query("flt03_search_term_table", with_views("v_lines", more=r"w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM benchmark), k AS (SELECT DISTINCT path, line, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM v_lines)") + "SELECT word, count(*) AS lines FROM k WHERE word IN (SELECT word FROM w) GROUP BY word")
def flt03_terms(t):
    token = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    words = t.benchmark.select(token.alias("word")).distinct()
    return corpus.search_terms_table(t.v_lines, words).groupBy("word").agg(F.count("*").alias("lines"))


@query("flt04_search_symbols", "SELECT p_partkey AS id, p_name AS name, count(*) OVER () > 25 AS truncated FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') ORDER BY concat(p_brand, '.', p_name), p_partkey LIMIT 25")
def flt04(t):
    symbols = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat_ws(".", "p_brand", "p_name").alias("fqn"))
    return corpus.search_symbols(symbols, "RING", 25).select("id", "name", "truncated")


@query("flt07_select_map_lines", with_views("v_lines", more="""q AS (SELECT path, line, text, line > 5 AND (contains(lower(text), 'euxa') OR contains(lower(text), 'sch ')) AS hit FROM v_lines), a AS (SELECT *, bool_or(hit) OVER (PARTITION BY path) AS any_hit FROM q),
 c AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line) AS rn FROM a WHERE line <= 5 OR hit OR (NOT any_hit AND line <= 30))""") + "SELECT path, CAST(line AS INT) AS line FROM c WHERE rn <= 30")
def flt07(t):
    return corpus.select_map_lines(t.v_lines, ["EUXA", "sch "], ["path"], max_lines=30, header=5).select("path", "line")


@query("flt14_calls_from", "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey = 7")
def flt14(t):
    return files.lookup(t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey"), ["l_orderkey", "l_linenumber"], l_suppkey=7)


@query("flt14_unique_by_name", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) = 1)")
def flt14_unique(t):
    return files.unique_by(t.orders.select("o_orderkey", "o_custkey"), "o_custkey")


@query("flt15_active_tasks", "SELECT o_custkey AS owner, count(*) AS active FROM orders WHERE o_orderstatus IN ('P', 'O') GROUP BY o_custkey")
def flt15(t):
    from tracewell.operators.runs import active_tasks

    return active_tasks(t.orders.select(F.col("o_custkey").alias("owner"), F.col("o_orderstatus").alias("status")), "owner", ["P", "O"])


@query("fn31_mentions", "SELECT DISTINCT doc_id, concat('item-', doc_id % 50) AS id FROM documents WHERE doc_id % 50 IN (SELECT item_id FROM benchmark) AND doc_id % 3 <> 0")
def fn31(t):
    tail = F.when(F.col("doc_id") % 3 == 0, "x").otherwise("")
    texts = t.documents.select("doc_id", F.concat("text", F.lit(" see item-"), (F.col("doc_id") % 50).cast("string"), tail, F.lit(", ok")).alias("text"))
    return corpus.mentions(texts, "doc_id", "text", t.benchmark.select(F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("id"))).select("doc_id", "id")


@query("fn32_overview", with_views("v_files") + """SELECT project_id, concat('## ', project_id, chr(10), chr(10), 'Languages: ', string_agg(concat(lang, ' ', n), ', ' ORDER BY lang), chr(10), chr(10), '- files: ', sum(n), chr(10), '- bytes: ', sum(b)) AS overview FROM (SELECT project_id, lang, count(*) AS n, sum(strlen(text)) AS b FROM v_files GROUP BY ALL) x GROUP BY project_id""")
def fn32(t):
    return corpus.overview(t.v_files)


@query("fn33_file_tree", with_views("v_files") + """SELECT '' AS parent, project_id AS name, true AS is_folder, count(*) AS files FROM v_files GROUP BY project_id UNION ALL SELECT project_id, lang, true, count(*) FROM v_files GROUP BY project_id, lang
 UNION ALL SELECT concat(project_id, '/', lang), string_split(path, '/')[-1], false, count(*) FROM v_files GROUP BY ALL""")
def fn33(t):
    return corpus.file_tree(t.v_files)


@query("fn39_check_repo_url", "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'scheme_or_host' WHEN page_id % 5 = 1 THEN 'credentials' WHEN page_id % 5 = 2 THEN NULL ELSE 'host_not_allowed' END AS refused FROM pages")
def fn39(t):
    key = F.col("page_id") % 5
    url = (
        F.when(key == 0, F.regexp_replace("url", "^[a-z]+:", "ssh:")).when(key == 1, F.regexp_replace("url", "^([a-z]+://)", "$1user:pw@"))
        .when(key == 2, F.regexp_replace("url", "^[a-z]+://[^/]+", "https://GitHub.com.")).otherwise(F.col("url"))
    )
    return t.pages.select("page_id", corpus.check_repo_url(url).alias("refused"))


@query("fn40_safe_log_row", r"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'GET [URL_REDACTED] Bearer [REDACTED]' ELSE concat(substr('GET [URL_REDACTED] Bearer [REDACTED] password=[REDACTED]', 1, 2048)) END AS message FROM pages""")
def fn40(t):
    tail = F.when(F.col("page_id") % 2 == 1, F.concat(F.lit(" password="), F.col("page_id").cast("string"))).otherwise("")
    raw = F.concat(F.lit("GET "), "url", F.lit(" Bearer abc"), F.col("page_id").cast("string"), tail)
    return t.pages.select("page_id", redact.safe_log_text(raw).alias("message"))


@query("fn42_symbol_outline", """WITH h AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS fqn FROM pages), p AS (SELECT fqn, CASE WHEN fqn LIKE 'b%' THEN 'class' WHEN fqn LIKE 'm%' THEN 'constant' ELSE 'function' END AS kind, array_to_string(string_split(fqn, '.')[:-2], '.') AS up FROM (SELECT fqn FROM h UNION SELECT array_to_string(string_split(fqn, '.')[:-2], '.') FROM h WHERE fqn LIKE 'm.%') z)
 SELECT 'site' AS file, fqn, kind, CASE WHEN up IN (SELECT fqn FROM p) THEN up END AS parent, CASE WHEN up IN (SELECT fqn FROM p) THEN 'child' WHEN kind = 'constant' THEN 'constants' WHEN kind = 'class' THEN 'root' ELSE 'functions' END AS placement FROM p""")
def fn42(t):
    hosts = t.pages.select(url_host("url").alias("fqn")).distinct()
    every = hosts.unionByName(hosts.filter("fqn like 'm.%'").select(F.regexp_replace("fqn", r"\.[^.]*$", "").alias("fqn"))).distinct()
    kind = F.when(F.col("fqn").startswith("b"), "class").when(F.col("fqn").startswith("m"), "constant").otherwise("function")
    return corpus.symbol_outline(every.select(F.lit("site").alias("file"), "fqn", kind.alias("kind")))


@query("agg01_language_counts", "SELECT lang, count(*) AS files FROM documents GROUP BY lang")
def agg01(t):
    return t.documents.groupBy("lang").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "lang")


@query("agg01_module_counts", with_views("v_files") + "SELECT project_id AS module, count(*) AS files FROM v_files GROUP BY project_id")
def agg01_modules(t):
    return corpus.module_counts(t.v_files)


@query("agg02_detect_stack", with_views("v_files") + """SELECT path, 'framework' AS kind, 'FastAPI' AS label, 2 AS line FROM v_files WHERE lang = 'en' UNION ALL SELECT path, 'framework', 'Express', 1 FROM v_files WHERE lang = 'fr'
 UNION ALL SELECT concat(project_id, '/package.json'), 'package_manager', 'npm', NULL FROM v_files WHERE lang NOT IN ('en', 'fr', 'de')""")
def agg02(t):
    lang = F.col("lang")
    head = F.when(lang == "en", "import x\napp = FastAPI(\n").when(lang == "fr", "const a = express()\n").otherwise("")
    path = F.when(~lang.isin("en", "fr", "de"), F.concat("project_id", F.lit("/package.json"))).otherwise(F.col("path"))
    return corpus.detect_stack(t.v_files.select(path.alias("path"), F.concat(head, "text").alias("text")))


@query("agg21_duplicate_root_causes", r"SELECT sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS digest, count(*) AS occurrences FROM documents GROUP BY 1 HAVING count(*) > 1")
def agg21(t):
    return corpus.duplicate_root_causes(t.documents, "text")


@query("srt02_rank_symbols", with_views("g_nodes", "g_edges") + """SELECT id, score FROM (SELECT n.id, CASE WHEN n.id IN (SELECT id FROM (SELECT id, count(*) AS d FROM (SELECT source AS id FROM g_edges UNION ALL SELECT target FROM g_edges) x GROUP BY id ORDER BY d DESC, id LIMIT 20) c) THEN 10 ELSE 0 END + CASE WHEN level IN ('class', 'function', 'method') THEN 3 ELSE 0 END AS score, level, name FROM g_nodes n) y""")
def srt02(t):
    symbols = t.g_nodes.select("id", "name", F.col("level").alias("kind"), F.col("level").alias("path"))
    return corpus.rank_symbols(symbols, graphs.central_nodes(t.g_edges)).select("id", "score")


_SNIP = """hit AS (SELECT path, line, line + 1 AS end_line FROM v_lines WHERE contains(text, 'sch ')), n AS (SELECT h.path, h.line, h.end_line, v.line AS k, concat(v.line, ': ', v.text) AS shown FROM hit h JOIN v_lines v ON v.path = h.path AND v.line BETWEEN greatest(1, h.line - 2) AND h.end_line + 2)"""


@query("win10_snippets", with_views("v_lines", more=_SNIP) + r"""SELECT path, CAST(line AS INT) AS line, CAST(min(k) AS INT) AS start_line, CAST(max(k) AS INT) AS stop_line, sha256(regexp_replace(regexp_replace(string_agg(shown, chr(10) ORDER BY k), '((?i)token = )"[^"\r\n]+"', '\1"[REDACTED]"', 'g'), '\bsk-[A-Za-z0-9_-]{12,}\b', '[REDACTED]', 'g')) AS body FROM n GROUP BY path, line HAVING sum(length(shown)) + count(*) - 1 <= 700""")
def win10(t):
    hits = t.v_lines.filter(F.contains("text", F.lit("sch "))).select("path", "line", (F.col("line") + 1).alias("end_line"))
    found = corpus.snippets_around(t.v_lines, hits, context=2, max_chars=700).filter("not truncated")
    return found.select("path", "line", "start_line", "stop_line", F.sha2("text", 256).alias("body"))


@query("win10_snippets_over_budget")
def win10_cut(t):
    """Snippets that had to shrink around their focus line; the greedy growth is tested against brute force."""
    hits = t.v_lines.filter(F.contains("text", F.lit("sch "))).select("path", "line", F.col("line").alias("end_line"))
    return corpus.snippets_around(t.v_lines, hits, context=5, max_chars=400).filter("truncated")
