"""Resolution queries: imports, names, members, dispatch and bindings over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions.text import url_host, url_path
from tracewell.operators import corpus, resolve
from tracewell.plans.registry import query
from tracewell.views import with_views


def _s(prefix, *cols):
    return F.concat(F.lit(prefix), *[c.cast("string") if not isinstance(c, str) else F.col(c).cast("string") for c in cols])


_IMPORTS = """imp AS (SELECT concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, concat('o', l_orderkey, '.py') AS file, CASE WHEN l_suppkey % 7 = 0 THEN 'os' ELSE concat('pkg.s', l_suppkey) END AS module, concat('p', l_partkey) AS symbol,
 CASE l_linenumber WHEN 1 THEN 'wildcard' WHEN 2 THEN 'module' WHEN 3 THEN 'system' ELSE 'symbol' END AS kind FROM lineitem),
 mods AS (SELECT concat('pkg.s', s_suppkey) AS module, concat('pkg/s', s_suppkey, '.py') AS path FROM supplier WHERE s_suppkey % 4 <> 0),
 defs AS (SELECT DISTINCT concat('pkg/s', l_suppkey, '.py') AS file, concat('p', l_partkey) AS name, concat('pkg/s', l_suppkey, '.py::p', l_partkey) AS fqn FROM lineitem WHERE l_returnflag = 'A'),
 b AS (SELECT i.id, i.file, i.module, i.symbol, m.path AS target_file, CASE WHEN kind = 'wildcard' THEN 'wildcard' WHEN kind = 'symbol' AND fqn IS NOT NULL THEN 'symbol' WHEN kind = 'symbol' THEN CASE WHEN i.module = 'os' THEN 'stdlib_symbol' ELSE 'external_symbol' END
  WHEN m.path IS NOT NULL THEN 'module' WHEN i.module = 'os' OR kind = 'system' THEN 'stdlib_module' ELSE 'external_module' END AS binding, fqn FROM imp i LEFT JOIN mods m ON m.module = i.module LEFT JOIN defs d ON d.file = m.path AND d.name = i.symbol)"""


def _bindings(t):
    line = t.lineitem
    imports = line.select(
        F.concat_ws("/", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("id"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string"), F.lit(".py")).alias("file"),
        F.when(F.col("l_suppkey") % 7 == 0, "os").otherwise(_s("pkg.s", "l_suppkey")).alias("module"), _s("p", "l_partkey").alias("symbol"),
        F.when(F.col("l_linenumber") == 1, "wildcard").when(F.col("l_linenumber") == 2, "module").when(F.col("l_linenumber") == 3, "system").otherwise("symbol").alias("kind"))
    file = lambda c: F.concat(F.lit("pkg/s"), F.col(c).cast("string"), F.lit(".py"))
    modules = t.supplier.filter("s_suppkey % 4 <> 0").select(_s("pkg.s", "s_suppkey").alias("module"), file("s_suppkey").alias("path"))
    definitions = line.filter("l_returnflag = 'A'").select(file("l_suppkey").alias("file"), _s("p", "l_partkey").alias("name")).distinct().withColumn("fqn", F.concat_ws("::", "file", "name"))
    stdlib = t.spark.createDataFrame([("os",), ("sys",)], "module string")
    return resolve.resolve_imports(imports, modules, definitions, stdlib)


@query("join01_resolve_imports", "WITH " + _IMPORTS + " SELECT id, file, binding, CASE WHEN binding = 'symbol' THEN fqn WHEN binding IN ('module', 'wildcard') THEN target_file ELSE module END AS payload FROM b")
def join01(t):
    return _bindings(t).select("id", "file", "binding", "payload")


@query("join01_import_edges", "WITH " + _IMPORTS + " SELECT DISTINCT file AS source, target_file AS target, 'imports' AS relation FROM b WHERE target_file IS NOT NULL")
def join01_edges(t):
    return resolve.import_edges(_bindings(t))


_MODULE_FILES = r"""mf AS (SELECT DISTINCT concat(replace(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '.', '/'), '/', replace(trim(regexp_extract(url, '^[a-z]+://[^/?#]+/([^?#]*)', 1), '/'), '.html', ''), '.py') AS path FROM pages),
 sx AS (SELECT path, array_to_string(list_slice(string_split(regexp_replace(path, '\.py$', ''), '/'), i, 99), '.') AS module FROM (SELECT path, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM mf) z),
 lk AS (SELECT page_id AS id, concat('lost.', array_to_string(list_slice(string_split(regexp_replace(path, '\.py$', ''), '/'), -1 - page_id % 3, 99), '.')) AS module, concat(replace(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '.', '/'), '/from.py') AS from_path FROM (SELECT page_id, url, concat(replace(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '.', '/'), '/', replace(trim(regexp_extract(url, '^[a-z]+://[^/?#]+/([^?#]*)', 1), '/'), '.html', ''), '.py') AS path FROM pages) q),
 tr AS (SELECT id, from_path, i, array_to_string(list_slice(string_split(module, '.'), i, 99), '.') AS suffix FROM (SELECT *, unnest(range(1, len(string_split(module, '.')) + 1)) AS i FROM lk) z),
 ht AS (SELECT id, from_path, suffix FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS rn FROM tr WHERE suffix IN (SELECT module FROM sx)) z WHERE rn = 1),
 cm AS (SELECT id, h.suffix, s.path, len(list_filter(range(1, 12), lambda n: n <= len(string_split(s.path, '/')) AND n <= len(string_split(h.from_path, '/')) AND list_slice(string_split(s.path, '/'), 1, n) = list_slice(string_split(h.from_path, '/'), 1, n))) AS common FROM ht h JOIN sx s ON s.module = h.suffix)"""


def _module_file(url="url"):
    body = F.replace(F.regexp_replace(url_path(url), "^/+|/+$", ""), F.lit(".html"), F.lit(""))
    return F.concat(F.replace(url_host(url), F.lit("."), F.lit("/")), F.lit("/"), body, F.lit(".py"))


@query("join02_module_suffix_index", "WITH " + _MODULE_FILES + " SELECT id, suffix, path, CAST(common AS INT) AS common FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY common DESC, len(string_split(path, '/')), path) AS rn FROM cm) z WHERE rn = 1")
def join02(t):
    files = t.pages.select(_module_file().alias("path")).distinct()
    parts = F.split(F.regexp_replace(_module_file(), r"\.py$", ""), "/")
    tail = F.slice(parts, F.greatest(F.size(parts) - (F.col("page_id") % 3).cast("int"), F.lit(1)), 99)
    lookups = t.pages.select(F.col("page_id").alias("id"), F.concat(F.lit("lost."), F.array_join(tail, ".")).alias("module"), F.concat(F.replace(url_host("url"), F.lit("."), F.lit("/")), F.lit("/from.py")).alias("from_path"))
    return resolve.resolve_modules(lookups, files).select("id", "suffix", "path", "common")


_REL = r"""pg AS (SELECT page_id, regexp_extract(url, '/([a-z]{2})/[0-9]+', 1) AS lang, regexp_extract(url, '/([0-9]+)', 1) AS num FROM pages), fl AS (SELECT DISTINCT concat('site/', lang, '/', num, CASE page_id % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.js' WHEN 2 THEN '/index.ts' ELSE '.mts' END) AS path FROM pg),
 lk AS (SELECT page_id AS id, page_id % 2 = 0 AS ts, concat('site/', lang, '/', num) AS base, CASE page_id % 3 WHEN 0 THEN '.js' WHEN 1 THEN '' ELSE '.mjs' END AS ext FROM pg),
 cd AS (SELECT id, unnest(CASE WHEN ts AND ext = '.js' THEN [concat(base, '.ts'), concat(base, '.tsx'), concat(base, '.js'), concat(base, '.jsx')] WHEN ts AND ext = '.mjs' THEN [concat(base, '.mts'), concat(base, '.mjs')]
  ELSE list_transform(['', '.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs', '/index.ts', '/index.js', '/index.tsx', '/index.jsx'], lambda s: concat(base, ext, s)) END) AS path, unnest(range(1, 12)) AS pr FROM lk)"""


@query("join03_resolve_relative", "WITH " + _REL + " SELECT id, arg_min(path, pr) AS path FROM cd WHERE path IN (SELECT path FROM fl) GROUP BY id")
def join03(t):
    lang, num = F.regexp_extract("url", "/([a-z]{2})/[0-9]+", 1), F.regexp_extract("url", "/([0-9]+)", 1)
    key = F.col("page_id")
    ext = F.when(key % 4 == 0, ".ts").when(key % 4 == 1, ".js").when(key % 4 == 2, "/index.ts").otherwise(".mts")
    files = t.pages.select(F.concat(F.lit("site/"), lang, F.lit("/"), num, ext).alias("path")).distinct()
    spec = F.concat(F.lit(".././"), lang, F.lit("/x/../"), num, F.when(key % 3 == 0, ".js").when(key % 3 == 1, "").otherwise(".mjs"))
    lookups = t.pages.select(key.alias("id"), F.when(key % 2 == 0, "site/zz/from.ts").otherwise("site/zz/from.js").alias("from_path"), spec.alias("spec"), (key % 2 == 0).alias("is_typescript"))
    return resolve.resolve_relative(lookups, files)


_INC = """fl AS (SELECT DISTINCT concat('inc/d', o_custkey % 7, '/h', o_custkey, '.h') AS path FROM orders), lk AS (SELECT o_orderkey AS id, concat('inc/d', o_orderkey % 7, '/a.c') AS from_path, CASE o_orderkey % 4 WHEN 0 THEN concat('h', o_custkey, '.h') WHEN 1 THEN concat('inc/d', o_custkey % 7, '/h', o_custkey, '.h') WHEN 2 THEN concat('d', o_custkey % 7, '/h', o_custkey, '.h') ELSE concat('zz/h', o_custkey, '.h') END AS header, o_custkey FROM orders)"""


@query("join04_resolve_include", "WITH " + _INC + """ SELECT id, concat('inc/d', o_custkey % 7, '/h', o_custkey, '.h') AS path, CASE id % 4 WHEN 0 THEN CASE WHEN id % 7 = o_custkey % 7 THEN 0 ELSE 2 END WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS rung FROM lk""")
def join04(t):
    cust = F.col("o_custkey")
    path = F.concat(F.lit("inc/d"), (cust % 7).cast("string"), F.lit("/h"), cust.cast("string"), F.lit(".h"))
    key = F.col("o_orderkey") % 4
    header = (
        F.when(key == 0, F.concat(F.lit("h"), cust.cast("string"), F.lit(".h"))).when(key == 1, path)
        .when(key == 2, F.concat(F.lit("d"), (cust % 7).cast("string"), F.lit("/h"), cust.cast("string"), F.lit(".h"))).otherwise(F.concat(F.lit("zz/h"), cust.cast("string"), F.lit(".h")))
    )
    lookups = t.orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("inc/d"), (F.col("o_orderkey") % 7).cast("string"), F.lit("/a.c")).alias("from_path"), header.alias("header"))
    return resolve.resolve_include(lookups, t.orders.select(path.alias("path")).distinct())


_NEAR = """lk AS (SELECT doc_id AS id, lang, concat(source, '/', CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'zz' END, '/', doc_id % 40, '.py') AS from_path FROM documents),
 cm AS (SELECT l.id, f.path, CASE WHEN split_part(f.path, '/', 1) <> split_part(l.from_path, '/', 1) THEN 0 WHEN split_part(f.path, '/', 2) <> split_part(l.from_path, '/', 2) THEN 1 WHEN split_part(f.path, '/', 3) <> split_part(l.from_path, '/', 3) THEN 2 ELSE 3 END AS common FROM lk l JOIN v_files f USING (lang))"""


@query("join05_nearest_candidate", with_views("v_files", more=_NEAR) + "SELECT id, path, CAST(common AS INT) AS common FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY common DESC, path) AS rn FROM cm) z WHERE rn = 1")
def join05(t):
    lookups = t.documents.select(F.col("doc_id").alias("id"), "lang", F.concat("source", F.lit("/"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("zz"), F.lit("/"), (F.col("doc_id") % 40).cast("string"), F.lit(".py")).alias("from_path"))
    return resolve.nearest_candidate(lookups, t.v_files.select("lang", "path"), "lang")


_LADDER = """refs AS (SELECT concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, concat('f', l_orderkey % 97) AS file, concat('C', l_orderkey % 200) AS class_fqn, l_orderkey AS caller, CASE l_linenumber WHEN 1 THEN 'self' WHEN 2 THEN 'super' WHEN 3 THEN 'v' WHEN 4 THEN 'm' WHEN 5 THEN 'os' ELSE '' END AS receiver, concat('m', l_partkey % 6) AS name FROM lineitem),
 members AS (SELECT DISTINCT concat('C', o_orderkey % 200) AS type, concat('m', o_custkey % 3) AS name, concat('C', o_orderkey % 200, '::m', o_custkey % 3) AS target FROM orders),
 inherited AS (SELECT concat('C', k) AS class_fqn, name, target FROM (SELECT DISTINCT o_orderkey % 200 AS k FROM orders) c JOIN members ON type = concat('C', k % 20) WHERE k >= 20),
 typed AS (SELECT o_orderkey AS caller, name, target FROM orders JOIN members ON type = concat('C', o_custkey % 200)),
 scope_defs AS (SELECT DISTINCT concat('f', o_orderkey % 97) AS file, concat('m', o_custkey % 4) AS name, concat('f', o_orderkey % 97, '::m', o_custkey % 4) AS target FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 97 < 60),
 bound AS (SELECT concat('f', k) AS file, d.name, d.target FROM (SELECT DISTINCT o_orderkey % 97 AS k FROM orders) x JOIN scope_defs d ON d.file = concat('f', (k + 1) % 97)),
 wild AS (SELECT concat('f', k) AS file, d.name, d.target FROM (SELECT DISTINCT o_orderkey % 97 AS k FROM orders) x JOIN scope_defs d ON d.file = concat('f', (k + 30) % 97) WHERE k % 2 = 0),
 res AS (SELECT r.id, CASE WHEN receiver = 'self' AND me.target IS NOT NULL THEN {{'t': me.target, 'm': 'class_scope', 'c': 'must', 'f': 'high', 's': 'project'}} WHEN receiver = 'super' AND ih.target IS NOT NULL THEN {{'t': ih.target, 'm': 'inheritance_lookup', 'c': 'must', 'f': 'high', 's': 'project'}}
  WHEN receiver = 'v' AND ty.target IS NOT NULL THEN {{'t': ty.target, 'm': 'receiver_type', 'c': 'must', 'f': 'medium', 's': 'project'}} WHEN receiver = 'm' AND bo.target IS NOT NULL THEN {{'t': bo.target, 'm': 'module_binding', 'c': 'must', 'f': 'high', 's': 'project'}}
  WHEN receiver = 'os' THEN {{'t': concat('<stdlib>::os::', r.name), 'm': 'external_binding', 'c': 'must', 'f': 'high', 's': 'stdlib'}} WHEN receiver = '' AND sd.target IS NOT NULL THEN {{'t': sd.target, 'm': 'local_scope', 'c': 'must', 'f': 'high', 's': 'project'}}
  WHEN receiver = '' AND wi.target IS NOT NULL THEN {{'t': wi.target, 'm': 'wildcard_import', 'c': 'may', 'f': 'medium', 's': 'project'}} END AS x, r.receiver
  FROM refs r LEFT JOIN members me ON me.type = r.class_fqn AND me.name = r.name LEFT JOIN inherited ih ON ih.class_fqn = r.class_fqn AND ih.name = r.name LEFT JOIN typed ty ON ty.caller = r.caller AND ty.name = r.name LEFT JOIN bound bo ON bo.file = r.file AND bo.name = r.name LEFT JOIN scope_defs sd ON sd.file = r.file AND sd.name = r.name LEFT JOIN wild wi ON wi.file = r.file AND wi.name = r.name)""".replace("{{", "{").replace("}}", "}")


def _resolved(t):
    order, cust = F.col("o_orderkey"), F.col("o_custkey")
    num = F.col("l_linenumber")
    refs = t.lineitem.select(
        F.concat_ws("/", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("id"), _s("f", F.col("l_orderkey") % 97).alias("file"),
        _s("C", F.col("l_orderkey") % 200).alias("class_fqn"), F.col("l_orderkey").alias("caller"),
        F.when(num == 1, "self").when(num == 2, "super").when(num == 3, "v").when(num == 4, "m").when(num == 5, "os").otherwise("").alias("receiver"), _s("m", F.col("l_partkey") % 6).alias("name"))
    members = t.orders.select(_s("C", order % 200).alias("class_fqn"), _s("m", cust % 3).alias("name")).distinct().withColumn("target", F.concat_ws("::", "class_fqn", "name"))
    keys = t.orders.select((order % 200).alias("k")).distinct().filter("k >= 20")
    inherited = keys.select(_s("C", "k").alias("_c"), _s("C", F.col("k") % 20).alias("class_fqn")).join(members, "class_fqn").select(F.col("_c").alias("class_fqn"), "name", "target")
    typed = t.orders.select(order.alias("caller"), _s("C", cust % 200).alias("class_fqn")).join(members, "class_fqn").select("caller", "name", "target")
    local = t.orders.filter("o_orderstatus = 'O' and o_orderkey % 97 < 60").select(_s("f", order % 97).alias("file"), _s("m", cust % 4).alias("name")).distinct().withColumn("target", F.concat_ws("::", "file", "name"))
    files = t.orders.select((order % 97).alias("k")).distinct()
    via = lambda df, shift: df.select(_s("f", "k").alias("_f"), _s("f", (F.col("k") + shift) % 97).alias("file")).join(local, "file").select(F.col("_f").alias("file"), "name", "target")
    stdlib = refs.select("name").distinct().select("name", F.concat(F.lit("<stdlib>::os::"), "name").alias("target"))
    receiver = lambda r: F.col("receiver") == r
    ladder = [
        resolve.Rung("class_scope", members, ["class_fqn", "name"], receiver("self")), resolve.Rung("inheritance_lookup", inherited, ["class_fqn", "name"], receiver("super")),
        resolve.Rung("receiver_type", typed, ["caller", "name"], receiver("v"), confidence="medium"), resolve.Rung("module_binding", via(files, 1), ["file", "name"], receiver("m")),
        resolve.Rung("external_binding", stdlib, ["name"], receiver("os"), scope="stdlib"), resolve.Rung("local_scope", local, ["file", "name"], receiver("")),
        resolve.Rung("wildcard_import", via(files.filter("k % 2 = 0"), 30), ["file", "name"], receiver(""), confidence="medium", certainty="may"),
    ]
    return resolve.resolve_references(refs, ladder, F.when(F.col("receiver") == "", "symbol_not_found").otherwise("unknown_receiver_type"))


@query("join06_resolve_references", "WITH " + _LADDER + """ SELECT id, x.t AS target, coalesce(x.m, 'unresolved') AS method, coalesce(x.c, 'unresolved') AS certainty, coalesce(x.f, 'low') AS confidence, x.s AS scope, CASE WHEN x IS NULL THEN CASE WHEN receiver = '' THEN 'symbol_not_found' ELSE 'unknown_receiver_type' END END AS unresolved_reason FROM res""")
def join06(t):
    return _resolved(t).select("id", "target", "method", "certainty", "confidence", "scope", "unresolved_reason")


@query("agg23_resolution_stats", "WITH " + _LADDER + " SELECT coalesce(x.m, 'unresolved') AS method, count(*) AS \"references\", count(*) FILTER (WHERE x IS NULL) AS unresolved FROM res GROUP BY 1")
def agg23(t):
    return resolve.resolution_stats(_resolved(t))


_FB = """sym AS (SELECT CASE WHEN c_custkey % 5 = 0 THEN concat('n', c_custkey) ELSE concat('n', c_mktsegment, c_custkey % 3) END AS name, concat('c', c_nationkey, '/', c_custkey, '.py') AS path, concat('fq', c_custkey) AS fqn, c_custkey % 2 = 0 AS is_member FROM customer),
 rf AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN concat('n', o_custkey) WHEN 1 THEN concat('nBUILDING', o_custkey % 3) ELSE concat('nMACHINERY', o_custkey % 3) END AS name, concat('c', o_custkey % 25, '/x.py') AS from_path, o_custkey % 2 = 0 AS is_member FROM orders),
 ct AS (SELECT name, is_member, count(DISTINCT fqn) AS n, min(fqn) AS only_fqn FROM sym GROUP BY ALL),
 nm AS (SELECT DISTINCT name, from_path FROM rf WHERE NOT is_member),
 nr AS (SELECT * FROM (SELECT m.name, m.from_path, s.fqn, row_number() OVER (PARTITION BY m.name, m.from_path ORDER BY CASE WHEN split_part(s.path, '/', 1) = split_part(m.from_path, '/', 1) THEN 0 ELSE 1 END, s.path, s.fqn) AS rn FROM nm m JOIN sym s ON s.name = m.name AND NOT s.is_member) z WHERE rn = 1)"""


@query("join07_fallback_unique_name", "WITH " + _FB + """ SELECT id, rf.name, CASE WHEN n = 1 THEN only_fqn WHEN n > 1 AND NOT rf.is_member THEN nr.fqn END AS target, CASE WHEN n = 1 THEN CASE WHEN rf.is_member THEN 'unique_member_heuristic' ELSE 'unique_name_heuristic' END WHEN n > 1 AND NOT rf.is_member THEN 'nearest_module_heuristic' ELSE 'unresolved' END AS method,
 CASE WHEN n IS NULL THEN CASE WHEN rf.is_member THEN 'unknown_receiver_type' ELSE 'symbol_not_found' END WHEN n > 1 AND rf.is_member THEN 'ambiguous_member' END AS unresolved_reason FROM rf LEFT JOIN ct ON ct.name = rf.name AND ct.is_member = rf.is_member LEFT JOIN nr ON nr.name = rf.name AND nr.from_path = rf.from_path""")
def join07(t):
    cust = F.col("c_custkey")
    symbols = t.customer.select(
        F.when(cust % 5 == 0, _s("n", "c_custkey")).otherwise(F.concat(F.lit("n"), "c_mktsegment", (cust % 3).cast("string"))).alias("name"),
        F.concat(F.lit("c"), F.col("c_nationkey").cast("string"), F.lit("/"), cust.cast("string"), F.lit(".py")).alias("path"), _s("fq", "c_custkey").alias("fqn"), (cust % 2 == 0).alias("is_member"))
    key, owner = F.col("o_orderkey"), F.col("o_custkey")
    name = F.when(key % 3 == 0, _s("n", "o_custkey")).when(key % 3 == 1, _s("nBUILDING", owner % 3)).otherwise(_s("nMACHINERY", owner % 3))
    refs = t.orders.select(key.alias("id"), name.alias("name"), F.concat(F.lit("c"), (owner % 25).cast("string"), F.lit("/x.py")).alias("from_path"), (owner % 2 == 0).alias("is_member"))
    return resolve.fallback_unique_name(refs, symbols)


_CONT = """d AS (SELECT concat('r', r_regionkey) AS id, '' AS parent_id, concat('file', r_regionkey) AS file FROM region UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey), concat('file', n_nationkey % 5) FROM nation UNION ALL SELECT concat('c', c_custkey), CASE WHEN c_custkey % 9 = 0 THEN 'gone' ELSE concat('n', c_nationkey) END, concat('file', c_custkey % 5) FROM customer),
 j AS (SELECT d.*, p.file AS pf FROM d LEFT JOIN d p ON p.id = d.parent_id)"""


@query("join08_containment_edges", "WITH " + _CONT + " SELECT CASE WHEN pf IS NOT NULL THEN parent_id ELSE file END AS source, id AS target, 'contains' AS relation FROM j UNION ALL SELECT file, id, 'declares' FROM j WHERE pf <> file")
def join08(t):
    rows = lambda df, ident, parent, key: df.select(ident.alias("id"), parent.alias("parent_id"), _s("file", F.col(key) % 5).alias("file"))
    definitions = (
        rows(t.region, _s("r", "r_regionkey"), F.lit(""), "r_regionkey").unionByName(rows(t.nation, _s("n", "n_nationkey"), _s("r", "n_regionkey"), "n_nationkey"))
        .unionByName(rows(t.customer, _s("c", "c_custkey"), F.when(F.col("c_custkey") % 9 == 0, "gone").otherwise(_s("n", "c_nationkey")), "c_custkey"))
    )
    return resolve.containment_edges(definitions)


@query("join09_inheritance_edges", "SELECT concat('c', c_custkey) AS source, concat('n', n_nationkey) AS target, CASE WHEN c_custkey % 3 = 0 AND n_nationkey % 3 = 0 THEN 'embeds' WHEN n_nationkey % 3 = 1 THEN 'implements' ELSE 'inherits' END AS relation FROM customer JOIN nation ON n_nationkey = c_nationkey")
def join09(t):
    bases = t.customer.select(_s("c", "c_custkey").alias("type"), F.when(F.col("c_custkey") % 3 == 0, "go").otherwise("java").alias("lang"), _s("NATION_", "c_nationkey").alias("base_name"))
    kind = F.when(F.col("n_nationkey") % 3 == 0, "struct").when(F.col("n_nationkey") % 3 == 1, "interface").otherwise("class")
    return resolve.inheritance_edges(bases, t.nation.select(F.col("n_name").alias("name"), _s("n", "n_nationkey").alias("id"), kind.alias("kind")))


_MEM = """m AS (SELECT DISTINCT concat('c', o_custkey) AS type, concat('m', o_orderkey % 4) AS name, concat('c', o_custkey, '::m', o_orderkey % 4) AS id FROM orders UNION SELECT concat('n', n_nationkey), concat('m', n_nationkey % 4), concat('n', n_nationkey, '::m', n_nationkey % 4) FROM nation UNION SELECT concat('r', r_regionkey), 'm1', concat('r', r_regionkey, '::m1') FROM region),
 o AS (SELECT concat('c', c_custkey) AS type, concat('n', c_nationkey) AS base, 1 AS depth FROM customer UNION ALL SELECT concat('c', c_custkey), concat('r', n_regionkey), 2 FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey), 1 FROM nation)"""


def _members(t):
    part = lambda df, owner, number: df.select(owner.alias("type"), number.alias("name")).distinct()
    rows = (
        part(t.orders, _s("c", "o_custkey"), _s("m", F.col("o_orderkey") % 4)).unionByName(part(t.nation, _s("n", "n_nationkey"), _s("m", F.col("n_nationkey") % 4)))
        .unionByName(part(t.region, _s("r", "r_regionkey"), F.lit("m1")))
    )
    return rows.withColumn("id", F.concat_ws("::", "type", "name"))


@query("join10_override_edges", "WITH " + _MEM + " SELECT id AS source, arg_min(target, depth) AS target FROM (SELECT m.id, o.depth, b.id AS target FROM m JOIN o ON o.type = m.type JOIN m b ON b.type = o.base AND b.name = m.name) x GROUP BY id")
def join10(t):
    up = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    order = (
        t.customer.select(_s("c", "c_custkey").alias("type"), _s("n", "c_nationkey").alias("base"), F.lit(1).alias("depth")).unionByName(up.select(_s("c", "c_custkey").alias("type"), _s("r", "n_regionkey").alias("base"), F.lit(2).alias("depth")))
        .unionByName(t.nation.select(_s("n", "n_nationkey").alias("type"), _s("r", "n_regionkey").alias("base"), F.lit(1).alias("depth")))
    )
    return resolve.override_edges(_members(t), order)


_DISP = ", ov AS (SELECT DISTINCT b.id AS target, s.id AS ov FROM m b JOIN o ON o.base = b.type AND o.depth = 1 JOIN m s ON s.type = o.type AND s.name = b.name), rk AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY ov) AS rn, count(*) OVER (PARTITION BY target) AS n FROM ov)"


def _dispatch(t):
    direct = t.customer.select(_s("c", "c_custkey").alias("type"), _s("n", "c_nationkey").alias("base")).unionByName(t.nation.select(_s("n", "n_nationkey").alias("type"), _s("r", "n_regionkey").alias("base")))
    calls = t.supplier.select(F.col("s_suppkey").alias("call_id"), F.concat(_s("n", "s_nationkey"), F.lit("::m"), (F.col("s_nationkey") % 4).cast("string")).alias("target"))
    return resolve.expand_dispatch(calls, _members(t), direct, cap=8)


@query("join11_expand_dispatch", "WITH " + _MEM + _DISP + " SELECT s_suppkey AS call_id, ov AS target, 'may' AS certainty, 'medium' AS confidence, n > 8 AS truncated FROM supplier JOIN rk ON rk.target = concat('n', s_nationkey, '::m', s_nationkey % 4) WHERE rn <= 8")
def join11(t):
    return _dispatch(t)[0]


@query("join11_targets_beyond_cap", "WITH " + _MEM + _DISP + " SELECT target, ov AS override FROM rk WHERE rn > 8")
def join11_beyond(t):
    return _dispatch(t)[1]


_IMPL = "i AS (SELECT concat('impl', p_partkey) AS id, p_name AS name, concat('s', p_size % 11) AS stem FROM part WHERE p_partkey % 2 = 1), dd AS (SELECT concat('decl', p_partkey) AS id, p_name AS name, concat('s', p_size % 13) AS stem FROM part WHERE p_partkey % 2 = 0)"


@query("join12_declaration_to_implementation", "WITH " + _IMPL + " SELECT dd.id, CASE WHEN (SELECT count(*) FROM i WHERE i.name = dd.name) = 1 THEN (SELECT min(id) FROM i WHERE i.name = dd.name) ELSE coalesce((SELECT min(id) FROM i WHERE i.name = dd.name AND i.stem = dd.stem), (SELECT min(id) FROM i WHERE i.name = dd.name)) END AS implementation FROM dd WHERE dd.name IN (SELECT name FROM i)")
def join12(t):
    side = lambda kind, odd, mod: t.part.filter(F.col("p_partkey") % 2 == odd).select(_s(kind, "p_partkey").alias("id"), F.col("p_name").alias("name"), _s("s", F.col("p_size") % mod).alias("stem"))
    return resolve.declaration_to_implementation(side("decl", 0, 13), side("impl", 1, 11))


_ATT = """ty AS (SELECT n_name AS name, concat('n', n_nationkey) AS id FROM nation WHERE n_nationkey % 5 <> 0), ex AS (SELECT concat('n', s_nationkey) AS owner, concat('m', s_suppkey % 6) AS name, min(concat('decl', s_suppkey)) AS id, min(s_suppkey) AS line FROM supplier GROUP BY 1, 2),
 mb AS (SELECT concat('def', c_custkey) AS id, concat('m', c_custkey % 9) AS name, concat('NATION_', c_nationkey) AS owner_name, c_custkey + 100000 AS line FROM customer),
 jj AS (SELECT mb.*, ty.id AS owner, ex.id AS canon, ex.line AS eline FROM mb JOIN ty ON ty.name = mb.owner_name LEFT JOIN ex ON ex.owner = ty.id AND ex.name = mb.name)"""


def _attached(t):
    types = t.nation.filter("n_nationkey % 5 <> 0").select(F.col("n_name").alias("name"), _s("n", "n_nationkey").alias("id"))
    existing = t.supplier.groupBy(_s("n", "s_nationkey").alias("owner"), _s("m", F.col("s_suppkey") % 6).alias("name")).agg(F.min(_s("decl", "s_suppkey")).alias("id"), F.min("s_suppkey").alias("line"))
    existing = existing.withColumn("is_declaration", F.col("line") % 2 == 0)
    members = t.customer.select(_s("def", "c_custkey").alias("id"), _s("m", F.col("c_custkey") % 9).alias("name"), _s("NATION_", "c_nationkey").alias("owner_name"), (F.col("c_custkey") + 100000).alias("line"))
    return resolve.attach_members(members, types, existing)


@query("join13_attach_members", "WITH " + _ATT + " SELECT coalesce(canon, id) AS id, owner, name, CASE WHEN canon IS NULL OR eline % 2 = 0 THEN line ELSE eline END AS line FROM jj")
def join13(t):
    return _attached(t)[0]


@query("join13_member_aliases", "WITH " + _ATT + " SELECT id AS alias, canon AS canonical FROM jj WHERE canon IS NOT NULL")
def join13_aliases(t):
    return _attached(t)[1]


@query("join33_variable_references", "SELECT concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS reference_id, o_orderkey AS declaration_id, o_orderpriority AS declared_type FROM lineitem JOIN orders ON o_orderkey = l_orderkey UNION ALL SELECT concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey), o_orderkey, o_orderpriority FROM lineitem JOIN orders ON o_orderkey = l_partkey WHERE l_partkey <> l_orderkey")
def join33(t):
    references = t.lineitem.select(F.concat_ws("/", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("reference_id"), F.array_distinct(F.array("l_orderkey", "l_partkey")).alias("declaration_ids"))
    declarations = t.orders.select(F.col("o_orderkey").alias("declaration_id"), F.col("o_orderpriority").alias("declared_type"))
    return resolve.variable_references(references, declarations).select("reference_id", "declaration_id", "declared_type")


_NODE = """nd AS (SELECT concat('f', o_custkey % 300, '::k', o_orderkey) AS id, concat('f', o_custkey % 300) AS file, concat('n', o_orderkey % 40) AS name, CAST(o_orderkey % 90 AS INT) AS line FROM orders WHERE o_orderkey % 4 <> 0 UNION ALL SELECT DISTINCT concat('f', o_custkey % 300), concat('f', o_custkey % 300), 'file', 0 FROM orders WHERE o_custkey % 300 < 250),
 sy AS (SELECT o_orderkey AS key, concat('f', o_custkey % 300) AS file, concat('k', CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey ELSE -1 END) AS fqn, concat('n', o_orderkey % 40) AS name, CAST(o_orderkey % 7 * 13 AS INT) AS line FROM orders),
 bl AS (SELECT file, name, line, min(id) AS id FROM nd GROUP BY ALL), bn AS (SELECT file, name, count(*) AS n, min(id) AS id FROM nd GROUP BY ALL)"""


@query("join34_symbol_to_node", "WITH " + _NODE + " SELECT key, CASE WHEN e.id IS NOT NULL THEN e.id WHEN sy.line > 0 AND bl.id IS NOT NULL THEN bl.id WHEN bn.n = 1 THEN bn.id WHEN f.id IS NOT NULL THEN f.id END AS node FROM sy LEFT JOIN (SELECT DISTINCT id FROM nd) e ON e.id = concat(sy.file, '::', fqn) LEFT JOIN bl ON bl.file = sy.file AND bl.name = sy.name AND bl.line = sy.line LEFT JOIN bn ON bn.file = sy.file AND bn.name = sy.name LEFT JOIN (SELECT DISTINCT id FROM nd) f ON f.id = sy.file")
def join34(t):
    key, file = F.col("o_orderkey"), _s("f", F.col("o_custkey") % 300)
    named = t.orders.filter("o_orderkey % 4 <> 0").select(F.concat(file, F.lit("::k"), key.cast("string")).alias("id"), file.alias("file"), _s("n", key % 40).alias("name"), (key % 90).cast("int").alias("line"))
    whole = t.orders.filter("o_custkey % 300 < 250").select(file.alias("id"), file.alias("file"), F.lit("file").alias("name"), F.lit(0).alias("line")).distinct()
    symbols = t.orders.select(key.alias("key"), file.alias("file"), _s("k", F.when(key % 3 == 0, key).otherwise(-1)).alias("fqn"), _s("n", key % 40).alias("name"), (key % 7 * 13).cast("int").alias("line"))
    return resolve.symbol_to_node(symbols, named.unionByName(whole))


_BIND = """SELECT event_id AS ref_id, CASE WHEN l.doc_id IS NOT NULL AND quality = 1 AND toxic = 0 THEN concat('exact', l.doc_id) WHEN event_type <> 'error' THEN concat('guess', user_id) END AS target, CASE WHEN l.doc_id IS NOT NULL AND quality = 1 AND toxic = 0 THEN 'declaration_binding' ELSE 'unique_name_heuristic' END AS method,
 CASE WHEN (l.doc_id IS NOT NULL AND quality = 1 AND toxic = 0) OR event_type <> 'error' THEN 'may' ELSE 'unresolved' END AS certainty, CASE WHEN l.doc_id IS NOT NULL AND quality = 1 AND toxic = 0 THEN 'high' ELSE 'low' END AS confidence,
 CASE WHEN l.doc_id IS NULL THEN 'compiler_callsite_not_mapped' WHEN toxic = 1 THEN 'overload_ambiguous' WHEN quality <> 1 THEN 'compiler_declaration_not_mapped' END AS fallback_reason FROM events LEFT JOIN labels l ON l.doc_id = event_id"""


def _bound(t):
    references = t.events.select(F.col("event_id").alias("ref_id"), F.when(F.col("event_type") != "error", _s("guess", "user_id")).alias("target"), F.lit("unique_name_heuristic").alias("method"), F.lit("low").alias("confidence"))
    bindings = t.labels.select(F.col("doc_id").alias("ref_id"), F.when(F.col("quality") == 1, _s("exact", "doc_id")).alias("target"), F.when(F.col("toxic") == 1, "overload_ambiguous").alias("reason"))
    return resolve.prefer_exact_bindings(references, bindings)


@query("join37_prefer_exact_bindings", _BIND)
def join37(t):
    return _bound(t)


@query("ext06_resolver_table", "SELECT fallback_reason, count(*) AS refs FROM (" + _BIND + ") x GROUP BY fallback_reason")
def ext06(t):
    """Any resolver that delivers the binding table takes part; the report counts why others fell back."""
    return _bound(t).groupBy("fallback_reason").agg(F.count("*").alias("refs"))


_DG = """c AS (SELECT path, line FROM v_lines), d AS (SELECT DISTINCT path, concat('f', line) AS name FROM c), one AS (SELECT name FROM d GROUP BY name HAVING count(*) = 1),
 cl AS (SELECT path, line, concat('f', line % 7) AS name FROM c UNION ALL SELECT path, line, 'h' FROM c UNION ALL SELECT path, line, concat('f', line + 90) FROM c),
 rs AS (SELECT cl.*, CASE WHEN EXISTS (SELECT 1 FROM d WHERE d.path = cl.path AND d.name = cl.name) THEN 'local_scope' WHEN cl.name IN (SELECT name FROM one) THEN 'unique_name_heuristic' END AS method FROM cl)"""


@query("gr33_dependency_graph", with_views("v_lines", more=_DG) + """SELECT 'contains' AS relation, 'declared' AS method, count(*) AS edges FROM d UNION ALL SELECT 'imports', 'external_binding', count(*) FROM (SELECT DISTINCT path, line % 3 FROM c) x
 UNION ALL SELECT 'calls', method, count(*) FROM rs WHERE method IS NOT NULL GROUP BY method UNION ALL SELECT 'unresolved', 'symbol_not_found', count(*) FROM rs WHERE method IS NULL""")
def gr33(t):
    """Lines to graph in one plan: scan facts, resolve them, and count edges by how they were found."""
    n = F.col("line")
    code = F.concat(F.lit("import mod"), (n % 3).cast("string"), F.lit(" ; def f"), n.cast("string"), F.lit("(x): f"), (n % 7).cast("string"), F.lit("(h(1)) + f"), (n + 90).cast("string"), F.lit("(2)"))
    nodes, edges, unresolved = resolve.dependency_graph(corpus.scan_code_facts(t.v_lines.select("path", "line", code.alias("text"))))
    found = edges.groupBy("relation", "method").agg(F.count("*").alias("edges"))
    return found.unionByName(unresolved.groupBy(F.col("unresolved_reason").alias("method")).agg(F.count("*").alias("edges")).withColumn("relation", F.lit("unresolved")).select("relation", "method", "edges"))
