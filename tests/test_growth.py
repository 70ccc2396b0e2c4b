"""Work and memory that grow no faster than the input."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.functions.ids import packed, unpacked
from tracewell.operators import evidence, flow, graphs, skew
from tracewell.plans import QUERIES
from tracewell.sources import files
from tracewell.views import Tables


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_table_of_prefixes_is_not_broadcast(spark, folder):
    assert "Broadcast" not in plan(QUERIES["join02_module_suffix_index"](spark, folder))


def _random_function(rng, fn, nodes=12):
    edges = {(fn, n, n + 1, rng.random() < 0.2) for n in range(nodes - 1)} | {(fn, rng.randrange(nodes), rng.randrange(nodes), rng.random() < 0.2) for _ in range(8)}
    writes = {(fn, n, rng.choice(["a", "a.x", "a[0]", "b"]), rng.random() < 0.7) for n in range(nodes) if rng.random() < 0.7}
    reads = {(fn, n, name) for n in range(nodes) for name in ("a", "a.x", "a[0]", "b") if rng.random() < 0.4}
    return edges, writes, reads


def test_small_functions_leave_no_states_as_rows(spark, monkeypatch):
    rng = random.Random(5)
    rows = [_random_function(rng, fn) for fn in range(20)]
    edges, writes, reads = ([r for part in parts for r in part] for parts in zip(*rows))
    tables = (
        spark.createDataFrame(edges, "fn long, source long, target long, before_write boolean"),
        spark.createDataFrame(writes, "fn long, node long, var string, certain boolean"), spark.createDataFrame(reads, "fn long, node long, var string"))
    answer = lambda **how: sorted(map(tuple, flow.reaching_definitions(*tables, **how).collect()))
    by_rows = answer(local_rows=0)
    assert by_rows == answer(local_rows=55) and len(by_rows) > 100
    monkeypatch.setattr(flow, "closure", None)
    assert answer() == by_rows


def test_references_of_small_functions_leave_no_states_as_rows(spark, monkeypatch):
    rng = random.Random(6)
    pick, sure, rows = (lambda: rng.choice("pqr")), (lambda: rng.random() < 0.7), {k: set() for k in ("edge", "alloc", "copy", "store", "load", "stop")}
    for fn in range(24):
        rows["edge"] |= {(fn, n, n + 1) for n in range(11)} | {(fn, rng.randrange(12), rng.randrange(12)) for _ in range(4)}
        for n in range(12):
            kind = rng.choice(["alloc", "alloc", "copy", "copy", "store", "load", "stop", "none"])
            row = {"alloc": lambda: (pick(), f"o{n}", sure()), "copy": lambda: (pick(), pick(), sure()), "store": lambda: (pick(), "f", pick()), "load": lambda: (pick(), pick(), "f"), "stop": lambda: (rng.choice(["*", "o1", "o5"]),)}
            if kind in row:
                rows[kind].add((fn, n, *row[kind]()))
    names = {"edge": "source long, target long", "alloc": "node long, name string, alloc string, certain boolean", "copy": "node long, src string, dst string, certain boolean",
             "store": "node long, base string, field string, value string", "load": "node long, dst string, base string, field string", "stop": "node long, alloc string"}
    edge, alloc, copy, store, load, stop = (spark.createDataFrame(sorted(rows[k]), f"fn int, {names[k]}") for k in rows)
    cases = [(None, None, stop, None, 2), (store, load, stop, 60)]
    answer = lambda case, **how: sorted(tuple(map(str, r)) for r in flow.may_refer(edge, alloc, copy, *case, **how)[0].collect())
    by_rows = [answer(case, local_rows=0) for case in cases]
    assert answer(cases[0], local_rows=26) == by_rows[0] and all(len(set(found)) == len(found) > 100 for found in by_rows)
    monkeypatch.setattr(flow, "walk", None)
    assert [answer(case) for case in cases] == by_rows
    assert {r[-1] for found in by_rows for r in found} == {"True", "False"}


def test_a_stream_of_a_table_in_parts(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/conversations.parquet").repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    answer = lambda place: sorted(map(tuple, QUERIES["st09_accumulate_seen_lines"](spark, place).collect()))
    assert answer(str(tmp_path)) == answer(folder)


def test_few_names_are_closed_without_rows_for_all_pairs(spark):
    rng = random.Random(8)
    rows = [(f"p{p}", rng.choice("abc"), rng.choice(["<", "<=", ">", ">=", "==", "!="]), rng.randint(-2, 2), None, rng.choice(["a", "b", "c", None])) for p in range(150) for _ in range(rng.randint(1, 6))]
    predicates = spark.createDataFrame(rows, "path string, var string, op string, value long, text string, other string")
    answer = lambda n: {r.path: r.status for r in flow.branch_feasibility(predicates, n).collect()}
    alone = answer(16)
    assert alone == answer(0) == answer(3) and len(set(alone.values())) == 3
    closed = flow._closed_in_rows(spark.createDataFrame([("p", i, j, w) for i, j, w in (("a", "a", 0), ("b", "b", 0), ("0", "0", 0), ("a", "b", 1), ("b", "0", 2))], "path string, i string, j string, w long"),
                                  spark.createDataFrame([("p", "0", "a", 5)], "path string, i string, j string, c long"))
    assert {tuple(r) for r in closed.collect()} == {("p", "a", "0", 3)}


def test_routes_are_made_distinct_while_narrow(spark, folder):
    text = Tables(spark, folder).candidates._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" in text and text.index("sha2") < text.index("Aggregate")


def test_a_page_moves_its_rows_once(spark):
    section = spark.createDataFrame([(k, o, "x" * 50 * o) for k in ("a", "b") for o in range(1, 5)], "k string, ord int, body string")
    page = evidence.detail_page(section, ["k"], ["ord"], offset=1, limit=2, max_bytes=300).select("k", "position", "status", "total_items")
    assert plan(page.select("k", "status")).count("Exchange hashpartitioning") <= 2
    assert sorted(map(tuple, page.collect())) == [("a", None, "page_too_large", 4), ("b", None, "page_too_large", 4)]


def test_confidence_of_whole_routes_needs_no_exchange(spark):
    edge = "struct<id:string,dispatch:string,certainty:string,confidence:string>"
    rows = [("a", [("1", "direct", "must", "high"), ("2", "direct", "may", "high")]), ("b", [("3", "direct", "must", "low")]), ("c", [("4", "direct", "must", "high")]), ("d", [("5", None, None, None)]), ("e", [])]
    routes = spark.createDataFrame(rows, f"candidate_id string, edges array<{edge}>")
    whole = evidence.path_confidence(routes, "candidate_id")
    assert "Exchange" not in plan(whole)
    by_edges = evidence.path_confidence(evidence.route_edges(routes), "candidate_id")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, by_edges.collect())) and whole.count() == 4


def test_flows_without_ends_are_found_in_one_pass(spark):
    flows = spark.createDataFrame([("f1", "a", "b"), ("f2", "a", "none"), ("f3", None, "b"), ("f4", "a", "b")], "flow_id string, src string, snk string")
    facts = spark.createDataFrame([("a",), ("b",), ("b",)], "fact_id string")
    both, lost = evidence.add_uncovered_flows(flows.filter("flow_id = 'f4'"), flows, facts)
    assert plan(lost).count("Join") == 3
    assert sorted((r.flow_id, r.origin) for r in both.collect()) == [("f1", "display_only"), ("f4", "retained")]
    assert sorted(r.flow_id for r in lost.collect()) == ["f2", "f3"]


def test_legacy_edges_of_one_project_spread(spark):
    sites = spark.createDataFrame([(1, "c/0", "f", [("e", "g", "direct")])], "project long, callsite_id string, caller string, targets array<struct<edge_id:string,target:string,dispatch:string>>")
    legacy = spark.range(2000).select((F.col("id") % 2).alias("project"), F.concat(F.lit("e"), "id").alias("id"), F.lit("f").alias("source"), F.lit("g").alias("target"), F.lit("calls").alias("relation"), F.lit("direct").alias("dispatch"))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        edges = files.call_edges(sites, legacy, "project")
        held = edges.filter("callsite_id is null").groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(r["count"] for r in held) == 1000 and max(r["count"] for r in held) < 500


def test_facts_on_a_route_are_joined_once(spark):
    routes = spark.createDataFrame([("r1", ["a", "b"]), ("r2", ["b"]), ("r3", ["c"])], "route string, nodes array<string>")
    facts = spark.createDataFrame([("a", "f1", "guard", "p", 1, "x"), ("b", "f2", "guard", "p", 2, "x"), ("b", "f3", "sink", "p", 1, "x")], "symbol string, fact_id string, fact_kind string, path string, line int, rule_id string")
    found = evidence.facts_on_path(routes, facts, "route", limit=2)
    assert plan(found).count("Join") == 1
    assert sorted(map(tuple, found.select("route", "position", "fact_id", "truncated").collect())) == [("r1", 1, "f1", True), ("r1", 2, "f3", True), ("r2", 1, "f3", False), ("r2", 2, "f2", False)]


def test_running_sums_leave_no_uncompressed_checkpoint(spark):
    placed = skew.ranked(spark.range(100).select((F.lit(100) - F.col("id")).alias("v")), [], ["v"], "rank")
    text = placed._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation" in text and text.count("ExistingRDD") + text.count("LogicalRDD") == 1  # the totals of the partitions alone
    assert all(r.v == r["rank"] for r in placed.collect())


def test_paths_and_origins_leave_no_uncompressed_checkpoint(spark, monkeypatch):
    monkeypatch.setattr(flow, "pin", None)
    monkeypatch.setattr(graphs, "pin", None)
    edges = spark.createDataFrame([(1, 1, "a", 2, "a", "e1"), (1, 2, "a", 3, "b", "e2")], "fn int, source long, source_var string, target long, target_var string, edge_id string")
    ends = lambda node, var: spark.createDataFrame([(1, node, var)], "fn int, node long, var string")
    assert [r.edge_ids for r in flow.value_paths(edges, ends(1, "a"), ends(3, "b")).collect()] == [["e1", "e2"]]
    copies = spark.createDataFrame([(1, 2, "a", "b")], "fn int, node long, in_var string, out_var string")
    def_use = spark.createDataFrame([(1, 1, 2, "a"), (1, 2, 3, "b")], "fn int, source long, target long, var string")
    assert [(r.origin, r.origin_var) for r in flow.backward_origins(ends(3, "b"), def_use, copies).collect()] == [(1, "a")]


def test_returns_meet_the_call_they_came_by(spark, monkeypatch):
    calls = 60
    sources = spark.createDataFrame([(f"s{i}", f"f{i}", "x") for i in range(calls)], "src string, fn string, var string")
    uses = [(f"f{i}", "x", "call", f"c{i}", "a", "must") for i in range(calls)] + [("hub", "p", "return", "ret", "p", "must")] + [(f"f{i}", "r", "sink", f"u{i}", "r", "must") for i in range(calls)]
    local = spark.createDataFrame(uses, "fn string, var string, use_kind string, use_id string, name string, certainty string")
    table = lambda rows, names: spark.createDataFrame(rows, names)
    tables = (sources, local, table([(f"c{i}", f"f{i}", "hub", "must") for i in range(calls)], "call_id string, caller string, callee string, certainty string"),
              table([(f"c{i}", "a", "p") for i in range(calls)], "call_id string, name string, param string"), table([(f"c{i}", "r") for i in range(calls)], "call_id string, result string"),
              table([(f"u{i}", f"snk{i}") for i in range(calls)], "use_id string, snk string"))
    keep, plans = flow.stored, []

    def watched(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return keep(df)

    monkeypatch.setattr(flow, "stored", watched)
    flows, _ = flow.propagate_taint(*tables, max_states=None, max_variants=None)
    assert sorted((r.src, r.snk) for r in flows.collect()) == sorted((f"s{i}", f"snk{i}") for i in range(calls))
    # no join keeps a condition that pairs all values in a callee with all of its calls
    assert plans and not any("isnull(_top" in line and " OR " in line for text in plans for line in text.splitlines() if "Join" in line)


def test_nodes_of_an_evidence_graph_read_no_edges_of_routes(spark, monkeypatch):
    monkeypatch.setattr(graphs, "pin", None)
    monkeypatch.setattr(flow, "pin", None)
    edges = spark.createDataFrame([("e1", "a", "b", "calls", "direct"), ("e2", "b", "c", "calls", "direct"), ("e3", "b", "c", "calls", "direct"), ("e4", "x", "c", "calls", "direct"), ("e5", "y", "z", "calls", "direct")],
                                  "id string, source string, target string, relation string, dispatch string")
    routes = spark.createDataFrame([("r1", ["a", "b", "c"], ["e1", "e2"]), ("r2", ["a", "b", "c"], ["e1", "e3"])], "route string, nodes array<string>, edge_ids array<string>")
    nodes, merged = flow.evidence_graph(routes, spark.createDataFrame([("c",), ("z",)], "id string"), edges, per_target=3)
    assert plan(nodes).count("Exchange hashpartitioning") == 1 and "Join" not in plan(nodes)
    assert sorted(map(tuple, nodes.collect())) == [("a", "route"), ("b", "route"), ("c", "route"), ("x", "context"), ("y", "context"), ("z", "operation")]
    assert sorted((r.source, r.target, r.id, r.occurrence_count) for r in merged.collect()) == [("a", "b", "e1", 1), ("b", "c", "e2", 2), ("x", "c", "e4", 1), ("y", "z", "e5", 1)]


def test_names_of_short_routes_are_connected_in_their_row(spark, monkeypatch):
    rng = random.Random(9)
    links = [(r, 0, rng.choice("abcdef"), 0, rng.choice("abcdef"), rng.random() < 0.95) for r in range(80) for _ in range(rng.randint(0, 5))]
    terms = [(r, 0, rng.choice("abcdef"), rng.choice(["<=", ">=", "=="]), rng.randint(0, 3), None) for r in range(80) for _ in range(3)]
    parts = spark.createDataFrame([(r, 0, 0, False) for r in range(80)], "route int, part int, frame int, gap boolean")
    bindings = spark.createDataFrame(links, "route int, frame int, name string, source_frame int, source_name string, exact boolean")
    predicates = spark.createDataFrame(terms, "route int, frame int, var string, op string, value long, text string")
    answer = lambda **how: {r.route: r.status for r in flow.compose_route(parts, predicates, bindings, **how).collect()}
    by_rounds = answer(local_links=0)
    assert answer(local_links=3) == by_rounds and len(set(by_rounds.values())) == 3
    monkeypatch.setattr(flow, "components", None)
    assert answer() == by_rounds


def test_short_ranges_take_few_steps(spark, monkeypatch):
    rng = random.Random(10)
    rows = [(a, a + rng.choice([-2, 0, 0, 1, 6, 7, 8, 63, 1000, 2**20])) for a in (rng.randrange(5000) for _ in range(400))] + [(None, 3), (3, None), (0, 2**31), (2**40, 2**40 + 5)]
    ranges = spark.createDataFrame(rows, "low long, high long").select("low", "high", flow.dyadic_cover(F.col("low"), F.col("high")).alias("cover"))
    for r in ranges.collect():
        tiles = sorted((c.block << c.level, (c.block + 1) << c.level) for c in r.cover)
        if r.low is None or r.high is None or r.low > r.high:
            assert not tiles
        else:
            assert tiles[0][0] == r.low and tiles[-1][1] == r.high + 1 and all(a[1] == b[0] for a, b in zip(tiles, tiles[1:]))
    steps, counted = flow.F.sequence, []
    monkeypatch.setattr(flow.F, "sequence", lambda *bounds: counted.append(bounds[1]) or steps(*bounds))
    flow.dyadic_cover(F.col("low"), F.col("high"))
    top = spark.createDataFrame([(7, 7), (1, 9), (0, 2**50)], "low long, high long").select(counted[0].alias("n")).collect()
    assert [r.n for r in top] == [0, 3, 39]


def test_settled_nodes_move_no_more(spark, monkeypatch):
    rows = [(1, f"n{i}", "top" if i == 0 else None, f"n{i - 1}" if i else None) for i in range(12)] + [(2, f"m{i}", f"v{i}", None) for i in range(50)] + [(3, "a", None, "b"), (3, "b", None, None), (3, "c", None, "lost")]
    keep, moved = flow.stored, []
    monkeypatch.setattr(flow, "pin", None)
    monkeypatch.setattr(flow, "stored", lambda df: moved.append(keep(df)) or moved[-1])
    got = {(r.fn, r.node): r.value for r in flow.resolved_upwards(spark.createDataFrame(rows, "fn int, node string, value string, up string")).collect()}
    assert got == {(1, f"n{i}"): "top" for i in range(12)} | {(2, f"m{i}"): f"v{i}" for i in range(50)} | {(3, "a"): None, (3, "b"): None, (3, "c"): None}
    assert [df.count() for df in moved][:2] == [65, 13]


def test_endpoints_meet_the_facts_once(spark):
    long = "candidate:" + "0a" * 12
    rows = [(long, "g1", "a", "b", ["e1"]), ("r2", "g2", "b", "a", ["e1", "none"]), ("r3", "g3", None, "b", []), ("r4", "g4", "a", "lost", None), (None, "g1", "a", "c", ["e2"])]
    routes = spark.createDataFrame(rows, "candidate_id string, path_group_id string, src string, snk string, edge_ids array<string>")
    facts = spark.createDataFrame([("a", "source"), ("b", "sink"), ("c", "sink"), ("c", "guard")], "fact_id string, fact_kind string")
    found = evidence.check_references(routes, facts, spark.createDataFrame([("e1",), ("e1",)], "id string"))
    assert plan(found).count("Join") == 2
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, [
        ("endpoint_role", "r2"), ("endpoint_role", "r2"), ("endpoint_unknown", "r3"), ("endpoint_unknown", "r4"), ("endpoint_role", None), ("edge_unknown", "r2"), ("edge_unknown", None), ("group_endpoints", "g1")]))


def test_packed_ids_are_shorter_and_come_back(spark):
    texts = ["candidate:" + "0a" * 12, "0a" * 12, "x" + "0A" * 12, "é:" + "9f" * 12, "é:" + "9f" * 12 + "\n", "0a" * 11, "", "\x01ab", "\x00", "ff" * 30, "a" * 23, None]
    got = spark.createDataFrame([(t,) for t in texts], "v string").select("v", packed("v").alias("p")).select("v", "p", unpacked("p").alias("back")).collect()
    assert [r.back for r in got] == texts and len({r.p and bytes(r.p) for r in got}) == len(texts)
    assert len(got[0].p) == 23 and len(got[1].p) == 13


def test_lines_meet_suppliers_while_narrow(spark, folder):
    text = Tables(spark, folder).candidates._jdf.queryExecution().analyzed().toString()
    at = [i for i, line in enumerate(text.splitlines()) if " Join " in line]
    assert "l_orderkey" in text.splitlines()[at[0]] and "l_suppkey" in text.splitlines()[at[1]]


def test_families_of_routes_that_tell_move_once(spark, folder):
    rows = [("r1", "g", "a", "b", "propagation_path", "unknown", False, True), ("r2", "g", "a", "b", "structural_lead", "not_checked", True, False), ("r2", "g", "a", "b", "other", None, None, False),
            ("r3", "h", "a", "c", "operation_lead", "unknown", False, None), ("r4", "i", "a", "d", None, "unknown", False, True), (None, None, "a", "d", "structural_lead", "unknown", None, False)]
    routes = spark.createDataFrame(rows, "candidate_id string, path_group_id string, src string, snk string, kind string, condition_status string, truncated boolean, reported boolean")
    told = evidence.path_family(routes, F.col("reported"))
    assert plan(told).count("Exchange hashpartitioning") == 1 and "Join" not in plan(told)
    listed = evidence.path_family(routes, routes.filter("reported").unionByName(routes.filter("reported")))
    assert told.columns == listed.columns and sorted(map(str, told.collect())) == sorted(map(str, listed.collect()))
    got = {r.path_group_id: r for r in told.collect()}
    assert [(got[g].retained_routes, got[g].reported_routes, got[g].progress, got[g].open_structural_lead, got[g].open_unknown, got[g].analysis_truncated) for g in ("g", "h", "i", None)] == [
        (3, 1, "partial", 1, 0, True), (1, 0, "not_started", 0, 1, False), (1, 1, "all_retained_reported", 0, 0, False), (1, 0, "not_started", 1, 1, None)]
    assert plan(QUERIES["agg09_path_family"](spark, folder)).count("Join") == 3  # those that make the routes


def test_sections_of_a_symbol_are_counted_once(spark, folder):
    routes = spark.createDataFrame([("r1", "a", [1, 2]), ("r2", "a", [1]), ("r3", "b", []), ("r4", None, None), ("r3", "c", [1])], "candidate_id string, mid string, steps array<int>")
    facts = spark.createDataFrame([("a",), ("a",), ("c",), ("x",), (None,)], "symbol string")
    open_ends = spark.createDataFrame([("b",), ("a",), (None,)], "symbol string")
    found = evidence.detail_sections(routes, None, facts, open_ends, symbol="mid")
    assert plan(found).count("Join") == 2
    assert sorted(map(tuple, found.collect())) == [("r1", 2, 2, 1), ("r2", 1, 2, 1), ("r3", 0, 0, 1), ("r3", 1, 1, 0), ("r4", 0, 0, 0)]
    single, named = routes.filter("mid is null or mid <> 'c'"), routes.filter("mid is null or mid <> 'c'").select("candidate_id", F.col("mid").alias("symbol"))
    by_rows = evidence.detail_sections(single, single, named.join(facts, "symbol"), named.join(open_ends, "symbol"))
    assert sorted(map(tuple, by_rows.collect())) == sorted(map(tuple, evidence.detail_sections(single, None, facts, open_ends, symbol="mid").collect()))
    assert plan(QUERIES["flt11_detail_sections"](spark, folder)).count("Join") == 5  # three that make the routes


def test_a_route_that_comes_twice_counts_once(spark):
    routes = spark.createDataFrame([("r1", "g", ["a", "b", "a"]), ("r1", "g", ["a", "b", "a"]), ("r2", "h", ["b"]), ("r3", "h", ["b"])], "route string, family string, nodes array<string>")
    assert sorted(map(tuple, evidence.family_membership(routes).collect())) == [("a", 1, 1, False), ("b", 3, 2, True)]


def test_pages_of_a_key_that_comes_once_do_not_move(spark):
    """The same pages as row by row: keys that come twice, without rows, in any order, over the budget, near it, with texts that JSON lengthens."""
    rows = [("a", [(2, "y"), (1, "x"), (3, None), (4, "z")]), ("b", [(1, "\n\u0001\"é" * 9)] * 2), ("c", []), ("d", None), (None, [(1, "x")]), ("e", [(n, "x" * 60) for n in range(5)]), ("f", [(1, "p"), (3, "q")]), ("f", [(2, "r")]), ("g", [None, (1, "s")]), ("h", [(1, "x" * 50), (None, "n")])]
    packed = spark.createDataFrame(rows, "k string, items array<struct<ord: int, body: string>>")
    flat = packed.select("k", F.explode("items").alias("s")).select("k", "s.*")
    told = lambda df: sorted(map(str, df.collect()))
    for offset, limit, most in ((0, 2, 100), (1, 2, 150), (0, 9, 230), (3, 0, 24_000)):
        want, got = evidence.detail_page(flat, ["k"], ["ord"], offset, limit, most), evidence.detail_page(packed, ["k"], ["ord"], offset, limit, most, "items")
        assert want.columns == got.columns and [f.dataType for f in want.schema] == [f.dataType for f in got.schema] and told(want) == told(got)
    once = evidence.detail_page(packed.filter("k <> 'f'"), ["k"], ["ord"], 1, 2, 150, "items")
    assert "Exchange" not in plan(once) and told(once) == told(evidence.detail_page(flat.filter("k <> 'f'"), ["k"], ["ord"], 1, 2, 150))


def test_facts_on_a_route_travel_with_packed_ids(spark):
    ident = "candidate:" + "0123456789abcdef01234567"
    routes = spark.createDataFrame([(ident, ["a", "b"]), ("plain", ["b", "b"]), ("", ["a"]), (None, ["a"])], "candidate_id string, nodes array<string>")
    facts = spark.createDataFrame([("a", "f1", "guard", None, 1, "x"), ("b", "f2", "guard", "p", 2, "x"), ("b", "f3", "sink", "p", 1, "x")], "symbol string, fact_id string, fact_kind string, path string, line int, rule_id string")
    found = evidence.facts_on_path(routes, facts, "candidate_id", limit=2)
    assert "unhex" in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [("", 1, "a", "f1", "guard", False), (ident, 1, "a", "f1", "guard", True), (ident, 2, "b", "f3", "sink", True), ("plain", 1, "b", "f3", "sink", True), ("plain", 2, "b", "f2", "guard", True)]
    numbered = routes.select(F.length("candidate_id").alias("n"), "nodes")
    assert sorted(r.n for r in evidence.facts_on_path(numbered, facts, "n", limit=1).collect()) == [0, 5, 34]


def test_candidates_count_what_lies_on_their_way_by_symbol(spark, monkeypatch):
    """Also over the limits, for symbols that come twice on a way and for one candidate in two rows."""
    rows = [("s", "t", ["a", "b", "a", None], ["e1"], "e1", 1, "f1"), ("s", "t", ["c"], ["e2"], "e2", 1, "f2"), ("s", "u", None, ["e3"], "e3", 1, "f3"), ("s", "u", ["b"], ["e4"], "e4", 2, "f4"), ("s", "u", ["b"], ["e4"], "e4", 2, "f4"), ("v", "t", ["x"], ["e5"], "e5", 1, "f5")]
    flows = spark.createDataFrame(rows, "src string, snk string, nodes array<string>, edge_ids array<string>, edge_key string, steps int, flow_id string")
    checks = [("a", "g1", "guard"), ("a", "g2", "sanitizer"), ("b", "g3", "guard"), ("b", "g4", "source"), (None, "g5", "guard")]
    facts = spark.createDataFrame([(s, i, k, "p", 1, "r") for s, i, k in checks], "symbol string, fact_id string, fact_kind string, path string, line int, rule_id string")
    open_ends = spark.createDataFrame([("u1", "a"), ("u2", "a"), ("u3", "b"), ("u4", None)], "id string, symbol string")
    leads = flows.filter("src = 'v'").withColumn("flow_id", F.lit(None).cast("string"))
    made = lambda *limits: sorted((r.src, r.snk, r.variant_no, r.kind[:4], r.guards, r.sanitizers, r.unresolved, r.truncated) for r in flow.build_candidates(flows.filter("src = 's'"), leads, facts, open_ends, None, *limits).collect())
    cut = made(3, 2)
    assert cut[0] == ("s", "t", 1, "prop", 2, 1, 2, True) and made(12, 20)[0] == ("s", "t", 1, "prop", 3, 2, 3, False)
    assert cut[1:] == [("s", "t", 2, "prop", 0, 0, 0, False), ("s", "u", 1, "prop", 0, 0, 0, False), ("s", "u", 2, "prop", 2, 0, 2, False), ("s", "u", 3, "prop", 2, 0, 2, False), ("v", "t", 1, "stru", 0, 0, 0, False)]
    monkeypatch.setattr(evidence, "facts_on_path", None)
    monkeypatch.setattr(flow, "pin", None)
    assert len(made(12, 20)) == 6


def test_ranks_need_no_exchange_but_the_sort(spark):
    """Keys that span partitions and batches, fill them, come once or are null."""
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id") % 700)).alias("k"), (F.col("id") % 2).alias("j"), (F.hash("id") % 1000).alias("o"), "id")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "29")
    try:
        for partitions in ("4", "60"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            got = skew.ranked(rows, ["k", "j"], ["o", "id"], "n")
            text = got._jdf.queryExecution().optimizedPlan().toString()
            assert "Window" not in text and "Aggregate" not in text
            want = rows.filter("k is not null").withColumn("n", F.expr("row_number() over (partition by k, j order by o, id)").cast("long"))
            assert got.schema["n"].dataType == want.schema["n"].dataType and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert skew.ranked(rows.limit(0), ["k"], ["o"]).collect() == []
