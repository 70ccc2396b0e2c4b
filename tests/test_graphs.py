"""Graph normalisation, paths and closures on hand-written and random graphs."""

import json
import random

from pyspark.sql import functions as F

from tracewell.functions import ids, verdicts
from tracewell.operators import graphs, resolve
from tracewell.operators.fixpoint import closure
from tracewell.sources.documents import load_node_link


def test_exchange_normalisation(spark):
    raw = {
        "nodes": [{"id": "a.py", "level": "module"}, {"id": "a.py::f", "level": "function", "file": "/host/a.py", "line": 3}, {"id": "a.py::f", "level": "function"}, {"level": "function"}, {"id": "<stdlib>::os", "level": "stdlib"}],
        "links": [{"source": {"id": "a.py"}, "target": "a.py::f", "relation": "contains"}, {"source": "a.py::f", "target": "<stdlib>::os", "type": "calls"}, {"source": "a.py", "target": "gone"}, {"source": "a.py", "target": "a.py"}],
    }
    nodes, edges = load_node_link(spark.createDataFrame([(1, json.dumps(raw))], "doc int, body string"), "doc", "body")
    clean = nodes.filter("id <> ''").dropDuplicates(["id"])
    kept, rejected = graphs.drop_dangling(edges, clean)
    assert clean.count() == 3 and kept.count() == 2
    assert {r.reason: r.edges for r in rejected.collect()} == {"dangling": 1, "self_loop": 1}
    shown = clean.select("id", verdicts.graph_scope("id", F.coalesce("level", F.lit("variable"))).alias("scope"), ids.safe_relative_path("file").alias("file")).collect()
    assert {r.id: r.scope for r in shown} == {"a.py": "project", "a.py::f": "project", "<stdlib>::os": "stdlib"}
    assert all(r.file is None for r in shown)
    assert all(r.id.startswith("dependency-view-edge:") for r in edges.collect())


def test_parallel_edges_and_caps(spark):
    edges = spark.createDataFrame([("e2", "a", "b", "calls", ""), ("e1", "a", "b", "calls", ""), ("e3", "a", "b", "calls", "virtual")], "id string, source string, target string, relation string, dispatch string")
    got = {(r.dispatch, r.id, r.occurrence_count) for r in graphs.merge_parallel_edges(edges).collect()}
    assert got == {("", "e1", 2), ("virtual", "e3", 1)}
    capped = graphs.cap_with_flag(edges, ["id"], 1).collect()
    assert [(r.id, r.omitted, r.truncated) for r in capped] == [("e1", 2, True)]


def test_a_dangling_edge_is_an_issue(spark):
    nodes = spark.createDataFrame([("a",), ("",)], "id string")
    edges = spark.createDataFrame([("e", "a", "missing"), ("", "a", "a")], "id string, source string, target string")
    got = sorted((r.code, r.edge_id) for r in graphs.validate_graph(nodes, edges).collect())
    assert got == [("dangling_edge", "e"), ("empty_identity", None), ("empty_identity", None)]


def random_graph(seed, nodes=9, count=16):
    rng = random.Random(seed)
    return [(f"e{i}", f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}") for i in range(count)]


def test_path_variants_keep_parallel_edges_apart(spark):
    rows = [e for e in random_graph(1) if e[1] != e[2]] + [("p1", "n0", "n1"), ("p2", "n0", "n1")]
    edges = spark.createDataFrame(rows, "id string, source string, target string")
    nodes = sorted({x for e in rows for x in e[1:]})
    s = spark.createDataFrame([(n,) for n in nodes], "s string")
    t = spark.createDataFrame([("n1",), ("n3",)], "t string")
    found = graphs.path_variants(edges, s, t, 4, None, None).filter("hops > 0").collect()
    want = set()

    def walk(path, ids_):
        if path[-1] in ("n1", "n3") and ids_:
            want.add((path[0], path[-1], tuple(ids_)))
        if len(ids_) < 4:
            for i, a, b in rows:
                if a == path[-1] and b not in path:
                    walk([*path, b], [*ids_, i])

    for n in nodes:
        walk([n], [])
    assert {(r.s, r.t, tuple(r.edge_ids)) for r in found} == want
    few = graphs.path_variants(edges, s, t, 4, 1, 2048).filter("hops > 0").collect()
    best = {}
    for a, b, ids_ in want:
        best[(a, b)] = min(best.get((a, b), (99, ())), (len(ids_), ids_))
    # the source itself counts as the first variant of a pair that is its own target
    assert {(r.s, r.t): tuple(r.edge_ids) for r in few} == {k: v[1] for k, v in best.items() if k[0] != k[1]}
    assert any(r.truncated for r in few)


def test_unrolled_rounds_reach_the_same_rows_and_levels(spark):
    rows = random_graph(4, 40, 70)
    hops = spark.createDataFrame(rows, "id string, n string, m string").select("n", "m")
    seed = spark.createDataFrame([("n0", "n0"), ("n5", "n5")], "s string, n string")
    step = lambda d: d.join(hops, "n").select("s", F.col("m").alias("n"))
    one = {tuple(r) for r in closure(seed, step, ["s", "n"], level="d").collect()}
    assert one == {tuple(r) for r in closure(seed, step, ["s", "n"], level="d", unroll=3).collect()}
    want, frontier, depth = {}, {("n0", "n0"), ("n5", "n5")}, 0
    while frontier:
        for x in frontier:
            want.setdefault(x, depth)
        depth += 1
        frontier = {(s, b) for s, n in frontier for _, a, b in rows if a == n} - set(want)
    assert one == {(s, n, d) for (s, n), d in want.items()}


def test_alias_chains_stop_after_eight_links(spark):
    aliases = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(100, 101), (101, 100)], "id int, alias int")
    got = {r.id: r.canonical for r in graphs.canonical(aliases).collect()}
    assert got == {**{i: min(i + 8, 12) for i in range(12)}, 100: 100, 101: 101}


def test_member_owner_is_the_most_derived_class(spark):
    bases = spark.createDataFrame([("C", "B"), ("B", "A"), ("C", "I"), ("D", "X"), ("D", "Y")], "type string, base string")
    members = spark.createDataFrame([("A", "m"), ("B", "m"), ("I", "m"), ("X", "n"), ("Y", "n")], "type string, member string")
    kinds = spark.createDataFrame([(t, "interface" if t == "I" else "class") for t in "ABCDIXY"], "type string, kind string")
    lookups = spark.createDataFrame([("C", "m"), ("B", "m"), ("D", "n"), ("A", "n")], "type string, member string")
    got = {(r.type, r.member, r.owner, r.ambiguous) for r in graphs.nearest_declaring_ancestor(lookups, members, graphs.ancestors(bases), kinds).collect()}
    assert got == {("C", "m", "B", False), ("B", "m", "B", False), ("D", "n", "X", True), ("D", "n", "Y", True)}


def test_paths_are_normalised(spark):
    raw = ["a/b/../c", "./a/./b", "../x", "a/../../b", "a//b/"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, p string").select("i", resolve.normalise_path(F.col("p")).alias("x")).orderBy("i")
    assert [r.x for r in df.collect()] == ["a/c", "a/b", "../x", "../b", "a/b"]


def test_long_chains_and_rings_have_no_round_limit(spark):
    """A chain and a ring of 1,000 nodes, five times the old limit; the number of rounds is far below that."""
    n = 1000
    hops = spark.range(n).select(F.concat(F.lit("c"), "id").alias("source"), F.concat(F.lit("c"), F.col("id") + 1).alias("target")).unionByName(
        spark.range(n).select(F.concat(F.lit("r"), "id").alias("source"), F.concat(F.lit("r"), (F.col("id") + 1) % n).alias("target")))
    seeds = spark.createDataFrame([("c0",), ("r7",)], "seed string")
    got = {(r.seed, r.node): r.level for r in graphs.reachable(hops, seeds, level="level").collect()}
    assert got == {("c0", f"c{i}"): i for i in range(n + 1)} | {("r7", f"r{(7 + i) % n}"): i for i in range(n)}


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(200)] + [(5000, 5001 + i) for i in range(300)] + [(7, 7), (9999, 9999)]
    label = {}
    for a, b in links:
        label.setdefault(a, a), label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    got = {r.id: r.component for r in graphs.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == label
