"""Distances, ancestors and dominators against plain walks, and their rounds on long functions."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from tracewell.operators import flow, trees


def plain_distances(edges, root):
    out, todo = {root: 0}, deque([root])
    while todo:
        n = todo.popleft()
        for a, b in edges:
            if a == n and b not in out:
                out[b] = out[n] + 1
                todo.append(b)
    return out


def test_distances_in_random_graphs(spark):
    rng, graphs = random.Random(4), {}
    for fn in range(8):
        n = rng.choice([2, 6, 20])
        graphs[fn] = {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.choice([1, n, 2 * n]))}
    edges = spark.createDataFrame([(fn, f"n{a}", f"n{b}") for fn, es in graphs.items() for a, b in es] + [(1, "n0", "n1")] * 2, "fn int, source string, target string")
    roots = spark.createDataFrame([(fn, "n0") for fn in graphs], "fn int, root string")
    graphs[1] = graphs[1] | {(0, 1)}
    got = {(r.fn, r.node): r.dist for r in trees.distances(edges, roots).collect()}
    assert got == {(fn, f"n{v}"): d for fn, es in graphs.items() for v, d in plain_distances(es, 0).items()}


@pytest.fixture(scope="module")
def forest(spark):
    """fn -> node -> parent (None at a root): random trees, a path of 300 nodes and a star."""
    rng, up = random.Random(6), {}
    for fn in range(12):
        up[fn] = {i: (rng.randrange(max(0, i - rng.choice([1, 3, 40])), i) if i else None) for i in range(80)}
    up[100] = {i: i - 1 if i else None for i in range(300)}
    up[101] = {i: 0 if i else None for i in range(50)}
    return up, spark.createDataFrame([(fn, n, p) for fn, t in up.items() for n, p in t.items()], "fn int, node long, up long")


def way(tree, node):
    out = [node]
    while tree[out[-1]] is not None:
        out.append(tree[out[-1]])
    return out


def test_ancestors(spark, forest):
    up, frame = forest
    tables = trees.jump_tables(frame)
    assert len(tables) == 3
    assert {(r.fn, r.node): r.depth for r in trees.depths(tables).collect()} == {(fn, n): len(way(t, n)) - 1 for fn, t in up.items() for n in t}
    rng, groups = random.Random(7), {}
    for g in range(200):
        fn = rng.choice(list(up))
        groups[fn, g] = {rng.choice(list(up[fn])) for _ in range(rng.choice([1, 2, 2, 3, 10]))}
    rows = spark.createDataFrame([(fn, g, n) for (fn, g), ns in groups.items() for n in ns], "fn int, grp long, node long")
    got = {(r.fn, r.grp): r.node for r in trees.common_ancestors(rows, tables).collect()}
    assert got == {(fn, g): next(a for a in way(up[fn], min(ns)) if all(a in way(up[fn], n) for n in ns)) for (fn, g), ns in groups.items()}
    ways = [(fn, n, rng.randint(0, len(way(t, n))), f"{fn}/{n}") for fn, t in up.items() for n in rng.sample(list(t), 20)]
    found = trees.ways_up(spark.createDataFrame(ways, "fn int, node long, count long, tag string"), tables).collect()
    assert sorted((r.tag, r.node) for r in found) == sorted((tag, a) for fn, n, count, tag in ways for a in way(up[fn], n)[:count])


def counted(monkeypatch):
    calls = []
    pin = trees.stored
    monkeypatch.setattr(trees, "stored", lambda df: calls.append(1) or pin(df))
    return calls


@pytest.mark.parametrize("shape,n", [("diamonds", 1_000)])
def test_long_functions_settle_in_few_rounds(spark, monkeypatch, shape, n):
    """One function that no task holds: the number of stored tables grows with the logarithm of its length."""
    node = spark.range(n).select(F.lit("f").alias("fn"), "id")
    hop = lambda where, far: node.filter(where).select("fn", F.col("id").alias("source"), (F.col("id") + far).alias("target")).filter(F.col("target").between(0, n - 1))
    if shape == "diamonds":  # 0 -> 1, 2 -> 3 -> 4, 5 -> 6 ...
        edges = hop("id % 3 = 0", 1).unionByName(hop("id % 3 = 0", 2)).unionByName(hop("id % 3 = 1", 2)).unionByName(hop("id % 3 = 2", 1))
        want = F.expr("node - if(node % 3 = 0, 3, node % 3)")
    else:
        edges, want = hop("true", 1).unionByName(hop("true", 2)), F.lit(0)
    calls = counted(monkeypatch)
    roots = spark.createDataFrame([("f", 0)], "fn string, root long")
    got = flow.immediate_dominators(edges, roots, 100)
    assert got.count() == n - 1 and got.filter(F.col("idom") != want).isEmpty()
    assert len(calls) < 110
