"""Mixing against a plain water level and the promises of pivotal rounding."""

import random

import numpy as np
from pyspark.sql import functions as F

from tracewell.llm import mixing as M
from tracewell.llm.common import word_count

SCHEMA = "doc_id long, source string, size long"


def levels(sizes):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target = {s: 0.0 for s in names}
    rest, free = 1.5 * sum(sizes.values()), set(names)
    while rest > 1e-9 and free:
        unit = rest / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * unit > 2 * sizes[s]}
        if not over:
            for s in free:
                target[s] = weight[s] * unit
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            rest -= target[s]
        free -= over
    return target


def check(rows, got):
    """``got``: rows of (doc_id, size, source_size, target, copies, taken, source)."""
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + (n or 0)
    want = levels(sizes)
    assert len(got) == len(rows)
    taken = dict.fromkeys(sizes, 0)
    for doc_id, size, source_size, target, copies, words, source in got:
        assert source_size == sizes[source] and np.isclose(target, want[source], rtol=1e-9)
        assert words == copies * size and 0 <= copies <= 2
        if sizes[source]:
            p = want[source] / sizes[source]
            assert np.floor(p - 1e-9) <= copies <= np.ceil(p + 1e-9)
        taken[source] += words
    for s, words in taken.items():
        assert abs(words - want[s]) <= max([n or 0 for _, x, n in rows if x == s]) / 2 + 1e-6
    return taken, want


def run(spark, rows):
    frame = spark.createDataFrame([(*r, r[1]) for r in rows], SCHEMA + ", _tag string")
    return [tuple(r) for r in M.mix(frame, carry=["_tag"]).collect()]


def test_hot_source_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(M, "FAN_IN", 8)
    rng = random.Random(2)
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 7}", int(rng.paretovariate(1.1) * 20)) for i in range(2500)]
    rows += [(5000 + i, None, 40 + i) for i in range(30)] + [(6000, "tiny", 3)]
    got = run(spark, rows)
    taken, want = check(rows, got)
    assert abs(taken["hot"] - want["hot"]) <= max(n for _, s, n in rows if s == "hot") / 2
    assert sorted(got, key=repr) == sorted(run(spark, rows[::-1]), key=repr)


def test_given_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    check([tuple(r) for r in docs.collect()], run(spark, [tuple(r) for r in docs.collect()]))


def test_odd_rows(spark):
    rows = [(1, "a", 0), (2, "a", None), (3, None, 10), (3, None, 10), (None, "b", 7), (4, "B", 100_000), (5, "", 5), (6, "é", 9), (7, "z", 3)]
    check(rows, run(spark, rows))
    assert all(r[3:6] == (0.0, 0, 0) for r in run(spark, [(1, "a", 0), (2, None, 0)]))


def test_repeated_rows_share_no_leaf_and_no_draw(spark, monkeypatch):
    monkeypatch.setattr(M, "FAN_IN", 64)
    rows = [(None, "a", 10)] * 3000 + [(7, "a", 10)] * 500 + [(i, f"s{i % 5}", 10 + i % 90) for i in range(3000)]
    ranks = M.with_copies(spark.createDataFrame(rows, SCHEMA), ["source", "doc_id", "size"]).groupBy("source", "doc_id", "size").agg(F.count("*").alias("n"), F.countDistinct("_copy").alias("d"), F.max("_copy").alias("m"))
    assert all(r.n == r.d + 1 and (r.m or 0) == r.n - 1 for r in ranks.collect())
    got = run(spark, rows)
    taken, want = check(rows, got)
    share = sum(r[4] for r in got if r[0] is None) / 3000
    assert abs(share - want["a"] / 35_000) < 0.05
    assert sorted(got, key=repr) == sorted(run(spark, rows[::-1]), key=repr)


def test_leaves_stay_small_under_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(M, "FAN_IN", 64)

    def leaf(rows):
        assert rows.num_rows < 2 * 64
        return M._rounded(rows, leaf=True)

    monkeypatch.setattr(M, "_leaf", leaf)
    assert M.mix(spark.createDataFrame([(None, "a", 10)] * 4000 + [(i, "a", 10) for i in range(1000)], SCHEMA)).count() == 5000


def test_empty(spark):
    assert run(spark, []) == []


def test_rounding_keeps_expectations():
    rng = np.random.default_rng(1)
    size = [50, 40, 30, 12, 7, 1]
    for way in (lambda: M.settle([0.3] * 6, size, rng.random(6).tolist()), lambda: M.settle_block(0.3, size, rng.random(6).tolist())):
        ups = np.zeros(6)
        for _ in range(20_000):
            values, left = way()
            assert abs(np.dot(values, size) - 0.3 * sum(size)) < 1e-6
            assert [i for i, v in enumerate(values) if 0 < v < 1] == ([left] if left >= 0 else [])
            ups += values
        assert np.allclose(ups / 20_000, 0.3, atol=0.015)


def test_short_documents_make_up_for_long_ones():
    rng = np.random.default_rng(2)
    for f in (0.05, 0.5, 0.77):
        size = sorted((int(x) for x in rng.pareto(1.2, 500) * 30 + 1), reverse=True)
        values, left = M.settle_block(f, size, rng.random(500).tolist())
        assert left == -1 or size[left] <= 3


def test_code_point_order(spark):
    names = ["b", "B", None, "é", "", "😀", "ﬀ", "a"]
    frame = spark.createDataFrame([(s, 1, 1) for s in names], "source string, source_size long, n long")
    got = {r.source: r["rank"] for r in M.ranked(frame, F.col("source").asc_nulls_last()).collect()}
    assert sorted(got, key=got.get) == sorted((s for s in names if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
