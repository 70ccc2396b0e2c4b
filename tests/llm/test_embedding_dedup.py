"""Embedding near duplicates against all pairs in numpy."""

import numpy as np
import pytest

from tracewell.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.98):
    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, np.float32).astype(np.float64)
        return x / np.linalg.norm(x)

    units = [unit(r[1]) if r[2] is not None else None for r in rows]
    n, root, links = len(rows), list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            a, b = units[i], units[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    low = {}
    for i in range(n):
        low[find(i)] = min(low.get(find(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], links[i], low[find(i)], rows[i][0] == low[find(i)]) for i in range(n))


def near(rng, base, cosine):
    other = rng.standard_normal(len(base))
    other -= other @ base / (base @ base) * base
    other *= np.linalg.norm(base) / np.linalg.norm(other)
    return cosine * base + np.sqrt(1 - cosine**2) * other


def planted(rng, n, dim=32):
    rows = []
    for i in range(n):
        base = rng.standard_normal(dim)
        for cosine in (1.0, 0.999, 0.985, 0.9802, 0.9795, 0.95):
            rows.append((len(rows) * 3 % 1009 + 1009 * (len(rows) // 1009), [float(x) for x in near(rng, base, cosine)], i % 3))
    return rows


def test_pairs_and_components(spark):
    rows = planted(np.random.default_rng(3), 60)
    got = sorted(map(tuple, E.embedding_components(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == brute(rows)


def test_given_table(spark, folder):
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding) if r.embedding is not None else None, r.label) for r in vectors.collect()]
    assert sorted(map(tuple, E.embedding_components(vectors).collect())) == brute(rows)


def test_sql(spark, tmp_path):
    """Planted neighbours in one file, read by both."""
    import duckdb

    spark.createDataFrame(planted(np.random.default_rng(6), 40), SCHEMA).coalesce(1).write.parquet(str(tmp_path / "v"))
    want = duckdb.connect().execute(E.oracle(f"read_parquet('{tmp_path}/v/*.parquet')")).fetchall()
    got = E.embedding_components(spark.read.parquet(str(tmp_path / "v"))).collect()
    assert sorted(map(tuple, got)) == sorted(want) and sum(r[1] for r in want) > 100


def test_large_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 40)
    rng = np.random.default_rng(4)
    base = rng.standard_normal(16)
    rows = [(i, [float(x) for x in base + 0.13 * rng.standard_normal(16)], 1) for i in range(300)]
    want = brute(rows)
    assert 100 < np.mean([r[1] for r in want]) < 299
    got = sorted(map(tuple, E.embedding_components(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == want


def test_odd_rows(spark):
    nan, inf, v = float("nan"), float("inf"), [1.0, 2.0, 3.0]
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0, 0.0], 1), (4, [nan, 1.0, 1.0], 1), (5, [inf, 1.0, 1.0], 1), (6, [None, 1.0, 2.0], 1), (7, v, None), (8, v, None),
            (9, v, 1), (10, v, 1), (11, v, 1), (12, [2.0, 4.0, 6.0], 1), (13, v, 2), (14, [1.0, 2.0], 1), (15, [1.0, 2.0], 1), (16, [1e30, 2e30, 3e30], 1), (10, v, 1)]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA + ", cid string, n_links int")
    got = sorted(map(tuple, E.embedding_components(frame).collect()))
    assert got == brute(rows)
    assert [r for r in got if r[0] == 9] == [(9, 5, 9, True)]
    lone = spark.createDataFrame([(None, v, 1), (20, v, 1)], SCHEMA)
    assert sorted(map(tuple, E.embedding_components(lone).collect()), key=repr) == [(20, 1, 20, True), (None, 1, 20, False)]


def test_empty(spark):
    assert E.embedding_components(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("dim", [8, 64])
def test_signatures_meet_at_the_threshold(dim):
    rng = np.random.default_rng(dim)
    base = rng.standard_normal((4000, dim))
    other = np.array([near(rng, b, 0.9801) for b in base])
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = (E.signatures(unit(x), E.TABLES, E.PLANES) for x in (base, other))
    assert ((a == b).any(axis=1)).mean() > 0.999
