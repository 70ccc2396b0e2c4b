"""Periodic runs against a scan of every lag."""

import hashlib
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from tracewell.llm import periodic_runs as P
from tracewell.llm.queries import ORACLES, QUERIES


def plain_runs(x):
    """Maximal stretches of every period up to a quarter of the length, word by word."""
    found = []
    for q in range(1, len(x) // 4 + 1):
        i = 0
        while i + q < len(x):
            s = i
            while i + q < len(x) and x[i] == x[i + q]:
                i += 1
            if i + q - s >= max(6, 4 * q) and not any(all(x[k] == x[k + d] for k in range(s, i + q - d)) for d in range(1, q)):
                found.append((s, i + q - s, q))
            i += i == s
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_result(doc_id, text):
    tokens = (text or "").encode().split()
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    n = len(tokens)
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        tokens = [t if i < a else tokens[a + (i - a) % p] for i, t in enumerate(tokens)]
    runs = plain_runs(tokens)
    gone = {i for s, n_words, q in runs for i in range(s + q, s + n_words)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *head, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()), sha(b" ".join(t for i, t in enumerate(tokens) if i not in gone)))


def sequences(rng, most=5):
    for _ in range(rng.randint(1, most)):
        n, words = rng.choice([0, 1, 5, 30, 200, 500]), rng.choice([1, 2, 3, 5, 50])
        t = [rng.randrange(words) for _ in range(n)]
        for _ in range(rng.randint(0, 4) if n > 8 else 0):
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 3))
            for i in range(a, min(n, a + rng.randint(p, 6 * p + 3))):
                t[i] = t[a + (i - a) % p]
            if rng.random() < 0.3:
                t[rng.randrange(n)] = 99
        yield t


def test_same_as_every_lag():
    rng, long_periods = random.Random(5), 0
    for _ in range(250):
        texts = list(sequences(rng))
        for t, got in zip(texts, P.runs_of([np.array(t, np.int64) for t in texts])):
            assert got == plain_runs(t)
            long_periods += sum(q > P.SHORT for _, _, q in got)
    assert long_periods > 30


@pytest.mark.parametrize("period", [1, 2, 7, 8, 9, 16, 17, 31, 32, 33, 64, 65, 127, 300])
def test_shortest_runs_of_each_period(period):
    """Four periods exactly are found, one word less is none, wherever the run stands."""
    rng = np.random.default_rng(period)
    for length, found in ((max(6, 4 * period), True), (max(6, 4 * period) - 1, False), (9 * period + 1, True)):
        before = rng.integers(10_000, 20_000, 37)
        unit = rng.permutation(period) + 1
        x = np.concatenate([before, np.resize(unit, length), rng.integers(20_000, 30_000, 41)])
        want = [(37, length, period)] if found and length >= 6 else []
        assert P.runs_of([x[:5], x, x]) == [[], want, want]


def test_long_texts_do_not_take_square_time():
    x = np.random.default_rng(0).integers(0, 40, 400_000)
    x[100_000:300_000] = np.resize(x[100_000:140_000], 200_000)
    (runs,) = P.runs_of([x])
    (run,) = [r for r in runs if r[2] > 1000]
    assert run[2] == 40_000 and run[0] <= 100_000 and run[0] + run[1] >= 300_000


def test_rows(spark):
    lines = ["", None, "one", "x " * 5, "x\x1cx " * 9, "a b " * 40, "la " * 7 + "end", "é ü\t" * 8 + "ß", "  ".join("qwer") * 6, "a a a a a a b a a a a a a b " * 5]
    texts = [(i, t, 1, 2) for i in range(45) for t in (lines[i % len(lines)],)] + [(7, lines[7], 1, 2)] * 2 + [(None, "z " * 12, 1, 2)]
    rng = random.Random(1)
    texts += [(100 + i, " ".join(map(str, t)), 1, 2) for i in range(40) for t in sequences(rng, 1)]
    texts += [(200, "w " * 200_000, 1, 2)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, n_words int, runs int")
    got = P.run_digests(P.periodic_runs(P.with_planted_runs(docs))).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((plain_result(i, t) if len(t or "") < 9999 else one_word(i, t) for i, t, *_ in texts), key=repr)
    assert sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in texts) >= 5


def one_word(doc_id, text):
    n = len(text.split())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, 1, 0, n, 1, 1000 * n, sha(f"0,{n},1\n"), sha("w"))


def test_operator_returns_spans_and_texts(spark):
    docs = spark.createDataFrame([("k", "go on on on on on on stop go")], "name string, text string")
    (row,) = P.periodic_runs(docs, keep=["name"]).collect()
    assert (row.name, row.n_words, [tuple(r) for r in row.runs], row.collapsed) == ("k", 9, [(1, 6, 1)], "go on stop go")


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert P.run_digests(P.periodic_runs(P.with_planted_runs(docs))).collect() == []


def test_sql(spark, folder):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = db.execute(ORACLES["op11_periodic_runs"])
    names = [c[0] for c in want.description]
    got = QUERIES["op11_periodic_runs"](spark, folder).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
