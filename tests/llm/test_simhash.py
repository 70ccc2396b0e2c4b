"""SimHash near duplicates against plain Python."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tracewell.llm import simhash
from tracewell.llm.components import connected_components


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(items, linked):
    root = {i: i for i in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in items}


def brute(rows):
    prints = {i: fingerprint(t) for i, t in rows}
    ids = sorted(prints)
    linked = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    root = components(ids, linked)
    return {(i, f"{prints[i]:016x}", root[i], root[i] == i) for i in ids}


def test_documents_match_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = {tuple(r) for r in simhash.simhash_components(docs).collect()}
    assert got == brute(rows)
    assert len({r[2] for r in got}) < len(rows)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, None, "x"), (2, "", None), (3, " \t\n", "y"), (4, "one", "y"), (5, "ONE", "y"), (6, "one two", None), (7, long, "z"), (8, long, "z"), (8, long, "z"), (None, "one", "q"), (9, "one two x\x0by", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").withColumn("component_id", F.lit("clash"))
    got = sorted(map(tuple, simhash.simhash_components(docs).collect()), key=repr)
    assert len(got) == len(rows)
    by = {r[0]: r for r in got}
    assert [by[i][2] for i in (1, 2, 3, 4, 5, 6, 7, 8, 9)] == [1, 1, 1, 4, 4, 6, 7, 7, 9]
    assert by[1][1] == "0" * 16 and by[None][2:] == (4, False)
    for i in (6, 7, 9):
        assert by[i][1] == f"{fingerprint([r for r in rows if r[0] == i][0][1]):016x}"


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_components(docs).collect() == []


@pytest.mark.parametrize("bits", [1, 6, 11])
def test_balls_find_every_link(bits):
    """Planted pairs at distances 0 to 5, dense clusters and lone fingerprints: same components as all pairs."""
    rng = random.Random(bits)
    prints = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        prints.add(x)
        for d in (1, 2, 3, 3, 4, 5):
            y = x
            for b in rng.sample(range(64), d):
                y ^= 1 << b
            prints.add(y)
    hub = rng.getrandbits(64)
    prints |= {hub ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)}
    prints = sorted(prints)
    want = components(prints, [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3])
    balls, values = simhash.Balls(bits), np.array(prints, np.uint64)
    places, owners = balls.targets(values)
    linked = []
    for place in range(1 << bits):
        a, b = simhash.colliding(balls, owners[places == place], place)
        linked += list(zip(map(int, a), map(int, b)))
    assert components(prints, linked) == want


def test_links_over_spark(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(400)]
    prints = base + [x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for x in base]
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    got = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    pairs = {frozenset(r) for r in got.collect()}
    assert {frozenset(p) for p in zip(signed[:400], signed[400:]) if p[0] != p[1]} == pairs


def test_components_of_a_long_chain(spark):
    n = 3000
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])) + [(7, 7), (n + 5, n + 9), (None, 3)], "a long, b long")
    got = dict(map(tuple, connected_components(edges).collect()))
    assert got == {i: 0 for i in range(n)} | {n + 5: n + 5, n + 9: n + 5}
