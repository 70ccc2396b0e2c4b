"""License scan against a scan of every position."""

import random
import re

from pyspark.sql import functions as F

from tracewell.llm import licenses as L


def brute(rows, templates=L.TEMPLATES):
    """(doc, license) for which some run of one and a half template lengths contains 0.8 of a wording."""
    out = set()
    for doc_id, text in rows:
        words = L.plain_words(text or "")
        shingles = L.shingle_list(words)
        for name, wording in templates:
            want = set(L.shingle_list(L.plain_words(wording)))
            span = -(-3 * len(want) // 2)
            at = [i for i, s in enumerate(shingles) if s in want]
            if any(len({shingles[j] for j in at if i <= j < i + span}) / len(want) >= 0.8 for i in at):
                out.add((doc_id, name))
    return out


def found(frame):
    return {(r.doc_id, r.license) for r in L.license_scan(frame).collect()}


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert len(want) > 10 and found(docs) == want


def test_edited_copies_anywhere(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(400))]
        name, wording = rng.choice(L.TEMPLATES)
        copy = wording.split()
        if len(copy) > 20 and i % 2:
            copy[rng.randrange(len(copy))] = "changed"
        if i % 5 == 0:
            copy = copy[: len(copy) // 2]
        at = rng.randrange(len(words) + 1)
        rows.append((i, re.sub(" ", lambda _: rng.choice([" ", "\n", ", "]), " ".join(words[:at] + copy + words[at:]))))
    want = brute(rows)
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(want) > 200 and got >= want
    assert all(dict(rows)[d] for d, _ in got - want) and len(got - want) <= 3


def test_positions_and_containment(spark):
    text = "a b c " + L.TEMPLATES[0][1] + " d e f " + L.TEMPLATES[2][1]
    got = sorted(map(tuple, L.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()))
    words = L.plain_words(text)
    assert [(r[1], r[2]) for r in got] == [("Apache-2.0", 1.0), ("MIT", 1.0)]
    assert words[got[1][3] : got[1][4]] == L.plain_words(L.TEMPLATES[0][1]) and words[got[0][3] : got[0][4]] == L.plain_words(L.TEMPLATES[2][1])


def test_odd_rows(spark):
    mit = "Released under the MIT License."
    long = "x y z " * 40_000 + mit + " q" * 70_000
    rows = [(1, None), (2, ""), (3, "Released under the MIT"), (4, mit), (4, mit), (None, mit), (5, long), (6, mit.upper())]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, words string").withColumn("license", F.lit(1))
    got = sorted((tuple(r) for r in L.license_scan(frame).collect()), key=repr)
    assert [r[:3] for r in got] == [(4, "MIT", 1.0), (4, "MIT", 1.0), (5, "MIT", 1.0), (6, "MIT", 1.0), (None, "MIT", 1.0)]
    assert got[2][3] == 120_000
    assert L.license_scan(frame.limit(0)).collect() == []


def test_own_templates(spark):
    frame = spark.createDataFrame([(1, "one two"), (2, "zero one two")], "doc_id long, text string")
    assert [tuple(r)[:2] for r in L.license_scan(frame, templates=[("short", "One two"), ("none", "...")]).collect()] == [(1, "short")]


def test_bands_meet_with_the_promised_chance():
    """Windows that contain 0.8 of a template in other words: at most one of thousands is missed."""
    rng = random.Random(0)
    missed = 0
    for k in range(3000):
        wording = " ".join(f"t{k}x{i}" for i in range(30))
        bands = L.Bands([("t", wording)])
        words = wording.split()
        words[rng.randrange(2, 28)] = "changed"
        text = [f"a{k}y{i}" for i in range(rng.randrange(60))] + words + [f"b{k}y{i}" for i in range(60)]
        hashes = L.np.array([L.xxhash.xxh64_intdigest(s.encode(), 42) for s in L.shingle_list(text)], L.np.uint64)
        missed += not list(bands.windows(hashes))
    assert missed <= 1


def test_similar_notices_are_told_apart(spark):
    def gnu(kind, version):
        return f"x y z This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. a b c"

    rows = [
        ("GPL-2.0", gnu("", 2)), ("GPL-3.0", gnu("", 3)), ("LGPL", gnu("Lesser ", 3)), ("AGPL", gnu("Affero ", 3)),
        ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
        ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
        ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
        ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy it."),
    ]
    got = found(spark.createDataFrame([(i, text) for i, (_, text) in enumerate(rows)], "doc_id long, text string"))
    assert got == {(i, name) for i, (name, _) in enumerate(rows)}
