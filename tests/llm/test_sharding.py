"""Interleaved shards against plain sorting."""

import hashlib
import zlib
from collections import Counter

from tracewell.llm import sharding as S

SCHEMA = "doc_id long, source string, size long"


def plain(rows, shards):
    """(row, shard, slot) by sorting in memory; rows are (doc_id, source, size)."""
    md5 = lambda s: hashlib.md5(f"{S.SEED}:{s}".encode()).hexdigest()
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    dealt = []
    for source, group in by.items():
        none_last = lambda v: (v is None, 0 if v is None else v)
        group.sort(key=lambda r: (md5("" if r[0] is None else r[0]), none_last(r[0]), r[2] is not None, r[2] or 0))
        phase = int(md5("" if source is None else "=" + source)[:12], 16) / 2.0**48
        dealt += [((r + phase) / len(group), (source is None, source or ""), r, row) for r, row in enumerate(group)]
    dealt.sort(key=lambda d: d[:3])
    n = len(dealt)
    return sorted(((*d[3], p * shards // n, p - -(-(p * shards // n) * n // shards)) for p, d in enumerate(dealt)), key=repr)


def run(spark, rows, shards=16):
    frame = spark.createDataFrame(rows, SCHEMA)
    return sorted((tuple(r) for r in S.interleave(frame, shards, carry=["size"]).select("doc_id", "source", "size", "shard", "slot").collect()), key=repr)


def test_same_as_sorting_with_a_hot_source(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 11}", i % 50) for i in range(1500)] + [(5000 + i, f"only{i}", 1) for i in range(40)]
    got = run(spark, rows)
    assert got == plain(rows, 16) and got == run(spark, rows[::-1])
    sizes = Counter(r[3] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    totals, each = Counter(r[1] for r in rows), Counter((r[1], r[3]) for r in got)
    for source, n in totals.items():
        for shard in range(16):
            assert abs(each[source, shard] - n / 16) <= 2.5
    # the sources of one row do not all go to the same shard
    assert len({r[3] for r in got if r[1].startswith("only")}) > 8


def test_odd_rows(spark):
    rows = [(None, "a", 3), (None, "a", 3), (None, None, None), (1, None, 2), (1, None, 2), (1, "", 2), (2, "é", 0), (-5, "=", 7)]
    for shards in (1, 3, 16):
        assert run(spark, rows, shards) == plain(rows, shards)


def test_empty(spark):
    assert run(spark, []) == []


def test_documents_with_clashing_names(spark):
    docs = spark.createDataFrame(
        [(1, "naïve", "a", 9, 9, 9), (2, None, "a", 9, 9, 9), (None, "", None, 9, 9, 9), (2, None, "a", 9, 9, 9), (4, "x" * 300_000, "b", 9, 9, 9)],
        "doc_id long, text string, source string, shard int, _place int, size int",
    )
    got = S.shard_documents(docs, shards=2).collect()
    want = {(1, 7, zlib.crc32("naïve".encode())), (2, 1, 0), (None, 1, 0), (4, 300_001, zlib.crc32(b"x" * 300_000))}
    assert {(r.doc_id, r["size"], r.text_crc32) for r in got} == want and len(got) == 5
    assert sorted((r.shard, r.slot) for r in got) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)]
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
