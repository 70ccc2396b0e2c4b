"""Packing: token round trip, dominance against exact search, and gapless places."""

import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewell.llm import packing as P
from tracewell.llm.tokens import byte_bpe, default_path


def optimum(items, capacity):
    """Fewest bins by exact search."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def search(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in {b for b in bins if b >= items[i]}:
            rest = list(bins)
            rest.remove(room)
            search(i + 1, [*rest, room - items[i]])
        search(i + 1, [*bins, capacity - items[i]])

    search(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    rng = random.Random(4)
    fixed = 0
    for _ in range(400):
        capacity = rng.choice([10, 17, 30])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        kinds, rest = P.reduce_instance(Counter(items), capacity)
        fixed += sum(len(k) * n for k, n in kinds)
        assert all(sum(k) <= capacity for k, _ in kinds)
        left = [s for s, n in rest.items() for _ in range(n)]
        assert Counter(s for k, n in kinds for s in k * n) + Counter(left) == Counter(items)
        assert sum(n for _, n in kinds) + optimum(left, capacity) == optimum(items, capacity)
    assert fixed > 500


@pytest.mark.parametrize("seed", range(5))
def test_plan_uses_every_piece_once(seed):
    rng = random.Random(seed)
    counts = Counter(min(1024, int(rng.paretovariate(0.8) * 20)) for _ in range(30_000))
    kinds = P.plan(counts, 1024)
    assert Counter({s: n for s, n in counts.items()}) == sum((Counter({s: c * n for s, c in Counter(k).items()}) for k, n in kinds), Counter())
    used, least = sum(n for _, n in kinds), -(-sum(s * n for s, n in counts.items()) // 1024)
    assert all(sum(k) <= 1024 for k, _ in kinds)
    assert used <= least * 1.01 + 1 or used == sum(n for s, n in counts.items() if s > 512)
    # runs of equal choices: what the driver holds does not grow with the number of pieces
    assert len(P.plan({s: n * 1000 for s, n in counts.items()}, 1024)) < 5000


def test_best_fit_like_one_by_one():
    rng = random.Random(9)
    for _ in range(50):
        counts = Counter(rng.randint(1, 60) for _ in range(80))
        bins = []
        for s in sorted(counts.elements(), reverse=True):
            fit = [i for i, b in enumerate(bins) if b >= s]
            if fit:
                i = min(fit, key=lambda i: bins[i])
                bins[i] -= s
            else:
                bins.append(100 - s)
        assert sum(n for _, n in P.best_fit(counts, 100)) == len(bins)


@lru_cache
def slow():
    return Tokenizer.from_file(default_path("byte_bpe_50k.json"))


def check(rows, got, sequence=1024):
    docs = defaultdict(list)
    for doc_id, text in rows:
        docs[doc_id].append(slow().encode(text or "", add_special_tokens=False).ids + [2])
    want = Counter()
    for doc_id, all_ids in docs.items():
        for ids in all_ids:
            ends = list(range(len(ids) % sequence or sequence, len(ids) + 1, sequence))
            for piece, (a, b) in enumerate(zip([0, *ends], ends)):
                want[doc_id, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter(r[:5] for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r[5]].append((r[6], r[3]))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= sequence
    return len(by), -(-sum(r[3] for r in got) // sequence)


COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_given_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").repartition(7)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    used, least = check(rows, [tuple(r) for r in P.pack(docs).select(*COLUMNS).collect()])
    assert used <= least + 1


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "<|endoftext|> x"), (5, "wörd \x00 😀 " * 3000), (6, "a"), (6, "a"), (None, "b c"), (7, "x " * 1023), (8, "x " * 1024)]
    frame = spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id long, text string, length int, ids string")
    check(rows, [tuple(r) for r in P.pack(frame).select(*COLUMNS).collect()])


def test_whole_sequences(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(40)
    packed = P.pack(docs, with_ids=True)
    whole = {r.sequence_id: r.ids for r in P.sequences(packed).collect()}
    for r in packed.collect():
        ids = whole[r.sequence_id][r.offset : r.offset + r.length]
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32 and len(whole[r.sequence_id]) <= 1024


def test_empty(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).select(F.count("*")).first()[0] == 0


def test_same_ids_from_both_libraries():
    rng = random.Random(0)
    pool = [" ", "  ", "\n", "\t", "\r\n", "\xa0", "\x85", " ", "　", "\x1c", "'s", "'S", "'ll", "a", "Z", "é", "1", "٣", "½", "!", "#", "😀", "́", "‍", "中", "\x00", "ß", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(25)))
        assert byte_bpe()(text).tolist() == slow().encode(text, add_special_tokens=False).ids
