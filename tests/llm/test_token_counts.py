"""Token counts against one tokenizer call per text."""

from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from tracewell.llm import token_counts as C
from tracewell.llm.tokens import default_path


def lengths(rows):
    tokenizer = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    return [(k, len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for k, t in rows]


def check(spark, frame, rows, monkeypatch=None):
    pairs = lengths(rows)
    histogram = C.length_histogram(frame, ["source"])
    assert Counter({(r.source, r.length): r.n_docs for r in histogram.collect()}) == Counter(pairs)
    sums = C.suffix_sums(histogram, ["source"])
    for r in sums.collect():
        own = [n for k, n in pairs if k == r.source]
        assert (r.n_total, r.tokens_total) == (len(own), sum(own))
        assert (r.docs_from, r.tokens_from) == (sum(n >= r.length for n in own), sum(n for n in own if n >= r.length))
        assert r.truncated_total == sum(min(n, r.length) for n in own) and np.isclose(r.share_below, np.mean([n < r.length for n in own]))
    limits = [0, 1, 7, 128, 512, 1024, 10**6]
    cut = {(r.source, r.limit): (r.docs_cut, r.truncated_total) for r in C.truncated_totals(sums, limits, ["source"]).collect()}
    for k in {k for k, _ in pairs}:
        own = sorted(n for s, n in pairs if s == k)
        for limit in limits:
            assert cut[k, limit] == (sum(n > limit for n in own), sum(min(n, limit) for n in own))
        for share in (0.0, 0.25, 0.5, 0.99, 1.0):
            got = C.quantiles(sums, [share], ["source"]).filter(f"source <=> {'null' if k is None else repr(k)}").first().length
            assert got == own[max(0, int(np.ceil(share * len(own))) - 1)]


@pytest.mark.parametrize("block", [1024, 16])
def test_given_documents(spark, folder, monkeypatch, block):
    monkeypatch.setattr(C, "_BLOCK", block)
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("source in ('src1', 'src2')")
    check(spark, docs, [(r.source, r.text) for r in docs.collect()])


def test_odd_rows(spark):
    rows = [("a", None), ("a", ""), (None, "x y z"), (None, "x y z"), ("a", "wörd " * 50_000), ("b", "<|endoftext|>")]
    check(spark, spark.createDataFrame([(*r, "clash") for r in rows], "source string, text string, n_docs string"), rows)


def test_empty(spark):
    assert C.suffix_sums(C.length_histogram(spark.createDataFrame([], "text string"))).collect() == []


def test_texts_are_encoded_once(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plan = C.suffix_sums(C.length_histogram(docs, ["source"]), ["source"])._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan
