"""Quality classifier: EM against planted accuracies, metrics against Python, verdicts against given labels."""

import re

import numpy as np
from pyspark.sql import functions as F

from tracewell.llm import weak_quality as W


def test_em_finds_planted_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(40_000) < 0.7
    right = np.array([0.95, 0.85, 0.75, 0.9, 0.6])
    votes = np.where(rng.random((40_000, 5)) < right, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.3] = W.SILENT
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = W.expectation_maximisation(patterns, counts.astype(float))
    assert np.allclose(model.accuracies(), right, atol=0.03) and abs(model.prior - 0.7) < 0.03
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.93


def brute(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    lines = [x for x in text.split("\n") if x.strip(" ")]
    n = len(w)
    share = lambda test: sum(map(test, w)) / n
    return (
        sum(text.count(c) for c in W.SYMBOLS) / n,
        share(lambda x: x.lower() in W.STOP_WORDS),
        min(1.0, len(set(w)) / n * max(1.0, (n / 100) ** 0.5)),
        share(lambda x: len(x) > 1 and x.upper() == x and x.lower() != x),
        sum(map(len, w)) / n,
        share(lambda x: x.lower() != x.upper()),
        (len(lines) - len(set(lines))) / len(lines),
        share(lambda x: x.endswith("!")),
        sum(x in w[max(0, i - 2) : i] for i, x in enumerate(w)) / n,
    )


def test_metrics(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("lang = 'en'")
    for r in docs.select("text", W.metrics(F.col("text")).alias("m")).collect():
        assert np.allclose(tuple(r.m), brute(r.text)), r.text[:80]


def test_keeps_clean_and_drops_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(4)
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = W.quality(docs).join(labels, "doc_id").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.97
    assert got[got.quality == 0].kept.mean() < 0.2


def test_copies_do_not_change_scores_order(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    a = W.quality(docs).toPandas().set_index("doc_id")
    b = W.quality(docs.repartition(5)).toPandas().set_index("doc_id")
    assert np.allclose(a.score, b.score.loc[a.index], atol=1e-6)


def test_odd_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    long = "the word of a line and more " * 40_000
    odd = spark.createDataFrame([(9001, None), (9002, ""), (9003, " \n\t"), (None, "a b"), (9004, long), (9004, long)], docs.schema)
    frame = docs.unionByName(odd).withColumns({"score": F.lit("clash"), "symbols": F.lit(1), "turn": F.lit(None).cast("int")})
    got = W.quality(frame)
    assert got.columns == ["doc_id", "score", "kept"] and got.count() == docs.count() + 6
    by = {r.doc_id: r.score for r in got.collect()}
    assert by[9001] == by[9002] and all(0 <= s <= 1 for s in by.values())


def test_empty(spark):
    assert W.quality(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_all_columns_stay(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert W.scored(docs, None, score="_q").columns == [*docs.columns, "_q"]
