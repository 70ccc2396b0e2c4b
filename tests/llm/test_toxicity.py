"""Toxicity: held-out accuracy, and what a score may depend on."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from tracewell.llm import toxicity as T
from tracewell.llm.linear import SPAN, fit_logistic, ngram_buckets


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(8)
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = T.toxicity(docs, labels).join(labels, "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    test = got[got.held_out]
    assert len(test) > 1000 and ((got.score >= 0) & (got.score <= 1)).all()
    assert test[test.predicted == 1].toxic.mean() > 0.97
    assert test[test.toxic == 1].predicted.mean() > 0.75
    order = test.score.rank()
    pos, n = test.toxic == 1, len(test)
    auc = (order[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (n - pos.sum()))
    assert auc > 0.97


def rows_of(spark, n=400):
    rows = [(i, f"plain words about number {i} and more of them {'you stupid fool' if i % 4 == 0 else 'you kind friend'}") for i in range(n)]
    docs = spark.createDataFrame([(*r, "clash", 0.5) for r in rows], "doc_id long, text string, toxic string, score double")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    return docs, labels


def test_one_threshold_whatever_the_size(spark, monkeypatch):
    """An n-gram counts from the same number of texts on in a small table."""
    seen, ratios = [], T.log_count_ratios
    monkeypatch.setattr(T, "log_count_ratios", lambda clean, toxic, *n: seen.append((clean + toxic, out := ratios(clean, toxic, *n))) or out)
    T.train(*rows_of(spark))
    (texts, out), = seen
    assert ((texts > 0) & (texts < T.LEAST_TEXTS)).any() and not out[texts < T.LEAST_TEXTS].any() and out[texts >= T.LEAST_TEXTS].any()


def test_held_out_labels_change_nothing(spark):
    docs, labels = rows_of(spark)
    turned = labels.withColumn("toxic", F.when(T.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, T.toxicity(docs, x).collect())) for x in (labels, turned))
    assert a == b
    assert all(r[3] == (r[0] % 4 == 0) for r in a)


def test_odd_rows(spark):
    docs, labels = rows_of(spark)
    more = spark.createDataFrame([(1000, None, None, None), (1001, "", None, None), (None, "you stupid fool", "x", None), (3, "you kind friend", None, None), (1002, "ok " * 500_000 + "you stupid fool", None, None)], docs.schema)
    odd = spark.createDataFrame([(None, 1, 1), (5, 1, None), (7, None, 7), (9, 0, 0), (9, 0, 0)], labels.schema)
    got = T.toxicity(docs.unionByName(more), labels.unionByName(odd)).collect()
    assert len(got) == 405
    by = {r.doc_id: r for r in got}
    assert by[1000].score == by[1001].score and by[1000].predicted == 0
    assert by[None].predicted == 1 and not by[None].held_out and by[1002].predicted == 1


def test_empty_and_one_class(spark):
    docs, labels = rows_of(spark, 40)
    assert T.toxicity(docs.limit(0), labels).collect() == []
    for some in (labels.limit(0), labels.filter("toxic = 0")):
        assert {(r.score, r.predicted) for r in T.toxicity(docs, some).collect()} == {(0.0, 0)}


def test_fit_rows_are_bounded_whatever_repeats(spark):
    copies = spark.range(500).select(F.lit(1).cast("long").alias("_id"), F.lit("same").alias("text"))
    many = spark.range(500).select(F.lit(2).cast("long").alias("_id"), F.concat(F.lit("t"), "id").alias("text"))
    single = spark.range(10, 30).select(F.col("id").alias("_id"), F.lit("one").alias("text"))
    known = spark.createDataFrame([(i, i % 2) for i in (1, 2, *range(10, 30))], "_id long, toxic int")
    texts = copies.unionByName(many).unionByName(single)
    rows = T.fit_sample(texts, known, 22, 40).collect()
    assert len(rows) == len(set(rows)) == 40 and {r._id for r in rows} == {1, 2, *range(10, 30)}
    assert sum(r._id == 1 for r in rows) == 1 and all(r.toxic == r._id % 2 for r in rows)
    rows = T.fit_sample(texts, known, 22, 5).collect()
    assert len(rows) == len({r._id for r in rows}) == 5


def test_filter_loses_no_labelled_text(spark):
    texts = spark.range(20_000).select(F.col("id").alias("_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    known = spark.range(0, 30_000, 7).select(F.col("id").alias("_id"), F.lit(1).alias("toxic"))
    got = T.labelled_texts(texts, known)
    assert sorted(map(tuple, got.collect())) == [(i, f"t{i}", 1) for i in range(0, 20_000, 7)]


def test_spans_keep_all_ngrams():
    rng = np.random.default_rng(0)
    text = "".join(rng.choice(list("abcde "), SPAN + 5000))
    cut = len(text) // 2
    assert set(ngram_buckets(text, (4, 9), 30)) >= set(ngram_buckets(text[cut - 300 : cut + 300].split(" ", 1)[1].rsplit(" ", 1)[0], (4, 9), 30))
    low = " " + " ".join(text.split()) + " "
    want = {low[i : i + n] for n in (4, 9) for i in range(len(low) - n + 1) if " " not in low[i + 1 : i + n - 1]}
    assert abs(len(ngram_buckets(text, (4, 9), 30)) - len(want)) < 0.01 * len(want)


def test_fit_separates():
    rows = [np.array([i % 2, 2 + i % 5], np.int32) for i in range(200)]
    y = np.array([i % 2 for i in range(200)], float)
    w, b = fit_logistic(rows, y, np.ones(8), np.ones(200), 1e-3)
    assert all((w[r].sum() + b > 0) == (t == 1) for r, t in zip(rows, y))
