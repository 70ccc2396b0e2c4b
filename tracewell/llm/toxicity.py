"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import shares, staged
from tracewell.llm.linear import fit_logistic, ngram_buckets, sigmoid

SIZES = (4, 6, 8, 9)
BITS = 20
THRESHOLD = 0.7
# an n-gram counts from this many labelled texts on
LEAST_TEXTS = 10
# labelled rows that the weights are fitted on; the log-count ratios see all labelled rows
FIT_ROWS = 6000
POSITIVE_WEIGHT = 4.0
_RANGE = 1 << 14
# bits of the filter that keeps unlabelled texts out of the shuffle: a fixed 8 MB, however many labels
_FILTER_BITS = 26


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        return float(sigmoid(self.weights[ngram_buckets(text or "", SIZES, BITS, self.weights)].sum() + self.bias))


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from: crc32 of the id as text leaves 1 over 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BITS), np.int32)
    rows = np.zeros(2, np.int64)
    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
            counts[toxic][ngram_buckets(text.as_py() or "", SIZES, BITS)] += 1
            rows[toxic] += 1
    if rows.any():
        starts = range(0, 1 << BITS, _RANGE)
        arrays = [pa.array([counts[k, s : s + _RANGE].tobytes() for s in starts]) for k in (0, 1)]
        texts = [pa.array([int(rows[k]) if s == 0 else 0 for s in starts], pa.int64()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(list(starts), pa.int32()), *arrays, *texts], names=["start", "clean", "toxic", "n_clean", "n_toxic"])


def _add(key: tuple, parts: Iterator[pa.RecordBatch]) -> pa.Table:
    total, texts = np.zeros((2, _RANGE), np.int64), [0, 0]
    for batch in parts.to_batches():
        for k, name in enumerate(("clean", "toxic")):
            for raw in batch.column(name):
                total[k] += np.frombuffer(raw.as_py(), np.int32)
            texts[k] += sum(batch.column(f"n_{name}").to_pylist())
    kept = [pa.array([total[k].astype("<i8").tobytes()]) for k in (0, 1)]
    return pa.table({"start": pa.array([key[0].as_py()], pa.int32()), "clean": kept[0], "toxic": kept[1], "n_clean": [texts[0]], "n_toxic": [texts[1]]})


def log_count_ratios(clean: np.ndarray, toxic: np.ndarray, n_clean: int, n_toxic: int, least: int = LEAST_TEXTS) -> np.ndarray:
    """Log of how much more often toxic texts have a bucket; zero for rare ones."""
    ratio = np.log((toxic + 1) / (n_toxic + 2)) - np.log((clean + 1) / (n_clean + 2))
    return np.where(clean + toxic >= least, ratio, 0.0)


def labelled_texts(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of (_id, text) joined with ``known`` on ``_id``.

    A filter of fixed size, gathered from the known ids, drops most texts without a label in place,
    so that they are not shuffled; the join is exact. More labels only let more texts through.
    """
    place = F.pmod(F.xxhash64("_id"), F.lit(1 << _FILTER_BITS)) + 1
    marked = known.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    parts = dict(map(tuple, marked.collect()))
    size = 1 << 15
    blank = bytes(size // 8)
    bits = b"".join(bytes(parts.get(b + 1, blank)) for b in range((1 << _FILTER_BITS) // size))
    shared = docs.sparkSession.sparkContext.broadcast(np.frombuffer(bits, np.uint8))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("place").to_numpy() - 1
            yield batch.filter(pa.array((shared.value[at >> 3] >> (at & 7) & 1).astype(bool)))

    rows = docs.filter("_id is not null").withColumn("place", place).mapInArrow(likely, "_id long, text string, place long")
    return rows.drop("place").join(known, "_id")


def fit_sample(texts: DataFrame, known: DataFrame, n_known: int, fit_rows: int) -> DataFrame:
    """(_id, text, toxic): at most ``fit_rows`` rows, one for each text of an id.

    Ids with the smallest hashes are chosen. Each gives one text first; further texts of an id only
    fill what is left, so no id crowds out others. Rows are chosen by keys, before any text moves.
    """
    chosen = known if n_known <= fit_rows else known.orderBy(F.xxhash64("_id"), "_id").limit(fit_rows)
    rows = texts.join(F.broadcast(staged(chosen)), "_id").withColumn("_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    keys = staged(rows.select("_id", "_hash").distinct())
    least = keys.groupBy("_id").agg(F.min("_hash").alias("_least"))
    kept = keys.join(F.broadcast(least), "_id").orderBy(F.col("_hash") != F.col("_least"), F.xxhash64("_id", "_hash"), "_id", "_hash").limit(fit_rows)
    return rows.join(F.broadcast(staged(kept.select("_id", "_hash"))), ["_id", "_hash"]).dropDuplicates(["_id", "_hash"]).select("_id", "text", "toxic")


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = FIT_ROWS) -> Model | None:
    """Model from the labelled rows that are not held out; None if a class is missing.

    Texts of each class are counted per bucket over all labelled rows, per task, range by range of
    the fixed number of buckets. The weights are fitted in one task on at most ``fit_rows`` rows
    of ids with the smallest hashes, so every label has the same chance; repeated rows count once
    there. The driver holds one number per bucket. A null label or id teaches nothing, of several labels of an id the largest
    counts.
    """
    known = labels.select(F.col(doc_id).cast("long").alias("_id"), F.col(label).cast("int").alias("toxic"))
    known = known.filter(F.col("_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("_id")))
    known = staged(known.groupBy("_id").agg(F.max("toxic").alias("toxic")))
    n_known = known.count()
    texts = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("text"))
    schema = "start int, clean binary, toxic binary, n_clean long, n_toxic long"
    labelled = labelled_texts(texts, known).select("text", "toxic")
    ranges = labelled.mapInArrow(_count, schema).repartition(shares(1 << BITS, _RANGE), "start").groupBy("start").applyInArrow(_add, schema)
    parts = sorted(ranges.collect())
    if not parts:
        return None
    clean, toxic = (np.concatenate([np.frombuffer(p[k], "<i8") for p in parts]) for k in ("clean", "toxic"))
    n_clean, n_toxic = (sum(p[k] for p in parts) for k in ("n_clean", "n_toxic"))
    if not n_clean or not n_toxic:
        return None
    ratios = log_count_ratios(clean, toxic, n_clean, n_toxic)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [ngram_buckets(t.as_py() or "", SIZES, BITS, ratios).astype("<i4").tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("toxic"), pa.array(raw, pa.binary())], names=["_id", "toxic", "raw"])

    def fit(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("_id", "ascending"), ("raw", "ascending")])
        buckets = [np.frombuffer(r.as_py(), "<i4") for r in rows.column("raw")]
        y = rows.column("toxic").to_numpy().astype(float)
        if not 0 < y.sum() < len(y):
            return pa.table({"weights": pa.array([], pa.binary()), "bias": pa.array([], pa.float64())})
        weights, bias = fit_logistic(buckets, y, ratios, np.where(y == 1, POSITIVE_WEIGHT, 1.0), 1e-3)
        return pa.table({"weights": pa.array([weights.astype("<f4").tobytes()]), "bias": pa.array([bias])})

    sample = fit_sample(texts, known, n_known, fit_rows).mapInArrow(features, "_id long, toxic int, raw binary")
    found = sample.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(lambda key, rows: fit(key, rows.drop_columns(["one"])), "weights binary, bias double").collect()
    if not found:
        return None
    return Model(np.frombuffer(found[0]["weights"], "<f4").astype(np.float64), found[0]["bias"])


def score(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, from its whole text alone.

    Null and empty texts get the score of a text without n-grams; without a model all scores are
    zero. Repeated rows and null ids come back as they are. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            scores = [held.score(t.as_py()) if held else 0.0 for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, **names: str) -> DataFrame:
    """Train on the labels that are not held out and score every document."""
    return score(docs, train(docs, labels, **names), **{k: v for k, v in names.items() if k != "label"})
