"""Quality classifier from weak labels: expectation maximisation over heuristics, then a hashed linear scorer."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import let, staged, words
from tracewell.llm.linear import fit_logistic, ngram_buckets, sigmoid
from tracewell.llm.quality_rules import STOP_WORDS, SYMBOLS

GOOD, BAD, SILENT = 1, 0, 2
FIT_ROWS = 8000
BITS = 18
THRESHOLD = 0.5

# name, metric, votes good if the metric lies within, votes bad if it lies outside the second range
Heuristic = tuple[str, str, tuple[float, float], tuple[float, float]]
HEURISTICS: tuple[Heuristic, ...] = (
    ("symbols", "symbols_per_word", (0.0, 0.02), (0.0, 0.1)),
    ("stop_words", "stop_word_ratio", (0.12, 0.6), (0.05, 1.0)),
    ("variety", "distinct_word_ratio", (0.35, 1.0), (0.25, 1.0)),
    ("capitals", "capital_word_ratio", (0.0, 0.1), (0.0, 0.4)),
    ("word_length", "mean_word_chars", (4.0, 6.5), (3.0, 9.0)),
    ("plain_words", "letter_word_ratio", (0.95, 1.0), (0.7, 1.0)),
    ("same_lines", "dup_line_ratio", (0.0, 0.1), (0.0, 0.4)),
    ("exclamations", "exclaimed_word_ratio", (0.0, 0.05), (0.0, 0.3)),
    ("echoes", "echoed_word_ratio", (0.0, 0.1), (0.0, 0.3)),
)
_INF = float("inf")


def metrics(text: Column) -> Column:
    """What the heuristics look at, as one struct; a text without words has nulls."""
    body = F.coalesce(text, F.lit(""))

    def of(w: Column) -> Column:
        n = F.when(F.size(w) > 0, F.size(w).cast("double"))
        lines = F.filter(F.split(body, "\n"), lambda x: F.trim(x) != "")
        share = lambda test: F.size(F.filter(w, test)) / n

        def same_as(back: int) -> Column:
            earlier = F.concat(F.array_repeat(F.lit(""), back), F.slice(w, 1, F.greatest(F.size(w) - back, F.lit(0))))
            return F.zip_with(w, earlier, lambda a, b: a == b)

        return F.struct(
            ((F.length(body) - F.length(F.translate(body, SYMBOLS, ""))) / n).alias("symbols_per_word"),
            share(lambda x: F.lower(x).isin(*STOP_WORDS)).alias("stop_word_ratio"),
            # long texts repeat words by nature: compare with the square root
            F.least(F.size(F.array_distinct(w)) / n * F.greatest(F.lit(1.0), F.sqrt(n / 100)), F.lit(1.0)).alias("distinct_word_ratio"),
            share(lambda x: (F.length(x) > 1) & (F.upper(x) == x) & (F.lower(x) != x)).alias("capital_word_ratio"),
            (F.length(F.array_join(w, "")) / n).alias("mean_word_chars"),
            share(lambda x: F.lower(x) != F.upper(x)).alias("letter_word_ratio"),
            let(lines, lambda x: F.when(F.size(x) > 0, (F.size(x) - F.size(F.array_distinct(x))) / F.size(x))).alias("dup_line_ratio"),
            share(lambda x: F.endswith(x, F.lit("!"))).alias("exclaimed_word_ratio"),
            # words equal to one of the two before
            (F.size(F.filter(F.zip_with(same_as(1), same_as(2), lambda a, b: a | b), lambda x: x)) / n).alias("echoed_word_ratio"),
        )

    return let(words(text), of)


def votes(found: Column, heuristics: Sequence[Heuristic] = HEURISTICS) -> list[Column]:
    """One vote per heuristic: good, bad or silent."""
    out = []
    for name, metric, good, bad in heuristics:
        value = found[metric]
        vote = F.when(value.between(*good), GOOD).when(~value.between(*bad), BAD).otherwise(SILENT)
        out.append(vote.cast("byte").alias(name))
    return out


@dataclass(frozen=True)
class LabelModel:
    """Chance of each vote given the class, and of the class itself."""

    prior: float
    table: np.ndarray  # heuristic, class, vote

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        logs = np.stack([np.full(len(patterns), np.log(p)) for p in (1 - self.prior, self.prior)], axis=1)
        for j in range(patterns.shape[1]):
            logs += np.log(self.table[j][:, patterns[:, j]]).T
        return sigmoid(logs[:, 1] - logs[:, 0])

    def accuracies(self) -> np.ndarray:
        """Share of right votes of each heuristic among those it casts."""
        weight = np.array([1 - self.prior, self.prior])
        joint = self.table * weight[None, :, None]
        right = joint[:, 0, BAD] + joint[:, 1, GOOD]
        return right / joint[:, :, :2].sum(axis=(1, 2))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> LabelModel:
    """Accuracies from the agreement of the voters alone; starts at their majority.

    ``patterns`` holds each combination of votes once, ``counts`` the documents with it.
    """
    good, bad = (patterns == GOOD).sum(axis=1), (patterns == BAD).sum(axis=1)
    belief = np.clip((good + 1) / (good + bad + 2), 0.05, 0.95)
    model = None
    for _ in range(rounds):
        mass = np.stack([counts * (1 - belief), counts * belief])
        table = np.empty((patterns.shape[1], 2, 3))
        for j in range(patterns.shape[1]):
            for vote in range(3):
                table[j, :, vote] = mass[:, patterns[:, j] == vote].sum(axis=1) + 0.5
        table /= table.sum(axis=2, keepdims=True)
        model = LabelModel(float(np.clip(mass[1].sum() / counts.sum(), 0.01, 0.99)), table)
        updated = model.posterior(patterns)
        if np.abs(updated - belief).max() < 1e-6:
            break
        belief = updated
    return model


def label_model(voted: DataFrame, names: Sequence[str]) -> tuple[LabelModel | None, DataFrame]:
    """Model over all documents, and (votes, posterior) per combination: at most 3 to the number of heuristics."""
    rows = voted.groupBy(*names).count().collect()
    spark = voted.sparkSession
    schema = ", ".join(f"{n} byte" for n in names) + ", posterior double"
    if not rows:
        return None, spark.createDataFrame([], schema)
    rows = sorted(tuple(r) for r in rows)
    patterns = np.array([r[:-1] for r in rows])
    model = expectation_maximisation(patterns, np.array([r[-1] for r in rows], float))
    return model, spark.createDataFrame([(*r[:-1], float(p)) for r, p in zip(rows, model.posterior(patterns))], schema)


def features(text: str) -> np.ndarray:
    """Buckets of short character n-grams and of a few coarse shapes of the text."""
    grams = ngram_buckets(text, (2, 3), BITS)
    w = text.split()
    n = max(1, len(w))
    shapes = {
        "distinct": len(set(w)) / n * max(1.0, (n / 100) ** 0.5),
        "capital": sum(x.isupper() and len(x) > 1 for x in w) / n,
        "letters": sum(any(c.isalpha() for c in x) for x in w) / n,
        "length": sum(map(len, w)) / n / 10,
        "echoes": sum(w[i] in w[max(0, i - 2) : i] for i in range(1, len(w))) / n,
    }
    coarse = [zlib.crc32(f"{k}:{min(20, int(10 * v))}".encode()) >> (32 - BITS) for k, v in shapes.items()]
    return np.unique(np.concatenate([grams, np.array(coarse, np.int32)]))


@dataclass(frozen=True)
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        at = features(text or "")
        return float(sigmoid(self.weights[at].sum() / np.sqrt(max(1, len(at))) + self.bias))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [features(t.as_py() or "").astype("<i4").tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary()), batch.column("posterior"), batch.column("turn")], names=["raw", "posterior", "turn"])


def _fit(key: tuple, rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([("turn", "ascending"), ("raw", "ascending")])
    buckets = [np.frombuffer(r.as_py(), "<i4") for r in rows.column("raw")]
    target = rows.column("posterior").to_numpy()
    share = np.clip(target.mean(), 0.02, 0.98)
    # both classes weigh the same, however rare one is
    importance = 0.5 * (target / share + (1 - target) / (1 - share))
    scale = np.zeros(1 << BITS)
    seen = np.bincount(np.concatenate(buckets), minlength=1 << BITS)
    scale[seen >= 3] = 1 / np.sqrt(max(1.0, np.mean([len(b) for b in buckets])))
    weights, bias = fit_logistic(buckets, np.clip(target, 0.001, 0.999), scale, importance, 1e-5, rounds=120, rate=0.1)
    weights *= np.sqrt(max(1.0, np.mean([len(b) for b in buckets])))
    return pa.table({"weights": pa.array([weights.astype("<f4").tobytes()]), "bias": pa.array([bias])})


def train(docs: DataFrame, text: str = "text", fit_rows: int = FIT_ROWS) -> tuple[Scorer | None, LabelModel | None]:
    """Label model over all documents, scorer on a bounded sample of them; (None, None) without rows.

    The sample takes about ``fit_rows`` texts by a hash of the text, so that copies of a text are in
    or out together and any text has the same chance.
    """
    names = [h[0] for h in HEURISTICS]
    cut = docs.select(F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.lit("fit")).alias("turn"))
    voted = staged(cut.select("turn", let(metrics(F.col("text")), lambda m: F.struct(*votes(m))).alias("v")).select("turn", "v.*"))
    model, beliefs = label_model(voted, names)
    if model is None:
        return None, None
    distinct = staged(voted.groupBy("turn", *names).agg(F.lit(1).alias("one")).drop("one"))
    few = distinct if distinct.count() <= fit_rows else distinct.orderBy("turn").limit(fit_rows)
    chosen = few.join(F.broadcast(beliefs), names).select(F.col("turn").alias("_turn"), "posterior")
    # at most fit_rows rows on one side; one text per hash
    sample = cut.join(F.broadcast(chosen), F.col("turn") == F.col("_turn")).mapInArrow(_features, "raw binary, posterior double, turn long")
    once = sample.groupBy("turn").agg(F.min("raw").alias("raw"), F.min("posterior").alias("posterior")).withColumn("one", F.lit(1))
    found = once.groupBy("one").applyInArrow(lambda key, rows: _fit(key, rows.drop_columns(["one"])), "weights binary, bias double").first()
    return Scorer(np.frombuffer(found["weights"], "<f4").astype(np.float64), found["bias"]), model


def scored(docs: DataFrame, scorer: Scorer | None, text: str = "text", score: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``score``; 0.5 without a scorer."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            values = [held.score(t.as_py()) if held else 0.5 for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names=[*batch.schema.names, score])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{score}` double"
    return docs.mapInArrow(run, schema)


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, score, kept) of every row, by a scorer trained on the posterior labels of all documents.

    No given label is used. Heuristics are silent on a null or blank text; its score is that of a
    text without n-grams. Repeated rows and null ids come back as they are; other columns are not
    read, whatever their names. An empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    scorer, _ = train(rows, fit_rows=fit_rows)
    return scored(rows, scorer).select("doc_id", "score", (F.col("score") >= threshold).alias("kept"))
