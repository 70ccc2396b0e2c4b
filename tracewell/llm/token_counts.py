"""Token counts: an exact histogram of encoded lengths whose suffix sums answer for every context limit."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import staged
from tracewell.llm.tokens import byte_bpe

_BLOCK = 1024


def _lengths(paths: tuple):
    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(*paths)
        for batch in batches:
            counts = [len(encode(t.as_py() or "")) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(counts, pa.int64())], names=[*batch.schema.names[1:], "length"])

    return lengths


def length_histogram(docs: DataFrame, by: Sequence[str] = (), text: str = "text", tokenizer: str | None = None, ranks: str | None = None) -> DataFrame:
    """(*by, length, n_docs): documents by exact number of ids, added up per task before the shuffle.

    Null and empty texts have length 0; null keys are a group; repeated rows count each time. Other
    columns are not read, whatever their names (a key may not be called length).
    """
    rows = docs.select(F.col(text).alias("_text"), *by)
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text"], "length long"])
    return rows.mapInArrow(_lengths((tokenizer, ranks)), schema).groupBy(*by, "length").agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The histogram with what lies at or above each length.

    Adds docs_from and tokens_from (documents of this length or more, and their tokens), n_total,
    tokens_total, share_below (documents that are shorter, as a quantile) and truncated_total: the
    tokens left if every document is cut at this length. Sums run inside blocks of lengths and over
    the block totals of a key, so no task sees all lengths. The histogram is staged, as it is read
    twice. An empty histogram stays empty.
    """
    rows = staged(histogram).withColumn("_block", F.floor(F.col("length") / _BLOCK)).withColumn("_tokens", F.col("length") * F.col("n_docs"))
    keys = list(by)
    longer = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    blocks = rows.groupBy(*keys, "_block").agg(F.sum("n_docs").alias("_d"), F.sum("_tokens").alias("_t"))
    blocks = blocks.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_block").alias("_b"),
        F.coalesce(F.sum("_d").over(longer), F.lit(0)).alias("_docs_after"),
        F.coalesce(F.sum("_t").over(longer), F.lit(0)).alias("_tokens_after"),
        F.sum("_d").over(whole).alias("n_total"),
        F.sum("_t").over(whole).alias("tokens_total"),
    )
    same = F.col("_block") == F.col("_b")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inner = Window.partitionBy(*keys, "_block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(blocks, same).withColumns(
        {"docs_from": F.col("_docs_after") + F.sum("n_docs").over(inner), "tokens_from": F.col("_tokens_after") + F.sum("_tokens").over(inner)}
    )
    below = F.col("tokens_total") - F.col("tokens_from")
    return out.select(
        *keys,
        "length",
        "n_docs",
        "docs_from",
        "tokens_from",
        "n_total",
        "tokens_total",
        ((F.col("n_total") - F.col("docs_from")) / F.col("n_total")).alias("share_below"),
        (below + F.col("length") * F.col("docs_from")).alias("truncated_total"),
    )


def truncated_totals(sums: DataFrame, limits: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """(*by, limit, docs_cut, truncated_total) for any context limits, from ``suffix_sums``.

    A document longer than the limit keeps ``limit`` tokens. Every given limit has a row per key.
    """
    asked = sums.withColumn("limit", F.explode(F.array(*[F.lit(int(n)).cast("long") for n in limits])))
    over = F.col("length") > F.col("limit")
    found = asked.groupBy(*by, "limit").agg(
        F.max("tokens_total").alias("_total"),
        F.coalesce(F.max(F.when(over, F.col("docs_from"))), F.lit(0)).alias("docs_cut"),
        F.coalesce(F.max(F.when(over, F.col("tokens_from"))), F.lit(0)).alias("_from"),
    )
    return found.select(*by, "limit", "docs_cut", (F.col("_total") - F.col("_from") + F.col("limit") * F.col("docs_cut")).alias("truncated_total"))


def quantiles(sums: DataFrame, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(*by, share, length): the smallest length that at least this share of the documents does not exceed."""
    asked = sums.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    reached = (F.col("n_total") - F.col("docs_from") + F.col("n_docs")) >= F.ceil(F.col("share") * F.col("n_total"))
    return asked.filter(reached).groupBy(*by, "share").agg(F.min("length").alias("length"))
