"""Mixing sources to target weights by pivotal dependent rounding in a reduction tree."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import positions, shares, staged

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2
# documents of one leaf, and residuals that one inner node combines
FAN_IN = 4096


def ranked(df: DataFrame, order: Column, name: str = "rank") -> DataFrame:
    """Position of every row in ``order`` from 0, without a task that sees all rows.

    The driver learns one count per partition of the sort.
    """
    placed = df.orderBy(order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    placed = staged(placed)
    counts = dict(map(tuple, placed.groupBy("_part").count().collect()))
    before, total = {}, 0
    for part in sorted(counts):
        before[part], total = total, total + counts[part]
    spark = df.sparkSession
    offsets = spark.createDataFrame(list(before.items()), "_part int, _before long")
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(offsets, "_part").withColumn(name, F.col("_before") + within).drop("_part", "_at", "_before")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """(source, source_size, n, rank, weight, target) of each row of (source, source_size, n).

    Sources in code-point order, null last, take the weights in turn and share ``budget`` times all
    sizes. A target stops at ``most`` times its source's size and the excess is shared again by
    weight. The level of the remaining ones rises until no more source is cut; each step is one
    aggregation, of which only three numbers reach the driver.
    """
    order = F.col("source").asc_nulls_last()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = staged(ranked(sizes, order).withColumn("weight", weight))
    cap = F.col("source_size") * float(most)
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, cut = 0.0, -1
    while total:
        over = F.col("weight") * level > cap
        fixed, free, now = table.agg(
            F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)), F.count_if(over)
        ).first()
        if now == cut or not free:
            break
        level, cut = (budget * total - fixed) / free, now
    return table.withColumn("target", F.least(F.col("weight") * level, cap))


def settle(f: Sequence[float], size: Sequence[int], draw: Sequence[float]) -> tuple[list[float], int]:
    """Pivotal rounding of documents in the given order; (values, position of the one left open or -1).

    Two open documents exchange expected words, so their sum stays as it is, until one of them is
    fully in or out. Either end is drawn with the chance that keeps each expectation. What stays
    open meets the next document.
    """
    out, left = list(f), -1
    for i, s in enumerate(size):
        if not 0.0 < out[i] < 1.0:
            continue
        if left < 0:
            left = i
            continue
        a, b = out[left] * size[left], out[i] * s
        up, down = min(size[left] - a, b), min(a, s - b)
        move = up if draw[i] * (up + down) < down else -down
        out[left], out[i] = _snapped((a + move) / size[left]), _snapped((b - move) / s)
        still = [k for k in (left, i) if 0.0 < out[k] < 1.0]
        left = still[0] if still else -1
    return out, left


def _snapped(f: float) -> float:
    return 0.0 if f < 1e-9 else 1.0 if f > 1 - 1e-9 else f


def settle_block(f: float, size: Sequence[int], draw: Sequence[float]) -> tuple[list[float], int]:
    """The same for documents, largest first, that all start from the fraction ``f``.

    Each document is paired with the bundle of all smaller ones, which share one fraction. So a long
    document can be settled at once, its words are made up for by many short ones, and what stays
    open is the shortest, unless a document outweighs all smaller ones together.
    """
    out, rest = [0.0] * len(size), sum(size)
    mass = f * rest
    for i, s in enumerate(size):
        share = _snapped(mass / rest) if rest else 0.0
        if share in (0.0, 1.0):
            out[i:] = [share] * (len(size) - i)
            return out, -1
        rest -= s
        a = share * s
        b = mass - a
        up, down = min(s - a, b), min(a, rest - b)
        if up + down <= 0:
            out[i] = share
            return out, i
        move = up if draw[i] * (up + down) < down else -down
        out[i], mass = _snapped((a + move) / s), b - move
        if 0.0 < out[i] < 1.0:
            out[i + 1 :] = [0.0 if move > 0 else 1.0] * (len(size) - i - 1)
            return out, i
    return out, -1


def _rounded(rows: pa.Table, leaf: bool) -> pa.Table:
    f, size, draw = (rows.column(c).to_numpy() for c in ("f", "size", "draw"))
    out = (draw < f).astype(np.float64)  # rows without words are drawn alone
    order = np.lexsort((draw, -size))
    order = order[size[order] > 0]
    fractions, sizes, draws = f[order].tolist(), size[order].tolist(), draw[order].tolist()
    if leaf:
        values, left = settle_block(fractions[0], sizes, draws) if fractions else ([], -1)
    else:
        values, left = settle(fractions, sizes, draws)
    out[order] = values
    still = np.zeros(len(f), bool)
    if left >= 0:
        still[order[left]] = True
    rows = rows.set_column(rows.schema.get_field_index("f"), "f", pa.array(out))
    return rows.append_column("open", pa.array(still))


def _leaf(rows: pa.Table) -> pa.Table:
    return _rounded(rows, leaf=True)


def _node(rows: pa.Table) -> pa.Table:
    return _rounded(rows, leaf=False)


def _draw(level: int, *columns: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(f"mix{level}"), *columns), 11) * F.lit(2.0**-53)


def with_copies(rows: DataFrame, keys: Sequence[str], name: str = "_copy") -> DataFrame:
    """``rows``, staged, with the rank among rows of equal ``keys``; null for the first, so that it leaves a hash as it is.

    Only rows whose keys repeat are ranked, by a range sort that also splits the rows of one key.
    """
    number = "_copy_row"
    rows = staged(rows.withColumn(number, F.monotonically_increasing_id()))
    same = [f"_k{i}" for i in range(len(keys))]
    meet = lambda: reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(s)) for k, s in zip(keys, same)])
    repeated = rows.groupBy(*[F.col(k).alias(s) for k, s in zip(keys, same)]).agg(F.count("*").alias("_n")).filter("_n > 1")
    repeated = staged(repeated)
    if repeated.isEmpty():
        return rows.withColumn(name, F.lit(None).cast("long"))
    placed, _ = positions(rows.join(repeated, meet(), "left_semi").select(number, *keys), [F.col(k) for k in keys] + [F.col(number)], "_place")
    first = placed.groupBy(*[F.col(k).alias(s) for k, s in zip(keys, same)]).agg(F.min("_place").alias("_first"))
    ranks = placed.join(first, meet()).select(number, F.nullif(F.col("_place") - F.col("_first"), F.lit(0)).alias(name))
    return staged(rows.join(ranks, number, "left"))


def mix(
    rows: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    budget: float = BUDGET,
    most: float = MOST,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Copies of every row of (doc_id, source, size) in the mix.

    Returns doc_id, size, source_size, target, copies, taken and the columns of ``carry``. Each
    document of a source expects target / source_size copies; the whole part is sure, the rest is
    rounded so that the words taken of a source differ from its target by half of the one document
    that stays open at the root at most. Leaves are blocks of a source fixed by a hash of doc_id and size,
    so a hot source spreads over many of them, and draws come from the same hash: reruns agree.
    Rows of equal doc_id, source and size are told apart by their rank, which enters both hashes, so they
    spread over the leaves and are drawn each for itself. Null source: a source of its own. Null size: 0. Rows of size 0 add no word; their copies are
    drawn alone. A null doc_id is drawn like any other value; equal rows are interchangeable.
    An empty table gives an empty result.
    """
    carry = list(carry)
    base = rows.select("doc_id", "source", F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size"), *carry)
    base = with_copies(base, ["source", "doc_id", "size"])
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = staged(targets(sizes, weights, budget, most).withColumn("blocks", F.ceil(F.col("n") / FAN_IN)))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = base.join(sources.withColumnRenamed("source", "_s"), base["source"].eqNullSafe(F.col("_s")))
    leaves = joined.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        "rank",
        F.pmod(F.xxhash64("doc_id", "size", "_copy"), F.col("blocks")).alias("block"),
        F.floor(expected).alias("sure"),
        (expected - F.floor(expected)).alias("f"),
        _draw(0, "doc_id", "size", "_copy").alias("draw"),
        "_copy",
        *carry,
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in leaves.schema) + ", open boolean"
    most_blocks, n_rows = sources.agg(F.coalesce(F.max("blocks"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    spread = leaves.repartition(min(shares(n_rows, FAN_IN, 4), 1 << 16), "rank", "block")
    settled = staged(spread.groupBy("rank", "block").applyInArrow(_leaf, schema))

    # inner nodes: residuals of up to FAN_IN children meet, level by level, until one per source is left
    key = "rank long, block long, leaf long, size long, id long, f double"
    left = settled.filter("open").select("rank", "block", F.col("block").alias("leaf"), "size", F.xxhash64("doc_id", "_copy").alias("id"), "f")
    decided = [settled.sparkSession.createDataFrame([], key)]
    level, width = 0, most_blocks
    while width > 1:
        level, width = level + 1, -(-width // FAN_IN)
        nodes = left.withColumn("block", F.floor(F.col("block") / FAN_IN)).withColumn("draw", _draw(level, "id", "size"))
        met = staged(nodes.groupBy("rank", "block").applyInArrow(_node, key + ", draw double, open boolean"))
        decided.append(met.filter("not open").drop("draw", "open"))
        left = met.filter("open").drop("draw", "open")
    last = left.withColumn("f", (F.col("f") >= 0.5).cast("double"))
    decided.append(last)
    ends = decided[0]
    for part in decided[1:]:
        ends = ends.unionByName(part)
    ends = ends.select(F.col("rank").alias("_rank"), F.col("leaf").alias("_leaf"), F.col("f").alias("_f"))
    pending = settled.filter("open").join(ends, (F.col("rank") == F.col("_rank")) & (F.col("block") == F.col("_leaf")))
    columns = ["doc_id", "size", "source_size", "target", "sure", *carry]
    done = settled.filter("not open").select(*columns, "f").unionByName(pending.select(*columns, F.col("_f").alias("f")))
    copies = (F.col("sure") + F.round("f")).cast("long")
    return done.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *carry)
