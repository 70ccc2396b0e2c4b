"""Skew-safe building blocks.

A key may hold a third of all rows. Nothing here sends such a group to one task: rows are cut or
pre-aggregated before the exchange, and order-dependent work runs on blocks of a key, whose small
per-block totals are then chained.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tracewell.functions import sorted_rows
from tracewell.session import stored

Order = Sequence[Column | str]

# Catalyst places a map-side group limit under row_number() <= n up to this n
GROUP_LIMIT = 1000


def top_n(df: DataFrame, keys: Sequence[str], order: Order, n: int, rank: str = "rn", salts: int = 64) -> DataFrame:
    """First ``n`` rows per key with their rank.

    Up to ``GROUP_LIMIT`` Catalyst already keeps only n rows per key and map task. Beyond it the
    same cut is made per salt first, so that the second window sees at most n * salts rows per key.
    """
    if n > GROUP_LIMIT:
        salt = F.pmod(F.xxhash64(*[c for c in df.columns]), F.lit(salts))
        part = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = df.withColumn("_salt", salt).withColumn("_rn", F.row_number().over(part)).filter(F.col("_rn") <= n).drop("_salt", "_rn")
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)


def _placed(df: DataFrame, keys: Sequence[str], order: Order) -> DataFrame:
    """Rows of one range sort with their partition and their place in it."""
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return stored(df.orderBy(*keys, *order).select("*", F.spark_partition_id().alias("_part"), local.alias("_at")))


def _with_offsets(placed: DataFrame, values: Sequence[str] = ()) -> DataFrame:
    """``placed`` with the totals of all earlier partitions, chained on the driver, and the place of a row among all."""
    totals = placed.groupBy("_part").agg(F.count("*").alias("_rows"), *[F.sum(v).alias(v) for v in values])
    before, rows = [0] * (len(values) + 1), []
    for part, *own in sorted(tuple(r) for r in totals.collect()):
        rows.append((part, *before))
        before = [a + (b or 0) for a, b in zip(before, own)]
    types = ", ".join(f"_o{f.name} {f.dataType.simpleString()}" for f in totals.schema if f.name != "_part")
    offsets = placed.sparkSession.createDataFrame(rows, f"_part int, {types}")
    return placed.join(offsets, "_part").withColumn("_pos", F.col("_o_rows") + F.col("_at"))


def running_sums(df: DataFrame, keys: Sequence[str], order: Order, values: dict[str, Column]) -> DataFrame:
    """Inclusive running sums per key in ``order``, in two passes over one range sort.

    A range partition never holds more than its share, whatever one key holds. Sums run inside each
    partition; the totals of the earlier partitions, one row each, are chained on the driver.
    """
    names = {f"_v{i}": n for i, n in enumerate(values)}
    work = df
    for temporary, name in names.items():
        work = work.withColumn(temporary, values[name])
    inner = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    summed = _with_offsets(_placed(work, keys, order), list(names))
    for temporary, name in names.items():
        summed = summed.withColumn(name, F.col(f"_o{temporary}") + F.coalesce(F.sum(temporary).over(inner), F.lit(0)))
    if keys:
        summed = stored(summed)
        starts = F.min(F.struct("_pos", *[(F.col(n) - F.coalesce(t, F.lit(0))).alias(t) for t, n in names.items()])).alias("_s")
        summed = summed.join(summed.groupBy(*keys).agg(starts), list(keys))
        for temporary, name in names.items():
            summed = summed.withColumn(name, F.col(name) - F.col(f"_s.{temporary}"))
    return summed.select(*[c for c in df.columns if c not in values], *values)


def ranked(df: DataFrame, keys: Sequence[str], order: Order, rank: str = "rn") -> DataFrame:
    """Row number per key in ``order`` over all its rows, however many one key has.

    The sort is the only exchange: a row counts from the first row of its key in its partition, and what
    a key has in the partitions before is chained on the driver, one row each.
    """
    if not keys:
        return _with_offsets(_placed(df, keys, order)).select(*[c for c in df.columns if c != rank], (F.col("_pos") + 1).alias(rank))
    work = df.dropna(subset=list(keys)).orderBy(*keys, *order)
    headed = work.mapInArrow(sorted_rows.heads(list(keys)), T.StructType([*work.schema.fields, T.StructField("_head", T.LongType())]))
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = stored(headed.select("*", F.spark_partition_id().alias("_part"), local.alias("_at")))
    key = F.struct(*keys)
    ends = placed.groupBy("_part").agg(F.count("*"), F.max("_head"), F.min_by(key, "_at"), F.max_by(key, "_at"))
    carried, last, rows = 0, None, []
    for part, count, head, first, end in sorted((tuple(r) for r in ends.collect()), key=lambda r: r[0]):
        carried = carried if last is not None and last == first else 0
        rows.append((part, carried))
        # what the last key has up to here
        carried, last = (carried + count if head == 0 else count - head), end
    offsets = df.sparkSession.createDataFrame(rows, "_part int, _carried long")
    number = F.col("_at") - F.col("_head") + 1 + F.when(F.col("_head") == 0, F.col("_carried")).otherwise(0)
    return placed.join(offsets, "_part").select(*[c for c in df.columns if c != rank], number.alias(rank))


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Row with the smallest ``order`` per key, by partial aggregation instead of a window."""
    head = [c for c in order]
    rest = [c for c in keep if c not in head]
    best = df.groupBy(*keys).agg(F.min(F.struct(*head, *rest)).alias("_m"))
    return best.select(*keys, *[F.col(f"_m.{c}").alias(c) for c in keep])


def with_totals(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Join per-key totals back on; the totals are pre-aggregated, the join may be split by AQE."""
    totals = df.groupBy(*keys).agg(*[expr.alias(name) for name, expr in aggs.items()])
    return df.join(totals, list(keys))


def prefix_sums(
    df: DataFrame, keys: Sequence[str], blocks: Column | Sequence[Column], order: Order, values: dict[str, Column]
) -> DataFrame:
    """Inclusive running sums per key in ``order``, without one task per key.

    ``blocks`` go from coarse to fine and must not decrease along ``order``; rows of one innermost
    block fit a task. Sums run inside the innermost block; each level adds the totals of the earlier
    blocks of its parent, taken from one pre-aggregated row per block. With no keys this is a global
    running sum whose only ordered step over everything sees the coarse block totals.
    """
    blocks = [blocks] if isinstance(blocks, Column) else list(blocks)
    names = [f"_b{i}" for i in range(len(blocks))]
    work = df
    for name, block in zip(names, blocks):
        work = work.withColumn(name, block)
    for name, value in values.items():
        work = work.withColumn(f"_v_{name}", value)
    finest = work.groupBy(*keys, *names).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    offsets = finest
    for n in values:
        offsets = offsets.withColumn(f"_o_{n}", F.lit(0))
    for depth, name in enumerate(names):
        parents = [*keys, *names[:depth]]
        totals = finest.groupBy(*parents, name).agg(*[F.sum(f"_t_{n}").alias(f"_t_{n}") for n in values])
        before = Window.partitionBy(*(parents or [F.lit(0)])).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
        part = totals.select(*parents, name, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_p_{n}") for n in values])
        offsets = offsets.join(part, [*parents, name])
        for n in values:
            offsets = offsets.withColumn(f"_o_{n}", F.col(f"_o_{n}") + F.col(f"_p_{n}"))
        offsets = offsets.drop(*[f"_p_{n}" for n in values])
    offsets = offsets.drop(*[f"_t_{n}" for n in values])
    inner = Window.partitionBy(*keys, *names).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = work.join(offsets, [*keys, *names])
    for n in values:
        out = out.withColumn(n, F.col(f"_o_{n}") + F.coalesce(F.sum(f"_v_{n}").over(inner), F.lit(0)))
    return out.drop(*names, *[f"_v_{n}" for n in values], *[f"_o_{n}" for n in values])


def with_neighbour(
    df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[str], columns: Sequence[str], *, prefix: str, back: bool = False
) -> DataFrame:
    """The next (or previous) row's ``columns`` per key as a struct column ``prefix``, worked block by block."""
    keys = list(keys)
    packed = F.struct(*order, *[c for c in columns if c not in order])
    work = df.withColumn("_block", block).withColumn("_row", packed)
    edge = (F.max if back else F.min)("_row").alias("_edge")
    by_block = Window.partitionBy(*keys).orderBy(F.desc("_block") if not back else F.asc("_block"))
    edges = work.groupBy(*keys, "_block").agg(edge).select(
        *keys, "_block", F.lag("_edge").over(by_block).alias("_beyond")
    )
    inner = Window.partitionBy(*keys, "_block").orderBy(*order)
    step = F.lag("_row").over(inner) if back else F.lead("_row").over(inner)
    return (
        work.join(edges, [*keys, "_block"])
        .withColumn(prefix, F.coalesce(step, F.col("_beyond")))
        .drop("_block", "_row", "_beyond")
    )
