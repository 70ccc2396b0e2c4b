"""Semi-naive iteration with reliable lineage cuts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.session import pin, stored


class NotConverged(RuntimeError):
    """The round budget ended before the closure did."""


def closure(
    seed: DataFrame,
    step: Callable[[DataFrame], DataFrame],
    keys: Sequence[str],
    max_rounds: int | None = None,
    compact_every: int = 8,
    level: str | None = None,
    unroll: int = 1,
) -> DataFrame:
    """All rows reachable from ``seed`` by ``step``; only new rows drive the next round, and without ``max_rounds`` none is the last but the one that finds nothing.

    A round is one job: expand the newest rows ``unroll`` times, drop known keys by an anti join,
    checkpoint. Several expansions per round save lineage cuts and scheduling on long chains. Rows
    consist of ``keys`` alone; ``level`` names a column with the number of steps to each row.
    """
    keys, depth = list(keys), level or "_level"
    delta = pin(seed.select(*keys).distinct().withColumn(depth, F.lit(0)))
    known = [delta]
    for number in count() if max_rounds is None else range(max_rounds):
        frontier, reached = delta.select(*keys), []
        for hop in range(1, unroll + 1):
            frontier = step(frontier).select(*keys).distinct()
            reached.append(frontier.withColumn(depth, F.lit(number * unroll + hop)))
        fresh = reduce(DataFrame.unionByName, reached)
        if unroll > 1:
            fresh = fresh.groupBy(*keys).agg(F.min(depth).alias(depth))
        seen = reduce(DataFrame.unionByName, [k.select(*keys) for k in known])
        fresh = pin(fresh.join(seen, keys, "left_anti"))
        known.append(fresh)
        # rows found before the last hop of this round were expanded within it
        delta = fresh.filter(F.col(depth) == (number + 1) * unroll)
        if delta.isEmpty():
            out = reduce(DataFrame.unionByName, known)
            return out if level else out.drop(depth)
        if len(known) > compact_every:
            known = [pin(reduce(DataFrame.unionByName, known))]
    raise NotConverged(f"no fixpoint after {max_rounds} rounds")


def walk(start: DataFrame, hops: DataFrame, keys: Sequence[str] = (), level: str | None = None, patience: int = 6, widest: int = 64) -> DataFrame:
    """``start`` rows (*keys, node, ...) and every node that hops (*keys, node, next) lead to from them, with fewest hops as ``level``.

    No round limit and no harm from cycles. While rounds go on, every ``patience`` of them the hops are
    joined with themselves, so that a round covers twice as many of them with exact lengths, up to
    ``widest``, as long as the table stays within that multiple of the edges.
    """
    keys, depth = list(keys), level or "_level"
    columns = [c for c in start.columns]
    far = stored(hops.select(*keys, "node", F.col("next").alias("_next")).filter("node <> _next").distinct().withColumn("_len", F.lit(1)))
    base, stride, number = far.count(), 1, 0
    delta = stored(start.distinct().withColumn(depth, F.lit(0)))
    known = [delta]
    while not delta.isEmpty():
        if number and number % patience == 0 and stride < widest and far.count() * 4 <= base * widest:
            more = far.select(*keys, F.col("node").alias("_next"), F.col("_next").alias("_far"), F.col("_len").alias("_more"))
            twice = far.join(more, [*keys, "_next"]).select(*keys, "node", F.col("_far").alias("_next"), (F.col("_len") + F.col("_more")).alias("_len"))
            far = stored(far.unionByName(twice.filter("node <> _next")).groupBy(*keys, "node", "_next").agg(F.min("_len").alias("_len")))
            stride *= 2
        grown = delta.join(far, [*keys, "node"]).select(*[F.col("_next").alias("node") if c == "node" else F.col(c) for c in columns], (F.col(depth) + F.col("_len")).alias(depth))
        seen = reduce(DataFrame.unionByName, [k.select(*columns) for k in known])
        delta = stored(grown.groupBy(*columns).agg(F.min(depth).alias(depth)).join(seen, columns, "left_anti"))
        known.append(delta)
        if len(known) > 8:
            known = [stored(reduce(DataFrame.unionByName, known))]
        number += 1
    out = reduce(DataFrame.unionByName, known)
    return out if level else out.drop(depth)
