"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import staged


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_minimum(edges: DataFrame) -> DataFrame:
    """Each edge with the smallest neighbour of its ``u``; pre-aggregated, the join may be split."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = _with_minimum(both).withColumn("m", F.least("m", "u"))
    return near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    near = _with_minimum(edges)
    moved = near.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(near.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; the root is the smallest node of the component.

    A round turns the edges towards the smallest neighbour, first from the larger, then from the
    smaller side; the number of rounds grows with the logarithm of the component size and the number
    of edges never grows. Each round ends in a staged table. Nothing but counts reaches the driver.
    Loops and null ends are ignored, repeated edges count once, no edge gives an empty result.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("_a"), F.col(b).alias("_b"))
    current = staged(pairs.filter("_a is not null and _b is not null and u <> v").select("u", "v").distinct())
    state = _state(current)
    while state[0]:
        current = staged(_small_star(_large_star(current)))
        before, state = state, _state(current)
        if state == before:
            break
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
