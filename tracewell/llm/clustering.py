"""Centroid clustering in exact integers, with a vantage-point tree over the centroids of each round."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import staged

CLUSTERS = 16
ROUNDS = 3
SCALE = 64
DIMENSIONS = 64
SEED = "1:"
LEAF = 3
# open nodes that one step of a search may hold: vectors times nodes
_OPEN = 1 << 22
# square roots and their differences are off by less than this share
_SLACK = 1e-12


class VantageTree:
    """Centroids split by their distance to a vantage point, until ``leaf`` or fewer are left.

    A node is (vantage or -1, centroids of a leaf, children as (node, nearest, farthest)), where
    nearest and farthest bound the distances of a child's centroids to the vantage point. The
    vantage point is the centroid farthest from the smallest-numbered one of the node.
    """

    def __init__(self, centroids: np.ndarray, leaf: int = LEAF) -> None:
        self.centroids = np.ascontiguousarray(centroids, np.int64)
        self.nodes: list = []
        if len(centroids):
            self._grow(np.arange(len(centroids)), max(leaf, 1))

    def _grow(self, members: np.ndarray, leaf: int) -> int:
        at = len(self.nodes)
        self.nodes.append(None)
        if len(members) <= leaf + 1:
            self.nodes[at] = (-1, members.tolist(), [])
            return at
        vantage = members[_squared(self.centroids[members], self.centroids[members[0]]).argmax()]
        rest = members[members != vantage]
        far = _squared(self.centroids[rest], self.centroids[vantage])
        order = np.lexsort((rest, far))
        rest, far = rest[order], np.sqrt(far[order].astype(np.float64))
        half, children = len(rest) // 2, []
        for part in (slice(None, half), slice(half, None)):
            children.append((self._grow(rest[part], leaf), far[part][0], far[part][-1]))
        self.nodes[at] = (int(vantage), [], children)
        return at

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of each point; ties go to the smaller number.

        Branch and bound, best first: every point opens the node with its own smallest bound, until that
        bound exceeds the distance found. The radius includes its rim, and a bound gives way by more
        than its rounding error, so a centroid as near as the best one is always looked at. Distances
        that decide are exact. Points that open the same node are handled together.
        """
        number, best = np.zeros(len(points), np.int64), np.full(len(points), np.iinfo(np.int64).max)
        at_once = max(1, _OPEN // max(1, len(self.nodes)))
        for start in range(0, len(points), at_once):
            part = slice(start, start + at_once)
            self._search(points[part], number[part], best[part])
        return number, best

    def _search(self, points: np.ndarray, number: np.ndarray, best: np.ndarray) -> None:
        bounds = np.full((len(points), len(self.nodes)), np.inf)
        bounds[:, 0] = 0.0
        rows = np.arange(len(points))
        while len(rows):
            node = bounds[rows].argmin(axis=1)
            low = bounds[rows, node]
            go = low <= np.sqrt(best[rows].astype(np.float64)) * (1 + _SLACK)
            go &= np.isfinite(low)
            rows, node = rows[go], node[go]
            for k in np.unique(node):
                here = rows[node == k]
                low = bounds[here, k]
                bounds[here, k] = np.inf
                vantage, leaf, children = self.nodes[k]
                for c in leaf if vantage < 0 else [vantage]:
                    found = _squared(points[here], self.centroids[c])
                    closer = (found < best[here]) | ((found == best[here]) & (c < number[here]))
                    number[here[closer]], best[here[closer]] = c, found[closer]
                if children:
                    far = np.sqrt(found.astype(np.float64))
                    for child, nearest, farthest in children:
                        gap = np.maximum(far - farthest, nearest - far) - _SLACK * (far + farthest)
                        bounds[here, child] = np.maximum(low, gap)


def _squared(points: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    gap = points - centroid
    return np.einsum("ij,ij->i", gap, gap)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def integer_points(vectors: DataFrame, vec_id: str, vector: str, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, point): vectors of ``dimensions`` finite components as whole numbers floor(scale * x).

    A squared distance of such points must fit into a long; a component too large for that ends the
    job with an error, as no result could hold it.
    """
    x = F.col(vector)
    whole = (F.size(x) == dimensions) & F.forall(x, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    largest = int((2**61 / dimensions) ** 0.5)
    number = lambda c: F.floor(c.cast("double") * scale)
    fits = lambda c: F.when(F.abs(c.cast("double") * scale) < largest, number(c)).otherwise(F.raise_error(F.lit(f"a component exceeds {largest} / {scale}")).cast("long"))
    return vectors.filter(x.isNotNull() & whole).select(F.col(vec_id).alias("vec_id"), F.transform(x, fits).alias("point"))


def first_centroids(points: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k points with the smallest hash of seed and vec_id; null ids last, equal ids by their components."""
    order = [F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256).asc_nulls_last(), F.col("point")]
    return np.array([r.point for r in points.orderBy(*order).limit(k).collect()], np.int64)


def _sums(tree):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, width = tree.value.centroids.shape
        total, count = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if batch.num_rows:
                points = _matrix(batch.column(0), width)
                number, _ = tree.value.nearest(points)
                np.add.at(total, number, points)
                count += np.bincount(number, minlength=k)
        used = np.flatnonzero(count)
        columns = [np.repeat(used, width), np.tile(np.arange(width), len(used)), total[used].ravel(), np.repeat(count[used], width)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["cluster", "at", "total", "n"])

    return sums


def _assigned(tree):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = tree.value.centroids.shape[1]
        for batch in batches:
            number, best = tree.value.nearest(_matrix(batch.column(1), width))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number, pa.int32()), pa.array(best, pa.int64())], names=["vec_id", "cluster", "distance"])

    return assign


def broadcast_tree(spark: SparkSession, centroids: np.ndarray):
    """The tree of one round on every executor; its size is that of k centroids."""
    return spark.sparkContext.broadcast(VantageTree(centroids))


def moved(points: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: componentwise floor of the mean of the points nearest to each.

    A task returns one sum per cluster and component, whatever it reads; k times d sums reach the driver.
    """
    tree = broadcast_tree(points.sparkSession, centroids)
    partial = points.select("point").mapInArrow(_sums(tree), "cluster long, at long, total long, n long")
    after = centroids.copy()
    for cluster, at, total, n in partial.groupBy("cluster", "at").agg(F.sum("total"), F.sum("n")).collect():
        after[cluster, at] = total // n
    tree.destroy()
    return after


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(c)) for c in centroid).encode()).hexdigest()


def cluster(
    vectors: DataFrame,
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
    seed: str = SEED,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid array) of every usable vector.

    Vectors of ``dimensions`` finite components take part, as whole numbers floor(scale * x); null
    vectors, other lengths and null or non-finite components are left out. The first centroids are the
    k points with the smallest hash of ``seed`` and vec_id (all of them if there are fewer). A round
    assigns all points and moves every centroid to the floor of its mean; an empty one stays. After
    ``rounds`` rounds the points are assigned once more. Distances are squared and exact, ties go to
    the smaller number, so equal vectors share a cluster and equal centroids go to the first.

    Repeated rows count each time; a null vec_id is kept and comes last in the choice of the first
    centroids. An empty table gives an empty result. Other columns are not read.

    Points are staged once; rounds only read them, so a hot cluster needs no shuffle of points. The
    driver holds k centroids, k * dimensions sums and k totals.
    """
    spark = vectors.sparkSession
    points = staged(integer_points(vectors, vec_id, vector, dimensions, scale))
    schema = f"vec_id {points.schema['vec_id'].dataType.simpleString()}, cluster int, distance long"
    result = f"{schema}, cluster_inertia long, inertia long, centroid array<long>"
    centroids = first_centroids(points, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], result)
    for _ in range(rounds):
        centroids = moved(points, centroids)
    assigned = staged(points.mapInArrow(_assigned(broadcast_tree(spark, centroids)), schema))
    inertia = dict(map(tuple, assigned.groupBy("cluster").agg(F.sum("distance")).collect()))
    rows = [(c, inertia[c], sum(inertia.values()), centroids[c].tolist()) for c in sorted(inertia)]
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    # one row per cluster: k at most
    return assigned.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def centroid_digest(centroid: Column) -> Column:
    """Lowercase hex sha256 of the components in decimal, joined by commas."""
    return F.sha2(F.array_join(centroid.cast("array<string>"), ","), 256)


def oracle(k: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """The same by comparing each vector with each centroid."""
    squared = f"list_sum(list_transform(range(1, {DIMENSIONS + 1}), lambda i: (v.p[i] - c.p[i]) * (v.p[i] - c.p[i])))::BIGINT"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT v.row, any_value(v.vec_id) AS vec_id, any_value(v.p) AS p, min({{'d': {squared}, 'c': c.c}}) AS near FROM kept v, c{r} c GROUP BY v.row)")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT old.c, coalesce(new.p, old.p) AS p FROM c{r} old LEFT JOIN (
                SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS p FROM (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (
                    SELECT near.c AS c, unnest(range({DIMENSIONS})) AS i, unnest(p) AS x FROM a{r}) GROUP BY c, i) GROUP BY c) new USING (c))""")
    return f"""
    WITH kept AS MATERIALIZED (
        SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS p FROM embeddings
        WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}
    ), c0 AS MATERIALIZED (
        SELECT row_number() OVER (ORDER BY sha256('{SEED}' || vec_id) NULLS LAST, p) - 1 AS c, p FROM kept ORDER BY c LIMIT {k}
    ), {", ".join(steps)}
    SELECT vec_id, near.c::INT AS cluster, near.d AS distance, (sum(near.d) OVER (PARTITION BY near.c))::BIGINT AS cluster_inertia, (sum(near.d) OVER ())::BIGINT AS inertia,
        sha256(array_to_string(final.p, ',')) AS centroid_sha256
    FROM a{rounds} JOIN c{rounds} final ON final.c = near.c"""
