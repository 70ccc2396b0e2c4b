"""Near duplicates among embeddings: sign hashing in several tables, exact cosine, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import shares, staged
from tracewell.llm.components import connected_components
from tracewell.llm.simhash import local_roots

THRESHOLD = 0.98
# a pair at cosine 0.98 misses all 32 tables of 16 planes with a chance of one in a million
TABLES = 32
PLANES = 16
# vectors of a bucket that are compared with each other in one block
BLOCK = 2048
ROWS_EACH = 8192
# buckets up to this size are compared together without a loop over buckets
SMALL = 32


@lru_cache(maxsize=4)
def planes_of(dim: int, tables: int, planes: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, tables * planes))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of one length as unit vectors in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def signatures(unit: np.ndarray, tables: int, planes: int) -> np.ndarray:
    """One number of ``planes`` bits per vector and table."""
    signs = unit @ planes_of(unit.shape[1], tables, planes) > 0
    return np.packbits(signs.reshape(len(unit), tables, planes), axis=2, bitorder="little").view(np.uint16).reshape(len(unit), tables)


def _sign(tables: int, planes: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            out = np.zeros((len(dims), tables), np.uint16)
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                out[own] = signatures(matrix(batch.column("embedding").take(pa.array(own)), int(dim)), tables, planes)
            raw = out.tobytes()
            keys = (np.arange(tables, dtype=np.int32)[None, :] << planes) | out.astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, tables, dtype=np.int32)), pa.array(keys.ravel()))
            wide = 2 * tables
            binary = pa.array([raw[i * wide : (i + 1) * wide] for i in range(len(dims))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("cid"), binary, lists], names=["cid", "sig", "keys"])

    return sign


def _pairs_within(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of positions that share one of the groups given by start and size."""
    position = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    after = np.repeat(sizes, sizes) - position - 1
    at = np.repeat(starts, sizes) + position
    first = np.repeat(at, after)
    second = first + 1 + np.arange(after.sum()) - np.repeat(np.cumsum(after) - after, after)
    return first, second


def matches(unit: np.ndarray, group: np.ndarray, side: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group (sorted) at the threshold or above.

    A group with rows of side 1 is a pair of blocks: only pairs across the sides are compared.
    """
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    crossed = np.add.reduceat(side, starts) > 0
    small = (sizes <= SMALL) & ~crossed
    if small.any():
        first, second = _pairs_within(starts[small], sizes[small])
        for low in range(0, len(first), 1 << 16):
            a, b = first[low : low + (1 << 16)], second[low : low + (1 << 16)]
            near = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
            yield a[near], b[near]
    for start, size, cross in zip(starts[~small], sizes[~small], crossed[~small]):
        rows = np.arange(start, start + size)
        left = rows[side[rows] == 0]
        right = rows[side[rows] == 1] if cross else left
        for low in range(0, len(left), 256):
            a, b = np.nonzero(unit[left[low : low + 256]] @ unit[right].T >= threshold)
            if not cross:
                a, b = a[a + low < b], b[a + low < b]
            yield left[a + low], right[b]


def _compare(dim: int, tables: int, threshold: float):
    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        cid, bid, p, q = (rows.column(c).to_numpy() for c in ("cid", "bid", "p", "q"))
        order = np.lexsort((q, p, bid))
        rows = rows.take(pa.array(order)).combine_chunks()
        cid, bid, p, q = cid[order], bid[order], p[order], q[order]
        group = np.cumsum(np.r_[False, (bid[1:] != bid[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])])
        side = rows.column("side").to_numpy().astype(np.int64)
        at = rows.column("at").to_numpy()
        copies = rows.column("copies").to_numpy()
        sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint16).reshape(-1, tables)
        unit = matrix(rows.column("embedding").combine_chunks(), dim)
        nodes, index = np.unique(cid, return_inverse=True)
        linked, found = np.zeros(len(nodes), np.int64), []
        for a, b in matches(unit, group, side, threshold):
            # a pair counts in the first table where it meets
            fresh = ((sig[a] == sig[b]) & (np.arange(tables)[None, :] < at[a][:, None])).any(axis=1)
            a, b = a[~fresh], b[~fresh]
            np.add.at(linked, index[a], copies[b])
            np.add.at(linked, index[b], copies[a])
            if len(a):
                found.append(np.unique(np.stack([index[a], index[b]], axis=1), axis=0))
        edges = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        root = local_roots(len(nodes), edges[:, 0], edges[:, 1])
        some = linked > 0
        return pa.table({"cid": nodes[some], "n": linked[some], "root": nodes[root[some]]})

    return compare


def _usable(embedding: Column) -> Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def embedding_components(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    threshold: float = THRESHOLD,
    tables: int = TABLES,
    planes: int = PLANES,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors``.

    Vectors link at a cosine of ``threshold`` or more where their labels are equal and not null and
    they have the same length. A null or zero vector, one with a null, NaN or infinite component and
    one without label link with nothing and are their own component. Equal vectors of a label become
    one class with a number of copies; all copies count as links. A class is compared with those of
    its buckets only, in blocks, so that a bucket of any size spreads over many tasks and no pair is
    ever written: a block returns link counts and a spanning star. Rows with a null vec_id take part
    but name no component and are not kept; repeated vec_ids are separate rows. Other columns are not
    read, whatever their names. An empty table gives an empty result.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("embedding"))
    usable = F.col("label").isNotNull() & _usable(F.col("embedding"))
    grouped = rows.filter(usable).groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = staged(grouped.select(F.monotonically_increasing_id().alias("cid"), F.size("embedding").alias("dim"), "*"))
    signed = classes.select("cid", "dim", "embedding").mapInArrow(_sign(tables, planes), "cid long, sig binary, keys array<int>")
    hashed = staged(classes.join(signed, "cid"))

    bucket = ["label", "dim", "key"]
    keyed = hashed.select("cid", "label", "dim", F.explode("keys").alias("key"))
    shared = keyed.groupBy(*bucket).agg(F.count("*").alias("m")).filter("m > 1")
    shared = staged(shared.withColumn("bid", F.monotonically_increasing_id()))
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    members = (
        keyed.join(shared, bucket)
        .withColumn("blocks", blocks)
        .withColumn("own", F.pmod(F.xxhash64("cid", "bid"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "cid",
            "bid",
            "dim",
            F.least("own", "other").alias("p"),
            F.greatest("own", "other").alias("q"),
            (F.col("own") > F.col("other")).cast("int").alias("side"),
            F.shiftright("key", planes).alias("at"),
        )
    )
    members = staged(members)
    parts = []
    # vectors of different lengths never meet; the number of lengths is that of the models in use
    for dim, n in sorted(map(tuple, members.groupBy("dim").count().collect())):
        bins = shares(n, ROWS_EACH, 8)
        own = members.filter(F.col("dim") == dim).join(hashed.select("cid", "copies", "sig", "embedding"), "cid")
        placed = own.withColumn("bin", F.pmod(F.xxhash64("bid", "p", "q"), F.lit(bins))).repartition(min(bins, 1 << 16), "bin")
        parts.append(placed.groupBy("bin").applyInArrow(_compare(int(dim), tables, threshold), "cid long, n long, root long"))
    empty = hashed.sparkSession.createDataFrame([], "cid long, n long, root long")
    compared = empty
    for part in parts:
        compared = compared.unionByName(part)
    compared = staged(compared)

    counts = compared.groupBy("cid").agg(F.sum("n").alias("n"))
    roots = connected_components(compared, "cid", "root").select(F.col("node").alias("cid"), "root")
    rooted = classes.select("cid", "least", "copies").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(names, "root").join(counts, "cid", "left")
    of = of.select("cid", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    named = classes.select("cid", F.col("label").alias("_l"), F.col("embedding").alias("_e")).join(of, "cid")
    joined = rows.join(named, usable & (F.col("label") == F.col("_l")) & (F.col("embedding") == F.col("_e")), "left")
    component = F.when(F.col("cid").isNotNull(), F.col("component_id")).otherwise(F.col("vec_id"))
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def oracle(vectors: str = "embeddings", threshold: float = THRESHOLD) -> str:
    """The same rows in SQL, by all pairs."""
    return f"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM {vectors}
), u AS MATERIALIZED (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), pr AS MATERIALIZED (
  SELECT a.r AS x, b.r AS y FROM u a JOIN u b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r WHERE list_cosine_similarity(a.e, b.e) >= {threshold}
), cc AS (
  SELECT r, r AS s FROM v UNION SELECT cc.r, pr.y FROM cc JOIN pr ON pr.x = cc.s
), co AS (
  SELECT cc.r, min(w.vec_id) AS component_id FROM cc JOIN v w ON w.r = cc.s GROUP BY cc.r
), ln AS (
  SELECT x AS r, count(*) AS n FROM pr GROUP BY x
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM v JOIN co USING (r) LEFT JOIN ln USING (r)"""
