"""SimHash near duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import let, lower_ascii, shares, staged, words
from tracewell.llm.components import connected_components

BITS = 64
RADIUS = 3
# variants that one task holds and sorts at a time
VARIANTS_EACH = 1 << 21
_MEAN_VARIANTS = 1073


def shingle_hashes(text: Column, size: int = 3) -> Column:
    """XXH64 (seed 42) of every word shingle, repeats included; a shorter text is one shingle, an empty one none."""

    def of(w: Column) -> Column:
        rows = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(F.concat_ws(" ", *[w[i + k] for k in range(size)])))
        whole = F.array(F.xxhash64(F.array_join(w, " ")))
        return F.when(F.size(w) >= size, rows).when(F.size(w) > 0, whole).otherwise(F.array().cast("array<bigint>"))

    return let(words(lower_ascii(text)), of)


def _majorities(batches: Iterator[pa.RecordBatch], chunk: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """(id, list of hashes) to (id, fingerprint); at most ``chunk`` hashes are unpacked at once."""
    for batch in batches:
        lists = batch.column(1)
        flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        owner_start = ends - sizes
        counts = np.zeros((len(sizes), BITS), np.int64)
        for low in range(0, len(flat), chunk):
            part = flat[low : low + chunk]
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            first = int(np.searchsorted(ends, low, "right"))
            last = int(np.searchsorted(owner_start, low + len(part), "left"))
            own = np.arange(first, last)[sizes[first:last] > 0]
            starts = np.maximum(owner_start[own] - low, 0)
            counts[own] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        marks = (2 * counts > sizes[:, None]).astype(np.uint8)
        prints = np.packbits(marks, axis=1, bitorder="little").view(np.int64).ravel()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): a bit is 1 where over half of the shingle hashes have it; no words: zero."""
    hashed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), shingle_hashes(F.col(text)).alias("h"))
    return hashed.mapInArrow(_majorities, "doc_id long, fp long")


def _parity(values: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values) & 1


class Balls:
    """The variants of a fingerprint and the partition each of them belongs to.

    Two fingerprints of odd distance differ in parity. So one of even parity takes all variants
    within two flips and one of odd parity all within one, half the radius on average: any two within
    three bits of each other then share a variant. The partition of a variant is linear over XOR,
    which lets all variants of a fingerprint for one partition travel as that fingerprint alone.
    """

    def __init__(self, bits: int, seed: int = 7):
        self.bits = bits
        codes = np.random.default_rng(seed).integers(0, 1 << bits, size=(BITS,), dtype=np.uint64)
        self.lookup = np.zeros((8, 256), np.uint64)
        for byte in range(8):
            for value in range(256):
                for bit in range(8):
                    if value >> bit & 1:
                        self.lookup[byte, value] ^= codes[8 * byte + bit]
        one = [1 << i for i in range(BITS)]
        near = np.array([0, *one], np.uint64)
        far = np.concatenate([near, np.array([one[i] | one[j] for i, j in combinations(range(BITS), 2)], np.uint64)])
        self.masks, self.codes = {}, {}
        for parity, masks in ((1, near), (0, far)):
            code = self.partition(masks)
            order = np.argsort(code, kind="stable")
            self.masks[parity] = masks[order]
            self.codes[parity] = code[order]

    def partition(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values), np.uint64)
        for byte in range(8):
            out ^= self.lookup[byte, (values >> np.uint64(8 * byte)) & np.uint64(255)]
        return out

    def targets(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(partition, fingerprint) for every partition that holds a variant of the fingerprint."""
        places, owners = [], []
        for parity in (0, 1):
            own = prints[_parity(prints) == parity]
            codes = np.unique(self.codes[parity])
            places.append((self.partition(own)[:, None] ^ codes[None, :]).ravel())
            owners.append(np.repeat(own, len(codes)))
        return np.concatenate(places), np.concatenate(owners)

    def variants(self, prints: np.ndarray, place: int) -> tuple[np.ndarray, np.ndarray]:
        """(variant, fingerprint) of all variants that belong to ``place``."""
        found, owners = [], []
        for parity in (0, 1):
            own = prints[_parity(prints) == parity]
            wanted = self.partition(own) ^ np.uint64(place)
            low = np.searchsorted(self.codes[parity], wanted, "left")
            many = np.searchsorted(self.codes[parity], wanted, "right") - low
            whose = np.repeat(np.arange(len(own)), many)
            at = np.arange(len(whose)) - np.repeat(np.cumsum(many) - many, many) + low[whose]
            owners.append(own[whose])
            found.append(owners[-1] ^ self.masks[parity][at])
        return np.concatenate(found), np.concatenate(owners)


@lru_cache(maxsize=2)
def balls_of(bits: int) -> Balls:
    return Balls(bits)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node index reachable from each of ``n`` nodes over the edges ``a``-``b``."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            return root
        low = np.minimum(ra, rb)
        np.minimum.at(root, np.maximum(ra, rb), low)
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped


def colliding(balls: Balls, prints: np.ndarray, place: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Verified links found in one partition of the variant space, as stars.

    All members of a variant are compared with the one that needed the fewest flips. Where that took
    two flips all members did, their distances are even and at most four, and those at distance two
    meet again at one flip each; so no pair is lost and no pair within a group is listed.
    """
    variant, owner = balls.variants(np.unique(prints), place)
    flips = np.bitwise_count(variant ^ owner).astype(np.uint8)
    order = np.lexsort((flips, variant))
    variant, owner, flips = variant[order], owner[order], flips[order]
    fresh = np.ones(len(variant), bool)
    fresh[1:] = variant[1:] != variant[:-1]
    first = np.flatnonzero(fresh)[np.cumsum(fresh) - 1] if len(variant) else np.zeros(0, int)
    hub = owner[first]
    near = ~fresh & (flips[first] < 2)
    near &= np.bitwise_count(owner ^ hub) <= radius
    nodes, index = np.unique(np.concatenate([owner[near], hub[near]]), return_inverse=True)
    half = len(index) // 2
    root = local_roots(len(nodes), index[:half], index[half:])
    linked = root != np.arange(len(nodes))
    return nodes[linked], nodes[root[linked]]


def _deal(bits: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = balls_of(bits)
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for low in range(0, len(prints), 1024):
                places, owners = balls.targets(prints[low : low + 1024])
                order = np.argsort(places, kind="stable")
                places, owners = places[order], owners[order]
                starts = np.flatnonzero(np.r_[True, places[1:] != places[:-1]])
                ends = np.r_[starts[1:], len(places)]
                raw = owners.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(places[starts].astype(np.int64)), pa.array([raw[8 * s : 8 * e] for s, e in zip(starts, ends)], pa.binary())],
                    names=["place", "prints"],
                )

    return deal


def _meet(bits: int, radius: int):
    def meet(key: tuple, rows: pa.Table) -> pa.Table:
        prints = np.frombuffer(b"".join(rows.column("prints").to_pylist()), np.uint64)
        a, b = colliding(balls_of(bits), prints, key[0].as_py(), radius)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return meet


def links(prints: DataFrame, fp: str = "fp", n_rows: int | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints at three or fewer differing bits.

    They connect the same fingerprints as all such pairs do; their number grows with the variants.
    """
    distinct = prints.select(F.col(fp).alias("fp")).filter("fp is not null").distinct()
    n_rows = distinct.count() if n_rows is None else n_rows
    bits = max(6, (shares(n_rows * _MEAN_VARIANTS, VARIANTS_EACH) - 1).bit_length())
    dealt = distinct.mapInArrow(_deal(bits), "place long, prints binary")
    grouped = dealt.repartition(min(1 << bits, 1 << 16), "place").groupBy("place")
    return grouped.applyInArrow(_meet(bits, RADIUS), "a long, b long")


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id, kept), one row per row of ``docs``.

    Fingerprints link at three or fewer differing bits; ``component_id`` is the smallest doc_id
    reachable, ``kept`` marks the document that stays. Null and blank texts have fingerprint zero
    and link like any other. Rows with a null doc_id take part in links, but name no component: a
    component of such rows alone has a null id and keeps none. Repeated rows share a component; each
    repetition of its smallest doc_id counts as kept. Other columns are not read, whatever their names.
    """
    prints = staged(fingerprints(docs, doc_id, text))
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    n_rows = distinct.count()
    roots = connected_components(links(distinct, n_rows=n_rows))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.select("fp", "root").join(names, "root").select("fp", "component_id")
    joined = prints.join(of, "fp")
    return joined.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )
