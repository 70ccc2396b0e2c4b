"""Best-fit packing of documents into sequences after Martello-Toth dominance reduction.

All lengths are whole numbers up to the sequence length, so an instance of any size is its histogram
of at most that many counts. Reduction and best fit run on this histogram, with repeated choices taken
at once; what they return are kinds of sequences with their number. The pieces are then placed by
their position among the pieces of their length, in parallel.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import staged
from tracewell.llm.tokens import byte_bpe

SEQUENCE = 1024
END_ID = 2

Kind = tuple[tuple[int, ...], int]


def _fixed(j: int, counts: dict[int, int], capacity: int) -> tuple[int, ...] | None:
    """A set with an item of size ``j`` that dominates all others with it, if the criterion finds one.

    Sizes are looked at in order; at most three of the smallest decide how many items fit beside j.
    """
    others = {s: n - (s == j) for s, n in counts.items() if n > (s == j)}
    room = capacity - j
    small: list[int] = []
    for s in sorted(others):
        small += [s] * min(3 - len(small), others[s])
        if len(small) == 3:
            break
    fits = [s for s in others if s <= room]
    if not fits:
        return (j,)
    best = max(fits)
    if best == room or len(small) < 2 or small[0] + small[1] > room:
        return (j, best)
    if len(small) == 3 and sum(small) <= room:
        return None
    # at most two items fit beside j: the fullest pair
    sizes, pair = sorted(fits), (0, 0)
    low, high = 0, len(sizes) - 1
    while low <= high:
        a, b = sizes[high], sizes[low]
        if a + b > room or (low == high and others[a] < 2):
            high -= 1
            continue
        if a + b > sum(pair):
            pair = (a, b)
        low += 1
    a, b = pair
    if best >= a + b:
        return (j, best)
    if best == a:
        between = sorted(s for s in others if b < s <= a for _ in range(min(2, others[s] - (s == a))))
        if len(between) < 2 or between[0] + between[1] > room:
            return (j, a, b)
    return None


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[Kind], dict[int, int]]:
    """(fixed kinds of sequences, counts that remain) by the dominance criterion, until it finds no more."""
    counts = {s: n for s, n in counts.items() if n}
    kinds: list[Kind] = []
    changed = True
    while changed:
        changed = False
        for j in sorted(counts, reverse=True):
            while counts.get(j):
                found = _fixed(j, counts, capacity)
                if found is None:
                    break
                # the choice stays the same while all its sizes last
                times = min(counts[s] // found.count(s) for s in set(found))
                for s in found:
                    counts[s] -= times
                counts = {s: n for s, n in counts.items() if n}
                kinds.append((found, times))
                changed = True
    return kinds, counts


def best_fit(counts: dict[int, int], capacity: int) -> list[Kind]:
    """Best fit by decreasing size: each item goes where it leaves the least room, else into a new sequence."""
    open_: dict[int, list[list]] = {}
    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            room = min((r for r in open_ if r >= size), default=None)
            if room is None:
                room = capacity
                open_[room] = [[(), n]]
            kinds = open_[room]
            items, times = kinds.pop()
            if not kinds:
                del open_[room]
            # an item leaves less room than any other sequence has, so the next one follows it
            each = room // size
            full = min(times, n // each)
            if full:
                open_.setdefault(room - each * size, []).append([items + (size,) * each, full])
                n -= full * each
            if full < times:
                rest = times - full
                if n:
                    open_.setdefault(room - n * size, []).append([items + (size,) * n, 1])
                    rest, n = rest - 1, 0
                if rest and items:
                    open_.setdefault(room, []).append([items, rest])
    return [(items, times) for kinds in open_.values() for items, times in kinds if items]


def plan(counts: dict[int, int], capacity: int = SEQUENCE) -> list[Kind]:
    """Kinds of sequences for a histogram of lengths from 1 to ``capacity``."""
    fixed, rest = reduce_instance(counts, capacity)
    return fixed + best_fit(rest, capacity)


class Slots:
    """Place of the n-th piece of a length: runs of equal sizes inside kinds, in order."""

    def __init__(self, kinds: Sequence[Kind]):
        rows, used, base = [], {}, 0
        for items, times in kinds:
            offset = 0
            for size, run in groupby(sorted(items, reverse=True)):
                each = len(list(run))
                rows.append((size, used.get(size, 0), base, offset, each))
                used[size] = used.get(size, 0) + times * each
                offset += each * size
            base += times
        rows.sort()
        table = np.array(rows, np.int64).reshape(-1, 5)
        self.size, self.first, self.base, self.offset, self.each = table.T
        self.key = self.size << 48 | self.first

    def place(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, size << 48 | rank, "right") - 1
        turn = rank - self.first[at]
        return self.base[at] + turn // self.each[at], self.offset[at] + turn % self.each[at] * size


def _cut(sequence: int, end_id: int, paths: tuple, with_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(*paths)
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        seen = np.zeros(sequence + 1, np.int64)
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            # one text at a time: a batch of long ones is never held as Python strings
            for doc_id, text in zip(ids, batch.column(1)):
                tokens = np.append(encode(text.as_py() or ""), np.uint32(end_id))
                first = len(tokens) % sequence or sequence
                start = 0
                for piece, end in enumerate(range(first, len(tokens) + 1, sequence)):
                    raw = tokens[start:end].astype("<u4")
                    rows.append((doc_id, piece, start, end - start, zlib.crc32(raw.tobytes()), part, int(seen[end - start]), raw.astype(np.int32) if with_ids else None))
                    seen[end - start] += 1
                    start = end
            columns = list(zip(*rows)) if rows else [[]] * 8
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", "ids"])

    return cut


def _placed(slots: Slots):
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = slots.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            kept = batch.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence), pa.array(offset)], names=[*kept.schema.names, "sequence_id", "offset"])

    return placed


def pack(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    sequence: int = SEQUENCE,
    end_id: int = END_ID,
    tokenizer: str | None = None,
    ranks: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """Place of every piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A document is its ids and ``end_id``; one longer than ``sequence`` is cut into pieces of that
    length, the first one shorter where it does not divide. A null or empty text is ``end_id`` alone.
    Repeated rows are packed as often as they occur, a null doc_id like any other. Other columns are
    not read, whatever their names. The driver sees the histogram of lengths, of ``sequence`` counts
    at most, whatever the number of documents. An empty table gives an empty result.
    """
    cut = _cut(sequence, end_id, (tokenizer, ranks), with_ids)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long, ids array<int>"
    pieces = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, schema)
    pieces = staged(pieces if with_ids else pieces.drop("ids"))
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    slots = Slots(plan(dict(map(tuple, by_part.groupBy("length").agg(F.sum("n")).collect())), sequence))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_part.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    numbered = pieces.join(before, ["length", "part"]).select(*columns, (F.col("before") + F.col("nth")).alias("rank"))
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.drop("rank").schema)
    return numbered.mapInArrow(_placed(slots), out + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) from the result of ``pack(..., with_ids=True)``: whole sequences, ready to write."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
