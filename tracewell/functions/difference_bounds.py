"""Feasibility of many short paths at once from their terms, for use inside Arrow batches.

Every comparison is one or two bounds i - j <= w, with a name for zero. The bounds of all paths of a
batch with equally many names are closed together, as one array of matrices. The module is pickled by
value, so executors need no installed copy of the package.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

OPS = ("<", "<=", ">", ">=", "==", "!=", "eq_text", "ne_text")
BARRED, EQ_TEXT, NE_TEXT, UNSUPPORTED, NO_OP = 5, 6, 7, 8, 9
SATISFIABLE, INFEASIBLE, UNKNOWN, ABSENT, BEYOND = 0, 1, 2, 3, -1
# sums of bounds up to this one stay whole in a double
LARGEST = 2**40


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, length) of each run of equal rows."""
    change = np.zeros(len(keys[0]), bool)
    change[:1] = True
    for key in keys:
        change[1:] |= key[1:] != key[:-1]
    first = np.flatnonzero(change)
    return first, np.diff(np.append(first, len(change)))


def _counted(*keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows in order, with how often each comes."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    first, length = _runs(*keys)
    return [k[first] for k in keys], length


def _numbers(path: np.ndarray, linked: np.ndarray, op: np.ndarray, x: np.ndarray, y: np.ndarray, c: np.ndarray, names: int, local_names: int, flags: np.ndarray) -> None:
    """Marks in ``flags`` (bad, open, beyond per path) what the comparisons of whole numbers say; names are numbers below ``names``, the last is zero."""
    # without a comparison of two names, each name of a path stands for itself
    unit, row = np.unique(path * (names + 1) + np.where(linked[path], 0, x + 1), return_inverse=True)
    at = unit // (names + 1)
    own, place = np.unique(np.concatenate([row * names + x, row * names + y]), return_inverse=True)
    first, n = _runs(own // names)
    place = place - first[np.concatenate([row, row])]
    i, j = place[: len(row)], place[len(row):]
    beyond = linked[at] & (n > local_names)
    beyond[row[(c > LARGEST) | (c < -LARGEST)]] = True
    flags[2][at[beyond]] = True
    for size in np.unique(n[~beyond]):
        chosen = np.flatnonzero(~beyond & (n == size))
        index = np.full(len(n), -1)
        index[chosen] = np.arange(len(chosen))
        here = index[row] >= 0
        b, o, i1, j1, w = index[row[here]], op[here], i[here], j[here], c[here]
        up, down = o != BARRED, o != BARRED
        up &= (o == 0) | (o == 1) | (o == 4)
        down &= (o == 2) | (o == 3) | (o == 4)
        closed = np.full((len(chosen), size, size), np.inf)
        closed[:, np.arange(size), np.arange(size)] = 0
        cells = closed.reshape(-1)
        np.minimum.at(cells, ((b * size + i1) * size + j1)[up], (w - (o == 0))[up].astype(float))
        np.minimum.at(cells, ((b * size + j1) * size + i1)[down], (-w - (o == 2))[down].astype(float))
        for k in range(size):
            np.minimum(closed, closed[:, :, k, None] + closed[:, None, k, :], out=closed)
        flags[0][at[chosen[(closed[:, np.arange(size), np.arange(size)] < 0).any(1)]]] = True
        barred = o == BARRED
        if not barred.any():
            continue
        # x - y must not be c; each pair once, with the range that the bounds leave to it
        b, i1, j1, w = b[barred], i1[barred], j1[barred], w[barred]
        (b, i1, j1, w), _ = _counted(b, np.minimum(i1, j1), np.maximum(i1, j1), np.where(i1 > j1, -w, w))
        high, low = closed[b, i1, j1], -closed[b, j1, i1]
        inside = (w <= high) & (w >= low)
        if not inside.any():
            continue
        (b, i1, j1), holes = _counted(b[inside], i1[inside], j1[inside])
        flags[0][at[chosen[b[holes >= closed[b, i1, j1] + closed[b, j1, i1] + 1]]]] = True
        several = chosen[np.bincount(b, minlength=len(chosen)) > 1]
        flags[1][at[several]] |= linked[at[several]]


def _texts(path: np.ndarray, op: np.ndarray, x: np.ndarray, named: np.ndarray, text: np.ndarray, texts: int, names: int, bad: np.ndarray) -> None:
    """Marks paths where a name equals two texts, or one that it must not equal."""
    key, of_name = (path * names + x) * texts + text, path * names + x
    equal = np.unique(key[op == EQ_TEXT])
    first, length = _runs(equal // texts)
    bad[(equal[first] // texts)[length > 1] // names] = True
    clash = (op == NE_TEXT) & named & np.isin(key, equal)
    bad[of_name[clash] // names] = True


def _status(table: pa.Table, path: np.ndarray, paths: int, chosen: np.ndarray, local_names: int) -> np.ndarray:
    """Status number of each path by the ``chosen`` terms."""
    column = lambda name: table[name].chunk(0) if table[name].num_chunks == 1 else pa.concat_arrays(table[name].chunks)
    op, var, other, value, text = (column(c) for c in ("op", "var", "other", "value", "text"))
    missing = lambda a: a.is_null().to_numpy(zero_copy_only=False)
    coded = pa.concat_arrays([var, other]).dictionary_encode()
    nameless = len(coded.dictionary)
    names = nameless + 2  # a name that is null is one name, a missing other is zero
    code, rows = coded.indices.fill_null(nameless).to_numpy().astype(np.int64), len(var)
    x, y, no_other = code[:rows], code[rows:].copy(), missing(other)
    y[no_other] = nameless + 1
    op, no_value, c = op.to_numpy(), missing(value), value.fill_null(0).to_numpy()
    linked = np.zeros(paths, bool)
    linked[path[chosen & ~no_other]] = True
    flags = np.zeros((3, paths), bool)
    at = chosen & (op <= BARRED) & (linked[path] | ~no_value)
    if at.any():
        _numbers(path[at], linked, op[at], x[at], y[at], c[at], names, local_names, flags)
    at = chosen & (op >= EQ_TEXT) & (op <= NE_TEXT) & ~missing(text)
    if at.any():
        words = text.dictionary_encode()
        _texts(path[at], op[at], x[at], ~missing(var)[at], words.indices.fill_null(0).to_numpy().astype(np.int64)[at], len(words.dictionary), names, flags[0])
    flags[1][path[chosen & (op == UNSUPPORTED)]] = True
    present = np.zeros(paths, bool)
    present[path[chosen]] = True
    return np.select([~present, flags[2], flags[0], flags[1]], [ABSENT, BEYOND, INFEASIBLE, UNKNOWN], SATISFIABLE).astype(np.int8)


def decider(local_names: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Function from terms (path, asked, op, var, other, value, text) in order of their path to (path, reach, counter).

    ``reach`` is decided by the terms that are not asked for, ``counter`` by all of them, where some are.
    """

    def solved(table: pa.Table, first: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
        path, paths = np.repeat(np.arange(len(first)), length), len(first)
        asked = table["asked"].to_numpy()
        reach, counter = _status(table, path, paths, ~asked, local_names), np.full(paths, ABSENT, np.int8)
        if asked.any():
            some = np.zeros(paths, bool)
            some[path[asked]] = True
            counter = np.where(some, _status(table, path, paths, some[path], local_names), counter)
        return pa.RecordBatch.from_arrays([pa.concat_arrays(table["path"].chunks).take(pa.array(first)), pa.array(reach), pa.array(counter)], ["path", "reach", "counter"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            path = pa.concat_arrays(table["path"].chunks)
            change = np.append(True, pc.not_equal(path[1:], path[:-1]).to_numpy(zero_copy_only=False))
            first = np.flatnonzero(change)
            # the last path may go on in the next batch
            if len(first) > 1:
                yield solved(table.slice(0, first[-1]), first[:-1], np.diff(first))
            held = table.slice(first[-1])
        if held is not None:
            yield solved(held, np.array([0]), np.array([held.num_rows]))

    return run


cloudpickle.register_pickle_by_value(sys.modules[__name__])
