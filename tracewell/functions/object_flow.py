"""Objects that the names of one small function may refer to, for use inside a grouped task.

The module is pickled by value, so executors need no installed copy of the package.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import pyarrow as pa
from pyspark import cloudpickle

EDGE, ALLOC, COPY, STORE, LOAD, STOP = range(6)
COLUMNS = ("row", "a", "b", "name", "other", "field", "flag")


def _spread(known: dict, todo: dict, after: Callable) -> None:
    """Adds the bits of ``todo`` to ``known`` and hands new ones on to ``after(key, bits)`` until none is new."""
    while todo:
        key = next(iter(todo))
        fresh = todo.pop(key) & ~known.get(key, 0)
        if fresh:
            known[key] = known.get(key, 0) | fresh
            for target, bits in after(key, fresh):
                todo[target] = todo.get(target, 0) | bits


def _each(bits: int):
    while bits:
        yield (bits & -bits).bit_length() - 1
        bits &= bits - 1


def references_of_one_function(table: pa.Table, max_entries: int | None, max_aliases: int | None) -> pa.Table:
    """(fn, at, name, alloc, given_up) rows of one function from its rows (fn, row, a, b, name, other, field, flag), by a work list over bit sets of objects."""
    kinds: list[list] = [[] for _ in range(6)]
    for row, *rest in set(zip(*[table[c].to_pylist() for c in COLUMNS])):
        kinds[row].append(rest)
    to, kills, moves, stops = {}, {}, {}, {}
    for a, b, *_ in kinds[EDGE]:
        to.setdefault(a, []).append(b)
    for a, _, name, _, _, flag in kinds[ALLOC] + kinds[COPY] + kinds[LOAD]:
        if flag:
            kills.setdefault(a, set()).add(name)
    for a, _, dst, src, _, _ in kinds[COPY]:
        moves.setdefault((a, src), set()).add(dst)
    objects = ["unknown", *{r[3] for r in kinds[ALLOC]} - {"unknown"}]
    number = {o: i for i, o in enumerate(objects)}
    for a, _, _, alloc, _, _ in kinds[STOP]:
        ended = ~1 if alloc == "*" else 1 << number[alloc] & ~1 if alloc in number else 0
        stops[a] = stops.get(a, 0) | ended

    def moved(key, bits):
        at, name = key
        names = moves.get(key, set()) | (set() if name in kills.get(at, ()) else {name})
        return [((target, n), bits) for target in to.get(at, ()) for n in names]

    def step(key, bits):
        return moved(key, bits & ~stops.get(key[0], 0) | (1 if bits & stops.get(key[0], 0) else 0))

    # an allocation inside a cycle may be any of several
    around, todo = {}, {}
    places = {a: i for i, a in enumerate({r[0] for r in kinds[ALLOC]})}
    for a, i in places.items():
        for target in to.get(a, ()):
            todo[target] = todo.get(target, 0) | 1 << i
    _spread(around, todo, lambda at, bits: [(target, bits) for target in to.get(at, ())])
    todo = {}
    for a, _, name, alloc, _, _ in kinds[ALLOC]:
        born = 1 << number[alloc] | (around.get(a, 0) >> places[a] & 1)
        for target in to.get(a, ()):
            todo[target, name] = todo.get((target, name), 0) | born
    states, heap = {}, {}
    while todo:
        _spread(states, todo, step)
        for a, _, base, value, field, _ in kinds[STORE]:
            for cell in _each(states.get((a, base), 0)):
                heap[cell, field] = heap.get((cell, field), 0) | states.get((a, value), 0)
        for a, _, dst, base, field, _ in kinds[LOAD]:
            bits = 0
            for cell in _each(states.get((a, base), 0)):
                bits |= heap.get((cell, field), 0)
            for target in to.get(a, ()):
                if bits & ~states.get((target, dst), 0):
                    todo[target, dst] = todo.get((target, dst), 0) | bits
    over = max_entries is not None and sum(bits.bit_count() for bits in states.values()) > max_entries
    if max_aliases is not None and not over:
        passed, todo = {}, {}
        aliases = {a: i for i, a in enumerate({r[0] for r in kinds[COPY]})}
        for a, _, dst, _, _, _ in kinds[COPY]:
            for target in to.get(a, ()):
                todo[target, dst] = todo.get((target, dst), 0) | 1 << aliases[a]
        _spread(passed, todo, moved)
        over = any(bits.bit_count() > max_aliases for key, bits in passed.items() if states.get(key))
    out = [(None, None, None)] if over else [(at, name, objects[i]) for (at, name), bits in states.items() for i in _each(bits)]
    at, name, alloc = zip(*out) if out else ((),) * 3
    schema = table.schema
    return pa.table({
        "fn": pa.array([table["fn"][0].as_py()] * len(out), schema.field("fn").type), "at": pa.array(at, schema.field("b").type),
        "name": pa.array(name, pa.string()), "alloc": pa.array(alloc, pa.string()), "given_up": pa.array([over] * len(out), pa.bool_()),
    })


def within(max_entries: int | None, max_aliases: int | None) -> Callable[[pa.Table], pa.Table]:
    """The same as a function of the rows alone."""
    def solve(table):
        return references_of_one_function(table, max_entries, max_aliases)

    return solve


cloudpickle.register_pickle_by_value(sys.modules[__name__])
