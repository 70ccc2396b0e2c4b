"""Definitions that reach the uses of one small function, for use inside a grouped task.

The module is pickled by value, so executors need no installed copy of the package.
"""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle

EDGE, DEFINITION, USE = 0, 1, 2


def uses_of_one_function(table: pa.Table) -> pa.Table:
    """Def-use rows of one function from its rows (fn, row, a, b, var, flag), by a work list over bit sets of definitions."""
    rows = set(zip(*[table[c].to_pylist() for c in ("row", "a", "b", "var", "flag")]))
    definitions = [(a, var, flag) for row, a, _, var, flag in rows if row == DEFINITION]
    made, of_name, ended, after = {}, {}, {}, {}
    for i, (node, var, _) in enumerate(definitions):
        made[node] = made.get(node, 0) | 1 << i
        of_name[var] = of_name.get(var, 0) | 1 << i
    for node, var, certain in definitions:
        if certain:
            for name, bits in of_name.items():
                if name == var or name.startswith((f"{var}.", f"{var}[")):
                    ended[node] = ended.get(node, 0) | bits
    for row, a, b, _, flag in rows:
        if row == EDGE:
            after.setdefault(a, []).append((b, flag))
    before, todo = {}, dict.fromkeys(made)
    while todo:
        node = next(iter(todo))
        del todo[node]
        came = before.get(node, 0)
        left = came & ~ended.get(node, 0) | made.get(node, 0)
        for target, before_write in after.get(node, ()):
            known = before.get(target, 0)
            more = known | (came if before_write else left)
            if more != known:
                before[target] = more
                todo[target] = None
    out = []
    for row, node, _, var, _ in rows:
        bits = before.get(node, 0) & of_name.get(var, 0) if row == USE else 0
        alone = bits & (bits - 1) == 0
        while bits:
            source, _, certain = definitions[(bits & -bits).bit_length() - 1]
            out.append((source, node, var, "must" if alone and certain else "may"))
            bits &= bits - 1
    source, target, var, certainty = zip(*out) if out else ((),) * 4
    fn = pa.array([table["fn"][0].as_py()] * len(out), table.schema.field("fn").type)
    node = table.schema.field("a").type
    return pa.table({"fn": fn, "source": pa.array(source, node), "target": pa.array(target, node), "var": pa.array(var, pa.string()), "certainty": pa.array(certainty, pa.string())})


cloudpickle.register_pickle_by_value(sys.modules[__name__])
