"""Dominator tree of one small flow graph, for use inside a grouped task.

The module is pickled by value, so executors need no installed copy of the package.
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle


def tree_of_one_function(pdf: pd.DataFrame) -> pd.DataFrame:
    """Immediate dominators of one small flow graph, by the iterative nearest-common-dominator rule."""
    fn, root = pdf["fn"].iloc[0], pdf["root"].iloc[0]
    after, before = {}, {}
    for a, b in zip(pdf["source"], pdf["target"]):
        after.setdefault(a, []).append(b)
        before.setdefault(b, []).append(a)
    order, seen, stack = [], {root}, [(root, iter(after.get(root, ())))]
    while stack:
        node, rest = stack[-1]
        child = next((c for c in rest if c not in seen), None)
        if child is None:
            order.append(node)
            stack.pop()
        else:
            seen.add(child)
            stack.append((child, iter(after.get(child, ()))))
    rank = {node: i for i, node in enumerate(order)}
    parent = {root: root}
    changed = True
    while changed:
        changed = False
        for node in reversed(order):
            if node == root:
                continue
            best = None
            for p in before.get(node, ()):
                if p not in parent:
                    continue
                if best is None:
                    best = p
                    continue
                a, b = p, best
                while a != b:
                    if rank[a] < rank[b]:
                        a = parent[a]
                    else:
                        b = parent[b]
                best = a
            if parent.get(node) != best:
                parent[node], changed = best, True
    rows = [(fn, n, p) for n, p in parent.items() if n != root]
    return pd.DataFrame(rows, columns=["fn", "node", "idom"])


cloudpickle.register_pickle_by_value(sys.modules[__name__])
