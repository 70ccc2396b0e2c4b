"""Runs of equal keys in the sorted rows of one partition, for use inside Arrow batches.

The module is pickled by value, so executors need no installed copy of the package.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle


def heads(keys: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Function that adds ``_head``: the place in the partition of the first row with the same keys, none of them null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, head, last = 0, 0, None
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            change = np.zeros(rows, bool)
            change[0] = last is not None and last != [batch[k][0].as_py() for k in keys]
            for k in keys:
                change[1:] |= pc.not_equal(batch[k][1:], batch[k][:-1]).to_numpy(zero_copy_only=False)
            place = np.maximum.accumulate(np.where(change, np.arange(start, start + rows), head))
            start, head, last = start + rows, int(place[-1]), [batch[k][rows - 1].as_py() for k in keys]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], [*batch.schema.names, "_head"])

    return run


cloudpickle.register_pickle_by_value(sys.modules[__name__])
