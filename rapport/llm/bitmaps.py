"""Arrays of fixed size that all tasks fill and that are combined on the cluster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PIECES = 16
SCHEMA = "piece int, counts binary"


def pieces(array: np.ndarray) -> pa.RecordBatch:
    """A task's array as rows, to be combined with those of other tasks."""
    return pa.RecordBatch.from_arrays([pa.array(np.arange(PIECES, dtype=np.int32)), pa.array(
        [part.tobytes() for part in np.split(array, PIECES)], pa.binary())], ["piece", "counts"])


def _merged(combine, kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(counts.as_buffer(), kind)
                total[piece] = combine(total[piece], part) if piece in total else part.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()),
                                          pa.array([v.tobytes() for v in total.values()], pa.binary())], ["piece", "counts"])

    return run


def gathered(rows: DataFrame, combine, kind, size: int) -> np.ndarray:
    """The arrays of all tasks combined. Its size is fixed by the caller; nothing else comes to the driver."""
    out = np.zeros(size, kind)
    step = size // PIECES
    for row in rows.repartition(PIECES, "piece").mapInArrow(_merged(combine, kind), SCHEMA).collect():
        out[row.piece * step:(row.piece + 1) * step] = np.frombuffer(row.counts, kind)
    return out
