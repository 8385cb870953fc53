"""Counting tables of fixed size over all rows of a table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def tally(df: DataFrame, size: int, add) -> np.ndarray:
    """A table of ``size`` counters: every task adds its rows to one of its own by ``add(table, batch)``, and all are summed.

    What moves are the counters in use, in pieces; what comes to the driver is one table of fixed size.
    """
    part = min(size, 1 << 16)
    schema = pa.schema([("at", pa.int32()), ("slots", pa.binary()), ("counts", pa.binary())])

    def pieces(table):
        for at in range(0, size, part):
            piece = table[at : at + part]
            used = np.flatnonzero(piece)
            if len(used):
                yield pa.RecordBatch.from_arrays([pa.array([at], type=pa.int32()), pa.array([used.astype(np.uint16).tobytes()], type=pa.binary()), pa.array([piece[used].tobytes()], type=pa.binary())], schema=schema)

    def count(batches):
        table = np.zeros(size, dtype=np.int64)
        for b in batches:
            add(table, b)
        yield from pieces(table)

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for at, slots, counts in zip(*(b.column(k).to_pylist() for k in range(3))):
                piece = sums.setdefault(at, np.zeros(part, dtype=np.int64))
                piece[np.frombuffer(slots, dtype=np.uint16)] += np.frombuffer(counts, dtype=np.int64)
        for at, piece in sums.items():
            used = np.flatnonzero(piece)
            yield pa.RecordBatch.from_arrays([pa.array([at], type=pa.int32()), pa.array([used.astype(np.uint16).tobytes()], type=pa.binary()), pa.array([piece[used].tobytes()], type=pa.binary())], schema=schema)

    out = np.zeros(size, dtype=np.int64)
    shape = "at int, slots binary, counts binary"
    for r in df.mapInArrow(count, shape).repartition("at").mapInArrow(merge, shape).toLocalIterator():
        out[r["at"] + np.frombuffer(bytes(r["slots"]), dtype=np.uint16).astype(np.int64)] += np.frombuffer(bytes(r["counts"]), dtype=np.int64)
    return out
