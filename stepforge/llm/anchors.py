"""Anchors: which hashed values occur more than once in a corpus, as a filter of fixed size.

Each task sorts its values and sends them, cut by their upper bits, as packed arrays (8 bytes a value, at most two
copies of each a task); a slice's task finds the values seen twice and sets their bits. The assembled bit table has
a fixed size whatever the corpus, is broadcast, and only ever lets too many values through, never too few.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

#: log2 of the bits in the table (32 MB), and the values that a task gathers before it sends them.
TABLE_BITS, FLUSH = 28, 2_000_000
#: Input bytes for each slice (a slice's task sorts about a tenth of that), and bounds of log2 of their number.
SLICE_BYTES, LEAST_BITS, MOST_BITS = 2 << 20, 6, 20


def hits(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value's bit is set."""
    at = values >> np.uint64(64 - TABLE_BITS)
    return (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def slice_bits(df: DataFrame) -> int:
    """log2 of the number of slices, from the plan's estimate of its input size."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(MOST_BITS, max(LEAST_BITS, (size // SLICE_BYTES).bit_length()))


def repeated(df: DataFrame, extract: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> np.ndarray:
    """The bit table of the values that extract yields at least twice over all batches of df."""

    bits_of_slice = slice_bits(df)

    def send(parts: list[np.ndarray]) -> pa.RecordBatch:
        values = np.sort(np.concatenate(parts))
        if len(values) > 2:
            third = np.zeros(len(values), bool)
            third[2:] = values[2:] == values[:-2]
            values = values[~third]
        cuts = np.searchsorted(values, np.arange(1 << bits_of_slice, dtype=np.uint64) << np.uint64(64 - bits_of_slice))
        chunks = np.split(values, cuts[1:])
        keep = [(k, c.tobytes()) for k, c in enumerate(chunks) if len(c)]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in keep], pa.int32()), pa.array([c for _, c in keep], pa.binary())], names=["slice", "packed"])

    def gather(batches):
        parts, size = [], 0
        for batch in batches:
            for values in extract(batch):
                parts.append(values)
                size += len(values)
                if size >= FLUSH:
                    yield send(parts)
                    parts, size = [], 0
        if size:
            yield send(parts)

    segment = 1 << (TABLE_BITS - bits_of_slice)

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        values = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["packed"]]))
        twice = values[1:][values[1:] == values[:-1]]
        bits = np.zeros(segment, np.uint8)
        bits[((twice >> np.uint64(64 - TABLE_BITS)) & np.uint64(segment - 1)).astype(np.int64)] = 1
        return pd.DataFrame([{"slice": int(pdf["slice"].iloc[0]), "bits": np.packbits(bits, bitorder="little").tobytes()}])

    table = np.zeros(1 << (TABLE_BITS - 3), np.uint8)
    width = segment >> 3
    for row in df.mapInArrow(gather, "slice int, packed binary").groupBy("slice").applyInPandas(mark, "slice int, bits binary").toLocalIterator():
        table[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
    return table
