"""A bitmap of 64-bit keys, of fixed size, folded on the cluster.

It answers "may be there": a key that was put in is always found, so workers can use it
to leave out rows before a join, which stays exact. A full bitmap leaves out nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftpanel.llm import textscan as ts

BITS = 24  # 2 MB
PIECE = 21  # bits of a large bitmap that are folded together: 256 KB
TOGETHER = 1 << 20  # keys a task gathers before it sends their places on
U = np.uint64


def bitmap(keys: DataFrame, column: str, size: int = BITS) -> np.ndarray:
    """At most 2^(size - 6) words come to the driver."""
    low = F.col(column).bitwiseAND((1 << size) - 1)
    words = (keys.groupBy(F.shiftright(low, 6).cast("int").alias("word"))
             .agg(F.bit_or(F.expr(f"shiftleft(1L, cast({column} & 63 as int))")).alias("bits")).toArrow())
    out = np.zeros(1 << (size - 6), np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint8)


def places(size: int) -> Callable:
    """The bits of a task's keys, as arrays by piece of the bitmap."""

    def sent(found: list[np.ndarray]) -> pa.RecordBatch:
        bit = np.sort((np.concatenate(found).view(U) & U((1 << size) - 1)).astype(np.uint32))
        bit = bit[np.concatenate([[True], bit[1:] != bit[:-1]])]
        first = np.searchsorted(bit, np.arange(1 << (size - PIECE)) << PIECE)
        first = np.append(first, len(bit))
        there = np.flatnonzero(np.diff(first))
        bounds = np.append(first[there], len(bit))
        inside = (bit & np.uint32((1 << PIECE) - 1)).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), ts.list_column(inside, bounds)], ["piece", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            found.append(batch.column(0).to_numpy())
            held += batch.num_rows
            if held > TOGETHER:
                yield sent(found)
                found, held = [], 0
        if held:
            yield sent(found)

    return run


def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One piece of the bitmap, batch by batch."""
    out = np.zeros(1 << PIECE, bool)
    for batch in batches:
        piece = batch.column("piece")[:1]
        out[batch.column("bits").flatten().to_numpy()] = True
    yield pa.RecordBatch.from_arrays([piece, pa.array([np.packbits(out, bitorder="little").tobytes()])], ["piece", "bytes"])


def large_bitmap(keys: DataFrame, column: str, size: int) -> np.ndarray:
    """As `bitmap`, for sizes of PIECE bits and more, where most keys have a word of their own that grouping would carry."""
    bits = keys.select(column).mapInArrow(places(size), "piece int, bits array<int>")
    pieces = bits.groupBy("piece").applyInArrow(folded, "piece int, bytes binary").toArrow()
    out = np.zeros((1 << (size - PIECE), 1 << (PIECE - 3)), np.uint8)
    for piece, data in zip(pieces["piece"].to_pylist(), pieces["bytes"], strict=True):
        out[piece] = np.frombuffer(data.as_buffer(), np.uint8)
    return out.reshape(-1)


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = keys & U(8 * len(bits) - 1)
    return (bits[(bit >> U(3)).astype(np.int64)] >> (bit & U(7)).astype(np.uint8)) & 1 > 0
