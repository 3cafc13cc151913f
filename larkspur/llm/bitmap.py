"""A bitmap of 64-bit hashes in the shared folder: a set test without false negatives that never decides alone, since a
join or a comparison of words follows.

It grows with its keys (`BITS_PER_KEY`, up to MAX_BITS) and is cut into slices, each written by the task that has its keys
and mapped by the workers that look into it: nothing of it goes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.shared import map_array, put_bytes

BITS_PER_KEY = 24
MAX_BITS = 1 << 40  # of all slices together
SLICE_BITS, SLICES = 1 << 22, 1 << 12  # bits of a slice, until there are so many slices


def _write(uri: str, words: int):
    """Rows (s, w, b), all of a slice in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[int, np.ndarray] = {}
        for batch in batches:
            s, w, b = (batch[c].to_numpy() for c in ("s", "w", "b"))
            for k in np.unique(s).tolist():
                slices.setdefault(k, np.zeros(words, np.int64))[w[s == k]] = b[s == k]
        for k, x in slices.items():
            put_bytes(f"{uri}-{k}", x.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(list(slices), pa.int64())], names=["s"])

    return run


def write_bitmap(keys: DataFrame, column: str, n: int, uri: str) -> str:
    """keys.column: well-mixed longs, about n of them. The name tells sizes and the slices that exist."""
    bits = min(MAX_BITS, max(1 << 16, 1 << (BITS_PER_KEY * max(n, 1) - 1).bit_length()))
    size = min(bits, max(SLICE_BITS, bits // SLICES))
    slot = F.col(column).bitwiseAND(F.lit(bits - 1))
    words = keys.groupBy(F.shiftright(slot, size.bit_length() - 1).alias("s"), F.shiftright(slot.bitwiseAND(F.lit(size - 1)), 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({column} & 63 as int))")).alias("b"))
    made = {r.s for r in words.repartition("s").mapInArrow(_write(uri, size // 64), "s long").collect()}
    there = "".join("1" if k in made else "0" for k in range(bits // size))
    return f"{uri}|{bits}|{size}|{int(there, 2):x}"


_open: dict[str, tuple[int, int, dict[int, np.ndarray | None]]] = {}


def in_bitmap(name: str, hashes: np.ndarray) -> np.ndarray:
    if name not in _open:
        _open.clear()
        uri, bits, size, there = name.split("|")
        n = int(bits) // int(size)
        marks = f"{int(there, 16):0{n}b}"
        _open[name] = int(bits), int(size), {k: map_array(f"{uri}-{k}", np.int64).view(np.uint64) if marks[k] == "1" else None for k in range(n)}
    bits, size, slices = _open[name]
    slot = hashes.astype(np.uint64) & np.uint64(bits - 1)
    out = np.zeros(len(slot), bool)
    if len(slices) == 1:
        parts = [(0, slice(None))]
    else:
        part = (slot >> np.uint64(size.bit_length() - 1)).astype(np.uint16)
        order = np.argsort(part, kind="stable")
        found, first = np.unique(part[order], return_index=True)
        parts = zip(found.tolist(), np.split(order, first[1:]), strict=True)
    for k, at in parts:
        if slices[k] is not None:
            own = slot[at] & np.uint64(size - 1)
            out[at] = (slices[k][own >> np.uint64(6)] >> (own & np.uint64(63))) & np.uint64(1) != 0
    return out
