"""Vectorised helpers that run inside Spark tasks on the buffers of Arrow columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
        x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
        return x ^ (x >> U(32))


def powers(n: int, cache: dict) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if len(cache.get("up", ())) < n:
        for name, b in (("up", _BASE), ("down", _BASE_INVERSE)):
            p = np.full(n, b, U)
            p[0] = 1
            with np.errstate(over="ignore"):
                cache[name] = np.cumprod(p, dtype=U)
    return cache["up"], cache["down"]


class Rolling:
    """Hash of any slice of a byte array from one pass of prefix sums."""

    def __init__(self, codes: np.ndarray, cache: dict):
        n = len(codes)
        up, self.down = powers(n + 1, cache)
        self.sums = np.zeros(n + 1, U)
        with np.errstate(over="ignore"):
            np.cumsum((codes.astype(U) + U(1)) * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U))


def bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all values end to end, and the n + 1 offsets. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def ids_of(column, missing: int) -> np.ndarray:
    """int64 values with a stand-in for nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.fill_null(missing)).astype(np.int64, copy=False)


def chunks(offs: np.ndarray, most: int):
    """Row ranges of at most `most` bytes each, or of one row."""
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def blanks() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 32
    return table


def spans(buf: np.ndarray, offs: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of bytes that are not in `gap`; runs never cross rows."""
    n = len(buf)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~gap[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    body = inside[1:-1]
    starts = np.flatnonzero(body & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(body & (~inside[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def binary_array(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
