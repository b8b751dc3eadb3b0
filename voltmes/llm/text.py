"""Words and hashes of whole Arrow text columns, without a Python loop over words.

A column is worked on in blocks of a few megabytes of whole texts, so the memory of a task follows the block
and its longest text, not the batch that Spark hands over.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 21
HASH_BYTES = 1 << 18
#: The separators of words: the space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C55)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Block(NamedTuple):
    """Consecutive texts as UTF-8; text i is ``data[bounds[i]:bounds[i + 1]]``."""

    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1


def blocks(column: pa.Array, size: int = BLOCK_BYTES, step: int = 1) -> Iterator[Block]:
    """The texts of a column, some ``size`` bytes at a time, ``step`` texts kept together. A null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        to = min(len(column), max(at + step, at + (to - at) // step * step))
        yield Block(data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at])
        at = to
    # Workers outlive their tasks and share the executor's memory with the next ones.
    pa.default_memory_pool().release_unused()
    if len(data) > BLOCK_BYTES:
        _handing_back()(0)


#: What clears the large things that a worker keeps for the next tasks of one step.
KEPT: list[Callable[[], None]] = []


def let_go() -> None:
    """For tasks of a step that keeps nothing large: what an earlier step has left in the worker goes."""
    if KEPT:
        while KEPT:
            KEPT.pop()()
        _handing_back()(0)


@lru_cache(1)
def _handing_back() -> Callable[[int], int]:
    """What returns the freed memory of arrays to the system; a C library may lack it."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)


def words(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the index of each text's first word (one more for the end)."""
    data, bounds = block
    n = len(data)
    space = SPACE[data]
    first, last = space.copy(), space.copy()
    if n:
        first[1:], last[:-1] = space[:-1], space[1:]
        first[bounds[bounds < n]] = True
        last[bounds[bounds > 0] - 1] = True
    starts = np.flatnonzero(first & ~space)
    ends = np.flatnonzero(last & ~space) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def mix(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the 64-bit input."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def draw(seed: np.ndarray, number: int) -> np.ndarray:
    """The given number of the random sequence that each seed stands for."""
    return mix(seed + np.uint64((number + 1) * int(_STEP) % (1 << 64)))


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n + 1, _BASE), np.full(n + 1, _INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, n + 1 at least."""
    return _powers(1 << max(18, int(n).bit_length()))


@lru_cache(2)
def byte_codes(lower: bool) -> np.ndarray:
    """A random number for each byte; with ``lower`` A-Z have those of a-z."""
    codes = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
    if lower:
        codes[65:91] = codes[97:123]
    return codes


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each span of bytes. The spans are in order and don't overlap."""
    codes, found, at = byte_codes(lower), np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + HASH_BYTES, side="right")))
        low, high = starts[at], ends[to - 1]
        up, down = powers(int(high - low))
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(codes[data[low:high]] * up[:high - low], out=sums[1:])
        a, b = starts[at:to] - low, ends[at:to] - low
        found[at:to] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        at = to
    return found


def owners(first: np.ndarray) -> np.ndarray:
    """The text of each word, from the index of each text's first word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def by_owner(owner: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The order by owner, then value. Owners are small numbers."""
    order = np.argsort(value)
    small = owner.astype(np.uint16) if not len(owner) or owner.max() < 1 << 16 else owner
    return order[np.argsort(small[order], kind="stable")]


def new_runs(*keys: np.ndarray) -> np.ndarray:
    """True where a row of sorted keys differs from the one before it."""
    fresh = np.zeros(len(keys[0]), bool)
    fresh[:1] = True
    for key in keys:
        fresh[1:] |= key[1:] != key[:-1]
    return fresh


def sums(owner: np.ndarray, count: int, weight: np.ndarray | None = None) -> np.ndarray:
    """Per owner the number of rows, or the sum of whole weights."""
    found = np.bincount(owner, weight, count)
    return found if weight is None else np.rint(found).astype(np.int64)


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))
