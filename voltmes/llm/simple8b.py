"""Simple-8b: whole numbers packed into 64-bit words, as many per word as the largest of them lets in.

The upper 4 bits of a word are its selector. Selector 0 is an escape: the word holds the place of a number of over 60
bits in a list of its own. Selector 1 stands for zeros only. Numbers are coded in frames of 1,024, each of which
begins with a new word whose place is stored, so frames are coded and decoded side by side.

Payload, little-endian: ``S8B1``, uint32 frames, uint64 numbers, uint32 words, uint32 escapes, then the first word of
each frame (uint32, one more for the end), the words and the escaped numbers (uint64).
"""

from __future__ import annotations

import struct

import numpy as np

FRAME = 1024
# Numbers per word and bits per number, by selector.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_HEAD = struct.Struct("<4sIQII")
_PAD = int(COUNTS.max())


def _bits(numbers: np.ndarray) -> np.ndarray:
    if numbers.max(initial=0) < 1 << 53:
        # The exponent of a double, which holds such numbers as they are.
        return np.frexp(numbers.astype(float))[1].astype(np.uint8)
    found, left = np.zeros(numbers.shape, np.uint8), numbers.copy()
    for step in (32, 16, 8, 4, 2, 1):
        large = left >= np.uint64(1 << step)
        found[large] += step
        left = np.where(large, left >> np.uint64(step), left)
    return found + (left > 0)


def encode(numbers: np.ndarray) -> bytes:
    numbers = np.asarray(numbers, np.uint64)
    frames = -(-len(numbers) // FRAME)
    table = np.zeros((frames, FRAME + _PAD), np.uint64)
    padded = np.zeros(frames * FRAME, np.uint64)
    padded[:len(numbers)] = numbers
    table[:, :FRAME] = padded.reshape(frames, FRAME)
    bits = _bits(table)
    # The largest need among the next 1, 2, 4, ... numbers, and from two of those among any count.
    widest, reach = {1: bits}, 1
    while 2 * reach <= _PAD:
        longer = widest[reach].copy()
        np.maximum(longer[:, :-reach], widest[reach][:, reach:], out=longer[:, :-reach])
        widest[2 * reach], reach = longer, 2 * reach
    choice = np.zeros((frames, FRAME), np.uint8)
    for selector in range(15, 0, -1):
        count = int(COUNTS[selector])
        half = 1 << (count.bit_length() - 1)
        need = np.maximum(widest[half][:, :FRAME], widest[half][:, count - half:count - half + FRAME])
        np.copyto(choice, np.uint8(selector), where=need <= np.uint8(BITS[selector]))
    at, row, steps = np.zeros(frames, np.int64), np.arange(frames), []
    ends = np.minimum(len(numbers) - row * FRAME, FRAME)
    while len(row):
        selector = choice[row, at]
        steps.append((row, at, selector))
        at = at + COUNTS[selector]
        going = at < ends[row]
        row, at = row[going], at[going]
    row, at, selector = (np.concatenate(x) if steps else np.zeros(0, np.int64) for x in zip(*steps)) if steps else (np.zeros(0, np.int64),) * 3
    order = np.argsort(row, kind="stable")
    row, at, selector = row[order], at[order], selector[order].astype(np.int64)
    packed = selector.astype(np.uint64) << np.uint64(60)
    place, flat = row * (FRAME + _PAD) + at, table.reshape(-1)
    escapes = np.zeros(0, np.uint64)
    for kind in np.unique(selector):
        own = np.flatnonzero(selector == kind)
        if kind == 0:
            escapes = flat[place[own]]
            packed[own] |= np.arange(len(own), dtype=np.uint64)
        elif BITS[kind]:
            first, word = place[own], packed[own]
            for k in range(COUNTS[kind]):
                word |= flat[first + k] << np.uint64(k * BITS[kind])
            packed[own] = word
    places = np.searchsorted(row, np.arange(frames + 1))
    return _HEAD.pack(b"S8B1", frames, len(numbers), len(packed), len(escapes)) + places.astype("<u4").tobytes() + packed.astype("<u8").tobytes() + escapes.astype("<u8").tobytes()


def decode(payload: bytes) -> np.ndarray:
    mark, frames, total, n_words, n_escapes = _HEAD.unpack_from(payload)
    if mark != b"S8B1":
        raise ValueError("not a Simple-8b payload")
    places = np.frombuffer(payload, "<u4", frames + 1, _HEAD.size)
    packed = np.frombuffer(payload, "<u8", n_words, _HEAD.size + 4 * (frames + 1))
    escapes = np.frombuffer(payload, "<u8", n_escapes, _HEAD.size + 4 * (frames + 1) + 8 * n_words)
    selector = (packed >> np.uint64(60)).astype(np.int64)
    after = np.cumsum(COUNTS[selector])
    row = np.repeat(np.arange(frames), np.diff(places.astype(np.int64)))
    before = np.concatenate([[0], after])[places[:-1].astype(np.int64)]
    place = after - COUNTS[selector] - before[row] + row * (FRAME + _PAD)
    table = np.zeros((frames, FRAME + _PAD), np.uint64)
    flat = table.reshape(-1)
    for kind in np.unique(selector):
        own = np.flatnonzero(selector == kind)
        if kind == 0:
            flat[place[own]] = escapes[(packed[own] & np.uint64((1 << 60) - 1)).astype(np.int64)]
        elif BITS[kind]:
            first, word, mask = place[own], packed[own], np.uint64((1 << int(BITS[kind])) - 1)
            for k in range(COUNTS[kind]):
                flat[first + k] = word >> np.uint64(k * BITS[kind]) & mask
    return table[:, :FRAME].reshape(-1)[:total]
