"""Vectorised word splitting and hashing of UTF-8 text, for Arrow-batched operators.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D; A-Z are lower-cased. Both rules are
byte-wise, so they hold for UTF-8 unchanged. Memory is bounded by cutting long texts at white space
into segments; a word longer than ``LONG_WORD`` bytes is hashed by blake2b instead.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 19
LONG_WORD = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_GAP = re.compile(rb"[\x20\x09-\x0D]")

_M = 0x9E3779B97F4A7C15 | 1
_M_INV = pow(_M, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: a bijection in which each input bit reaches each output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's powers 0 to n - 1 and their inverses, modulo 2**64; kept up to two segments' worth."""
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    size = max(n, SEGMENT + (1 << 16))
    made = []
    for base in (_M, _M_INV):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        np.multiply.accumulate(p, out=p)
        made.append(p)
    if size <= 4 * SEGMENT:
        _powers[:] = made
    return made[0][:n], made[1][:n]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans of buf; equal spans have equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    pw, inv = powers(len(buf))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * pw, out=total[1:])
    return mix((total[ends] - total[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def spans(buf: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of buf, none of which crosses a position in cuts (text starts)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ink = ~SPACE[buf]
    before = np.empty_like(ink)
    before[0], before[1:] = False, ink[:-1]
    cuts = cuts[cuts < len(buf)]
    before[cuts] = False
    after = np.empty_like(ink)
    after[-1], after[:-1] = False, ink[1:]
    after[cuts[cuts > 0] - 1] = False
    return np.flatnonzero(ink & ~before), np.flatnonzero(ink & ~after) + 1


def segments(text: bytes) -> Iterator[bytes]:
    """The text in pieces cut at white space, each about SEGMENT bytes or one longer word."""
    at, n = 0, len(text)
    while n - at > SEGMENT:
        gap = _GAP.search(text, at + SEGMENT)
        end = gap.start() if gap else n
        yield text[at:end]
        at = end
    yield text[at:]


def _of_text(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, word starts, ends and hashes of a long text, by segments."""
    found, at = [], 0
    for piece in segments(text):
        buf = LOWER[np.frombuffer(piece, np.uint8)]
        s, e = spans(buf, np.zeros(0, np.int64))
        long = np.flatnonzero(e - s > LONG_WORD)
        if len(long):
            rest = np.flatnonzero(e - s <= LONG_WORD)
            h = np.empty(len(s), np.uint64)
            for i in long.tolist():
                h[i] = int.from_bytes(hashlib.blake2b(buf[s[i] : e[i]].tobytes(), digest_size=8).digest(), "little")
            for i in rest.tolist():
                h[i] = span_hashes(buf[s[i] : e[i]], np.zeros(1, np.int64), np.array([e[i] - s[i]]))[0]
        else:
            h = span_hashes(buf, s, e)
        found.append((buf, s + at, e + at, h))
        at += len(piece)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary array; a null has no bytes."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return offsets, data


def word_spans(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, offsets, hashes, bytes, starts, ends) for runs of rows.

    Row first + i has the words offsets[i] to offsets[i + 1]; word k is bytes[starts[k] : ends[k]].
    """
    offsets, data = column_bytes(column)
    row, n = 0, len(column)
    while row < n:
        if offsets[row + 1] - offsets[row] > SEGMENT:
            buf, s, e, hashes = _of_text(data[offsets[row] : offsets[row + 1]].tobytes())
            yield row, 1, np.array([0, len(hashes)]), hashes, buf, s, e
            row += 1
            continue
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SEGMENT, "right")) - 1)
        base = offsets[row]
        buf = LOWER[data[base : offsets[last]]]
        s, e = spans(buf, offsets[row:last] - base)
        yield row, last - row, np.searchsorted(s, offsets[row : last + 1] - base), span_hashes(buf, s, e), buf, s, e
        row = last


def word_hashes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, offsets, hashes) for runs of rows: row first+i has hashes[offsets[i]:offsets[i+1]]."""
    for found in word_spans(column):
        yield found[:4]
