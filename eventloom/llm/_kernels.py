"""Vectorised text kernels on Arrow string columns (UTF-8 bytes in numpy).

Texts are worked on in blocks of about ``BLOCK`` bytes, so that the temporary arrays stay a
small multiple of the block. Of a text beyond a block, the flags of its bytes and a few 8-byte
values for each of its words or lines are held.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
U = np.uint64
#: Odd base and its inverse modulo 2**64; a value for each byte.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
BYTE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, … n - 1 modulo 2**64; up to a block's worth is remembered."""
    if n > BLOCK + 1:
        return _made(base, n)
    if base not in _powers:
        _powers[base] = _made(base, BLOCK + 1)
    return _powers[base][:n]


def _made(base: int, n: int) -> np.ndarray:
    got = np.full(n, base, U)
    got[0] = 1
    return np.multiply.accumulate(got)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def blocks(column: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) pairs of about ``most`` bytes each; null counts as the empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at, n = 0, len(column)
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield at, column.slice(at, to - at)
        at = to


@dataclass
class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a block of texts, in order."""

    data: np.ndarray  #: bytes of all texts
    bounds: np.ndarray  #: text i has the bytes bounds[i]:bounds[i+1]
    starts: np.ndarray  #: first byte of each word
    ends: np.ndarray  #: byte behind each word
    first: np.ndarray  #: text i has the words first[i]:first[i+1]
    text: np.ndarray  #: the text of each word
    hashes: np.ndarray  #: 64-bit hash of each word

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a slice made by ``blocks``."""
    n = len(column)
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[ends[0] : ends[-1]] if body is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span, whatever its place; spans are in order and don't overlap.

    Spans are taken a block of bytes at a time, and a span beyond a block in pieces, so the temporary
    arrays don't grow with a text.
    """
    out = np.zeros(len(starts), U)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        to = int(np.searchsorted(ends, low + BLOCK, "right"))
        if to <= at:  # one long span
            to, value = at + 1, 0
            for piece in range(low, int(ends[at]), BLOCK):
                part = data[piece : min(piece + BLOCK, int(ends[at]))]
                value += int((BYTE[part] * powers(BASE, len(part))).sum()) * pow(BASE, piece - low, 1 << 64)
            out[at] = U(value % (1 << 64))
        else:
            part = data[low : int(ends[to - 1])]
            sums = np.zeros(len(part) + 1, U)
            np.cumsum(BYTE[part] * powers(BASE, len(part)), out=sums[1:])
            first = starts[at:to] - low
            out[at:to] = (sums[ends[at:to] - low] - sums[first]) * powers(INVERSE, len(part) + 1)[first]
        at = to
    return mixed(out + (ends - starts).astype(U))


def words(column: pa.Array, lower: bool = False) -> Words:
    data, bounds = raw(column)
    if lower:
        data = LOWER[data]
    n = len(data)
    space = SPACE[data]
    edge = np.ones(n + 1, bool)
    edge[1:n] = space[: n - 1]
    edge[bounds] = True
    starts = np.flatnonzero(edge[:n] & ~space)
    edge[:n] = space
    edge[bounds] = True
    ends = np.flatnonzero(edge[1:] & ~space) + 1
    first = np.searchsorted(starts, bounds)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    return Words(data, bounds, starts, ends, first, text, spans_hash(data, starts, ends))


def windows(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows of ``size`` words inside one text, and the windows' hashes."""
    n = len(w.hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    value = w.hashes[:n].copy()
    for k in range(1, size):
        value *= U(BASE)
        value += w.hashes[k : k + n]
    at = np.flatnonzero(w.text[:n] == w.text[size - 1 :])
    return at, mixed(value[at])


def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` between the bounds of each text."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def covered(at: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a window of ``size`` words that begins at one of ``at``."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, at, 1) if len(at) < 16 else steps.__iadd__(np.bincount(at, minlength=n + 1))
    steps[size:] -= np.bincount(at, minlength=n + 1)[: n + 1 - size] if len(at) and n + 1 > size else 0
    return np.cumsum(steps[:-1]) > 0


def code_points(data: np.ndarray) -> np.ndarray:
    """A flag for each byte that begins a character."""
    return (data & 0xC0) != 0x80
