"""Words of an Arrow text column as numpy arrays: hashes, shingles and counts without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_ODD, _INV = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 2**64)
#: Texts are taken in pieces of about this many bytes (one text is never cut).
PIECE = 1 << 19

_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16, 0 if have is None else 2 * len(have)), base, U)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser: every bit of the result depends on every bit of ``h``."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def pieces(column: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of rows in them). Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        last = min(last, n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def table(separators: bytes, lower: bool = False) -> np.ndarray:
    """Byte to byte; separators become 0, other bytes stay over 0 (NUL becomes 1)."""
    out = np.arange(256, dtype=np.uint8)
    out[0] = 1
    if lower:
        out[65:91] += 32
    out[list(separators)] = 0
    return out


WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
PLAIN, LOWER = table(WHITE), table(WHITE, lower=True)
#: Letters, digits and bytes over 127 make words; all else in ASCII parts them.
ALNUM = table(bytes(b for b in range(128) if not chr(b).isalnum()), lower=True)


class Words:
    """Words of the rows of one piece: ``hash`` of each, ``start``/``end`` bytes, ``row`` offsets (row i has
    words row[i]:row[i+1])."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, bytes_to: np.ndarray = PLAIN):
        mapped = bytes_to[data]
        inside = mapped != 0
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edges = offsets[:-1][offsets[:-1] < len(data)]
        begins[edges] = inside[edges]
        ends = inside.copy()
        ends[:-1] &= begins[1:] | ~inside[1:]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.row = np.searchsorted(self.start, offsets)
        if len(self.start):
            h = np.add.reduceat(mapped.astype(U) * powers(len(mapped), _ODD), self.start) * powers(len(mapped), _INV)[self.start]
            self.hash = mix(h + (self.end - self.start).astype(U))
        else:
            self.hash = np.zeros(0, U)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k consecutive words within a row, and the row offsets of these. A row with 1 to k-1
        words has its whole sequence as one shingle."""
        n = np.diff(self.row)
        h, weight = self.hash, powers(k + 1, _ODD)
        count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
        rows = np.concatenate([[0], np.cumsum(count)])
        at = np.repeat(self.row[:-1] - rows[:-1], count) + np.arange(rows[-1])
        out = np.zeros(rows[-1], U)
        left = np.repeat(n, count)
        padded = np.concatenate([h, np.zeros(k, U)])
        for i in range(k):
            part = padded[at + i] * weight[i + 1]
            out += part if (n >= k).all() else np.where(left > i, part, U(0))
        return mix(out + np.minimum(left, k).astype(U)), rows


def shingled(h: np.ndarray, k: int) -> np.ndarray:
    """Shingle hashes of one sequence of word hashes, as ``Words.shingles`` has them."""
    n = len(h)
    if not n:
        return np.zeros(0, U)
    if n < k:
        return mix((h * powers(k + 1, _ODD)[1 : n + 1]).sum(dtype=U, keepdims=True) + U(n))
    out = np.zeros(n - k + 1, U)
    for i, weight in enumerate(powers(k + 1, _ODD)[1:]):
        out += h[i : i + len(out)] * weight
    return mix(out + U(k))
