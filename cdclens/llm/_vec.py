"""Words of Arrow string batches as numpy hash arrays, without a Python object per word.

A word's hash is a polynomial over its bytes modulo 2**64, read off one running
sum over the buffer, then mixed with the word's length.  Every word of a batch is
hashed by the same few array operations, whatever the number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once.  Longer texts are cut at separators, so memory stays bounded.
SLICE = 1 << 20

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _spread(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=_U)
    step, have = _U(base), 1
    while have < n:  # doubles the known part each time
        more = min(have, n - have)
        out[have : have + more] = out[:more] * step
        have += more
        step = step * step
    return out


_pow = _powers(_BASE, 1)
_inv = _powers(_INVERSE, 1)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        with np.errstate(over="ignore"):
            _pow, _inv = _powers(_BASE, n), _powers(_INVERSE, n)
    return _pow, _inv


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Words are runs of anything but the ASCII white space 20, 09-0D.
NOT_SPACE = ~byte_set((0x20, 0x20), (0x09, 0x0D))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_VALUE = _spread(256, 7)
_VALUE_LOWER = _VALUE[_LOWER]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return data[off[0] : off[-1]] if len(off) else data, off - off[0] if len(off) else np.zeros(1, dtype=np.int64)


def slices(data: np.ndarray, off: np.ndarray, is_word: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int, int, int, bool]]:
    """(first document, past the last, first byte, past the last, whole): runs of whole documents,
    or parts of a document that is longer than the limit, cut at a separator."""
    a, n = 0, len(off) - 1
    while a < n:
        b = int(np.searchsorted(off, off[a] + limit, "right")) - 1
        if b > a:
            yield a, b, int(off[a]), int(off[b]), True
            a = b
            continue
        at, end = int(off[a]), int(off[a + 1])
        while at < end:
            to = min(at + limit, end)
            while to < end:
                cut = np.flatnonzero(~is_word[data[at:to]])
                if len(cut):
                    to = at + int(cut[-1]) + 1
                    break
                to = min(to + limit, end)
            yield a, a + 1, at, to, to == end
            at = to
        a += 1


def spans(sub: np.ndarray, starts: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end; a word never crosses a document's start."""
    w = is_word[sub]
    begin, end = w.copy(), w.copy()
    begin[1:] &= ~w[:-1]
    end[:-1] &= ~w[1:]
    inner = starts[(starts > 0) & (starts < len(sub))]
    begin[inner] = w[inner]
    end[inner - 1] = w[inner - 1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def span_hashes(sub: np.ndarray, s: np.ndarray, e: np.ndarray, lower: bool) -> np.ndarray:
    power, inverse = _tables(len(sub) + 1)
    total = np.zeros(len(sub) + 1, dtype=_U)
    np.cumsum((_VALUE_LOWER if lower else _VALUE)[sub] * power[: len(sub)], out=total[1:])
    return mix((total[e] - total[s]) * inverse[s] + (e - s).astype(_U) * _U(0x9E3779B97F4A7C15))


def documents(column: pa.Array, is_word: np.ndarray = NOT_SPACE, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, past the last, word hashes, offset of each document's words and the end)."""
    data, off = buffers(column)
    parts: list[np.ndarray] = []
    for a, b, at, to, whole in slices(data, off, is_word):
        sub = data[at:to]
        starts = off[a:b] - at if b - a > 1 or whole and not parts else np.zeros(1, dtype=np.int64)
        s, e = spans(sub, starts, is_word)
        h = span_hashes(sub, s, e, lower)
        if b - a > 1 or (whole and not parts):
            yield a, b, h, np.append(np.searchsorted(s, starts), len(s))
            continue
        parts.append(h)
        if whole:
            h = np.concatenate(parts)
            parts = []
            yield a, b, h, np.array([0, len(h)])


_ROLL = _spread(64, 99)


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """A hash for each n consecutive words; with fewer, one for the whole; with none, nothing."""
    if not len(h):
        return h
    m = max(1, len(h) - n + 1)
    k = min(n, len(h))
    out = np.full(m, _U(k), dtype=_U)
    for i in range(k):
        out += h[i : i + m] * _ROLL[i]
    return mix(out)
