"""Hashed word features of Arrow text batches, as numpy arrays."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from cdclens.llm import _vec as V

_U = np.uint64

#: Runs of letters and digits (any byte above 7F is a letter here) are words, and so are runs of other signs.
_CLASS = np.full(256, 2, dtype=np.uint8)
_CLASS[0x30:0x3A] = 1
_CLASS[0x41:0x5B] = 1
_CLASS[0x61:0x7B] = 1
_CLASS[0x80:] = 1
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_BIG = V.byte_set((0x41, 0x5A))
_SMALL = V.byte_set((0x61, 0x7A))
_REPEAT, _CAPITALS, _SIGN = (_U(x) for x in (0x1111, 0x2222, 0x3333))


def _class_spans(sub: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k = _CLASS[sub]
    edge = np.ones(len(sub) + 1, dtype=bool)
    edge[1:-1] = k[1:] != k[:-1]
    edge[starts[starts < len(sub)]] = True
    at = np.flatnonzero(edge)
    s, e = at[:-1], at[1:]
    kind = k[s]
    keep = kind > 0
    return s[keep], e[keep], kind[keep]


def words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first document, past the last, word hashes, first-4-bytes hashes, is sign run, document offsets).
    A word of capitals alone becomes one word for all such, and one that repeats the word before it another."""
    data, off = V.buffers(column)
    held: list[tuple[np.ndarray, ...]] = []
    for a, b, at, to, whole in V.slices(data, off, V.NOT_SPACE):
        sub = data[at:to]
        single = b - a == 1 and not (whole and not held)
        starts = np.zeros(1, dtype=np.int64) if single else off[a:b] - at
        if len(sub):
            s, e, kind = _class_spans(sub, starts)
            h = V.span_hashes(sub, s, e, lower=True)
            head = V.span_hashes(sub, s, np.minimum(e, s + 5), lower=True)
            big = np.append(0, np.cumsum(_BIG[sub]))
            small = np.append(0, np.cumsum(_SMALL[sub]))
            caps = (big[e] - big[s] >= 3) & (small[e] == small[s])
            shape = h.copy()
            shape[caps] = _CAPITALS
            same = np.zeros(len(h), dtype=bool)
            lag = np.flatnonzero(h[1:] == h[:-1]) + 1
            same[lag] = True
            over = np.flatnonzero((h[2:] == h[:-2]) & (kind[1:-1] == 2)) + 2  # a sign between does not count
            same[over] = True
            shape[same & (kind == 1)] = _REPEAT
            if len(h):
                part = (h, head, shape, kind == 2)
            else:
                part = (h, head, shape, np.zeros(0, dtype=bool))
        else:
            s = np.zeros(0, dtype=np.int64)
            part = (np.zeros(0, dtype=_U),) * 3 + (np.zeros(0, dtype=bool),)
        if not single:
            yield (a, b, *part, np.append(np.searchsorted(s, starts), len(s)))
            continue
        held.append(part)
        if whole:
            part = tuple(np.concatenate(x) for x in zip(*held))
            held = []
            yield (a, b, *part, np.array([0, len(part[0])]))


def fold(doc_ids: np.ndarray, modulus: int) -> np.ndarray:
    """crc32 of each id as text, modulo.  A null id counts as the empty text."""
    return np.array([zlib.crc32(b"" if x is None else str(int(x)).encode()) % modulus for x in doc_ids], dtype=np.int64)


def quality_features(column: pa.Array, bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, past the last, feature ids, values, document offsets): word uni- and bigrams,
    each occurrence weighing one over the document's number of them."""
    for a, b, h, _, shape, sign, off in words(column):
        n = np.diff(off)
        first = np.zeros(len(h), dtype=bool)
        first[off[:-1][n > 0]] = True
        bi = np.full(len(h), _U(0x77))
        bi[1:] = shape[:-1]
        bi[first] = _U(0x77)
        two = V.mix(bi * _U(0x9E3779B97F4A7C15) + shape)
        ids = np.empty(2 * len(h), dtype=np.int64)
        ids[0::2] = (shape >> _U(64 - bits)).astype(np.int64)
        ids[0::2][shape == _CAPITALS] = 1
        ids[0::2][shape == _REPEAT] = 2
        ids[1::2] = (two >> _U(64 - bits)).astype(np.int64)
        yield a, b, ids, np.repeat(1.0 / np.maximum(n, 1), 2 * n), 2 * off


def presence_features(column: pa.Array, bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, past the last, feature ids, document offsets): each distinct word and word start once a document."""
    size = 1 << bits
    for a, b, h, head, _, sign, off in words(column):
        doc = np.repeat(np.arange(b - a, dtype=np.int64), np.diff(off))
        keep = ~sign
        ids = np.concatenate([(h[keep] >> _U(65 - bits)).astype(np.int64), (head[keep] >> _U(65 - bits)).astype(np.int64) + size // 2])
        key = np.unique(np.concatenate([doc[keep], doc[keep]]) * size + ids)
        yield a, b, key % size, np.searchsorted(key, np.arange(b - a + 1, dtype=np.int64) * size)


def sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The sum of each document's values."""
    total = np.append(0.0, np.cumsum(values, dtype=np.float64))
    return total[off[1:]] - total[off[:-1]]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))
