"""Vectorised word hashing over Arrow batches of texts.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. All of these
are ASCII, so splitting UTF-8 bytes equals splitting code points. Hashes are
64-bit: a polynomial over a random value per byte, modulo 2**64, finished by a
mixing step; the same bytes give the same hash on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once; bounds the working memory of a task.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), keyed by ``salt``."""
    x = x + np.uint64((salt * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64), 77)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    np.multiply.accumulate(out, out=out)
    return out


_POW = _powers(_BASE, 1 << 16)
_INV = _powers(pow(_BASE, -1, 1 << 64), 1 << 16)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if n > len(_POW):
        size = 1 << int(n - 1).bit_length()
        _POW, _INV = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
    return _POW, _INV


class Words:
    """Words of a run of texts.

    ``hash`` has a value per word, ``start`` and ``end`` its bytes in ``data``;
    text i has the words ``first[i]:first[i + 1]``.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool):
        if lower:
            data = _LOWER[data]
        self.data = data
        solid = ~_SPACE[data]
        # a text's first byte starts a word even if the text before ends in one
        begins, ends = solid.copy(), solid.copy()
        inner = bounds[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        begins[1:] &= ~solid[:-1]
        begins[inner] = solid[inner]
        ends[:-1] &= ~solid[1:]
        ends[inner - 1] = solid[inner - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, bounds)
        power, inverse = _tables(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
        raw = (sums[self.end] - sums[self.start]) * inverse[self.start]
        self.hash = mix(raw + (self.end - self.start).astype(np.uint64) * np.uint64(_BASE))


def text_slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, bounds) of runs of about SLICE_BYTES; a null text has no bytes."""
    texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    whole = texts.buffers()[2]
    data = np.frombuffer(whole, np.uint8) if whole is not None else np.zeros(0, np.uint8)
    null = np.asarray(texts.is_null())
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1
        j = min(max(j, i + 1), n)
        bounds = offsets[i : j + 1] - offsets[i]
        part = data[offsets[i] : offsets[j]]
        if null[i:j].any() and len(part):  # bytes under a null are arbitrary
            keep = np.repeat(~null[i:j], np.diff(bounds))
            part = part[keep]
            bounds = np.concatenate([[0], np.cumsum(np.where(null[i:j], 0, np.diff(bounds)))])
        yield i, j, part, bounds
        i = j


def grams(words: Words, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words, and where each text's begin.

    With ``short`` a text of one to k-1 words has its whole sequence as one.
    """
    h, first = words.hash, words.first
    count = np.diff(first)
    n = np.maximum(count - k + 1, 0)
    if short:
        n = np.where((count > 0) & (count < k), 1, n)
    at = np.concatenate([[0], np.cumsum(n)])
    begin = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], n)
    out = np.zeros(at[-1], np.uint64)
    size = np.repeat(np.minimum(count, k), n)
    for j in range(k):
        here = size > j
        if here.all():
            out = mix(out + h[begin + j], j + 1)
        else:
            out[here] = mix(out[here] + h[begin[here] + j], j + 1)
    return mix(out + size.astype(np.uint64), 99), at


def distinct(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's values sorted, without repeats, and where each text's begin."""
    n = np.diff(at)
    owner = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((values, owner))
    values = values[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[fresh], owner[fresh]
    return values, np.searchsorted(owner, np.arange(len(n) + 1))
