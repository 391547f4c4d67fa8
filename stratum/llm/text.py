"""Vectorised word and shingle hashing over blocks of UTF-8 text.

A *word* is a maximal run of characters other than space and U+0009..U+000D, with
A-Z lower-cased.  A document's *shingles* are its distinct runs of ``n`` words; a
document of fewer words has one shingle, its whole word sequence; one without
words has none.  Shingles are identified by 54-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
ID_BITS = 54
ID_MASK = U((1 << ID_BITS) - 1)
MAX_DOCS = 1 << (64 - ID_BITS)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix, elementwise."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers_of(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, base, dtype=U)
        steps[0] = 1
        have = np.cumprod(steps, dtype=U)
        if size <= 1 << 23:
            _powers[name] = have
    return have[:n]


def text_blocks(column: pa.Array, max_bytes: int = 1 << 20, max_docs: int = MAX_DOCS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive runs of rows; a null text counts as empty.

    A run holds at most ``max_docs`` rows and about ``max_bytes`` bytes; a longer text is a run of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(column.buffers()[1], dtype=np.int64, count=n + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + max_bytes, "right")) - 1
        j = min(max(j, i + 1), i + max_docs, n)
        yield i, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words per text) of all words of a block; words never cross texts."""
    inside = np.empty(len(buf) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.logical_not(_SPACE[buf], out=inside[1:-1])
    begins = inside[1:-1] & ~inside[:-2]
    finish = inside[1:-1] & ~inside[2:]
    edges = offs[1:-1]
    edges = edges[(edges > 0) & (edges < len(buf))]
    if len(edges):
        begins[edges] = inside[edges + 1]
        finish[edges - 1] |= inside[edges]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finish) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offs))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word's (lower-cased) bytes, the same wherever the word stands."""
    if not len(starts):
        return np.zeros(0, dtype=U)
    sums = np.empty(len(buf) + 1, dtype=U)
    sums[0] = 0
    np.cumsum((_LOWER[buf] if lower else buf).astype(U) * _powers_of("p", _P, len(buf)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _powers_of("i", _PINV, len(buf))[starts]
    return mix(h + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def shingle_keys(buf: np.ndarray, offs: np.ndarray, n: int = 5) -> np.ndarray:
    """The distinct shingles of a block's texts, sorted: (text << 54) | shingle id."""
    starts, ends, counts = word_spans(buf, offs)
    h = word_hashes(buf, starts, ends)
    doc = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    keys = []
    total = len(h)
    if total >= n:
        acc = np.zeros(total - n + 1, dtype=U)
        for k in range(n):
            acc *= U(0xC2B2AE3D27D4EB4F)
            acc += h[k : total - n + 1 + k]
        whole = doc[: total - n + 1] == doc[n - 1 :]
        keys.append((doc[: total - n + 1][whole].astype(U) << U(ID_BITS)) | (mix(acc[whole]) >> U(64 - ID_BITS)))
    for m in range(1, n):
        which = np.flatnonzero(counts == m)
        if len(which):
            acc = np.full(len(which), m, dtype=U)
            for k in range(m):
                acc *= U(0xC2B2AE3D27D4EB4F)
                acc += h[first[which] + k]
            keys.append((which.astype(U) << U(ID_BITS)) | (mix(acc) >> U(64 - ID_BITS)))
    if not keys:
        return np.zeros(0, dtype=U)
    key = np.sort(np.concatenate(keys))
    return key[np.concatenate(([True], key[1:] != key[:-1]))]


def per_text(keys: np.ndarray, texts: int) -> np.ndarray:
    """How many of a block's sorted keys each text has."""
    return np.diff(np.searchsorted(keys, np.arange(texts + 1, dtype=U) << U(ID_BITS))) if texts < MAX_DOCS else np.bincount((keys >> U(ID_BITS)).astype(np.int64), minlength=texts)
