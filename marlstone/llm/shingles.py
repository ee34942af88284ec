"""Word shingles of whole texts as 64-bit hashes, and circulant MinHash signatures, over numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_rng = np.random.Generator(np.random.PCG64(9_2026))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_ODD = _rng.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHORT = np.uint64(0x632BE59BD9B4E019)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text hashed at once; a longer text is a block of its own.
BLOCK = 1 << 19

_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        grown = np.empty((2, max(n, 2 * BLOCK)), np.uint64)
        for row, base in zip(grown, (_BASE, _BASE_INV), strict=True):
            row[0], row[1:] = 1, base
            np.multiply.accumulate(row, out=row)
        _pow, _inv = grown
    return _pow[:n], _inv[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _block(texts: list[bytes], n: int) -> list[np.ndarray]:
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    blank = _BLANK[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank)).astype(np.int8)))
    start, stop = edge[::2], edge[1::2]
    doc = np.searchsorted(ends, start, "right")
    power, inverse = _powers(len(buf))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * power, out=total[1:])
    word = mix((total[stop] - total[start]) * inverse[start])
    m = len(word) - n + 1
    if m > 0:
        value = word[:m] * _ODD[0]
        for i in range(1, n):
            value += word[i : i + m] * _ODD[i]
        whole = doc[:m] == doc[n - 1 :]
        value, owner = mix(value[whole]), doc[:m][whole]
    else:
        value, owner = np.empty(0, np.uint64), np.empty(0, np.int64)
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    words = np.searchsorted(doc, np.arange(len(texts) + 1))
    out = []
    for i in range(len(texts)):
        if 0 < words[i + 1] - words[i] < n:
            own = word[words[i] : words[i + 1]]
            out.append(mix((own * _ODD[: len(own)]).sum(keepdims=True) + _SHORT * np.array([len(own)], np.uint64)))
        else:
            out.append(value[cut[i] : cut[i + 1]])
    return out


def shingles(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """For each text, the hashes of its n-word shingles in order, repeats included.

    A-Z are lower-cased; words are runs of bytes other than ``[\\x20\\x09-\\x0D]``. A text with fewer words gives one hash
    of its whole sequence; null, empty and blank texts give none.
    """
    block: list[bytes] = []
    size = 0
    for t in texts:
        raw = (t or "").encode("utf-8", "surrogatepass").lower()
        if block and size + len(raw) > BLOCK:
            yield from _block(block, n)
            block, size = [], 0
        block.append(raw)
        size += len(raw) + 1
    if block:
        yield from _block(block, n)


#: Elements of a signature block: fits a core's cache.
_CHUNK = 1 << 15


def signatures(sets: list[np.ndarray], k: int) -> np.ndarray:
    """Circulant MinHash: coordinate j of a set is the least pi(sigma(x) + j) over its shingles x, modulo 2**32.

    sigma, the first permutation, scatters shingles over the circle; pi, the second, is one fixed bijection of it; the circular
    shift by j makes all k coordinates from the two. Every set must be non-empty.
    """
    out = np.empty((len(sets), k), np.uint32)
    i = 0
    while i < len(sets):
        j, size = i, 0
        while j < len(sets) and (j == i or size + len(sets[j]) <= _CHUNK):
            size += len(sets[j])
            j += 1
        sigma = (mix(np.concatenate(sets[i:j]) ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate(([0], np.cumsum([len(s) for s in sets[i : j - 1]]))).astype(np.int64)
        x, t = np.empty_like(sigma), np.empty_like(sigma)
        for shift in range(k):
            np.add(sigma, np.uint32(shift), out=x)
            for right, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
                np.right_shift(x, np.uint32(right), out=t)
                np.bitwise_xor(x, t, out=x)
                np.multiply(x, np.uint32(factor), out=x)
            np.right_shift(x, np.uint32(16), out=t)
            np.bitwise_xor(x, t, out=x)
            out[i:j, shift] = np.minimum.reduceat(x, starts)
        i = j
    return out


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` coordinates; keys of different bands differ."""
    n, k = signature.shape
    key = np.zeros((n, k // rows), np.uint64) + np.arange(k // rows, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for r in range(rows):
        key = mix(key + signature[:, r::rows][:, : k // rows].astype(np.uint64) * _ODD[8 + r % 8] + np.uint64(r))
    return key.view(np.int64)
