"""Word shingles of a text as sorted 64-bit hashes; the kernel that the near-duplicate operator runs in its tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WIDTH = 5
#: Bytes that are hashed at a time; longer texts go in pieces cut at white space.
PIECE = 1 << 20
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RANDOM = np.random.default_rng(20240501)
_BYTE = _RANDOM.integers(1, 2**63, size=256, dtype=np.uint64)
_STEP = _RANDOM.integers(1, 2**63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64."""
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_UP, _DOWN = _powers(1 << 12)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _pieces(data: bytes) -> Iterator[bytes]:
    """The text in pieces of about ``PIECE`` bytes that end at white space; a longer word stays whole."""
    at = 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        yield data[at:end]
        at = end


def _hash_words(data: bytes) -> np.ndarray:
    """A hash for each word between white space: a polynomial in its bytes, from differences of running sums."""
    global _UP, _DOWN
    codes = np.frombuffer(data, np.uint8)
    if len(codes) >= len(_UP):
        _UP, _DOWN = _powers(2 * len(codes))
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = ~_SPACE[codes]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_BYTE[codes] * _UP[: len(codes)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * _DOWN[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words between ASCII white space, A-Z lower-cased, in order."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)
    parts = [_hash_words(piece) for piece in _pieces(data)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint64)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Distinct shingles, sorted. With fewer than ``width`` words, the whole sequence as one; without words, empty."""
    ids = word_hashes(text)
    if not len(ids):
        return ids
    width = min(width, len(ids))
    size = len(ids) - width + 1
    total = ids[:size] * _STEP[0] + np.uint64(width)
    for k in range(1, width):
        total = (total ^ (total >> np.uint64(29))) * _STEP[k] + ids[k : k + size]
    total = mixed(total)
    total.sort()
    first = np.ones(size, bool)
    np.not_equal(total[1:], total[:-1], out=first[1:])
    return total[first]
