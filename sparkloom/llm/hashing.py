"""Hashes of words and shingles of whole texts, vectorised over byte buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text hashed at once.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i below ``n``."""
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        size = max(n, PIECE + 4096)
        held = np.full(size, base, np.uint64)
        held[0] = 1
        held = np.multiply.accumulate(held)
        _POWERS[base] = held
    return held[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _pieces(buffer: bytes) -> Iterator[bytes]:
    """The buffer in pieces of about ``PIECE`` bytes that end where a word ends."""
    start = 0
    while start < len(buffer):
        end = start + PIECE
        while end < len(buffer) and not _SPACE[buffer[end]]:
            end += 1
        yield buffer[start:end]
        start = end


def word_hashes(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word (run of bytes that are no ASCII white space)."""
    hashes, starts, offset = [], [], 0
    for piece in _pieces(buffer):
        data = np.frombuffer(piece, np.uint8)
        space = np.r_[True, _SPACE[data], True]
        begin = np.flatnonzero(space[:-1] & ~space[1:])
        end = np.flatnonzero(~space[:-1] & space[1:])
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data)), out=sums[1:])
        h = (sums[end] - sums[begin]) * powers(_INVERSE, len(data) + 1)[begin]
        hashes.append(mix(h ^ (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        starts.append(begin + offset)
        offset += len(piece)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def _combine(columns: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(columns[0]), len(columns), np.uint64)
    for c in columns:
        h = mix(h * np.uint64(0x2545F4914F6CDD1D) + c)
    return h


def shingle_sets(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct hashes of ``n``-word shingles.

    ASCII letters are lower-cased.  A text of fewer words is one shingle; a text
    without words, or null, has none.
    """
    group: list[bytes] = []
    size = 0
    for text in texts:
        data = text.encode("utf-8", "surrogatepass").lower() if text else b""
        group.append(data)
        size += len(data)
        if size >= PIECE:
            yield from _sets(group, n)
            group, size = [], 0
    if group:
        yield from _sets(group, n)


def _sets(group: list[bytes], n: int) -> Iterator[np.ndarray]:
    hashes, starts = word_hashes(b"\n".join(group))
    ends = np.cumsum([len(d) + 1 for d in group])
    upto = np.r_[0, np.searchsorted(starts, ends)]
    long = _combine([hashes[i : len(hashes) - n + 1 + i] for i in range(n)]) if len(hashes) >= n else np.zeros(0, np.uint64)
    for a, b in zip(upto[:-1], upto[1:], strict=True):
        if b - a >= n:
            yield np.unique(long[a : b - n + 1])
        elif b > a:
            yield _combine([hashes[i : i + 1] for i in range(a, b)])
        else:
            yield np.zeros(0, np.uint64)
