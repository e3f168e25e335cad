"""Hashed five-word shingles of whole texts, computed for many texts at once with numpy.

A word is a run of ASCII letters and digits and of bytes over 127 in the lower-case UTF-8 text. A text of one to four
words has one shingle, that of all its words; a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from reportlake.llm.common import U64, mix

WORDS = 5
_PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_IS_WORD = np.array([b > 127 or chr(b).isalnum() for b in range(256)])
_tables: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2^64, up to a piece's length."""
    if not _tables:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(_PIECE + 1, U64(base))
            p[0] = 1
            _tables.append(np.multiply.accumulate(p))
    return _tables


def _piece(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word of at most _PIECE bytes: differences of a polynomial prefix sum."""
    up, down = _powers()
    word = _IS_WORD[raw]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    start, end = edge[0::2], edge[1::2]
    total = np.zeros(len(raw) + 1, U64)
    np.cumsum((raw.astype(U64) + U64(1)) * up[: len(raw)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93)), start


def words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word; longer input is cut where no word is, a word over _PIECE bytes in pieces."""
    data = np.frombuffer(raw, np.uint8)
    if len(data) <= _PIECE:
        return _piece(data)
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = min(at + _PIECE, len(data))
        if end < len(data):
            gap = np.flatnonzero(~_IS_WORD[data[at:end]])
            end = at + int(gap[-1]) + 1 if len(gap) else end
        h, s = _piece(data[at:end])
        hashes.append(h)
        starts.append(s + at)
        at = end
    return np.concatenate(hashes), np.concatenate(starts)


def _of_words(w: np.ndarray) -> np.ndarray:
    n = len(w)
    if not n:
        return w
    if n < WORDS:
        w = np.concatenate([w, np.zeros(WORDS - n, U64)])
    x = w[: len(w) - WORDS + 1].copy()
    for j in range(1, WORDS):
        x = x * U64(0x2545F4914F6CDD1D) + w[j : len(w) - WORDS + 1 + j]
    return mix(x)


def shingles(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct shingles, ascending, and how often each occurs."""
    at = 0
    while at < len(texts):
        group, size = [], 0
        while at < len(texts) and (not group or size + len(texts[at] or "") < _PIECE // 2):
            group.append((texts[at] or "").lower().encode("utf-8", "replace"))
            size += len(group[-1])
            at += 1
        hashes, starts = words(b"\n".join(group))
        ends = np.cumsum([len(g) + 1 for g in group])
        cuts = np.searchsorted(starts, ends)
        for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
            x = np.sort(_of_words(hashes[a:b]))
            first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
            yield x[first], np.diff(np.append(first, len(x)))
