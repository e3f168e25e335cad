"""Token ids of many texts at once: texts are cut into units that a tokenizer never joins, each different unit is encoded
once, and the ids of all texts are gathered by index.

Equal units of a batch are found by a 64-bit hash and then compared byte by byte, so a collision can't change an id.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from itertools import count

import numpy as np

from reportlake.llm.common import U64

_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_MARK = np.array([chr(b) in ".,;:!?" for b in range(256)])
_SPAN = 64
_VALUES = np.random.default_rng(7).integers(1, 1 << 63, (_SPAN + 1) * 256, dtype=np.uint64) * U64(2) + U64(1)
_VALUES[_SPAN * 256 :] = 0  # the row of bytes outside units


class Units:
    """The units of a byte text. A unit ends before a blank byte or a byte that opens a unit (``heads``); a single final
    mark after an ASCII letter is a unit of its own, ``glued``."""

    def __init__(self, raw: bytes, blank: np.ndarray, heads: np.ndarray):
        self.raw = raw
        data = np.frombuffer(raw, np.uint8)
        n = len(data)
        gap, head = blank[data], heads[data]
        begin = ~gap
        begin[1:] &= gap[:-1]
        begin |= head
        mark = _MARK[data]
        mark[:1] = False
        mark[1:] &= _LETTER[data[:-1]]
        mark[:-1] &= gap[1:] | head[1:]
        begin |= mark
        self.start = np.flatnonzero(begin)
        stops = np.append(np.flatnonzero(gap | begin), n)
        self.end = stops[np.searchsorted(stops, self.start, side="right")]
        self.glued = mark[self.start]
        if not len(self.start):
            self.first = self.which = np.zeros(0, np.int64)
            return
        lead = self.start[0]  # only blanks stand before
        data, gap = data[lead:], gap[lead:]
        unit = np.cumsum(begin[lead:], dtype=np.int32) - 1
        start, size = (self.start - lead).astype(np.int32), self.end - self.start
        place = np.arange(len(data), dtype=np.int32) - start[unit]
        code = _VALUES[(np.where(gap, _SPAN, place & (_SPAN - 1)) << 8) + data]
        if size.max() > _SPAN:
            code *= U64(1) + U64(2) * (place // _SPAN).astype(U64)
        key = np.add.reduceat(code, start) * U64(0x9E3779B97F4A7C15) + self.glued.astype(U64)
        _, self.first, self.which = np.unique(key, return_index=True, return_inverse=True)
        same = self.first[self.which]
        twin = np.minimum(start[same][unit] + place, len(data) - 1)
        if (size != size[same]).any() or (self.glued != self.glued[same]).any() or not (gap | (data[twin] == data)).all():
            self._by_name()

    def _by_name(self) -> None:
        """Two different units share a hash: tell units apart by their bytes."""
        seen: dict[tuple[bytes, bool], int] = {}
        names = [(self.raw[a:b], bool(g)) for a, b, g in zip(self.start.tolist(), self.end.tolist(), self.glued, strict=True)]
        self.which = np.array([seen.setdefault(x, len(seen)) for x in names], np.int64)
        self.first = np.zeros(len(seen), np.int64)
        self.first[self.which[::-1]] = np.arange(len(names))[::-1]

    def names(self) -> list[bytes]:
        """The different units; a glued mark has a zero byte before it."""
        rows = zip(self.start[self.first].tolist(), self.end[self.first].tolist(), self.glued[self.first].tolist(), strict=True)
        return [b"\0" + self.raw[a:b] if g else self.raw[a:b] for a, b, g in rows]


def sorted_ids(parts: list[np.ndarray], size: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of units one after another, from ``parts`` that hold them in ``order``; ``size`` is each unit's number."""
    flat, own = np.concatenate([np.zeros(0, "<u4"), *parts]), size[order]
    at = np.zeros(len(size), np.int64)
    at[order] = np.cumsum(own) - own
    return gathered(flat, at, size), size


def gathered(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ranges of ``flat`` that begin at ``at``, one after another."""
    ends = np.cumsum(size)
    return flat[np.repeat(at - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


class UnitTable:
    """Ids of units, learned once each; holds ``max_units`` and those of the batch at hand. ``learn`` returns the ids of
    units one after another, and how many each has."""

    def __init__(self, learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], max_units: int = 300_000):
        self.learn, self.max_units = learn, max_units
        self.clear()

    def clear(self) -> None:
        self.known: defaultdict[bytes, int] = defaultdict(count().__next__)  # a new unit gets the next number
        self.flat, self.at, self.size = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def ids(self, units: Units) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all units one after another, the number of ids before each unit and at last of all)."""
        if len(self.known) > self.max_units:
            self.clear()
        names, learned = units.names(), len(self.known)
        which = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))
        if len(self.known) > learned:
            try:
                ids, size = self.learn([names[i] for i in np.flatnonzero(which >= learned).tolist()])
            except BaseException:
                self.clear()  # the new units have numbers, but no ids
                raise
            self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, ids])
        which = which[units.which]
        size = self.size[which]
        return gathered(self.flat, self.at[which], size), np.concatenate([[0], np.cumsum(size)])
