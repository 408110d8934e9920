"""Anchors: content-defined places that stand for all windows around them.

A window of ``length`` symbols (bytes or words) has ``span + 1`` grams of ``length - span``
symbols.  Its anchor is its leftmost gram with the smallest value.  The value depends on the gram alone,
so equal windows have the same anchor at the same place, and one anchor stands for some
``span / 2`` windows.  A window that begins ``l`` symbols before its anchor (its level) equals another if the
``l`` symbols before the anchors and the ``length - l`` from them on are equal.  So it is enough to
send, for each anchor, what stands around it once, and to extend it on both sides where anchors meet.
"""

from __future__ import annotations

import numpy as np

from .common import Grouped

#: A value that no anchor may have.
NEVER = np.uint32(0xFFFFFFFF)


def spans_of(length: int) -> int:
    """How far an anchor may lie behind the start of its window."""
    return min(25, length // 2)


def smallest_places(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest value of every run of ``width`` values, and how far from its start it lies (the leftmost)."""
    n, y, at = 1, values, np.zeros(len(values), np.uint8)
    while n < width and len(y) > 0:
        step = min(n, width - n)
        right = y[step:] < y[:-step]
        at = np.where(right, at[step:] + np.uint8(step), at[:-step])
        y = np.where(right, y[step:], y[:-step])
        n += step
    return y, at


class Anchors:
    """Anchors of the windows that start where ``valid`` says so: places, and the levels of their windows."""

    def __init__(self, values: np.ndarray, valid: np.ndarray, span: int) -> None:
        low = np.zeros(0, np.int64)
        if len(values) > span:
            least, offset = smallest_places(values, span + 1)
            low = np.flatnonzero(valid[: len(least)] & (least < NEVER))
            anchor = low + offset[low]
        if not len(low):
            self.place = self.low = self.high = np.zeros(0, np.int64)
            return
        # Anchors never step back from one window to the next, so windows of one anchor are neighbours.
        new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.append(new[1:], len(low)) - 1
        self.place = anchor[new]
        self.low, self.high = self.place - low[last], self.place - low[new]

    def pick(self, mine: np.ndarray) -> None:
        self.place, self.low, self.high = self.place[mine], self.low[mine], self.high[mine]

    def covered(self, bits: np.ndarray, size: int, length: int) -> np.ndarray:
        """Symbols under the windows whose level is set in the bits of their anchor."""
        bad = np.zeros(size + 1, np.int32)
        for level in range(int(self.high.max(initial=-1)) + 1):
            bad[1:][self.place[(bits >> np.uint32(level)) & np.uint32(1) > 0] - level] = 1
        total = np.cumsum(bad)
        gone = total[1:].copy()
        if size > length:
            gone[length:] -= total[1 : size - length + 1]
        return gone > 0


def level_bits(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Bits of all levels from ``low`` to ``high``."""
    one = np.uint64(1)
    return ((one << (high + 1).astype(np.uint64)) - (one << low.astype(np.uint64))).astype(np.uint32)


def smaller_elsewhere(low: np.ndarray, high: np.ndarray, ids: np.ndarray, classes, span: int) -> np.ndarray:
    """For each context the bits of the levels whose window a smaller document also holds.

    ``classes(level)`` gives two numbers for every context: equal windows have equal numbers.
    """
    bits = np.zeros(len(ids), np.uint32)
    for level in range(span + 1):
        mine = np.flatnonzero((low <= level) & (level <= high))
        if len(mine) < 2:
            continue
        left, right = classes(level)
        g = Grouped(left[mine].astype(np.int64) << 32 | right[mine].astype(np.int64))
        bits[mine[ids[mine] > g.least(ids[mine])[g.group]]] |= np.uint32(1 << level)
    return bits
