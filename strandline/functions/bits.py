"""Blocks on a grid as rows of bits: a row of 64 cells is a number, so what a block shows of itself costs a few operations instead of one a cell."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BELOW = np.array([(1 << k) - 1 for k in range(65)], np.uint64)  # the lowest k bits


def spans(lo: np.ndarray, hi: np.ndarray, words: int) -> np.ndarray:
    """[n, words]: bits lo to hi - 1 of rows of 64 * words cells."""
    base = 64 * np.arange(words)
    a, b = (np.clip(v[:, None] - base, 0, 64) for v in (lo, hi))
    return _BELOW[b] & ~_BELOW[np.minimum(a, b)]


def laid(at: np.ndarray, x0: np.ndarray, y0: np.ndarray, w: np.ndarray, h: np.ndarray, frames: int, grid_w: int, grid_h: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(records, cells): numbers of records of different frames and the cells [k, grid_h, words] in which these are seen.

    at: the frame of each record, ascending, records in order.  A frame's last record hides those before it, so the last ones come first.
    """
    words = -(-grid_w // 64)
    covered = np.zeros((frames, grid_h, words), np.uint64)
    back = np.searchsorted(at, at, "right") - 1 - np.arange(len(at))
    order = np.argsort(back, kind="stable")
    ends = np.searchsorted(back[order], np.arange(back.max(initial=-1) + 1), "right").tolist()  # none without records
    y = np.arange(grid_h)
    for lo, hi in zip([0, *ends], ends):
        r = order[lo:hi]
        row = spans(np.clip(x0[r], 0, grid_w), np.clip(x0[r] + w[r], 0, grid_w), words)
        inside = (y >= y0[r, None]) & (y < (y0[r] + h[r])[:, None])
        block = np.where(inside[:, :, None], row[:, None, :], np.uint64(0))
        yield r, block & ~covered[at[r]]
        covered[at[r]] |= block


class Tiles:
    """Tiles of size x size cells: which of them a set of cells touches, and how many of their cells it holds."""

    def __init__(self, size: int, grid_w: int, grid_h: int):
        self.rows = np.arange(0, grid_h, size)
        lo = np.arange(0, grid_w, size)
        self.columns = spans(lo, np.minimum(lo + size, grid_w), -(-grid_w // 64))
        self.shape = len(self.rows), len(lo)

    def touched(self, cells: np.ndarray) -> np.ndarray:
        any_row = np.bitwise_or.reduceat(cells, self.rows, axis=1)
        return ((any_row[:, :, None, :] & self.columns) != 0).any(-1)

    def counts(self, cells: np.ndarray) -> np.ndarray:
        own = np.bitwise_count(cells[:, :, None, :] & self.columns).sum(-1, dtype=np.int64)
        return np.add.reduceat(own, self.rows, axis=1)
