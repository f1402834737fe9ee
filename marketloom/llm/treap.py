"""K2-treap over a grid of terms and documents: quadtree cells with the largest impact below them.

The grid is padded to 2^h by 2^h. Level 0 is one cell; a cell that holds a point has a mask of its
four quarters and the largest value in it. Only cells that hold points are stored, level by level in
Morton order, so the children of a cell lie together and begin where the quarters of all cells
before it end: masks alone give the way down. Values are stored as what a cell has less than its
parent, since most equal it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ONES = np.array([bin(m).count("1") for m in range(16)], np.uint8)
BELOW = np.array([[bin(m & ((1 << q) - 1)).count("1") for q in range(4)] for m in range(16)], np.int64)


@dataclass
class Treap:
    """``masks[l]`` and ``peaks[l]`` of the cells of level ``l``; the last level has single points."""

    height: int
    masks: list[np.ndarray]
    peaks: list[np.ndarray]
    firsts: list[np.ndarray]

    @classmethod
    def build(cls, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, size: int) -> Treap:
        """From points that are unique per (row, column), with values below 2^31; ``size`` bounds both."""
        height = max(int(size - 1).bit_length(), 1)
        key = _spread(rows) << np.int64(1) | _spread(columns)
        order = np.argsort(key, kind="stable")
        key, peak = key[order], values[order].astype(np.int32)
        masks, peaks = [], [peak]
        for _ in range(height):
            up = key >> 2
            starts = np.flatnonzero(np.concatenate([[True], up[1:] != up[:-1]])) if len(up) else up
            quarter = (1 << (key & 3)).astype(np.uint8)
            masks.append(np.bitwise_or.reduceat(quarter, starts) if len(up) else quarter)
            peak = np.maximum.reduceat(peak, starts) if len(up) else peak
            peaks.append(peak)
            key = up[starts]
        masks.reverse()
        peaks.reverse()
        return cls(height, masks, peaks, [_firsts(m) for m in masks])

    def dump(self) -> tuple[bytes, bytes]:
        """Masks, and values as differences from the parent cell, of all levels from the top."""
        falls = [self.peaks[0]]
        for above, below, mask in zip(self.peaks, self.peaks[1:], self.masks):
            falls.append(np.repeat(above, ONES[mask]) - below)
        return np.concatenate([*self.masks, np.array([], np.uint8)]).tobytes(), np.concatenate(
            falls
        ).astype("<i4").tobytes()

    @classmethod
    def load(cls, height: int, masks: bytes, falls: bytes) -> Treap:
        flat, fall = np.frombuffer(masks, np.uint8), np.frombuffer(falls, "<i4")
        level, at, low = [], 0, len(fall[:1])
        peaks = [fall[:1]]
        for _ in range(height):
            mask = flat[at : at + len(peaks[-1])]
            at += len(mask)
            parent = np.repeat(peaks[-1], ONES[mask])
            peaks.append(parent - fall[low : low + len(parent)])
            low += len(parent)
            level.append(mask)
        return cls(height, level, peaks, [_firsts(m) for m in level])

    def step(self, level: int, cells: np.ndarray, half: np.ndarray, right: int) -> np.ndarray:
        """Cells of the next level: ``half`` of the rows, left or right half of the columns.

        A cell of -1 holds no point, nor does a quarter that is not in its mask.
        """
        mask = self.masks[level][cells]
        quarter = half * 2 + right
        held = (cells >= 0) & ((mask >> quarter.astype(np.uint8)) & 1 == 1)
        return np.where(held, self.firsts[level][cells] + BELOW[mask, quarter], -1)


def _firsts(masks: np.ndarray) -> np.ndarray:
    ends = np.cumsum(ONES[masks], dtype=np.int32)
    return ends - ONES[masks]


def _spread(numbers: np.ndarray) -> np.ndarray:
    """The bits of numbers below 2^31 at the even places of a 64-bit number."""
    x = numbers.astype(np.int64)
    for shift, keep in (
        (16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
        (2, 0x3333333333333333), (1, 0x5555555555555555),
    ):
        x = (x | x << np.int64(shift)) & np.int64(keep)
    return x


def best_columns(
    treap: Treap, rows: np.ndarray, weights: np.ndarray, ids: np.ndarray, k: int,
    found: list[tuple[int, int]], at_once: int = 64,
) -> list[tuple[int, int]]:
    """The ``k`` best of ``found`` and of the columns, as (-score, id) in order.

    A column's score is the sum of ``weights`` times its values in ``rows``; scores of 0 do not
    count. The paths of all rows go down together over ranges of columns. The sum of weighted
    cell maxima bounds every column of a range; ranges of the highest bound are opened first,
    ``at_once`` together, and those whose bound is below the k-th score found so far never. Equal
    scores go by id, so a range that can only equal the k-th score is still opened.
    """
    best = sorted(found)[:k]
    least = -best[k - 1][0] if len(best) == k else 1
    if len(treap.peaks[0]) == 0 or len(rows) == 0:
        return best
    cells = [np.zeros((1, len(rows)), np.int64)] + [np.zeros((0, len(rows)), np.int64)] * treap.height
    columns = [np.zeros(1, np.int64)] + [np.zeros(0, np.int64)] * treap.height
    bounds = [np.array([int(weights.sum()) * int(treap.peaks[0][0])])]
    bounds += [np.zeros(0, np.int64) for _ in range(treap.height)]
    while True:
        tops = [int(b.max()) if len(b) else -1 for b in bounds[: treap.height]]
        level = max(range(len(tops)), key=lambda i: (tops[i], i), default=None)
        if level is None or tops[level] < max(least, 1):
            return best
        bound = bounds[level]
        alive = np.flatnonzero(bound >= least)
        if len(alive) > at_once:
            order = np.argpartition(-bound[alive], at_once)
            taken, left = alive[order[:at_once]], alive[order[at_once:]]
        else:
            taken, left = alive, alive[:0]
        half = (rows >> (treap.height - 1 - level)) & 1
        new_cells, new_columns = [], []
        for right in (0, 1):
            new_cells.append(treap.step(level, cells[level][taken], half[None, :], right))
            new_columns.append(columns[level][taken] * 2 + right)
        cells[level], columns[level], bounds[level] = cells[level][left], columns[level][left], bound[left]
        below, names = np.concatenate(new_cells), np.concatenate(new_columns)
        peaks = treap.peaks[level + 1]
        score = np.where(below >= 0, peaks[below], 0).astype(np.int64) @ weights
        keep = score >= least
        below, names, score = below[keep], names[keep], score[keep]
        if level + 1 < treap.height:
            cells[level + 1] = np.concatenate([cells[level + 1], below])
            columns[level + 1] = np.concatenate([columns[level + 1], names])
            bounds[level + 1] = np.concatenate([bounds[level + 1], score])
        elif len(score):
            best = sorted([*best, *zip((-score).tolist(), ids[names].tolist())])[:k]
            least = -best[k - 1][0] if len(best) == k else 1
