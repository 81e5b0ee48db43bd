"""Exact nearest vectors of a slice: short vectors lie in cells, and only cells that may hold one of a query's best are scored.

A cell knows its centre, the distance of its farthest vector and the box around its vectors: none of them is nearer to a query than the centre less that
distance, nor than the box, which bounds its score. Nothing is left out that could be among the best; a query for which too many cells remain is
scored against all vectors, some at a time.
"""

from __future__ import annotations

import math

import numpy as np

#: Vectors of a cell at least, and numbers of a vector up to which cells are made: long vectors lie far from every centre.
CELL_ROWS, CELL_SIZE = 64, 16
#: Numbers held at a time when cells are looked into, and vectors scored at a time without cells (for ``QUERY_ROWS`` queries).
HELD_NUMBERS, DENSE_ROWS = 4_000_000, 50_000
#: Scores that differ by no more are ties, which the final ranking decides; slack on the bounds, for the last digits of sums.
TIE, SLACK = 1e-9, 1e-12
#: Scores of a group, compared together.
GROUP_ITEMS = 64


def tops(scores: np.ndarray, top_k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, item) of the best finite scores of each row (no NaN); ties at the cut stay, the final ranking decides by id.

    The best of small groups come first: the ``top_k``-th of those is no more than the ``top_k``-th score, so that few groups have to be looked into.
    """
    groups = scores.shape[1] // GROUP_ITEMS
    if groups <= 4 * top_k:
        rows, places = [], []
        for i, row in enumerate(scores):
            usable = np.flatnonzero(np.isfinite(row))
            if len(usable) > top_k:
                cut = np.partition(row[usable], -top_k)[-top_k]
                usable = usable[row[usable] >= cut - TIE]
            rows.append(np.full(len(usable), i))
            places.append(usable)
        return np.concatenate(rows), np.concatenate(places)
    grouped = scores[:, : groups * GROUP_ITEMS].reshape(len(scores), groups, GROUP_ITEMS)
    best = grouped.max(axis=2)
    cut = np.partition(best, -top_k, axis=1)[:, -top_k] - TIE
    row, group = np.nonzero((best >= cut[:, None]) & np.isfinite(best))
    inside = grouped[row, group]
    hit, place = np.nonzero((inside >= cut[row, None]) & np.isfinite(inside))
    rest = scores[:, groups * GROUP_ITEMS :]
    last, at = np.nonzero((rest >= cut[:, None]) & np.isfinite(rest))
    rows, places = np.concatenate((row[hit], last)), np.concatenate((group[hit] * GROUP_ITEMS + place, at + groups * GROUP_ITEMS))
    order = np.lexsort((places, rows))
    return rows[order], places[order]


class Cells:
    """The vectors of a slice (all finite) with the code of their scope."""

    def __init__(self, vectors: np.ndarray, codes: np.ndarray):
        self.vectors, self.codes, self.mixed = vectors, codes, bool(len(codes)) and bool((codes != codes[0]).any())
        self.places = None
        count, size = vectors.shape
        if size > CELL_SIZE or count < CELL_ROWS**2:
            return
        cells, most = [np.arange(count)], max(CELL_ROWS, math.isqrt(count // 2))
        while len(cells[0]) > most:  # halves by number, however many vectors are equal, so that all are of like size
            cells = [half for own in cells for half in self._halves(own)]
        wide = max(map(len, cells))
        self.places = np.full((len(cells), wide), -1)
        for i, own in enumerate(cells):
            self.places[i, : len(own)] = own
        held = vectors[self.places]
        held[self.places < 0] = np.nan
        self.centres = np.nanmean(held, axis=1)
        self.reach = np.sqrt(np.nanmax(((held - self.centres[:, None, :]) ** 2).sum(axis=2), axis=1))
        self.low, self.high = np.nanmin(held, axis=1), np.nanmax(held, axis=1)
        self.held = np.nan_to_num(held)
        self.longest, self.inner = (self.held**2).sum(axis=2).max(axis=1), (self.centres**2).sum(axis=1)

    def _halves(self, own: np.ndarray) -> list[np.ndarray]:
        mine = self.vectors[own]
        along = (mine.max(axis=0) - mine.min(axis=0)).argmax()
        order = np.argpartition(mine[:, along], len(own) // 2)
        return [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]

    def _dense(self, asks: np.ndarray, scopes: np.ndarray | None, floor: np.ndarray, top_k: int):
        """Rows, places and scores from all vectors, ``DENSE_ROWS`` at a time."""
        found = []
        for start in range(0, len(self.vectors), DENSE_ROWS):
            scores = asks @ self.vectors[start : start + DENSE_ROWS].T
            allowed = scores >= floor[:, None]
            if scopes is not None:
                allowed &= scopes[:, None] == self.codes[None, start : start + DENSE_ROWS]
            row, place = tops(scores if allowed.all() else np.where(allowed, scores, -np.inf), top_k)
            found.append((row, place + start, scores[row, place]))
        return found

    def _inside(self, asks: np.ndarray, scopes: np.ndarray | None, floor: np.ndarray, row: np.ndarray, cell: np.ndarray):
        """Places and scores of the cells of each (query, cell); minus infinity below the floor and in other scopes."""
        scores, places = np.matmul(self.held[cell], asks[row][:, :, None])[:, :, 0], self.places[cell]
        fits = (scores >= floor[row, None]) & (places >= 0)
        if scopes is not None:
            fits &= self.codes[places] == scopes[row, None]
        scores[~fits] = -np.inf
        return places, scores

    def _above(self, asks: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distances from the centres (of queries of squared length ``own``), and what no vector of a cell can exceed by them."""
        apart = np.sqrt(np.maximum(own[:, None] + self.inner[None, :] - 2 * (asks @ self.centres.T), 0))
        return apart, (own[:, None] + self.longest[None, :] - np.maximum(apart - self.reach[None, :], 0) ** 2) / 2 + SLACK

    def _cells(self, asks: np.ndarray, scopes: np.ndarray | None, floor: np.ndarray, top_k: int):
        """Rows, places and scores from the cells; which queries need too many of them, and get none."""
        own = (asks**2).sum(axis=1)
        (apart, above), every = self._above(asks, own), np.arange(len(asks))
        first = min(above.shape[1], 2 + 2 * top_k // self.places.shape[1])
        near = np.argpartition(apart, first - 1, axis=1)[:, :first]
        places, scores = self._inside(asks, scopes, floor, np.repeat(every, first), near.ravel())
        places, scores = places.reshape(len(asks), -1), scores.reshape(len(asks), -1)
        least = np.maximum(floor, np.partition(scores, -top_k, axis=1)[:, -top_k] - TIE) if scores.shape[1] >= top_k else floor
        need = above >= least[:, None]
        np.put_along_axis(need, near, False, axis=1)
        many = need.sum(axis=1) > need.shape[1] // 2
        row, cell = np.nonzero((scores >= least[:, None]) & np.isfinite(scores) & ~many[:, None])
        found = [(row, places[row, cell], scores[row, cell])]
        row, cell = np.nonzero(need & ~many[:, None])
        beside = np.maximum(np.maximum(self.low[cell] - asks[row], asks[row] - self.high[cell]), 0)
        reached = (own[row] + self.longest[cell] - (beside**2).sum(axis=1)) / 2 + SLACK >= least[row]
        row, cell = row[reached], cell[reached]
        step = max(1, HELD_NUMBERS // self.held[0].size)
        for start in range(0, len(row), step):
            r, c = row[start : start + step], cell[start : start + step]
            places, scores = self._inside(asks, scopes, least, r, c)
            hit, at = np.nonzero(np.isfinite(scores))
            found.append((r[hit], places[hit, at], scores[hit, at]))
        return found, many

    def best(self, asks: np.ndarray, scopes: np.ndarray | None, floor: np.ndarray, top_k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(query, place, score)`` of the ``top_k`` best of at least ``floor`` in a query's scope (``None``: anywhere), and what ties with the last of them."""
        if scopes is not None and len(self.codes) and not self.mixed and (scopes == self.codes[0]).all():
            scopes = None
        sound = np.isfinite(asks).all(axis=1)
        if not sound.all():
            asks, floor = np.where(sound[:, None], asks, 0.0), np.where(sound, floor, np.inf)
        if not len(self.vectors) or not len(asks):
            found = []
        elif self.places is None:
            found = self._dense(asks, scopes, floor, top_k)
        else:
            found, many = self._cells(asks, scopes, floor, top_k)
            if many.any():
                back = np.flatnonzero(many)
                all_of = self._dense(asks[many], None if scopes is None else scopes[many], floor[many], top_k)
                found += [(back[rows], places, scores) for rows, places, scores in all_of]
        if not found:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        row, place, score = (np.concatenate(part) for part in zip(*found))
        order = np.lexsort((-score, row))  # the best first, query by query
        row, place, score = row[order], place[order], score[order]
        start = np.searchsorted(row, np.arange(len(asks) + 1))
        last = np.minimum(start[:-1] + top_k, start[1:]) - 1
        kept = score >= score[last[row]] - TIE
        return row[kept], place[kept], score[kept]
