"""Sums over branches for all pairs of two tiles of samples: a vectorised kernel over Arrow batches.

Rows come sorted by tile pair and branch. Branches are taken some at a time as two dense matrices (samples by branches),
so memory is bounded by the tile's size whatever the number of branches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows that are taken together; branches of a matrix.
ROWS, BRANCHES = 200_000, 4_096
SCHEMA = "rep int, ord_i int, ord_j int, top double, bottom double"
_KEYS = ("rep", "tile_i", "tile_j", "part")


class TilePair:
    """Sums of numerator and denominator for the pairs of one tile pair."""

    def __init__(self, family: str, alpha: float, adjusted: bool, rep: int, tile_i: int, tile_j: int, size: int) -> None:
        self.family, self.alpha, self.adjusted = family, alpha, adjusted
        self.rep, self.first, self.size = rep, (tile_i * size, tile_j * size), size
        self.top, self.bottom = np.zeros((size, size)), np.zeros((size, size))
        self.totals = np.zeros(size), np.zeros(size)

    def add(self, ords: np.ndarray, branches: np.ndarray, lengths: np.ndarray, counts: np.ndarray, totals: np.ndarray) -> None:
        """Rows of some whole branches."""
        starts = np.flatnonzero(np.concatenate([[True], branches[1:] != branches[:-1]]))
        for k in range(0, len(starts), BRANCHES):
            own = starts[k : k + BRANCHES]
            a, b = own[0], starts[k + BRANCHES] if k + BRANCHES < len(starts) else len(ords)
            column = np.repeat(np.arange(len(own)), np.diff(np.append(own, b)))
            sides = []
            for first, t in zip(self.first, self.totals, strict=True):
                at = ords[a:b] - first
                inside = (at >= 0) & (at < self.size)
                c = np.zeros((self.size, len(own)))
                c[at[inside], column[inside]] = counts[a:b][inside]
                t[at[inside]] = totals[a:b][inside]
                sides.append((c, t))
            self._sum(lengths[own], *sides)

    def _sum(self, length: np.ndarray, left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> None:
        (c, t), (d, u) = left, right
        if self.family.startswith("unweighted"):
            x, y = (c > 0).astype(float), (d > 0).astype(float)
        else:
            x, y = (np.divide(v, n[:, None], out=np.zeros_like(v), where=n[:, None] > 0) for v, n in (left, right))
        if self.family.startswith("unweighted") and not self.adjusted:
            # of two presences the difference and the union follow from what both have
            both = (x * length) @ y.T
            alone = (x @ length)[:, None] + (y @ length)[None, :]
            self.top += alone - 2 * both
            self.bottom += alone - both
            return
        for i in range(self.size):
            upper = np.abs(x[i] - y)
            lower = np.maximum(x[i], y) if self.family.startswith("unweighted") else x[i] + y
            if self.family == "generalized":
                some = lower > 0
                upper *= np.power(lower, self.alpha - 1.0, out=np.zeros_like(lower), where=some)
                lower = np.power(lower, self.alpha, out=np.zeros_like(lower), where=some)
            if self.adjusted:
                m = c[i] + d
                spread = m * (t[i] + u[:, None] - m)
                weight = np.divide(1.0, np.sqrt(np.maximum(spread, 0.0)), out=np.zeros_like(m), where=spread > 0)
                upper, lower = upper * weight, lower * weight
            self.top[i] += upper @ length
            self.bottom[i] += lower @ length

    def rows(self) -> pa.RecordBatch:
        i, j = np.indices(self.top.shape)
        i, j = i + self.first[0], j + self.first[1]
        keep = (i < j) & ((self.top != 0) | (self.bottom != 0))
        n = int(keep.sum())
        columns = [np.full(n, self.rep, dtype=np.int32), i[keep].astype(np.int32), j[keep].astype(np.int32), self.top[keep], self.bottom[keep]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["rep", "ord_i", "ord_j", "top", "bottom"])


def summed(family: str, alpha: float, adjusted: bool):
    """For mapInArrow: rows (rep, tile_i, tile_j, part, size, ord, node_id, length, c, t), sorted by the first four and
    node_id, to SCHEMA. With variance adjustment the first rows of each part have no branch ('') but all totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, key, held, n = None, None, [], 0

        def take(rows: pa.Table, last: bool) -> pa.Table | None:
            """Adds whole branches; returns the rows of the last one if more of it may follow."""
            codes = rows.column("node_id").combine_chunks().dictionary_encode().indices.to_numpy()
            end = len(codes) if last else int(np.flatnonzero(codes != codes[-1]).max(initial=-1)) + 1
            if end:
                now = rows.slice(0, end)
                pair.add(now.column("ord").to_numpy(), codes[:end], *(now.column(k).to_numpy() for k in ("length", "c", "t")))
            return rows.slice(end) if end < len(codes) else None

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in _KEYS])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if (own := tuple(keys[:, a].tolist())) != key:
                    if pair is not None:
                        if held:
                            take(pa.Table.from_batches(held), True)
                        yield pair.rows()
                    held, n, key = [], 0, own
                    pair = TilePair(family, alpha, adjusted, *own[:3], batch.column("size")[a].as_py())
                held.append(batch.slice(a, b - a))
                n += b - a
                if n >= ROWS:
                    rest = take(pa.Table.from_batches(held), False)
                    held, n = (rest.combine_chunks().to_batches(), 0) if rest is not None else ([], 0)
        if pair is not None:
            if held:
                take(pa.Table.from_batches(held), True)
            yield pair.rows()

    return run
