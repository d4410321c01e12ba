"""The sparse matrix of one tree node inside a task, with the counts that both decision trees split by.

A group is a (term, value) that occurs; groups are numbered by term, then value. A node's counts per group and class come
from its own cells, or, for the child with most rows, from its parent's counts minus those of the other children. So a
cell is counted again only when it goes to a smaller child, and a long chain of splits that each take off a few rows costs
the counts of those rows. Nodes are taken from a stack, so no recursion limits the depth.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def codes(column) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct values, each row's place among them) of a string column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    d = pc.dictionary_encode(column)
    if isinstance(d, pa.ChunkedArray):
        d = d.combine_chunks()
    names = np.array(d.dictionary.to_pylist(), dtype=object).astype(str)
    order = np.argsort(names, kind="stable")
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    return names[order], place[d.indices.to_numpy(zero_copy_only=False)]


def places(key: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, each one's place among them) of numbers from 0 to ``span - 1``; without a sort where they lie close."""
    if span > 8 * len(key) + 1_000_000:
        return np.unique(key, return_inverse=True)
    seen = np.zeros(span, bool)
    seen[key] = True
    return np.flatnonzero(seen), (np.cumsum(seen, dtype=np.int32 if span < 2**31 else np.int64) - 1)[key]


class NodeCells:
    """``row``, ``term`` and ``value`` per cell; ``y`` is the class number of every row, of ``k`` classes."""

    def __init__(self, y: np.ndarray, k: int, row: np.ndarray, term: np.ndarray, value: np.ndarray):
        self.y, self.k, n = y, k, len(y)
        whole = value.astype(np.int64)
        if len(whole) and whole.min() >= 0 and (whole == value).all():          # counts
            values, v = places(whole, int(whole.max()) + 1)
            values = values.astype(value.dtype)
        else:
            values, v = np.unique(value, return_inverse=True)
        width = max(1, len(values))
        key, g = places(term.astype(np.int64) * width + v, (int(term.max()) + 1) * width if len(term) else 0)
        self.gt, self.gv = key // width, values[key % width]
        if (row[1:] < row[:-1]).any():
            by_row = np.argsort(row, kind="stable")
            row, g = row[by_row], g[by_row]
        self.row_ptr = np.searchsorted(row, np.arange(n + 1))
        small = len(key) * k < 2**31
        self.key = g.astype(np.int32 if small else np.int64) * k + y[row].astype(np.int32 if small else np.int64)   # cells by row: the group and the row's class
        self.post_ptr = np.concatenate([[0], np.cumsum(np.bincount(g, minlength=len(key)))])
        self.post_row = row[np.argsort(g, kind="stable")]         # cells by group: their rows
        self.here = np.zeros(n, bool)

    def size(self, rows: np.ndarray) -> int:
        return int((self.row_ptr[rows + 1] - self.row_ptr[rows]).sum())

    def counts(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(group * k + class, count) of the cells of ``rows``, each key once and sorted."""
        lens = self.row_ptr[rows + 1] - self.row_ptr[rows]
        total = int(lens.sum())
        at = np.repeat(self.row_ptr[rows] - np.cumsum(lens) + lens, lens) + np.arange(total)
        if total * 4 < len(self.gt) * self.k:
            return np.unique(self.key[at], return_counts=True)
        c = np.bincount(self.key[at], minlength=len(self.gt) * self.k)
        found = np.flatnonzero(c)
        return found, c[found]

    def present(self, rows: np.ndarray, whole: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(groups that occur, their counts per class) of a node; ``whole`` are its counts of all groups if it has them."""
        if whole is not None:
            m = whole.reshape(-1, self.k)
            groups = np.flatnonzero(m.any(axis=1))
            return groups, m[groups]
        key, c = self.counts(rows)
        g = key // self.k
        new = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool)
        m = np.zeros((int(new.sum()), self.k), np.int64)
        m[np.cumsum(new) - 1, key % self.k] = c
        return g[new], m

    def rows_of(self, rows: np.ndarray, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``rows``, groups) of the cells in groups ``first`` to ``end - 1`` of a node's sorted rows."""
        a, b = self.post_ptr[first], self.post_ptr[end]
        who = self.post_row[a:b]
        group = np.repeat(np.arange(first, end), np.diff(self.post_ptr[first:end + 1]))
        self.here[rows] = True
        hit = self.here[who]
        self.here[rows] = False
        return np.searchsorted(rows, who[hit]), group[hit]

    def children(self, parts: list[np.ndarray], whole: np.ndarray | None) -> list[np.ndarray | None]:
        """Counts of all groups for each child that has cells enough to be worth them; ``whole`` is the parent's and is used up."""
        cells = len(self.gt) * self.k
        largest = max(range(len(parts)), key=lambda i: len(parts[i]))
        out: list[np.ndarray | None] = [None] * len(parts)
        for i, rows in enumerate(parts):
            own = self.size(rows) > cells
            if i == largest and whole is not None or i != largest and not own and whole is None:
                continue
            if i == largest and not own:
                continue
            key, c = self.counts(rows)
            if i != largest and whole is not None:
                whole[key] -= c
            if own:
                out[i] = np.zeros(cells, np.int64)
                out[i][key] = c
        if whole is not None and self.size(parts[largest]) * 4 > cells:
            out[largest] = whole
        return out
