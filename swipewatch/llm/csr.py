"""Sparse matrices by compressed rows, and their row-wise product."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``starts[0], starts[0]+1, ..`` for ``lengths[0]`` numbers, then from ``starts[1]``, and so on."""
    ends = np.cumsum(lengths, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - (ends - lengths), lengths)


@dataclass
class Csr:
    """Row ``i`` has ``values[indptr[i]:indptr[i+1]]`` in the columns ``indices[..]`` of ``width``."""

    indptr: np.ndarray
    indices: np.ndarray
    values: np.ndarray
    width: int

    @property
    def height(self) -> int:
        return len(self.indptr) - 1

    @classmethod
    def of_runs(cls, ends: np.ndarray, width: int) -> "Csr":
        """Incidence of consecutive runs with their places: run ``i`` has the columns from ``ends[i-1]`` to ``ends[i]``."""
        indptr = np.concatenate([[0], ends]).astype(np.int64)
        return cls(indptr, np.arange(width, dtype=np.int64), np.ones(width, np.int64), width)

    @classmethod
    def of_labels(cls, labels: np.ndarray, width: int) -> "Csr":
        """One entry a row: row ``i`` has column ``labels[i]``."""
        n = len(labels)
        return cls(np.arange(n + 1, dtype=np.int64), labels.astype(np.int64), np.ones(n, np.int64), width)

    def transposed(self) -> "Csr":
        rows = np.repeat(np.arange(self.height, dtype=np.int64), np.diff(self.indptr))
        counts = np.bincount(self.indices, minlength=self.width)
        # places in the order of columns; rows come in order already
        ordered = len(self.indices) < 2 or bool((self.indices[1:] >= self.indices[:-1]).all())
        order = slice(None) if ordered else np.argsort(self.indices, kind="stable")
        indptr = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        return Csr(indptr, rows[order], self.values[order], self.height)

    def times(self, other: "Csr") -> "Csr":
        """Gustavson's product: row ``i`` is the sum of the rows of ``other`` that row ``i`` names, each times its value."""
        if self.width != other.height:
            raise ValueError(f"{self.width} columns times {other.height} rows")
        sizes = np.diff(other.indptr)[self.indices]
        at = spread(other.indptr[self.indices], sizes)
        rows = np.repeat(np.repeat(np.arange(self.height, dtype=np.int64), np.diff(self.indptr)), sizes)
        columns = other.indices[at]
        values = np.repeat(self.values, sizes) * other.values[at]
        # accumulate what falls on the same place of a row
        key = rows * max(1, other.width) + columns
        if len(key) and not (key[1:] >= key[:-1]).all():
            order = np.argsort(key, kind="stable")
            key, values = key[order], values[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        sums = np.add.reduceat(values, first) if len(first) else values
        rows, columns = key[first] // max(1, other.width), key[first] % max(1, other.width)
        indptr = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=self.height))]).astype(np.int64)
        return Csr(indptr, columns, sums, other.width)

    def rows(self) -> np.ndarray:
        """Row number of each entry."""
        return np.repeat(np.arange(self.height, dtype=np.int64), np.diff(self.indptr))
