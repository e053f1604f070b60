"""Vector algebra on numpy matrices: what the driver's forms and the numpy tiers of the operators share."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa

from lateview.functions.vec import FLOOR


def checked(value: Any, shape: str, finite: str) -> np.ndarray:
    """``value`` as a matrix of doubles; ValueError ``shape`` if it is no matrix or empty, ``finite`` if it holds NaN or an infinity."""
    m = np.asarray(value, dtype=float)
    if m.ndim != 2 or 0 in m.shape:
        raise ValueError(shape)
    if not np.isfinite(m).all():
        raise ValueError(finite)
    return m


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Every row over its length, or over the floor where that is longer."""
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), FLOOR)


def maxsim(query: np.ndarray, document: np.ndarray) -> float:
    """Sum over query rows of the largest scalar product with a document row; rows are unit rows."""
    return float((query @ document.T).max(axis=1).sum())


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """An array<array<double>> column of one width: all rows as one matrix, and where each value's rows begin and end."""
    ends = column.offsets.to_numpy()
    rows = column.values
    inner = rows.offsets.to_numpy()
    values = rows.values.to_numpy(zero_copy_only=False)
    width = int(inner[ends[0] + 1] - inner[ends[0]]) if ends[-1] > ends[0] else 1
    return values[inner[ends[0]] : inner[ends[-1]]].reshape(-1, width), ends - ends[0]


def each(column: pa.Array) -> Iterator[np.ndarray]:
    """Every value of an array<array<double>> column as a matrix of its own; a null, empty or ragged one comes as an empty matrix."""
    ends = column.offsets.to_numpy()
    inner = column.values.offsets.to_numpy()
    values = column.values.values.to_numpy(zero_copy_only=False)
    for a, z in zip(ends[:-1], ends[1:]):
        width = np.diff(inner[a : z + 1])
        even = len(width) and width[0] and (width == width[0]).all()
        yield values[inner[a] : inner[z]].reshape(z - a, width[0]) if even else np.zeros((0, 0))


#: Products of a query row and a document row that are held at once.
HELD = 1 << 22


def maxsim_of_rows(queries: np.ndarray, sizes: Sequence[int], column: pa.Array) -> np.ndarray:
    """MaxSim ``[query, item]`` of queries (their unit rows one after another, ``sizes`` of each) and the items of a column."""
    rows, ends = flat(column)
    out = np.empty((len(sizes), len(ends) - 1))
    starts = np.cumsum([0, *sizes])[:-1]
    step = max(1, HELD // max(1, len(queries)))
    first = 0
    while first < len(ends) - 1:  # whole items, as many as fit
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + step, "right")) - 1)
        each = queries @ rows[ends[first] : ends[last]].T
        best = np.maximum.reduceat(each, ends[first:last] - ends[first], axis=1)
        out[:, first:last] = np.add.reduceat(best, starts, axis=0)
        first = last
    return out


def best(scores: np.ndarray, ids: pa.Array, k: int) -> np.ndarray:
    """Positions of the ``k`` best scores; of equal ones those of the smaller ids."""
    if len(scores) <= k:
        return np.arange(len(scores))
    edge = -np.partition(-scores, k - 1)[k - 1]
    at = np.flatnonzero(scores >= edge)
    names = np.array([x.encode() for x in ids.take(pa.array(at)).to_pylist()], object)
    return at[np.lexsort((names, -scores[at]))[:k]]
