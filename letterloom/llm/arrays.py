"""Numpy helpers for Arrow batches inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column end to end, and the row offsets into them. Null rows are
    empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        column = pa.array([], column.type)
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    offsets = np.zeros(len(column) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return column.flatten(), offsets


def forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For every vertex below ``n`` the smallest vertex of its group under links x-y."""
    label = np.arange(n)
    while len(x):
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        open_ = label[x] != label[y]
        x, y = label[x[open_]], label[y[open_]]
    return label
