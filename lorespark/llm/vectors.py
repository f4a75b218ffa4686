"""Parts that the vector operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F


def usable(col: str = "embedding", empty: bool = False) -> F.Column:
    """Whether a vector is there, has components (unless ``empty`` ones will do), and none of them is null, NaN or infinite."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf")))
    return F.coalesce(((F.size(col) > 0) | F.lit(empty) & F.col(col).isNotNull()) & ~F.exists(col, bad), F.lit(False))


def matrix(blobs, dtype, width: int | None = None) -> np.ndarray:
    """Rows of binary vectors as a matrix; shorter ones are padded with zeros."""
    rows = [np.frombuffer(b, dtype) for b in blobs]
    wide = max([width or 0, *map(len, rows)])
    if all(len(r) == wide for r in rows):
        return np.frombuffer(b"".join(blobs), dtype).reshape(len(rows), wide).copy()
    out = np.zeros((len(rows), wide), dtype)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def lists(col: pa.Array) -> list[np.ndarray]:
    """A list column without nulls as one array per row."""
    off = col.offsets.to_numpy()
    flat = col.values.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]
