"""Vectors of numbers as the operators on embeddings take them: usable rows, whole-number components, packed blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Components beyond this size have no exact square sum in a long, for up to 2^10 of them; such a vector is an error.
LARGEST = 1 << 26
#: What whole numbers a double holds exactly.
_EXACT = 1 << 53


def usable(vec: Column, size: int | None = None) -> Column:
    """Whether a vector is there, has the size asked for, and holds finite numbers alone."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(finite & (F.lit(True) if size is None else F.size(vec) == size), F.lit(False))


def whole_numbers(vec: Column, scale: int) -> Column:
    """floor(scale * x) of each component x, as doubles that are whole."""
    return F.transform(vec, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))


def matrix(col: pa.Array, size: int) -> np.ndarray:
    """Rows of equal size as one array of longs; a component beyond LARGEST is an error."""
    flat = col.flatten().to_numpy(zero_copy_only=False)
    if len(flat) and np.abs(flat).max() > LARGEST:
        raise ValueError(f"a component beyond {LARGEST} after scaling: its products don't fit a long")
    return flat.astype(np.int64).reshape(-1, size)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two arrays of longs: through doubles where these are exact, else in longs."""
    most = a.shape[1] * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    if most < _EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most >= 1 << 63:
        raise ValueError("inner products don't fit a long")
    return a @ b.T
