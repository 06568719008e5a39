"""Vector columns as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """True for vectors with components that are all there and finite."""
    whole = F.col(vector).isNotNull() & (F.size(vector) > 0)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(whole & finite, F.lit(False))


def matrix(column: pa.Array, dtype) -> np.ndarray:
    """The rows of a list column, all of one length and without nulls."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(len(column), -1)


def byte_matrix(column: pa.Array) -> np.ndarray:
    """The rows of a binary column, all of one length, as uint8."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)
