"""What the operators on embedding vectors share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, vector_col: str, multiple: int = 1) -> DataFrame:
    """Rows whose vector has components, their number a multiple of ``multiple``, none of them null or not finite.

    The vector becomes ``_vector``, an array of doubles.
    """
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall("_vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.withColumn("_vector", vector).where(F.col("_vector").isNotNull() & (F.size("_vector") > 0) & (F.size("_vector") % multiple == 0) & F.coalesce(finite, F.lit(False)))


def by_id(id_col: str) -> list[Column]:
    """Ascending id, null last, then by the vector itself."""
    ident = F.col(f"`{id_col}`")
    return [ident.isNull(), ident, F.col("_vector")]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of an Arrow column as the rows of an array of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
