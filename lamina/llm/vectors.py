"""Tables of vectors as the operators on vectors read them: one row for an id, all of one length, finite components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, vector_col: str, *, limit: float | None = None, width: int | None = None) -> DataFrame:
    """Rows whose vector holds no null and no non-finite component, none of magnitude ``limit`` or more, and has the length that most
    such rows have (the shorter one of two that are as frequent), or ``width``."""
    x = F.col(vector_col)
    good = vectors.where(x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < F.lit(float("inf") if limit is None else limit))))
    if width is not None:
        return good.where(F.size(x) == width)
    sizes = good.groupBy(F.size(x).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return good.where(F.size(x) == (sizes["d"] if sizes else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a batch, a row each, in double precision."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))
