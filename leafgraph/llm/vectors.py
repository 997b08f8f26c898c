"""Tables of vectors: which take part, and their Arrow columns as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, ids: str, vector: str) -> DataFrame:
    """The rows with an id and a vector, all finite and not all zero; ``v`` is it in double precision, ``dims`` its length."""
    rows = rows.where(F.col(ids).isNotNull() & F.col(vector).isNotNull()).where(F.expr(f"forall({vector}, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists({vector}, x -> x <> 0)"))
    return rows.withColumns({"v": F.col(vector).cast("array<double>"), "dims": F.size(vector)})


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of equally long lists as rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def scaled(v: np.ndarray) -> np.ndarray:
    """The rows times powers of two that bring their largest components near one: exact, and cosines stay, but nothing overflows."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1]) if len(v) else v


def by_length(column: pa.Array | pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The places and the matrix of each length among a column of lists."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    places = [np.flatnonzero(sizes == n) for n in np.unique(sizes)]
    return [(at, matrix(column.take(pa.array(at)))) for at in places]


def sample_matrix(rows: DataFrame, ids: str, bound: int) -> np.ndarray:
    """The vectors, all of one length, of at most ``bound`` rows, chosen by a hash of the id."""
    return matrix(sample_lists(rows, ids, bound))


def sample_lists(rows: DataFrame, ids: str, bound: int) -> pa.ChunkedArray:
    """The vectors of at most ``bound`` rows, chosen by a hash of the id."""
    return rows.orderBy(F.xxhash64(ids), ids).limit(bound).select("v").toArrow().column(0)
