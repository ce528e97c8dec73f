"""Integer vectors: scaled rows of an embedding table and exact inner products over them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tenderloom.session import cut_lineage

#: A component x counts as floor(SCALE * x).
SCALE = 256


def usable(vector: Column) -> Column:
    """Whether a vector is there and holds finite numbers only."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(finite(x.cast("double")), F.lit(False))), F.lit(False))


def integer_rows(df: DataFrame, vector: str, *keep: Column) -> DataFrame:
    """row (unique), the columns of keep, and x, the scaled vector; written once, so that row stays the same."""
    scaled = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    rows = df.filter(usable(F.col(vector))).select(*keep, scaled.alias("x"))
    return cut_lineage(rows.select(F.monotonically_increasing_id().alias("row"), "*"))


def flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of a column of lists, the row of each value and its place in its list."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(lists.offsets.to_numpy())
    owner = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), owner, place


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a column of lists; what a shorter list lacks is 0."""
    values, owner, place = flat(column)
    made = np.zeros((len(column), int(place.max()) + 1 if len(place) else 0), np.int64)
    made[owner, place] = values
    return made


def widened(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x


def largest(x: np.ndarray) -> int:
    return max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0


def number_kind(width: int, *sizes: int) -> type:
    """A type in which sums of width products of numbers up to these sizes are exact."""
    bound = max(width, 1)
    for s in sizes:
        bound *= max(s, 1)
    if bound < 1 << 53:
        return np.float64
    if bound < 1 << 63:
        return np.int64
    raise OverflowError("an inner product of these vectors may exceed a long")
