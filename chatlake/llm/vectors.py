"""Helpers of the operators on vectors: usable rows as integers, matrices from Arrow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(table: DataFrame, scale: int, *more: str) -> DataFrame:
    """(vec_id, x, *more) of the rows whose vector is whole: x = floor(scale * component), an array of longs.

    Rows whose vector is null, empty, or holds null or non-finite components go.  Repeated rows stay
    repeated; columns not named are not read.
    """
    whole = F.coalesce((F.size("embedding") > 0) & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False))
    return table.filter(whole).select(F.col("vec_id").cast("long").alias("vec_id"),
                                      F.transform("embedding", lambda v: F.floor(v.cast("double") * scale)).alias("x"), *more)


def common_width(rows: DataFrame) -> int:
    """The number of components that most rows have (the larger one of a tie); 0 without rows."""
    found = rows.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    return found.width if found else 0


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column whose lists are equally long, without nulls."""
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def narrow(x: np.ndarray) -> np.ndarray:
    """The same integers in the smallest of the types of 2, 4 and 8 bytes that holds them."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    for kind in (np.int16, np.int32):
        if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max:
            return x.astype(kind)
    return x.astype(np.int64)


def unpacked(data: bytes, width: int, rows: int) -> np.ndarray:
    """The matrix whose ``narrow`` bytes are ``data``."""
    return np.frombuffer(data, dtype=f"<i{len(data) // (width * rows)}").reshape(rows, width)
