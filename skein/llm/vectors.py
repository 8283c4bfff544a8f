"""What the vector operators share: which rows take part, and packing for Python."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec, dim) of the rows that take part: id and vector not null, no null
    or non-finite component, not all zero. Repeated ids are one vector, the least
    of theirs; other columns are not read, whatever their names. Vectors of floats
    stay so, which halves what is shuffled; all others become array<double>."""
    vec = F.col(vec_col) if dict(df.dtypes)[vec_col] == "array<float>" else F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("vec").alias("vec")).withColumn("dim", F.size("vec"))


def matrix(column) -> np.ndarray:
    """An Arrow list column of equal lengths as a matrix of doubles."""
    n = len(column)
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaled by the largest component first, so that nothing overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the pairs of rows a[i], b[i], in double precision."""
    a = a / np.abs(a).max(axis=1, keepdims=True)
    b = b / np.abs(b).max(axis=1, keepdims=True)
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))
