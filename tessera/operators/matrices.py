"""Tall matrices: a row of a DataFrame is a matrix row, columns are few; what reaches the driver is columns x columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.stats import gram


def gram_matrix(df: DataFrame, cols: list[str]) -> np.ndarray:
    at = {c: i for i, c in enumerate(cols)}
    out = np.zeros((len(cols), len(cols)))
    for r in gram(df, cols).collect():  # as many rows as pairs of columns
        out[at[r["a"]], at[r["b"]]] = out[at[r["b"]], at[r["a"]]] = r["value"] or 0.0
    return out


def gram_times(df: DataFrame, cols: list[str], vector: list[float]) -> DataFrame:
    """name, value: the Gram matrix times a vector in one pass, without the matrix."""
    x = [F.col(f"`{c}`").cast("double") for c in cols]
    along = sum((a * F.lit(float(v)) for a, v in zip(x, vector, strict=True)), F.lit(0.0))
    sums = df.agg(*(F.sum(a * along).alias(f"c{k}") for k, a in enumerate(x)))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"c{k}").alias("value")) for k, c in enumerate(cols)))).alias("r")).select("r.*")


def multiply(df: DataFrame, cols: list[str], matrix: np.ndarray, names: list[str]) -> DataFrame:
    """Add the columns ``names``: the row times a local matrix (columns x names)."""

    def product(k: int) -> Column:
        return sum((F.col(f"`{c}`").cast("double") * F.lit(float(matrix[i, k])) for i, c in enumerate(cols)), F.lit(0.0))

    return df.withColumns({n: product(k) for k, n in enumerate(names)})


def singular_values(df: DataFrame, cols: list[str], k: int, condition: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest singular values and right vectors (as columns, largest entry positive), from the Gram matrix.

    Values below ``condition`` times the largest are left out.
    """
    values, vectors = np.linalg.eigh(gram_matrix(df, cols))
    order = np.argsort(-values)[:k]
    s = np.sqrt(np.maximum(values[order], 0.0))
    order, s = order[s > condition * max(s.max(initial=0.0), 1e-300)], s[s > condition * max(s.max(initial=0.0), 1e-300)]
    v = vectors[:, order]
    return s, v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1.0, 1.0)


def left_vectors(df: DataFrame, cols: list[str], s: np.ndarray, v: np.ndarray, names: list[str]) -> DataFrame:
    """Add the entries of the left singular vectors of each row."""
    return multiply(df, cols, v / s, names)


def tall_qr(df: DataFrame, cols: list[str], names: list[str] | None = None) -> tuple[np.ndarray, DataFrame]:
    """R (upper triangle, positive diagonal) and the rows with those of Q added, for independent columns.

    R is the Cholesky factor of the Gram matrix, taken a second time from Q for exact digits.
    """
    names = names or [f"q_{c}" for c in cols]
    first = np.linalg.cholesky(gram_matrix(df, cols)).T
    rows = multiply(df, cols, np.linalg.inv(first), names)
    second = np.linalg.cholesky(gram_matrix(rows, names)).T
    return second @ first, multiply(df, cols, np.linalg.inv(second @ first), names)
