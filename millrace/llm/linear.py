"""Logistic regression by Newton's method, and samples of labelled rows with a bound."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, l2: float, steps: int = 25, free: int | None = None) -> np.ndarray:
    """Weights w for sigmoid(x @ w). free: the column (an intercept) that isn't held down."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], l2)
    if free is not None:
        penalty[free] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ w)
        h = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * h[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def held_out(id_col: str) -> Column:
    """Rows that no label is learned from: crc32 of the id as text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(labels: DataFrame, label: str, each: int, id_col: str = "doc_id", extra: list[str] = ()) -> DataFrame:
    """id, label and the columns `extra`: of each of the two classes of `label` the `each` rows whose hashed ids are
    smallest; held-out rows and rows without an id or label never. Of an id's rows in a class the least counts."""
    rows = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("label"), *extra).where(~held_out("id") & F.col("id").isNotNull())
    least = F.min(F.struct("label", *extra)).alias("own")
    own = [rows.where(F.col("label") == v).groupBy("id").agg(least).orderBy(F.xxhash64("id", F.lit(29)), "id").limit(each) for v in (0, 1)]
    return own[0].unionByName(own[1]).select("id", "own.*")


def labelled_rows(labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """id and label of every row of the two classes that isn't held out and has an id; of rows that repeat one."""
    rows = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("label"))
    return rows.where(~held_out("id") & F.col("id").isNotNull() & F.col("label").isin(0, 1)).distinct()
