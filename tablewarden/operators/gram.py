"""Sums over all pairs of columns in one pass: masked Gram blocks per task, added up by pair.

With Z the values, zero where missing, and M the mask of present ones, MᵀM counts the common rows of every pair, ZᵀM and
(Z²)ᵀM hold a column's sums over the rows of the other, and ZᵀZ the products. A task keeps these four blocks, whatever the
number of its rows, and hands on one row per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows that a task multiplies at a time.
BLOCK_ROWS = 1024
SUMS = ["n", "x", "y", "xx", "yy", "xy"]


def pair_sums_of_all(values: DataFrame) -> DataFrame:
    """``i, j, n, x, y, xx, yy, xy`` for i < j: sums over the rows where both double columns i and j are present.

    Columns without common rows have zero sums; a table without rows gives no rows.
    """
    width = len(values.columns)
    i, j = np.triu_indices(width, 1)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, square, product = (np.zeros((width, width)) for _ in range(4))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                z = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in part.columns])
                m = ~np.isnan(z)
                z = np.where(m, z, 0.0)
                m = m.astype(np.float64)
                count += m.T @ m
                total += z.T @ m
                square += (z * z).T @ m
                product += z.T @ z
        sums = [count[i, j], total[i, j], total[j, i], square[i, j], square[j, i], product[i, j]]
        for at in range(0, len(i), 100_000):
            cut = slice(at, at + 100_000)
            columns = [pa.array(i[cut].astype(np.int32)), pa.array(j[cut].astype(np.int32)), *[pa.array(s[cut]) for s in sums]]
            yield pa.RecordBatch.from_arrays(columns, ["i", "j", *SUMS])

    each = values.mapInArrow(add, "i int, j int, " + ", ".join(f"{s} double" for s in SUMS))
    return each.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in SUMS])
