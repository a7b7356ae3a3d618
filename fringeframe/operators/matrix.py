"""Normal equations as aggregates: Gram matrices and data vectors of few columns over any number of rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gram_of_arrays(rows: DataFrame, array: str) -> DataFrame:
    """(i, j, f): A'A for rows of arrays of one length, i <= j. A task adds the products of its batches to one matrix and emits it once; rows with a null are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for batch in batches:
            lists = batch.column(0).drop_null()
            if not len(lists):
                continue
            m = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
            m = m[np.isfinite(m).all(axis=1)]
            total = m.T @ m if total is None else total + m.T @ m
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "f"])

    return rows.select(array).mapInArrow(run, "i int, j int, f double").groupBy("i", "j").agg(F.sum("f").alias("f"))


def normal_equations(rows: DataFrame, columns: Sequence[Column], target: Column, weight: Column) -> DataFrame:
    """One row: sums f_i_j = sum w a_i a_j (i <= j), d_i = sum w a_i y and c = sum w y y."""
    n = len(columns)
    sums = [F.sum(weight * columns[i] * columns[j]).alias(f"f_{i}_{j}") for i in range(n) for j in range(i, n)]
    return rows.agg(*sums, *(F.sum(weight * c * target).alias(f"d_{i}") for i, c in enumerate(columns)), F.sum(weight * target * target).alias("c"), F.count(F.lit(1)).alias("n"))
