"""Embedding columns as numpy blocks inside tasks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(column: str) -> Column:
    """A vector without NULL or non-finite components; false for a NULL vector."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad, F.lit(False))


def below(column: str, bound: float) -> Column:
    """All components of a finite vector have a smaller magnitude than ``bound``."""
    return F.forall(column, lambda x: F.abs(x) < bound)


def common_size(vectors: DataFrame, column: str, step: int = 1) -> int | None:
    """The commonest length that is a positive multiple of ``step``; ties take the longer one."""
    sizes = vectors.select(F.size(column).alias("size")).where((F.col("size") > 0) & (F.col("size") % step == 0))
    top = sizes.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    return top["size"] if top else None


def matrix(batch: pa.RecordBatch, column: str, dim: int):
    """All vectors of a batch, one in each line."""
    import numpy as np

    values = batch.column(batch.schema.get_field_index(column)).flatten()
    return np.asarray(values.to_numpy(zero_copy_only=False), dtype="float64").reshape(-1, dim)
