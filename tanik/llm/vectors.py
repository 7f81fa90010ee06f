"""Helpers for tables of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def usable(vector: Column) -> Column:
    """True for a vector that is not null or empty, has only finite components, and one that is not 0."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def as_double(vector: Column) -> Column:
    """The vector in double precision, -0.0 written as 0.0 so that equal vectors are equal."""
    return F.transform(vector, lambda x: x.cast("double") + 0.0)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of equal length as rows of doubles."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(whole, pa.ChunkedArray):
        whole = pa.concat_arrays(whole.chunks)
    if not len(whole):
        return np.empty((0, 0))
    return np.asarray(whole.flatten(), float).reshape(len(whole), -1)


def smallest_ids(rows: DataFrame, by: list[str], key: str, most: int) -> DataFrame:
    """For each distinct value of ``by`` its ``most`` smallest keys as array ``ids``, and their number ``copies``.

    Rows are first ranked within parts of a key's hash and then among those parts, so a value that
    holds a large share of all rows is never gathered in one task.
    """
    from pyspark.sql import Window as W

    salted = rows.select(*by, F.col(key).alias("id"), F.pmod(F.xxhash64(key), F.lit(64)).alias("part"))
    parts = salted.withColumn("copies", F.count("*").over(W.partitionBy(*by, "part"))).withColumn("rank", F.row_number().over(W.partitionBy(*by, "part").orderBy("id")))
    parts = parts.where(F.col("rank") <= most).groupBy(*by, "part").agg(F.collect_list("id").alias("ids"), F.first("copies").alias("copies"))
    return parts.groupBy(*by).agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, most).alias("ids"), F.sum("copies").alias("copies"))
