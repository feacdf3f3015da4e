"""Vectors that take part in the operators on embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_finite(vector: Column) -> Column:
    """True for a vector whose entries are all there and finite; false for null."""
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vector.isNotNull() & F.coalesce(good, F.lit(False))


def finite_rows(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(id, v) of the rows with finite vectors, as doubles, and the dimension.

    The dimension is the largest length; shorter vectors are continued by zeros.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).filter(is_finite(F.col("v")))
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    zeros = F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v"))
    return rows.withColumn("v", F.when(F.size("v") < width, F.concat("v", zeros)).otherwise(F.col("v"))), width
