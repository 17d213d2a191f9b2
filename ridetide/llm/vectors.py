"""Embedding tables: which vectors take part, and classes of equal vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(column: str) -> Column:
    """Not null, not empty, all components finite, not zero."""
    infinite = F.lit(float("inf"))
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
    return F.coalesce(F.col(column).isNotNull() & finite & F.exists(column, lambda x: x != 0), F.lit(False))


def main_dimension(vectors: DataFrame, column: str) -> int:
    """The most frequent number of components, the larger of equals; 0 for no vectors."""
    sizes = vectors.groupBy(F.size(column).alias("size")).count().orderBy(F.desc("count"), F.desc("size"))
    first = sizes.first()
    return first["size"] if first else 0
