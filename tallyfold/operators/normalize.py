"""Global min-max normalization."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregates import divide


def min_max_normalize(
    df: DataFrame,
    key: str,
    value: str,
    name: str = "normalized",
    one_per_key: bool = False,
    order_by: str | Sequence[str] | None = None,
    order_is_unique: bool = False,
    on_zero: str = "null",
) -> DataFrame:
    """``(value - min) / (max - min)`` over the whole column, as a double.

    The minimum and maximum are one aggregated row, so the side that is broadcast
    is one row at any scale; a window over everything would pull all rows into one
    task.

    ``one_per_key`` keeps, per key, the row that comes first by ``order_by`` (ties
    by the value); minimum and maximum still see every row.  With
    ``order_is_unique`` the order needs no tie rule and a single numeric order
    column is enough for hash aggregation instead of sorting.
    """
    bounds = df.agg(
        F.min(value).cast("double").alias("_lo"),
        F.max(value).cast("double").alias("_hi"),
    )
    rows = df.select(key, value)
    if one_per_key:
        if order_by is None:
            raise ValueError("one_per_key needs order_by: which row survives must be defined")
        order = [order_by] if isinstance(order_by, str) else list(order_by)
        rank = F.col(order[0]) if order_is_unique and len(order) == 1 else F.struct(*order, value)
        rows = df.groupBy(key).agg(F.min_by(value, rank).alias(value))
    span = F.col("_hi") - F.col("_lo")
    scaled = divide(F.col(value).cast("double") - F.col("_lo"), span, on_zero)
    return rows.crossJoin(F.broadcast(bounds)).select(key, scaled.alias(name))
