"""Grouped and global aggregates.

All of them aggregate before the shuffle, so a key that holds a third of the
rows still sends one row per task.  Buffers are fixed-width (counts, doubles,
decimals), which keeps the plans on hash aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exact import exact_sums_by

EXACT = "exact"  # instead of a scale: sums of doubles rounded once, equal on every run


def _keys(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def total(value: Column | str, scale: int | None = None) -> Column:
    """Sum of a column as a double.

    A sum of doubles depends on the order in which tasks finish.  With ``scale``
    the values are added as decimals with that many places: exact for money, and
    the same on every run and every cluster size.  A value with more places is rounded
    to them, half up, before it is added (0.005 at two places is 0.01).  Values must stay below
    10 ** (18 - scale); larger ones are an error under ANSI mode, never wrapped.
    """
    value = F.col(value) if isinstance(value, str) else value
    if scale is None:
        return F.sum(value).cast("double")
    return F.sum(value.cast(f"decimal(18,{scale})")).cast("double")


def divide(numerator: Column, divisor: Column, on_zero: str = "null") -> Column:
    """Double division with a chosen outcome for a zero divisor.

    ``null`` gives NULL.  ``ieee`` gives what IEEE 754 gives for a divisor that is
    the negation of an empty sum, that is minus zero: -Infinity over a positive
    numerator, +Infinity over a negative one, NaN over zero.  ``nan`` gives NaN.
    """
    numerator, divisor = numerator.cast("double"), divisor.cast("double")
    ratio = F.try_divide(numerator, divisor)
    if on_zero == "null":
        return ratio
    nan = F.lit(float("nan"))
    if on_zero == "nan":
        return F.when(divisor == 0, nan).otherwise(ratio)
    if on_zero == "ieee":
        at_zero = (
            F.when(numerator > 0, F.lit(float("-inf"))).when(numerator < 0, F.lit(float("inf"))).otherwise(nan)
        )
        return F.when(divisor == 0, at_zero).otherwise(ratio)
    raise ValueError(f"on_zero must be null, nan or ieee, not {on_zero!r}")


def mean_by(
    df: DataFrame, keys: str | Sequence[str], value: str, name: str = "mean", scale: int | str | None = None
) -> DataFrame:
    """True mean per key, whatever the number of partitions.

    ``scale`` here and below: places of a decimal sum, or ``"exact"`` for the exact sum of
    doubles as they are (see :func:`exact_sums_by`).
    """
    if scale == EXACT:
        return exact_sums_by(df, keys, value, "_total", mean_name=name).drop("_total")
    mean = F.avg(value) if scale is None else F.try_divide(total(value, scale), F.count(value).cast("double"))
    return df.groupBy(*_keys(keys)).agg(mean.alias(name))


def count_sum_by(
    df: DataFrame,
    keys: str | Sequence[str],
    value: str,
    count_name: str = "n",
    sum_name: str = "total",
    scale: int | str | None = None,
) -> DataFrame:
    """Row count and sum per key in one pass.  Integer sums stay 64-bit integers."""
    if scale == EXACT:
        return exact_sums_by(df, keys, value, sum_name, rows_name=count_name).select(*_keys(keys), count_name, sum_name)
    summed = F.sum(value) if scale is None else total(value, scale)
    return df.groupBy(*_keys(keys)).agg(F.count(F.lit(1)).alias(count_name), summed.alias(sum_name))


def max_by_key(
    df: DataFrame, keys: str | Sequence[str], value: str, name: str = "max", floor: float | int | None = None
) -> DataFrame:
    """Largest value per key; ``floor`` is the least value ever reported."""
    top = F.max(value)
    if floor is not None:
        top = F.greatest(top, F.lit(floor).cast(df.schema[value].dataType))
    return df.groupBy(*_keys(keys)).agg(top.alias(name))


def sums_by(df: DataFrame, keys: str | Sequence[str], sums: dict[str, Column | str]) -> DataFrame:
    """Several sums over one composite key: ``{output name: column to sum}``."""
    return df.groupBy(*_keys(keys)).agg(*[F.sum(column).alias(name) for name, column in sums.items()])


def argmax(df: DataFrame, value: str, key: str) -> DataFrame:
    """The one (key, value) row with the largest value.

    Ties go to the least key; no row with a value gives no row.  Each task keeps
    its own best row, so only one row per task is moved.
    """
    best = df.select(key, value).where(F.col(value).isNotNull())
    return best.orderBy(F.desc(value), F.asc(key)).limit(1)


def signed_ratio_by(
    df: DataFrame,
    keys: str | Sequence[str],
    value: str,
    name: str = "ratio",
    on_zero: str = "null",
    scale: int | str | None = None,
) -> DataFrame:
    """Per key, the positive value over minus the sum of the negative values.

    Zero counts as positive.  Of several positive values the largest is used; a
    key with none has 0.0.
    """
    v = F.col(value)
    if scale == EXACT:
        negative = df.select(*_keys(keys), v, F.when(v < 0, v).alias("_negative"))
        summary = exact_sums_by(negative, keys, "_negative", "_neg", maxima={"_pos": F.when(v >= 0, v).cast("double")})
        summary = summary.fillna(0.0, ["_pos", "_neg"])
    else:
        summary = df.groupBy(*_keys(keys)).agg(
            F.coalesce(F.max(F.when(v >= 0, v)).cast("double"), F.lit(0.0)).alias("_pos"),
            F.coalesce(total(F.when(v < 0, v), scale), F.lit(0.0)).alias("_neg"),
        )
    return summary.select(*_keys(keys), divide(F.col("_pos"), -F.col("_neg"), on_zero).alias(name))
