"""Top-N reports: N is the caller's, so the result is N rows at any scale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_n(df: DataFrame, by: str, n: int = 10, ties: str | None = None, ascending_output: bool = True) -> DataFrame:
    """The N rows with the largest ``by``; equal values are ranked by ``ties``, or if
    that is not given by all other columns in their order, so the result does not
    depend on partitions.

    Every task keeps N rows of its own and only those are merged.  The N rows
    come out in ascending order unless told otherwise.
    """
    rest = [ties] if ties else [c for c in df.columns if c != by]
    order = [F.desc(by), *[F.asc(c) for c in rest]]
    top = df.orderBy(*order).limit(n)
    if not ascending_output:
        return top
    return top.orderBy(F.asc(by), *[F.desc(c) for c in rest])


def top_distinct_counts(df: DataFrame, count: str, word: str, n: int = 10, ascending_output: bool = True) -> DataFrame:
    """The N largest distinct counts, each with its greatest word."""
    survivors = df.groupBy(count).agg(F.max(word).alias(word))
    return top_n(survivors, count, n, ascending_output=ascending_output)
