"""Symmetric difference of two keyed datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALL_DIGITS = "^[0-9]+$"  # fixed value: a first token like this marks the second set


def tagged_difference(df: DataFrame, key: str, tag: str) -> DataFrame:
    """Keys that carry exactly one distinct tag, each once.

    One aggregation: the least and the greatest tag of a key are the same when
    there is only one.  Repeats of a key collapse before the shuffle, and no join
    and no set of tags per key is needed.  Integer tags keep it a hash aggregation.
    """
    ends = df.groupBy(key).agg(F.min(tag).alias("_first"), F.max(tag).alias("_last"))
    return ends.where(F.col("_first") == F.col("_last")).select(key)


def symmetric_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys found in exactly one of two datasets, each once; other columns are dropped."""
    both = left.select(key, F.lit(0).alias("_side")).unionByName(right.select(key, F.lit(1).alias("_side")))
    return tagged_difference(both, key, "_side")


def split_tagged(lines: DataFrame, line: str = "value", id_name: str = "id", tag_name: str = "side") -> DataFrame:
    """Tell two kinds of two-column lines apart by their content.

    A first token of digits only means the second set (tag 1) with its id in the
    second column; anything else means the first set (tag 0) with its id in the
    first column.  Blanks at the end of a line separate nothing.  A line without its
    id column is an error.
    """
    kept = F.rtrim(F.col(line))
    split = lines.select(line, F.explode(F.array(F.split(kept, " "))).alias("_parts"))
    first, second = F.get("_parts", F.lit(0)), F.get("_parts", F.lit(1))
    second_set = first.rlike(ALL_DIGITS)
    error = F.raise_error(F.concat(F.lit("no id in line: "), F.col(line)))
    blanks_only = (first == "") & (F.col(line) != "")
    return split.select(
        F.when(second_set, F.coalesce(second, error)).when(blanks_only, error).otherwise(first).alias(id_name),
        F.when(second_set, F.lit(1)).otherwise(F.lit(0)).alias(tag_name),
    )
