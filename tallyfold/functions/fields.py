"""Number parsing, and packing or unpacking of composite text fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHOLE_NUMBER = r"^[+-]?[0-9]+$"  # fixed value: what a strict integer looks like


def number(text: Column, data_type: T.DataType, strict: bool = False) -> Column:
    """Text as a typed value, NULL where it does not parse.

    The cast tolerates blanks around a number.  ``strict`` accepts an integer
    only when the text is nothing but an optional sign and digits.
    """
    value = text.try_cast(data_type)
    if strict and isinstance(data_type, T.IntegralType):
        return F.when(text.rlike(WHOLE_NUMBER), value)
    return value


def unpack(df: DataFrame, column: str, sep: str, names: Sequence[str]) -> DataFrame:
    """Replace a packed text column by its parts, one column per name."""
    parts = [F.split_part(F.col(column), F.lit(sep), F.lit(i)).alias(n) for i, n in enumerate(names, 1)]
    kept = [F.col(c) for c in df.columns if c != column]
    return df.select(*kept, *parts)


def layout(sep: str, *parts: Column | str) -> Column:
    """Join columns into one line of text.  NULL is written as an empty field, so
    every line has the same number of fields."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.concat_ws(sep, *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
