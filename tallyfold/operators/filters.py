"""Row filters: no shuffle, and the predicate reaches the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_unless(df: DataFrame, column: str, unwanted: object, exempt_column: str, exempt: object) -> DataFrame:
    """Drop rows whose ``column`` is ``unwanted``, but never those whose
    ``exempt_column`` is exactly ``exempt``.

    NULL is a value like any other here: it is not the unwanted one, so its rows
    stay, and not the exempt one, so it saves none.
    """
    return df.where(~F.col(column).eqNullSafe(F.lit(unwanted)) | F.col(exempt_column).eqNullSafe(F.lit(exempt)))
