"""A third rule for bad rows: neither dropped nor an error, but set aside with the reason."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fields import number
from .delimited import raw_fields, schema_of

GOOD, BAD = "good", "bad"


class Sorted(NamedTuple):
    good: DataFrame
    bad: DataFrame  # line, reason
    counts: dict[str, int]  # rows by outcome: ``good`` and every reason that occurs


def _problem(field: T.StructField, strict: bool) -> Column:
    """Why a field makes its row bad, or NULL."""
    raw = F.col(field.name)
    missing = F.when(raw.isNull(), f"missing {field.name}")
    if isinstance(field.dataType, T.StringType):
        return missing
    return F.coalesce(missing, F.when(number(raw, field.dataType, strict).isNull(), f"bad {field.name}"))


def read_setting_aside(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str,
    out: str,
    sep: str = ",",
    used: Sequence[str] | None = None,
    header: bool = True,
    marker: str | None = None,
    quoted: bool = False,
    strict: bool = False,
) -> Sorted:
    """Sort the rows of delimited text into good and bad ones, in one pass over it.

    Both are written below ``out`` (``status=good`` and ``status=bad``), which must not
    exist.  A bad row is its line and its first problem: ``missing`` or ``bad`` and the
    field, in the order of ``used``.  The rows are counted by outcome while they are
    written.  Columns and headers as in :func:`read_delimited`.
    """
    schema = schema_of(schema)
    used = list(used) if used is not None else schema.names
    fields = [schema[n] for n in used]
    raw = raw_fields(spark, path, schema.names, sep, header, marker, quoted)
    reason = F.coalesce(*[_problem(f, strict) for f in fields])
    typed = [f"_v{i}" for i in range(len(fields))]
    rows = raw.withColumn("_reason", reason).select(
        *[F.when(F.col("_reason").isNull(), F.col(f.name) if isinstance(f.dataType, T.StringType) else number(F.col(f.name), f.dataType, strict)).alias(v)
          for f, v in zip(fields, typed, strict=True)],
        F.when(F.col("_reason").isNotNull(), F.col("_line")).alias("line"),
        F.col("_reason").alias("reason"),
        F.when(F.col("_reason").isNull(), GOOD).otherwise(BAD).alias("status"),
    )
    reasons = [f"{what} {f.name}" for f in fields for what in ("missing", "bad")]
    seen = Observation()
    observed = rows.observe(
        seen, F.count_if(F.col("reason").isNull()).alias(GOOD), *[F.count_if(F.col("reason") == r).alias(r) for r in reasons]
    )
    observed.write.partitionBy("status").parquet(out)
    counts = {k: v for k, v in seen.get.items() if v or k == GOOD}

    def written(status: str) -> DataFrame:
        stored = T.StructType([f for f in rows.schema.fields if f.name != "status"])
        if not (counts[GOOD] if status == GOOD else len(counts) > 1):  # no row, no folder
            return spark.createDataFrame([], stored)
        return spark.read.schema(stored).parquet(f"{out}/status={status}")

    good = written(GOOD).select(*[F.col(v).alias(f.name) for f, v in zip(fields, typed, strict=True)])
    return Sorted(good, written(BAD).select("line", "reason"), counts)
