"""Key-ordered folders with an index of each file's keys, and a reader that opens only what it needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pairs import write_pairs
from .swap import replacing

INDEX = "_key_ranges"  # hidden from readers of the folder
ROWS = "rows"


def write_ranges(df: DataFrame, path: str, key: str, files: int | None = None) -> None:
    """Write a Parquet folder in the order of ``key``, with least and greatest key and rows of every file.

    The index is made from the written files' key column, one row per file.
    """
    spark = df.sparkSession
    with replacing(spark, path) as fresh:
        write_pairs(df, f"{fresh}/{ROWS}", keys=key, files=files)
        written = spark.read.parquet(f"{fresh}/{ROWS}")
        index = written.groupBy(F.regexp_extract("_metadata.file_path", "[^/]*$", 0).alias("file")).agg(
            F.min(key).alias("low"), F.max(key).alias("high"), F.count_if(F.col(key).isNull()).alias("nulls"), F.count(F.lit(1)).alias("n")
        )
        index.coalesce(1).write.parquet(f"{fresh}/{INDEX}")


def key_ranges(spark: SparkSession, path: str) -> DataFrame:
    """``file, low, high, nulls, n`` of every file."""
    return spark.read.parquet(f"{path}/{INDEX}")


def read_range(spark: SparkSession, path: str, key: str, low: object = None, high: object = None) -> DataFrame:
    """Rows with ``low <= key <= high`` (None: no bound on that side), from the files that can hold such keys.

    Other files are not opened, so neither their footers nor their listing cost anything.
    What comes to the driver is the names of the matching files.  Rows with a NULL key
    match only if neither bound is given.
    """
    schema = spark.read.parquet(f"{path}/{ROWS}").schema
    ranges, inside = key_ranges(spark, path), F.lit(True)
    if low is not None:
        ranges, inside = ranges.where(F.col("high") >= F.lit(low)), inside & (F.col(key) >= F.lit(low))
    if high is not None:
        ranges, inside = ranges.where(F.col("low") <= F.lit(high)), inside & (F.col(key) <= F.lit(high))
    names = sorted(r.file for r in ranges.select("file").collect())
    if not names:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*[f"{path}/{ROWS}/{name}" for name in names])
    return rows if low is None and high is None else rows.where(inside)
