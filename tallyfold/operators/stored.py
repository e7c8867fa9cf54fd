"""Keyed sets that are stored once and compared many times without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sets import tagged_difference

BUCKETS = 64


def store_keys(df: DataFrame, key: str, table: str, path: str | None = None, buckets: int = BUCKETS) -> None:
    """Store the distinct values of ``key`` as a table in buckets of that key, sorted in each.

    One shuffle, here and never again: a bucket is one file.  ``path`` is where the files
    go; without it the warehouse.  Sets that are to be compared need equal ``buckets`` and
    key types.
    """
    keys = df.select(F.col(key)).distinct().repartition(buckets, key)
    writer = keys.write.bucketBy(buckets, key).sortBy(key).mode("overwrite").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def difference_of_stored(spark: SparkSession, left: str, right: str, key: str) -> DataFrame:
    """Keys found in exactly one of two stored sets, each once; NULL is a key like any other.

    A bucket of one table holds the same keys as that bucket of the other, so every task
    reads both and joins them where they lie: no exchange.  The NULL key is compared apart;
    each set has it once at most.
    """
    a, b = (spark.table(t).select(F.col(key), F.lit(True).alias("_here")) for t in (left, right))
    joined = a.join(b, key, "full_outer").where(F.col(key).isNotNull() & (a["_here"].isNull() | b["_here"].isNull())).select(key)
    nulls = [spark.table(t).where(F.col(key).isNull()).select(key, F.lit(side).alias("_side")) for side, t in enumerate((left, right))]
    return joined.union(tagged_difference(nulls[0].union(nulls[1]), key, "_side"))
