"""Text files as lines or as whole files, with the file's name as a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .pieces import PIECE_BYTES, file_pieces


def _base_name(uri: Column) -> Column:
    """The name at the end of a file's address, with percent-encoded characters as they are."""
    return F.url_decode(F.replace(F.regexp_extract(uri, "[^/]*$", 0), F.lit("+"), F.lit("%2B")))


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per line: (file_name, value).  Large files are split over tasks."""
    return spark.read.text(path).select(_base_name(F.col("_metadata.file_path")).alias("file_name"), "value")


def read_whole_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per file: (file_name, content), with exactly the file's content.

    An empty file is a row with empty content.  Bytes that are not UTF-8 become U+FFFD.
    Files are never split, small ones share a task, and a file must fit in one cell
    (2 GiB); use :func:`read_file_pieces` or :func:`read_lines` for files that may be larger.
    """
    return file_pieces(spark, path, PIECE_BYTES, "never").select(
        F.regexp_extract("path", "[^/]*$", 0).alias("file_name"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
    )
