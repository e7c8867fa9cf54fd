"""Result folders: overwritten on each run, and in key order over all part files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fields import layout
from .swap import replacing


def _in_key_order(df: DataFrame, keys: Sequence[str], files: int | None) -> DataFrame:
    """Total order by the keys, then by a hash of the other columns, so that rows of
    one huge key are spread over several part files instead of one.  Range bounds
    are sampled from narrow rows, however wide the table is.  Columns with a map in
    them cannot be hashed and only ride along."""
    rest = [f.name for f in df.schema.fields if f.name not in keys and "map<" not in f.dataType.simpleString()]
    order = [*keys, F.xxhash64(*rest) if rest else F.rand(0)]
    if files is None:
        return df.orderBy(*order)
    return df.repartitionByRange(files, *order).sortWithinPartitions(*order)


def write_pairs(
    df: DataFrame, path: str, keys: str | Sequence[str] | None = None, fmt: str = "parquet", header: bool = False,
    files: int | None = None,
) -> None:
    """Write a result folder, replacing what is there; runs the plan.

    What is there stays until the new result is complete, so a job that fails leaves it.

    ``fmt`` is ``parquet``, ``csv``, ``tsv`` (both quote where needed, keep blanks
    around a value, and keep empty strings apart from NULL) or ``text`` (fields
    joined by tabs as they are, for people to read).  ``keys`` puts the rows in key order; without it no sort is made.
    ``files`` is how many files hold them, at most; without it Spark decides by size.
    """
    if fmt not in ("parquet", "csv", "tsv", "text"):
        raise ValueError(f"fmt must be parquet, csv, tsv or text, not {fmt!r}")
    if keys is not None:
        df = _in_key_order(df, [keys] if isinstance(keys, str) else list(keys), files)
    if fmt == "text":
        write_lines(df.select(layout("\t", *df.columns).alias("value")), path)
        return
    with replacing(df.sparkSession, path) as fresh:
        if fmt == "parquet":
            df.write.parquet(fresh)
        else:
            sep = "\t" if fmt == "tsv" else ","
            df.write.csv(fresh, sep=sep, header=header, emptyValue='""', escape='"',
                         ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_lines(lines: DataFrame, path: str, max_lines_per_file: int = 0) -> None:
    """Write one text column as lines, replacing what is there when it is complete; runs the plan."""
    if len(lines.columns) != 1:
        lines = lines.select(F.col("value"))
    with replacing(lines.sparkSession, path) as fresh:
        lines.write.option("maxRecordsPerFile", max_lines_per_file).text(fresh)
