"""Delimited text with a positional schema and an explicit rule for bad rows."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fields import number
from .records import read_quoted_records

# A field of a line with a comma put before it: a comma, then what is no comma, quoted
# stretches whole.  Possessive repeats: one pass over the line.
QUOTED_FIELD = r',((?:[^,"]++|"[^"]*+")*+)'
# In a line with an odd number of quotes: a comma with an even number of them after it.
COMMA_BEFORE_PAIRS = r',(?=(?:[^"]*+"[^"]*+")*+[^"]*+$)'


def _quoted_fields(line: Column) -> Column:
    fields = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(QUOTED_FIELD), F.lit(1))
    even = F.regexp_count(line, F.lit('"')) % 2 == 0
    return F.when(even, fields).otherwise(F.split(line, COMMA_BEFORE_PAIRS))


MISSING = "\ue000"  # what the CSV reader reports for a field that is not there


def schema_of(schema: T.StructType | str) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def _split_lines(
    spark: SparkSession, path: str | list[str], names: list[str], sep: str, marker: str | None, quoted: bool
) -> DataFrame:
    """Raw text fields by position; trailing empty fields count as missing.

    The fields come out of a generator, which filters are not pushed through: each
    line is split once, not once more for every field a later filter tests.
    """
    lines = spark.read.text(path)
    if marker is not None:
        lines = lines.where(~F.col("value").contains(marker))
    trimmed = F.regexp_replace("value", f"({re.escape(sep)})+$", "")
    lines = lines.select("value", F.when(F.col("value").endswith(sep), trimmed).otherwise(F.col("value")).alias("_kept"))
    parts = _quoted_fields(F.col("_kept")) if quoted and sep == "," else F.split("_kept", re.escape(sep))
    has_fields = (F.col("_kept") != "") | (F.col("value") == "")
    split = lines.where(has_fields).select("value", F.explode(F.array(parts)).alias("_parts"))
    return split.select(
        F.col("value").alias("_line"), *[F.get("_parts", F.lit(i)).alias(n) for i, n in enumerate(names)]
    )


def _csv_fields(
    spark: SparkSession, path: str | list[str], names: list[str], sep: str, header: bool, quoted: bool, multiline: bool,
    piece_bytes: int | None = None,
) -> DataFrame:
    """Raw text fields by Spark's CSV parser; an empty field is missing, but quotes around nothing are an empty string.

    With ``piece_bytes`` records with newlines in them are found by many tasks a file, and
    the parser gets one record at a time.
    """
    text_schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    options = {
        "sep": sep,
        "quote": '"' if quoted else "",
        "escape": '"' if quoted else "\\",
        "mode": "PERMISSIVE",
        "multiLine": str(multiline).lower(),
        "ignoreLeadingWhiteSpace": "false",
        "ignoreTrailingWhiteSpace": "false",
        **({"nullValue": MISSING, "emptyValue": ""} if quoted else {}),
    }
    if piece_bytes is not None:
        records = read_quoted_records(spark, path, piece_bytes).where("record <> ''")
        if header:
            records = records.where("start > 0")
        parsed = F.explode(F.array(F.from_csv("record", text_schema.simpleString()[7:-1].replace(":string", " STRING"), options)))
        fields = records.select(parsed.alias("_fields")).select("_fields.*")
    else:
        fields = spark.read.csv(path, schema=text_schema, header=header, enforceSchema=True, lineSep="\n", **options)
    return fields.select(F.concat_ws(sep, *names).alias("_line"), *names)


def raw_fields(
    spark: SparkSession, path: str | list[str], names: list[str], sep: str, header: bool, marker: str | None, quoted: bool,
    multiline: bool = False, piece_bytes: int | None = None,
) -> DataFrame:
    """``_line`` and the fields as text, by position; a field that is not there is NULL."""
    if marker is not None:
        return _split_lines(spark, path, names, sep, marker, quoted)
    return _csv_fields(spark, path, names, sep, header, quoted, multiline, piece_bytes)


def _typed(raw: Column, line: Column, field: T.StructField, rule: str, complete: Column, strict: bool) -> Column:
    value = raw if isinstance(field.dataType, T.StringType) else number(raw, field.dataType, strict)
    if rule == "skip":
        return value.alias(field.name)
    error = F.raise_error(F.concat(F.lit(f"bad {field.name} in row: "), line))
    if rule == "fail":
        return F.coalesce(value, error).alias(field.name)
    return F.when(complete, F.coalesce(value, error)).alias(field.name)


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str,
    sep: str = ",",
    used: Sequence[str] | None = None,
    header: bool = True,
    marker: str | None = None,
    quoted: bool = False,
    on_bad: str = "skip",
    fail_on: Sequence[str] = (),
    strict: bool = False,
    multiline: bool = False,
    piece_bytes: int | None = None,
) -> DataFrame:
    """The ``used`` columns (default: all) of every file under a path.

    Columns are taken by position from ``schema``; more fields than the schema
    has are ignored.  A row is bad when a used field is missing or does not parse;
    unused fields are never looked at.  ``on_bad='skip'`` drops bad rows and
    ``'fail'`` raises.  Under ``skip``, ``fail_on`` names columns where a missing
    field still skips the row, but one that is there and does not parse raises.

    Headers: with ``header`` the first line of each file is dropped.  With
    ``marker`` every line that contains the marker is dropped instead, data rows
    included, and ``header`` is not looked at.

    ``quoted`` lets a comma stand inside double quotes.  The quotes are stripped,
    but with ``marker`` they stay in the field.  ``multiline`` lets a quoted value
    hold newlines as well (not with ``marker``).  A file is then read by one task, or with
    ``piece_bytes`` by a task for every piece of that size; for this a field with a quote
    in it must be quoted and the quote doubled, as all CSV writers do.
    """
    if on_bad not in ("skip", "fail"):
        raise ValueError(f"on_bad must be skip or fail, not {on_bad!r}")
    if piece_bytes is not None and (marker is not None or not (quoted and multiline)):
        raise ValueError("piece_bytes is for quoted text with newlines; all other text is split anyway")
    schema = schema_of(schema)
    names = schema.names
    used = list(used) if used is not None else names
    raw = raw_fields(spark, path, names, sep, header, marker, quoted, multiline, piece_bytes)
    rules = {n: "fail" if on_bad == "fail" else "parse" if n in fail_on else "skip" for n in used}
    complete = reduce(and_, [F.col(n).isNotNull() for n in used])
    typed = raw.select(*[_typed(F.col(n), F.col("_line"), schema[n], rules[n], complete, strict) for n in used])
    return typed if on_bad == "fail" else typed.dropna()


def read_pairs(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str, piece_bytes: int | None = None
) -> DataFrame:
    """What ``write_pairs(fmt="tsv")`` wrote, as it was: tabs, quotes, newlines, blanks, empty strings and NULL.

    A value that does not parse is an error.  A file is read by one task, because a
    value may hold newlines, or with ``piece_bytes`` by a task for every piece.
    """
    schema = schema_of(schema)
    raw = _csv_fields(spark, path, schema.names, "\t", header=False, quoted=True, multiline=True, piece_bytes=piece_bytes)
    typed = [_typed(F.col(f.name), F.col("_line"), f, "parse", F.col(f.name).isNotNull(), False) for f in schema.fields]
    return raw.select(*typed)
