"""Twelve batch jobs: an input folder in, a result DataFrame out.

Each job takes the session and an input folder.  With ``out`` it also replaces
that folder by the result, in key order, as text lines of the job's own layout; the
returned DataFrame is still lazy, so using it computes the job once more.
Parsing follows the strict rules (marker lines dropped, bad rows skipped) unless
``marker=None`` asks for ordinary one-line headers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import flatten_lines, layout
from ..operators import (
    argmax,
    count_sum_by,
    keep_unless,
    max_by_key,
    max_tf,
    mean_by,
    min_max_normalize,
    signed_ratio_by,
    split_tagged,
    sums_by,
    tagged_difference,
    top_distinct_counts,
    top_n,
    word_counts,
)
from ..sinks import write_lines
from ..sources import read_delimited, read_lines, read_whole_files

# The input layouts, and the words that mark a header line.
HOUSES = "address STRING, city STRING, state STRING, zipcode STRING, price DOUBLE"
TRANSFERS = "bank STRING, year INT, amount INT"
TEMPERATURES = "city STRING, temperature INT"
MEDALS = (
    "id STRING, name STRING, country STRING, sex STRING, c4 STRING, c5 STRING, c6 STRING, "
    "sport STRING, gold INT, silver INT, bronze INT"
)
GRADES = "name STRING, grade INT"
TREES = "district_name STRING, age_of_tree INT"
PATIENTS = "id STRING, patient_cycle_num INT, counseling STRING"
SCORES = "character STRING, num DOUBLE"


def _finish(result: DataFrame, out: str | None, line: Column, order: list[str | Column]) -> DataFrame:
    if out is not None:
        write_lines(result.orderBy(*order).select(line.alias("value")), out)
    return result


def avg_price(spark: SparkSession, path: str, out: str | None = None, marker: str | None = "Address",
              scale: int | str | None = None) -> DataFrame:
    """Mean house price per zip code: (zipcode, avg_price)."""
    houses = read_delimited(spark, path, HOUSES, used=["zipcode", "price"], marker=marker)
    result = mean_by(houses, "zipcode", "price", "avg_price", scale=scale)
    return _finish(result, out, layout("\t", "zipcode", "avg_price"), ["zipcode"])


def bank_transfers(spark: SparkSession, path: str, out: str | None = None, marker: str | None = "Amount") -> DataFrame:
    """Number and sum of transfers per bank: (bank, transfers, amount).

    A row without an amount is skipped; an amount that is no number is an error.
    """
    rows = read_delimited(spark, path, TRANSFERS, sep=" ", used=["bank", "amount"], marker=marker,
                          fail_on=["amount"])
    result = count_sum_by(rows, "bank", "amount", "transfers", "amount")
    return _finish(result, out, layout("\t", "bank", layout(" ", "transfers", "amount")), ["bank"])


def max_temp(spark: SparkSession, path: str, out: str | None = None, marker: str | None = "Temperature",
             floor: int | None = None) -> DataFrame:
    """Highest temperature per city: (city, max_temperature)."""
    rows = read_delimited(spark, path, TEMPERATURES, sep=", ", marker=marker)
    result = max_by_key(rows, "city", "temperature", "max_temperature", floor=floor)
    return _finish(result, out, layout("\t", "city", "max_temperature"), ["city"])


def medals(spark: SparkSession, path: str, out: str | None = None, marker: str | None = "nationality") -> DataFrame:
    """Medal totals per athlete: (name, sex, country, sport, gold, silver, bronze).

    The text layout has an empty field after ``sex``.  A medal count that is no
    number is an error.
    """
    who, won = ["name", "sex", "country", "sport"], ["gold", "silver", "bronze"]
    rows = read_delimited(spark, path, MEDALS, used=who + won, marker=marker, quoted=True, fail_on=won)
    result = sums_by(rows, who, {m: m for m in won})
    line = layout(",", "name", "sex", F.lit(""), "country", "sport", *won)
    return _finish(result, out, line, who)


def norm_grades(spark: SparkSession, path: str, out: str | None = None, marker: str | None = "Name",
                one_per_key: bool = False, order_by: str | None = None, on_zero: str = "null") -> DataFrame:
    """Grades scaled to 0..1 over all students: (name, normalized)."""
    rows = read_delimited(spark, path, GRADES, marker=marker)
    result = min_max_normalize(rows, "name", "grade", one_per_key=one_per_key, order_by=order_by, on_zero=on_zero)
    return _finish(result, out, layout("\t", "name", "normalized"), ["name", "normalized"])


def oldest_tree(spark: SparkSession, path: str, out: str | None = None, marker: str | None = "age_of_tree",
                per_district: bool = False) -> DataFrame:
    """The district with the oldest tree, or with ``per_district`` the oldest tree
    of every district: (district_name, age_of_tree).  An age that is no number is
    an error."""
    rows = read_delimited(spark, path, TREES, marker=marker, fail_on=["age_of_tree"])
    if per_district:
        result = max_by_key(rows, "district_name", "age_of_tree", "age_of_tree")
    else:
        result = argmax(rows, "age_of_tree", "district_name").select("district_name", "age_of_tree")
    return _finish(result, out, layout("\t", "district_name", "age_of_tree"), ["district_name"])


def patient_filter(spark: SparkSession, path: str, out: str | None = None,
                   marker: str | None = "PatientCycleNum") -> DataFrame:
    """Patients except those in cycle 1 without counseling: (id, patient_cycle_num, counseling)."""
    rows = read_delimited(spark, path, PATIENTS, sep=", ", marker=marker)
    result = keep_unless(rows, "patient_cycle_num", 1, "counseling", "Yes")
    line = layout("\t", "id", layout(" ", "patient_cycle_num", "counseling"))
    return _finish(result, out, line, ["patient_cycle_num", "id", "counseling"])


def score_comp(spark: SparkSession, path: str, out: str | None = None, marker: str | None = "Num",
               on_zero: str = "null", scale: int | str | None = None) -> DataFrame:
    """Per character, the positive number over minus the sum of the negative ones: (character, score)."""
    rows = read_delimited(spark, path, SCORES, sep=" ", marker=marker)
    result = signed_ratio_by(rows, "character", "num", "score", on_zero=on_zero, scale=scale)
    return _finish(result, out, layout("\t", "character", "score"), ["character"])


def sym_diff(spark: SparkSession, path: str, out: str | None = None) -> DataFrame:
    """Ids found in only one of two kinds of lines in one folder: (id)."""
    tagged = split_tagged(spark.read.text(path))
    result = tagged_difference(tagged, "id", "side")
    return _finish(result, out, layout("\t", "id", F.lit("")), ["id"])


def read_folder_files(spark: SparkSession, path: str, out: str | None = None) -> DataFrame:
    """Every file of a folder as one line: (file_name, content)."""
    files = read_whole_files(spark, path)
    result = files.select("file_name", flatten_lines("content").alias("content"))
    return _finish(result, out, layout("\t", "file_name", "content"), ["file_name"])


def max_tf_words(spark: SparkSession, path: str, out: str | None = None, norm: str = "distinct",
                 doc: str = "file_name") -> DataFrame:
    """Per word, the number of files with it and the file where its term frequency
    is highest: (word, docs, file_name, tf).  ``doc`` may name a partition column
    of the folder instead of the file name."""
    if doc == "file_name":
        lines = read_lines(spark, path)
    else:  # a typed partition column would make one document of folders 01 and 1
        lines = spark.read.schema(T.StructType().add("value", "string").add(doc, "string")).text(path)
    result = max_tf(lines, doc, "value", norm=norm, one_row_per_doc=False)
    return _finish(result, out, layout("\t", "word", layout(", ", "docs", doc)), ["word"])


def top_words(spark: SparkSession, path: str, out: str | None = None, n: int = 10, keep_blank: bool = False,
              distinct_counts: bool = False) -> DataFrame:
    """The N most used words in ascending order of use: (n, word)."""
    counts = word_counts(spark.read.text(path), "value", keep_blank=keep_blank)
    if distinct_counts:
        result = top_distinct_counts(counts, "n", "word", n)
    else:
        result = top_n(counts, "n", n, ties="word")
    result = result.select("n", "word")
    return _finish(result, out, layout("\t", "n", "word"), [F.asc("n"), F.desc("word")])


JOBS: dict[str, Callable[..., DataFrame]] = {
    "avg_price": avg_price,
    "bank_transfers": bank_transfers,
    "max_temp": max_temp,
    "medals": medals,
    "norm_grades": norm_grades,
    "oldest_tree": oldest_tree,
    "patient_filter": patient_filter,
    "score_comp": score_comp,
    "sym_diff": sym_diff,
    "read_folder_files": read_folder_files,
    "max_tf_words": max_tf_words,
    "top_words": top_words,
}
