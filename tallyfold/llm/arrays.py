"""Running sums, running maxima and pieces of long texts inside one row, in linear time.

An aggregation that appends to an array copies it at every step.  Here arrays are worked
through in blocks of ``BLOCK``: what is copied at a step is a block at most, or one entry
per block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 128
CHARS = 1024


def _blocks(values: Column) -> Column:
    last = F.ceil(F.size(values) / BLOCK).cast("int")
    return F.transform(F.slice(F.sequence(F.lit(0), F.greatest(last, F.lit(1)) - 1), 1, last), lambda i: F.slice(values, i * BLOCK + 1, F.lit(BLOCK)))


def _scan(values: Column, start: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """What was combined before each value, by appending: for short arrays."""
    zero = F.struct(start.alias("at"), F.array().cast("array<int>").alias("before"))
    return F.aggregate(values, zero, lambda acc, v: F.struct(
        combine(acc["at"], v).alias("at"), F.concat(acc["before"], F.array(acc["at"])).alias("before")))["before"]


def running(values: Column, start: int, combine: Callable[[Column, Column], Column]) -> Column:
    """For every int of an array, ``combine`` (associative, with ``start`` as its zero) of all before it."""
    zero = F.lit(start).cast("int")

    def of(blocks: Column) -> Column:
        whole = F.transform(blocks, lambda block: F.aggregate(block, zero, combine))
        return F.flatten(F.zip_with(blocks, _scan(whole, zero, combine), lambda block, before: _scan(block, before, combine)))

    return let(_blocks(values), of)


def running_sums(values: Column) -> Column:
    return running(values, 0, lambda a, b: a + b)


def running_maxima(values: Column) -> Column:
    return running(values, 0, lambda a, b: F.greatest(a, b))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once per row."""
    return F.element_at(F.transform(F.array(value), then), 1)


def chunks(text: Column) -> Column:
    """The text in chunks of ``CHARS`` characters, for :func:`part`."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHARS}}}"), F.lit(0))


def part(cut: Column, start: Column, end: Column) -> Column:
    """Characters ``start`` to ``end`` of a chunked text, without walking through what stands before."""
    def chunk(i: Column) -> Column:
        return F.coalesce(F.get(cut, i), F.lit(""))

    start = F.greatest(start, F.lit(0))
    first, last = F.floor(start / CHARS).cast("int"), F.floor(end / CHARS).cast("int")
    within = F.substring(chunk(first), start % CHARS + 1, end - start)
    between = F.array_join(F.slice(cut, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    across = F.concat(F.substring(chunk(first), start % CHARS + 1, F.lit(CHARS)), between, F.substring(chunk(last), F.lit(1), end % CHARS))
    return F.when(end <= start, "").when(first == last, within).otherwise(across)
