"""The most frequent values without shuffling all of them: a sketch, and its proof.

The sketch is a row of ``slots`` counters that every value is hashed into; it is as large
for any vocabulary, and sketches of tasks add up.  A counter is at least the count of every
value in it, which gives both a choice of candidates and a bound for all others:

1. Values of the fullest slots are counted exactly.  If the N-th of these counts is above
   the fullest slot that was left out, no other value can be among the first N: done.
2. Otherwise every slot that holds as much as that N-th count is counted as well.  A value
   outside has less than the N-th count by its slot alone, so the result is always whole.

Only values of chosen slots are shuffled.  The rows are scanned once for the sketch and
once per round, which pays where the vocabulary of a task is large.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .topk import top_n

SLOTS = 1 << 16
CANDIDATES = 8  # slots of the first round, for every wanted value


class TopCounts(NamedTuple):
    """The result, and why it is right: ``bound`` is below ``least`` unless everything was counted."""

    rows: DataFrame
    least: int | None  # the N-th count
    bound: int  # what a value that was not counted can have at most
    counted_slots: int
    rounds: int


def _slot(column: str, slots: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(slots))


def _counts(rows: DataFrame, column: str, count: str, chosen: DataFrame, slots: int) -> DataFrame:
    """Exact counts of the values in some slots; at most ``slots`` numbers are sent to the tasks."""
    kept = rows.withColumn("_slot", _slot(column, slots)).join(F.broadcast(chosen.select("_slot")), "_slot", "left_semi")
    return kept.groupBy(column).agg(F.count(F.lit(1)).alias(count))


def top_counts(rows: DataFrame, column: str, n: int = 10, count: str = "n", slots: int = SLOTS, candidates: int = CANDIDATES) -> TopCounts:
    """The ``n`` most frequent values of a column (ties: the least value), as :func:`top_n` gives them.

    NULL is no value.  With fewer than ``n`` values all are returned.
    """
    rows = rows.select(column).where(F.col(column).isNotNull())
    sketch = rows.groupBy(_slot(column, slots).alias("_slot")).agg(F.count(F.lit(1)).alias("_total"))
    fullest = sketch.orderBy(F.desc("_total"), "_slot").limit(n * candidates + 1).collect()
    spark = rows.sparkSession
    first = fullest[: n * candidates]
    bound = fullest[n * candidates]["_total"] if len(fullest) > n * candidates else 0
    chosen = spark.createDataFrame(first, sketch.schema) if first else sketch.limit(0)

    def leading(chosen: DataFrame) -> list:
        return top_n(_counts(rows, column, count, chosen, slots), count, n, ties=column, ascending_output=False).collect()

    top, counted, rounds = leading(chosen), len(first), 1
    least = top[n - 1][count] if len(top) == n else None
    if bound and (least is None or bound >= least):
        chosen = sketch.where(F.col("_total") >= (least or 0))
        counted, rounds = chosen.count(), 2
        top = leading(chosen)
        bound = (least - 1) if least else 0  # of any value in a slot that was left out
        least = top[n - 1][count] if len(top) == n else None
    found = spark.createDataFrame(top, rows.select(column, F.lit(0).cast("long").alias(count)).schema)  # n rows
    return TopCounts(top_n(found, count, n, ties=column), least, bound, counted, rounds)
