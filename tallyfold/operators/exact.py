"""Sums of doubles that are exact, and so the same on every run and every cluster size.

A double is a whole number times a power of two, so it is cut into parts of ``BITS`` bits
at fixed places of the binary scale.  Parts at one place are whole numbers and add up
exactly in any order; at the end the places' sums are carried into one long binary number,
which is rounded to a double once.

Values are grouped by key and by the place of their highest part, with a fixed number of
64-bit sums each, so the plan is a hash aggregation before the shuffle, and a hot key sends
some rows per task.  A key has at most as many groups as doubles have places.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 16  # sums of a place have room for 2 ** 47 rows
PARTS = 6  # 53 bits, up to 15 of them off the first place, and one place to spare for the logarithm's rounding
LOW, HIGH = -67, 63  # places of the scale: 2 ** (16 * place)
SMALL, LIFT = 2.0**-900, 15  # smaller values are lifted by 15 places, so that all their parts are ordinary doubles
_BASE = 1 << BITS


def _power(place: Column) -> Column:
    """2 ** (BITS * place), from a table: exact."""
    table = F.array(*[F.lit(2.0 ** (BITS * p)) for p in range(LOW, HIGH + 1)])
    return F.get(table, (place - LOW).cast("int"))


def _parts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys`` (and what else is to be kept), ``_n`` (1 for a value), ``_odd`` (a value that is not finite), ``_place`` and the parts ``_p0``, ``_p1``, ..."""
    v = F.col(value).cast("double")
    odd = F.isnan(v) | (F.abs(v) == float("inf"))
    rows = df.select(
        *keys, F.when(v.isNotNull(), 1).alias("_n"), F.when(odd, v).alias("_odd"), F.when(odd | v.isNull(), 0.0).otherwise(v).alias("_v")
    )
    small = (F.abs("_v") < SMALL) & (F.col("_v") != 0)
    rows = rows.withColumn("_small", small)
    rows = rows.withColumn("_v", F.when(F.col("_small"), F.col("_v") * 2.0 ** (BITS * LIFT)).otherwise(F.col("_v")))
    rows = rows.withColumn("_at", F.coalesce(F.floor(F.log2(F.abs("_v")) / BITS), F.lit(0)).cast("int"))
    rows = rows.withColumn("_unit", _power(F.col("_at")))
    for i in range(PARTS):
        # a quotient by a power of two and the rest are exact
        rows = rows.withColumn(f"_p{i}", (F.col("_v") / F.col("_unit")).cast("long"))
        rows = rows.withColumn("_v", F.col("_v") - F.col(f"_p{i}") * F.col("_unit")).withColumn("_unit", F.col("_unit") / float(_BASE))
    place = F.col("_at") - F.when(F.col("_small"), LIFT).otherwise(0)
    return rows.select(*keys, "_n", "_odd", place.alias("_place"), *[f"_p{i}" for i in range(PARTS)])


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _rounded(groups: str) -> Column:
    """The double nearest to the sum of an array of ``place, parts`` structs."""
    groups = F.col(groups)
    low = F.array_min(F.transform(groups, lambda g: g["place"])) - (PARTS - 1)
    high = F.array_max(F.transform(groups, lambda g: g["place"])) + 4  # room for 64 bits of carry
    sums = F.transform(F.sequence(low, high), lambda at: F.aggregate(
        groups, F.lit(0).cast("long"), lambda total, g: total + F.coalesce(F.get(g["parts"], g["place"] - at), F.lit(0).cast("long"))))

    def carried(values: Column) -> Column:
        """Digits from 0 to 2 ** BITS - 1, and the last carry: -1 under a negative number."""
        zero = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<long>").alias("digits"))
        return F.aggregate(values, zero, lambda state, v: F.struct(
            F.shiftright(state["carry"] + v, BITS).alias("carry"),
            F.concat(state["digits"], F.array((state["carry"] + v).bitwiseAND(F.lit(_BASE - 1)))).alias("digits"),
        ))

    def nearest(digits: Column) -> Column:
        """The five highest digits, and whether anything stands below them, rounded by one conversion."""
        top = F.array_max(F.transform(digits, lambda d, i: F.when(d != 0, i)))

        def of(top: Column) -> Column:
            def digit(i: int) -> Column:
                return F.coalesce(F.when(top >= i, F.get(digits, top - i)), F.lit(0).cast("long"))

            below = F.exists(F.transform(digits, lambda d, i: (i < top - 4) & (d != 0)), lambda x: x)
            upper = F.shiftleft(digit(0), 32) + F.shiftleft(digit(1), 16) + digit(2)
            lower = F.shiftleft(F.shiftleft(digit(3), 16) + digit(4), 1) + F.when(below, 1).otherwise(0)
            number = upper.cast("decimal(20,0)") * F.lit(1 << 33).cast("decimal(11,0)") + lower.cast("decimal(11,0)")
            place = low + top - 4
            tiny = place < LOW
            scale = _power(F.when(tiny, place + 2 * LIFT).otherwise(place)) * F.lit(0.5)
            scaled = number.cast("double") * scale
            return F.when(tiny, scaled * 2.0 ** (-BITS * 2 * LIFT)).otherwise(scaled)

        return _let(top, lambda t: F.when(t.isNull(), 0.0).otherwise(of(t)))

    def signed(values: Column) -> Column:
        def of(state: Column) -> Column:
            mirrored = carried(F.transform(values, lambda v: -v))["digits"]
            return F.when(state["carry"] < 0, -_let(mirrored, nearest)).otherwise(_let(state["digits"], nearest))

        return _let(carried(values), of)

    return _let(sums, signed)


def exact_sums_by(
    df: DataFrame,
    keys: str | Sequence[str],
    value: str,
    sum_name: str = "total",
    count_name: str | None = None,
    mean_name: str | None = None,
    rows_name: str | None = None,
    maxima: dict[str, Column] | None = None,
) -> DataFrame:
    """Per key the double nearest to the true sum of a column, and on request the number of values and the mean.

    ``rows_name`` counts all rows, and ``maxima`` are more columns: the largest value of each.

    Equal bits whatever the order, the partitions and the cluster.  NULLs are left out; a
    key without a value has the sum NULL.  A NaN, or infinities of both signs, give NaN; an
    infinity gives itself.  A sum beyond the largest double is an infinity.  The mean is the
    rounded sum over the count.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    inner = [f"_k{i}" for i in range(len(keys))]
    more = maxima or {}
    kept = [f"_m{i}" for i in range(len(more))]
    largest = [F.max(m).alias(m) for m in kept]
    own = df.select(
        *[F.col(k).alias(i) for k, i in zip(keys, inner, strict=True)], F.col(value).alias("_value"),
        *[c.alias(m) for c, m in zip(more.values(), kept, strict=True)],
    )
    summed = _parts(own, inner + kept, "_value").groupBy(*inner, "_place").agg(
        F.count(F.lit(1)).alias("_rows"), F.count("_n").alias("_n"), F.sum("_odd").alias("_odd"),
        *[F.sum(f"_p{i}").alias(f"_p{i}") for i in range(PARTS)], *largest,
    )
    group = F.struct(F.col("_place").alias("place"), F.array(*[f"_p{i}" for i in range(PARTS)]).alias("parts"))
    whole = summed.groupBy(*inner).agg(
        F.sum("_rows").alias("_rows"), F.sum("_n").alias("_n"), F.sum("_odd").alias("_odd"),
        F.collect_list(group).alias("_groups"), *largest,  # a group per place
    )
    total = F.when(F.col("_n") > 0, F.coalesce(F.col("_odd"), _rounded("_groups")))
    result = whole.select(*[F.col(i).alias(k) for k, i in zip(keys, inner, strict=True)], total.alias(sum_name), "_n", "_rows",
                          *[F.col(m).alias(name) for m, name in zip(kept, more, strict=True)])
    out = [*keys, sum_name, *more]
    if rows_name:
        result, out = result.withColumn(rows_name, F.col("_rows")), [*out, rows_name]
    if count_name:
        result, out = result.withColumn(count_name, F.col("_n")), [*out, count_name]
    if mean_name:
        result, out = result.withColumn(mean_name, F.try_divide(F.col(sum_name), F.col("_n").cast("double"))), [*out, mean_name]
    return result.select(*out)
