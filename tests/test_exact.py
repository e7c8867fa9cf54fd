"""Exact sums, and the most frequent values by a sketch."""

import math
import random
import struct
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tallyfold import operators as ops


def nearest(values):
    return math.fsum(values)  # correctly rounded


def bits(x):
    return None if x is None else struct.pack(">d", x)


def sums(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "k STRING, v DOUBLE").repartition(parts)
    return {r.k: (r.total, r.n, r.mean) for r in ops.exact_sums_by(df, "k", "v", count_name="n", mean_name="mean").collect()}


def test_sums_are_rounded_once(spark):
    pick = random.Random(1)
    groups = {
        "money": [round(pick.uniform(-1000, 1000), 2) for _ in range(500)],
        "wide": [pick.uniform(-1, 1) * 2.0 ** pick.randrange(-300, 300) for _ in range(400)],
        "cancel": [1e308, 1.0, -1e308, 1e-300, 2.0**53, 1.0, -(2.0**53)],
        "tiny": [5e-324, 5e-324, -1.5e-310, 2.0**-1022, 2.0**-901, 2.0**-899],
        "edges": [2.0**e for e in range(-1074, 1000, 13)] + [-(2.0 ** (16 * e)) for e in range(-60, 60, 3)],
        "near": [math.nextafter(2.0 ** (16 * e), s * math.inf) for e in range(-50, 60, 7) for s in (1, -1)],
        "halfway": [2.0**53, 1.0, 2.0**-200],
        "half-even": [2.0**53, 1.0],
        "zeros": [0.0, -0.0],
        "one": [-1.25],
        "ulps": [0.1] * 10,
        "negative": [-0.1] * 7 + [-(2.0**60)],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs]
    got = sums(spark, rows)
    for k, vs in groups.items():
        want = nearest(vs)
        assert got[k][0] == want and got[k][1] == len(vs), (k, got[k], want)
        assert got[k][2] == want / len(vs)


def test_equal_bits_for_any_partitions(spark):
    pick = random.Random(2)
    rows = [(f"k{pick.randrange(5)}", pick.gauss(0, 1) * 10.0 ** pick.randrange(-20, 20)) for _ in range(3000)]
    seen = set()
    for parts in (1, 7, 64):
        pick.shuffle(rows)
        seen.add(tuple(sorted((k, bits(t), n, bits(m)) for k, (t, n, m) in sums(spark, rows, parts).items())))
    assert len(seen) == 1
    want = {k: nearest([v for q, v in rows if q == k]) for k in {k for k, _ in rows}}
    assert {k: t for k, t, *_ in next(iter(seen))} == {k: bits(v) for k, v in want.items()}


def test_what_is_not_finite(spark):
    inf, nan = math.inf, math.nan
    rows = [("inf", inf), ("inf", 1.0), ("both", inf), ("both", -inf), ("nan", nan), ("nan", 2.0), ("none", None), ("some", None), ("some", 3.0),
            (None, 1.0), (None, 2.0), ("over", 1.7e308), ("over", 1.7e308)]
    got = sums(spark, rows)
    assert got["inf"][0] == inf and math.isnan(got["both"][0]) and math.isnan(got["nan"][0]) and got["over"][0] == inf
    assert got["none"] == (None, 0, None) and got["some"] == (3.0, 1, 3.0) and got[None] == (3.0, 2, 1.5)
    assert sums(spark, []) == {}


def test_exact_aggregates(spark):
    rows = [("a", 0.1), ("a", 0.2), ("a", -0.3), ("b", 2.0), ("c", -1.0), ("c", None), ("d", None)]
    df = spark.createDataFrame(rows, "k STRING, v DOUBLE")
    mean = {r.k: r["mean"] for r in ops.mean_by(df, "k", "v", scale="exact").collect()}
    assert mean == {"a": nearest([0.1, 0.2, -0.3]) / 3, "b": 2.0, "c": -1.0, "d": None}
    counted = ops.count_sum_by(df, "k", "v", scale="exact")
    assert counted.columns == ["k", "n", "total"]
    assert {tuple(r) for r in counted.collect()} == {("a", 3, nearest([0.1, 0.2, -0.3])), ("b", 1, 2.0), ("c", 2, -1.0), ("d", 1, None)}
    plain = {r.k: r.ratio for r in ops.signed_ratio_by(df, "k", "v").collect()}
    assert {r.k: r.ratio for r in ops.signed_ratio_by(df, "k", "v", scale="exact").collect()} == plain
    assert Fraction(mean["a"]) != Fraction((0.1 + 0.2 - 0.3) / 3)


def test_one_shuffle_of_fixed_width_sums(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
    plan = ops.exact_sums_by(df, "k", "v")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def words(spark, counts):
    rows = [(w,) for w, c in counts.items() for _ in range(c)]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows or [], "w STRING")


@pytest.mark.parametrize("n, slots, candidates", [(1, 4, 1), (3, 16, 1), (3, 1 << 16, 8), (10, 8, 1), (50, 64, 2)])
def test_top_counts_equal_the_full_count(spark, n, slots, candidates):
    pick = random.Random(n)
    counts = {f"w{i}": 1 + int(300 / (i + 1)) + pick.randrange(3) for i in range(120)} | {"none": 0, "ties": 5, "tier": 5}
    df = words(spark, counts).union(spark.createDataFrame([(None,)] * 40, "w STRING"))
    got = ops.top_counts(df, "w", n, "c", slots, candidates)
    want = ops.top_n(df.where("w IS NOT NULL").groupBy("w").agg(F.count("*").alias("c")), "c", n, ties="w")
    assert [tuple(r) for r in got.rows.collect()] == [tuple(r) for r in want.collect()]
    assert got.bound < (got.least or 1) and got.counted_slots <= slots


def test_a_first_round_that_proves_it(spark):
    df = words(spark, {"the": 500, "of": 300} | {f"rare{i}": 1 for i in range(300)})
    got = ops.top_counts(df, "w", 2, "c")
    assert got.rounds == 1 and got.counted_slots <= 16 and got.least == 300 and got.bound < 300
    few = ops.top_counts(words(spark, {"a": 2}), "w", 5, "c")
    assert few.rounds == 1 and [tuple(r) for r in few.rows.collect()] == [("a", 2)]
    assert ops.top_counts(words(spark, {}), "w", 5, "c").rows.count() == 0


def test_all_values_alike(spark):
    got = ops.top_counts(words(spark, {f"w{i:03}": 4 for i in range(200)}), "w", 3, "c", slots=32, candidates=1)
    assert sorted(r.w for r in got.rows.collect()) == ["w000", "w001", "w002"] and got.rounds == 2
