"""Rows set aside, stored sets, safe overwriting, freed stages and key ranges."""

import os

import pytest
from pyspark.sql import functions as F

from tallyfold import operators as ops
from tallyfold.session import shared_dir
from tallyfold.sinks import key_ranges, read_range, replacing, write_lines, write_pairs, write_ranges
from tallyfold.sources import read_delimited, read_setting_aside
from tallyfold.stages import Stages


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_bad_rows_are_set_aside_with_their_reason(spark, folder, out):
    path = folder(a="id,n,f\na,1,0.5\nb,,x\nc,x,1\nd,2,\ne,3,y\n,,\nf,4,2.5,more\n")
    found = read_setting_aside(spark, path, "id STRING, n INT, f DOUBLE", out)
    assert rows(found.good) == [("a", 1, 0.5), ("f", 4, 2.5)] and found.good.columns == ["id", "n", "f"]
    assert rows(found.good) == rows(read_delimited(spark, path, "id STRING, n INT, f DOUBLE"))
    assert rows(found.bad.select("reason")) == [("bad f",), ("bad n",), ("missing f",), ("missing id",), ("missing n",)]
    assert ("c,x,1", "bad n") in rows(found.bad)
    assert found.counts == {"good": 2, "missing n": 1, "bad n": 1, "missing f": 1, "bad f": 1, "missing id": 1}
    used = read_setting_aside(spark, path, "id STRING, n INT, f DOUBLE", out + "2", used=["n"], marker="id")
    assert rows(used.good) == [(1,), (2,), (3,), (4,)] and used.counts["good"] == 4


def test_no_good_rows_no_bad_rows_no_rows(spark, folder, out):
    only_bad = read_setting_aside(spark, folder(a="x\ny\n"), "n INT", out + "1", header=False)
    assert rows(only_bad.good) == [] and rows(only_bad.bad) == [("x", "bad n"), ("y", "bad n")] and only_bad.counts == {"good": 0, "bad n": 2}
    only_good = read_setting_aside(spark, folder(a="1\n2\n"), "n INT", out + "2", header=False)
    assert rows(only_good.good) == [(1,), (2,)] and rows(only_good.bad) == []
    none = read_setting_aside(spark, folder(a=""), "n INT", out + "3", header=False)
    assert rows(none.good) == rows(none.bad) == [] and none.counts == {"good": 0}


def test_stored_sets_are_compared_without_an_exchange(spark, tmp_path):
    left = spark.createDataFrame([(1,), (1,), (2,), (None,), (None,), (5,)], "k BIGINT")
    right = spark.createDataFrame([(2,), (3,), (3,), (None,)], "k BIGINT")
    only = right.where("k IS NOT NULL")
    for name, df in (("stored_l", left), ("stored_r", right), ("stored_o", only)):
        ops.store_keys(df, "k", name, f"{tmp_path}/{name}", buckets=4)
    got = ops.difference_of_stored(spark, "stored_l", "stored_r", "k")
    assert rows(got) == rows(ops.symmetric_difference(left, right, "k")) == [(1,), (3,), (5,)]
    assert rows(ops.difference_of_stored(spark, "stored_l", "stored_o", "k")) == [(1,), (3,), (5,), (None,)]
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    join = plan[plan.index("SortMergeJoin") : plan.index("HashAggregate")]  # what follows compares the NULL keys, two rows at most
    assert "FullOuter" in join and "Exchange" not in join
    for name in ("stored_l", "stored_r", "stored_o"):
        spark.sql(f"DROP TABLE {name}")


def test_a_failed_overwrite_leaves_the_old_result(spark, out, lines):
    write_lines(spark.createDataFrame([("old",)], "value STRING"), out)
    bad = spark.range(100).select(F.when(F.col("id") == 70, F.raise_error(F.lit("no"))).otherwise(F.lit("new")).alias("value"))
    for write in (write_lines, lambda df, path: write_pairs(df, path, fmt="csv"), write_pairs):
        with pytest.raises(Exception, match="no"):
            write(bad, out)
        assert lines(out) == ["old"] and os.listdir(os.path.dirname(out)) == [os.path.basename(out)]


def test_a_job_may_replace_what_it_reads(spark, out):
    write_pairs(spark.range(10), out)
    write_pairs(spark.read.parquet(out).where("id > 6"), out)
    assert rows(spark.read.parquet(out)) == [(7,), (8,), (9,)]


def test_a_driver_that_died_between_the_renames(spark, out, lines):
    parent, name = os.path.split(out)
    write_lines(spark.createDataFrame([("old",)], "value STRING"), out)
    os.rename(out, f"{parent}/_{name}.old")
    with pytest.raises(RuntimeError), replacing(spark, out):
        assert lines(out) == ["old"]  # put back first
        raise RuntimeError
    assert lines(out) == ["old"]
    os.rename(out, f"{parent}/_{name}.old")
    write_lines(spark.createDataFrame([("new",)], "value STRING"), out)
    assert lines(out) == ["new"] and os.listdir(parent) == [name]


def test_stages_are_freed_by_their_last_reader(spark):
    here = lambda stage: os.path.exists(stage.path.removeprefix("file:"))
    with Stages(spark) as stages:
        a = stages.write(spark.range(50), "a", readers=2)
        b = stages.derive("b", lambda t: t.where("id < 9"), a)
        assert here(a) and here(b) and not a.freed
        c = stages.derive("c", lambda s, t: s.join(t, "id"), a, b)
        assert not here(a) and not here(b) and here(c)
        with pytest.raises(ValueError):
            a.read()
        with pytest.raises(Exception, match="broken"):
            stages.derive("d", lambda t: t.select(F.raise_error(F.lit("broken")).alias("x")), c)
        assert here(c) and c.readers == 1
        left = stages.write(spark.range(1), "left")
        result = stages.result(c)
    assert not here(left) and result.count() == 9
    with pytest.raises(ValueError):
        stages.write(spark.range(1), "none", readers=0)


def test_a_chain_holds_two_stages_at_a_time(spark):
    folder = shared_dir(spark)
    held = lambda: sum(n.startswith("chain-") for n in os.listdir(folder.removeprefix("file:")))
    with Stages(spark) as stages:
        stage, most = stages.write(spark.range(1000), "chain"), 0
        for _ in range(5):
            stage = stages.derive("chain", lambda t: t, stage)
            most = max(most, held())
        assert most == 1 and stage.read().count() == 1000
    assert held() == 0


def test_ranges_open_only_matching_files(spark, out):
    df = spark.range(3000).select((F.col("id") % 1000).alias("k"), "id").union(spark.createDataFrame([(None, -1)], "k BIGINT, id BIGINT"))
    write_ranges(df.repartition(5), out, "k", files=8)
    index = key_ranges(spark, out).collect()
    assert len(index) >= 4 and sum(r.n for r in index) == 3001 and sum(r.nulls for r in index) == 1
    for low, high in ((100, 149), (None, 10), (990, None), (2000, None), (None, None), (5, 4)):
        inside = (F.lit(True) if low is None else F.col("k") >= low) & (F.lit(True) if high is None else F.col("k") <= high)
        want = df if low is None and high is None else df.where(inside)
        got = read_range(spark, out, "k", low, high)
        assert rows(got) == rows(want)
        if low == 100:
            assert 1 <= len(got.inputFiles()) <= 2
    write_ranges(df.limit(0), out, "k")
    assert rows(read_range(spark, out, "k", 1, 2)) == [] and rows(read_range(spark, out, "k")) == []


def test_files_in_key_order(spark, out, lines):
    df = spark.range(2000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v")).repartition(8)
    write_pairs(df, out, keys="k", fmt="text", files=6)
    keys = [int(line.split("\t")[0]) for line in lines(out)]
    assert len(keys) == 2000 and keys == sorted(keys)
    assert sum(n.startswith("part-") for n in os.listdir(out)) >= 4  # a hot key spans files
