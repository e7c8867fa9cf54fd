"""Sources, sinks and the shared folder."""

import os

import pytest
from pyspark.sql import functions as F

from tallyfold.session import new_path, shared_dir
from tallyfold.sinks import write_lines, write_pairs
from tallyfold.sources import read_delimited, read_lines, read_pairs, read_whole_files


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("header", [False, True])
def test_bad_rows(spark, folder, header):
    head = "id,n,extra\n" if header else ""
    path = folder(a=head + "a,1,x\nb,,x\nc\nd,2\n,,\ne, 3,x\nf,3.5,x\ng,99999999999,x\n")
    how = {"header": True} if header else {"marker": "no such text"}
    got = read_delimited(spark, path, "id STRING, n INT", used=["id", "n"], **how)
    assert rows(got) == [("a", 1), ("d", 2), ("e", 3)]
    assert rows(read_delimited(spark, path, "id STRING, n INT", strict=True, **how)) == [("a", 1), ("d", 2)]
    with pytest.raises(Exception, match="bad n in row"):
        read_delimited(spark, path, "id STRING, n INT", on_bad="fail", **how).collect()


def test_unused_fields_do_not_make_a_row_bad(spark, folder):
    path = folder(a="x,bad,7\n")
    got = read_delimited(spark, path, "a STRING, b INT, c INT", used=["c", "a"], header=False)
    assert got.columns == ["c", "a"] and rows(got) == [(7, "x")]
    with pytest.raises(ValueError):
        read_delimited(spark, path, "a STRING", on_bad="maybe")


def test_trailing_empty_fields_are_missing(spark, folder):
    got = read_delimited(spark, folder(a="x,,\n,y,\n,,\na,,b\n"), "a STRING, b STRING", marker="#")
    assert rows(got) == [("", "y"), ("a", "")]


def test_header_is_dropped_from_every_file(spark, folder):
    path = folder(a="h\n1\n", b="h\n2", c="h\n")
    assert rows(read_delimited(spark, path, "h INT")) == [(1,), (2,)]


@pytest.mark.parametrize("sep", [",", ", ", " ", "\t", "|"])
def test_separators(spark, folder, sep):
    path = folder(a=f"x{sep}1\ny{sep}2")
    for how in ({"header": False}, {"marker": "#"}):
        assert rows(read_delimited(spark, path, "a STRING, b INT", sep=sep, **how)) == [("x", 1), ("y", 2)]


def test_quoted_fields(spark, folder):
    path = folder(a='"a, b",1\n"say ""hi""",2\n')
    stripped = read_delimited(spark, path, "t STRING, n INT", header=False, quoted=True)
    assert rows(stripped) == [("a, b", 1), ('say "hi"', 2)]
    kept = read_delimited(spark, path, "t STRING, n INT", marker="#", quoted=True)
    assert rows(kept) == [('"a, b"', 1), ('"say ""hi"""', 2)]


def test_leading_zeros_stay_in_text(spark, folder):
    assert rows(read_delimited(spark, folder(a="01002,1"), "z STRING, n INT", header=False)) == [("01002", 1)]


def test_whole_files_and_lines(spark, folder):
    path = folder(a="one\n\ntwo\n", b="", c=b"x\xff")
    assert rows(read_whole_files(spark, path)) == [("a.txt", "one\n\ntwo\n"), ("b.txt", ""), ("c.txt", "x�")]
    lines = rows(read_lines(spark, path).where("file_name = 'a.txt'"))
    assert lines == [("a.txt", ""), ("a.txt", "one"), ("a.txt", "two")]


def test_pairs_are_written_in_key_order_over_all_files(spark, out, lines):
    df = spark.range(2000).select((F.col("id") % 7).alias("k"), F.col("id").alias("v")).repartition(8)
    write_pairs(df, out, keys="k", fmt="text")
    keys = [int(line.split("\t")[0]) for line in lines(out)]
    assert len(keys) == 2000 and keys == sorted(keys)
    assert rows(read_pairs(spark, out, "k BIGINT, v BIGINT")) == rows(df)


def test_a_huge_key_is_spread_over_part_files(spark, out):
    df = spark.range(50000).select(F.lit("hot").alias("k"), F.col("id").alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_pairs(df, out, keys="k", fmt="text")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(name.startswith("part-") for name in os.listdir(out)) > 1


@pytest.mark.parametrize("fmt", ["csv", "tsv", "parquet"])
def test_formats_keep_hard_values(spark, out, fmt):
    df = spark.createDataFrame([("a,\tb", 'say "x"'), ("", "z")], "p STRING, q STRING")
    write_pairs(df, out, fmt=fmt)
    if fmt == "parquet":
        back = spark.read.parquet(out)
    else:
        back = spark.read.csv(out, schema="p STRING, q STRING", sep="," if fmt == "csv" else "\t", escape='"')
    assert rows(back.na.fill("")) == rows(df)
    with pytest.raises(ValueError):
        write_pairs(df, out, fmt="xml")


def test_overwrite(spark, out, lines):
    for text in ("old", "new"):
        write_lines(spark.createDataFrame([(text,)], "value STRING"), out)
    assert lines(out) == ["new"]


def test_paths_in_the_shared_folder_are_new(spark):
    assert shared_dir(spark) == shared_dir(spark)
    assert new_path(spark, "x") != new_path(spark, "x")


class FakeSession:
    """Just the settings of a session."""

    def __init__(self, **settings):
        self.settings = {k.replace("_", "."): v for k, v in settings.items()}
        self.conf = self

    def get(self, key, default=None):
        return self.settings.get(key, default)


def test_the_sessions_own_folder_is_used():
    fake = FakeSession(spark_checkpoint_dir="store://bucket/tmp/", spark_master="yarn")
    assert shared_dir(fake) == "store://bucket/tmp"
    assert new_path(fake, "pairs").startswith("store://bucket/tmp/pairs-")


def test_a_checkpoint_folder_set_by_hand_is_used():
    fake = FakeSession(spark_master="yarn")
    fake.sparkContext = type("Context", (), {"getCheckpointDir": lambda self: "store://set/by/hand"})()
    assert shared_dir(fake) == "store://set/by/hand"


def test_a_cluster_without_a_shared_folder_is_an_error():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(FakeSession(spark_master="yarn"))


@pytest.mark.parametrize("name", ["a b.txt", "50%.txt", "a#b.txt", "x+y.txt", "x%20y.txt", "é.txt"])
def test_file_names_are_exact(spark, tmp_path, name):
    (tmp_path / name).write_text("x\n")
    (tmp_path / f"empty {name}").write_text("")
    assert rows(read_whole_files(spark, str(tmp_path))) == sorted([(name, "x\n"), (f"empty {name}", "")])
    assert rows(read_lines(spark, str(tmp_path))) == [(name, "x")]


HARD = [("a\tb", 'say "x"', 1), ("", "z", None), (None, "  pad  ", 2), ("two\nlines\r\nthree", '"', 3), ("\\", "", 4), (None, None, None)]


def test_tsv_comes_back_as_it_was(spark, out):
    df = spark.createDataFrame(HARD, "p STRING, q STRING, n INT")
    write_pairs(df, out, fmt="tsv")
    back = read_pairs(spark, out, "p STRING, q STRING, n INT")
    assert sorted(map(repr, map(tuple, back.collect()))) == sorted(map(repr, HARD))


def test_csv_comes_back_as_it_was(spark, out):
    df = spark.createDataFrame(HARD, "p STRING, q STRING, n INT")
    write_pairs(df, out, fmt="csv", header=True)
    back = read_delimited(spark, out, "p STRING, q STRING, n INT", quoted=True, multiline=True)
    assert sorted(map(repr, map(tuple, back.collect()))) == sorted(repr(h) for h in HARD if None not in h)


def test_a_bad_value_in_pairs_is_an_error(spark, folder):
    with pytest.raises(Exception, match="bad n in row"):
        read_pairs(spark, folder(a="x\ty\n"), "k STRING, n INT").collect()


def test_key_order_with_a_map_and_a_wide_column(spark, out):
    df = spark.range(50).select((F.col("id") % 3).alias("k"), F.create_map(F.lit("a"), "id").alias("m"), F.repeat(F.lit("x"), 1000).alias("wide"))
    write_pairs(df, out, keys="k")
    assert spark.read.parquet(out).count() == 50
    only = df.select("k", "m")
    write_pairs(only, out, keys="k")
    assert spark.read.parquet(out).count() == 50


def test_a_line_with_very_many_commas_and_quotes(spark, folder):
    path = folder(a="," * 100_000 + "\n" + '"a, b",1,"",\n' + '"x",,2\n' + 'odd " quote,3\n')
    got = read_delimited(spark, path, "t STRING, n STRING", marker="#", quoted=True, used=["t"])
    assert rows(got) == [('"a, b"',), ('"x"',), ('odd " quote',)]
