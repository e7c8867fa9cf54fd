"""Files in pieces, quoted records over pieces, and texts cut between words."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallyfold import operators as ops
from tallyfold.functions import cut_text
from tallyfold.sources import pieces as source
from tallyfold.sources import read_delimited, read_file_pieces, read_pairs, read_quoted_records, read_whole_files
from tallyfold.sinks import write_pairs


def joined(df):
    found = {}
    for r in sorted(df.collect(), key=lambda r: (r.path, r.start)):
        found[r.file_name] = found.get(r.file_name, "") + r.content
    return found


TEXTS = {
    "a": "one two\nthree, vier fünf ẞ — 字字字 \U0001f600\U0001f600x\n" * 3,
    "b": "",
    "c": "x" * 100,
    "d": b"bad \xff\xfe and \x80\x80\x80\x80\x80\x80\x80 \xe2\x82 cut \xf0\x9f\x98" * 2,
    "e": "\n\n\n a1b2 3 c\n",
}


@pytest.mark.parametrize("cut", ["chars", "words", "lines"])
@pytest.mark.parametrize("size", [3, 7, 64, 10**6])
def test_pieces_join_to_the_files(spark, folder, cut, size):
    path = folder(**TEXTS)
    want = {f"{n}.txt": t.decode("utf-8", "replace") if isinstance(t, bytes) else t for n, t in TEXTS.items()}
    got = read_file_pieces(spark, path, size, cut)
    assert joined(got) == want
    assert {(r.file_name): r.content for r in read_whole_files(spark, path).collect()} == want
    assert (got.where("file_name = 'a.txt'").count() == 1) == (size == 10**6)


def test_cuts_fall_where_they_may(spark, folder):
    path = folder(**{k: v for k, v in TEXTS.items() if isinstance(v, str)})
    for r in read_file_pieces(spark, path, 5, "words").where("start > 0").collect():
        whole = TEXTS[r.file_name[0]].encode()
        assert not (re.match(rb"[0-9a-zA-Z]", whole[r.start - 1 : r.start]) and re.match("[0-9a-zA-Z]", r.content))
    lines = read_file_pieces(spark, path, 5, "lines").where("start > 0").collect()
    assert lines and all(TEXTS[r.file_name[0]].encode()[r.start - 1] == 10 for r in lines)


def test_words_of_pieces_are_the_words_of_files(spark, folder):
    path = folder(**{k: v for k, v in TEXTS.items() if isinstance(v, str)})
    whole = {r.word: r.n for r in ops.word_counts(read_whole_files(spark, path), "content").collect()}
    for size in (4, 50):
        assert {r.word: r.n for r in ops.word_counts(read_file_pieces(spark, path, size, "words"), "content").collect()} == whole


def test_planning():
    files = [("big", 250), ("empty", 0), ("s1", 30), ("s2", 40)]
    tasks = source.planned(files, 100, whole=False)
    assert [[(p.path, p.piece, p.start, p.end) for p in t] for t in tasks] == [
        [("big", 0, 0, 100)], [("big", 1, 100, 200)], [("big", 2, 200, 250)], [("empty", 0, 0, 0)], [("s1", 0, 0, 30)], [("s2", 0, 0, 40)]]
    assert [len(t) for t in source.planned([(f"f{i}", 10) for i in range(5)], 2 * source.OPEN_COST, whole=True)] == [2, 2, 1]


def test_small_pieces_share_tasks():
    files = [("a", 10 * source.OPEN_COST), ("b", 3 * source.OPEN_COST), ("c", 5)]
    tasks = source.planned(files, source.OPEN_COST, whole=False)
    got = source.gathered(tasks, 4 * source.OPEN_COST)
    assert [p for t in got for p in t] == [p for t in tasks for p in t] and [len(t) for t in got] == [4, 4, 4, 2]
    assert source.gathered(tasks, 1) == tasks and source.gathered([], 9) == []


def test_tasks_follow_the_bytes_and_not_the_pieces(spark, folder):
    path = folder(a="ab cd\n" * 2000)
    got = read_file_pieces(spark, path, 1000).select("piece", F.spark_partition_id().alias("task")).collect()
    assert len(got) == 12 and len({r.task for r in got}) == 1


def test_two_readers_of_counts_read_pieces_once(spark, folder, monkeypatch):
    """Counts of (document, word) are read for the totals and for the frequencies: one shuffle of the pieces serves both."""
    monkeypatch.setattr(source, "LEAST_TASK", 1)  # several tasks: one alone needs no shuffle
    path = folder(**{k: v for k, v in TEXTS.items() if isinstance(v, str)})
    counted = ops.max_tf(read_file_pieces(spark, path, 50, "words"), "path", "content")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = counted._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert plan.count("MapInArrow") == 1 and "ReusedExchange" in plan


def test_listing(spark, tmp_path):
    for name in ("a b/k=1/x.txt", "a b/k=1/_hidden", "a b/.hidden", "a b/plain.txt", "a b/sub/not-listed.txt", "c%41+d/y[1].txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    names = lambda *paths: sorted(p.rsplit("/", 1)[1] for p, _ in source.listed(paths))
    assert names(f"{tmp_path}/a b") == ["plain.txt", "x.txt"] and names(f"file://{tmp_path}/a b") == ["plain.txt", "x.txt"]
    assert names(f"{tmp_path}/*b/k=?", f"{tmp_path}/c%41+d") == ["x.txt", "y[1].txt"]
    assert names(f"{tmp_path}/a b/plain.txt", f"{tmp_path}/a b/plain.txt") == ["plain.txt"]
    with pytest.raises(FileNotFoundError):
        source.listed([f"{tmp_path}/none"])
    assert read_file_pieces(spark, f"{tmp_path}/c%41+d").first().content == "c%41+d/y[1].txt"
    with pytest.raises(ValueError):
        read_file_pieces(spark, str(tmp_path), cut="sometimes")


def test_lines_of_joined_pieces_are_whole(spark, folder):
    """As the query does it: several files of many pieces, in few tasks, joined by their places."""
    texts = {n: "".join(f"{n}{i} ẞ字\U0001f600\n" for i in range(300)) for n in "xyz"}
    pieces = read_file_pieces(spark, folder(**texts), 37)
    assert pieces.rdd.getNumPartitions() < 50 < pieces.count() / 4
    assert joined(pieces) == {f"{n}.txt": t for n, t in texts.items()}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("size", [5, 33, 10**6])
def test_quoted_records_equal_the_one_task_reader(spark, folder, size):
    pick = random.Random(size)
    value = lambda: "".join(pick.choice(['""', ",", "\n", "x", " ", "é", "\n\n"]) for _ in range(pick.randrange(12)))
    cell = lambda: pick.choice(["", '""', "plain", "two words", f'"{value()}"', f'"{value()}"'])
    file = lambda: "h1,h2,h3\n" + "\n".join(",".join(cell() for _ in range(3)) for _ in range(25))
    path = folder(a=file() + "\n", b=file(), c="h1,h2,h3\n", d="", e="h1,h2,h3")
    how = dict(schema="a STRING, b STRING, c STRING", used=["b", "a"], quoted=True, multiline=True)
    one = rows(read_delimited(spark, path, **how))
    assert rows(read_delimited(spark, path, **how, piece_bytes=size)) == one and len(one) > 20


def test_records_and_their_places(spark, folder):
    text = 'a\n"b\nc""\n"\n\n"open\nto the end'
    for size in (1, 2, 100):
        got = read_quoted_records(spark, folder(x=text), size).collect()
        assert sorted((r.start, r.record) for r in got) == [(0, "a"), (2, '"b\nc""\n"'), (11, ""), (12, '"open\nto the end')]


def test_records_are_cut_by_few_tasks(spark, folder):
    path = folder(a='x,"y\n"\n' * 2000)
    got = read_quoted_records(spark, path, 1000).select("start", F.spark_partition_id().alias("task")).collect()
    assert sorted(r.start for r in got) == [7 * i for i in range(2000)] and len({r.task for r in got}) == 1


def test_pairs_come_back_over_pieces(spark, out):
    df = spark.createDataFrame([(1, 'a\tb\n"', None), (2, "", "x"), (3, None, " é \n\n"), (4, "\\", '"\n"')], "k INT, t STRING, u STRING")
    write_pairs(df, out, keys="k", fmt="tsv", files=2)
    for size in (4, 1000):
        assert rows(read_pairs(spark, out, "k INT, t STRING, u STRING", piece_bytes=size)) == rows(df)


def test_quoted_text_over_pieces_is_parsed_by_few_tasks(spark, folder):
    text = "k,t\n" + "".join(f'{i},"a\n""{i}"""\n' for i in range(900))
    got = read_delimited(spark, folder(a=text, b=text), "k INT, t STRING", quoted=True, multiline=True, piece_bytes=2000)
    found = got.select("k", "t", F.spark_partition_id().alias("task")).collect()
    assert sorted((r.k, r.t) for r in found) == sorted(2 * [(i, f'a\n"{i}"') for i in range(900)])
    assert len({r.task for r in found}) <= 2


def test_pieces_are_for_quoted_newlines_only(spark, folder):
    with pytest.raises(ValueError):
        read_delimited(spark, folder(a="x"), "a STRING", piece_bytes=10)


@pytest.mark.parametrize("size", [1, 2, 5, 40])
def test_texts_are_cut_between_words(spark, size):
    pick = random.Random(size)
    texts = ["".join(pick.choice("ab1 .é-\n\U0001f600") for _ in range(pick.randrange(90))) for _ in range(60)] + ["", None, "w" * 50]
    got = spark.createDataFrame([(t,) for t in texts], "t STRING").select("t", cut_text("t", size).alias("parts")).collect()
    for r in got:
        assert (r.t is None) == (r.parts is None) and "".join(r.parts or []) == (r.t or "")
        for a, b in zip(r.parts or [], (r.parts or [])[1:], strict=False):
            assert not (re.search(r"[0-9a-zA-Z]\Z", a) and re.match("[0-9a-zA-Z]", b))
        assert all(len(p) <= size or re.fullmatch("[0-9a-zA-Z]+", p) for p in r.parts or [])


def test_a_giant_row_counts_like_its_words(spark):
    """13 MB in one cell, cut and dealt out; the parts are small and on many tasks."""
    giant = spark.range(1).select(F.lit("d").alias("doc"), F.repeat(F.lit("alpha b2c, gamma. "), 12 << 16).alias("text"))
    parts = ops.cut_rows(giant, "text", 1 << 17, tasks=8)
    sizes = parts.select(F.char_length("text").alias("n"), F.spark_partition_id().alias("task")).collect()
    assert len(sizes) > 90 and max(r.n for r in sizes) <= 1 << 17 and len({r.task for r in sizes}) > 4
    got = {r.word: (r.docs, r.doc, r.tf) for r in ops.max_tf(parts, "doc", "text").collect()}
    assert got == {w: (1, "d", (12 << 16) / 3) for w in ("alpha", "bc", "gamma")}
