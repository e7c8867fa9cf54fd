"""Operators on small frames: ties, blanks, zero divisors, and partitioning."""

import math
import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyfold import operators as ops
from tallyfold.functions import flatten_lines, layout, tokens, unpack


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plan(df):
    """The physical plan; of a frame that has run, only the final one."""
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


PAIRS = [("a", -5.0), ("a", 4.0), ("b", -3.0), ("b", -1.0), ("c", 2.0), ("c", 9.0), ("d", 0.0)]


@pytest.fixture
def pairs(spark):
    return spark.createDataFrame(PAIRS, "k STRING, v DOUBLE")


def test_mean_count_sum_max(pairs):
    assert rows(ops.mean_by(pairs, "k", "v")) == [("a", -0.5), ("b", -2.0), ("c", 5.5), ("d", 0.0)]
    assert rows(ops.mean_by(pairs, "k", "v", scale=2)) == rows(ops.mean_by(pairs, "k", "v"))
    assert rows(ops.count_sum_by(pairs, "k", "v")) == [("a", 2, -1.0), ("b", 2, -4.0), ("c", 2, 11.0), ("d", 1, 0.0)]
    assert rows(ops.max_by_key(pairs, "k", "v")) == [("a", 4.0), ("b", -1.0), ("c", 9.0), ("d", 0.0)]
    assert rows(ops.max_by_key(pairs, "k", "v", floor=0)) == [("a", 4.0), ("b", 0.0), ("c", 9.0), ("d", 0.0)]


def test_signed_ratio(pairs):
    got = dict(rows(ops.signed_ratio_by(pairs, "k", "v")))
    assert got == {"a": 0.8, "b": 0.0, "c": None, "d": None}
    got = dict(rows(ops.signed_ratio_by(pairs, "k", "v", on_zero="ieee")))
    assert got["c"] == -math.inf and math.isnan(got["d"])
    with pytest.raises(ValueError):
        ops.signed_ratio_by(pairs, "k", "v", on_zero="zero")


def test_argmax_ties_and_no_rows(spark, pairs):
    tied = pairs.unionByName(spark.createDataFrame([("b", 9.0)], "k STRING, v DOUBLE"))
    got = ops.argmax(tied, "v", "k").collect()[0]
    assert (got.k, got.v) == ("b", 9.0)
    assert ops.argmax(pairs.where("false"), "v", "k").collect() == []
    assert ops.argmax(pairs.select("k", F.lit(None).cast("double").alias("v")), "v", "k").collect() == []
    assert "TakeOrderedAndProject" in plan(ops.argmax(tied, "v", "k"))


def test_keep_unless_needs_no_shuffle(spark):
    df = spark.createDataFrame([(1, "Yes"), (1, "No"), (1, "yes"), (2, "No")], "c INT, y STRING")
    kept = ops.keep_unless(df, "c", 1, "y", "Yes")
    assert rows(kept) == [(1, "Yes"), (2, "No")]
    assert "Exchange" not in plan(kept)


def test_normalize(spark, pairs):
    got = dict(rows(ops.min_max_normalize(pairs.where("k <> 'd'").groupBy("k").agg(F.max("v").alias("v")), "k", "v")))
    assert got == {"a": 0.5, "b": 0.0, "c": 1.0}
    flat = spark.createDataFrame([("a", 3), ("b", 3)], "k STRING, v INT")
    assert rows(ops.min_max_normalize(flat, "k", "v")) == [("a", None), ("b", None)]
    assert all(math.isnan(v) for _, v in rows(ops.min_max_normalize(flat, "k", "v", on_zero="nan")))
    with pytest.raises(ValueError):
        ops.min_max_normalize(flat, "k", "v", one_per_key=True)


def test_one_per_key_sees_all_rows_for_the_bounds(spark):
    df = spark.createDataFrame([("a", 1, 4), ("a", 2, 10), ("b", 3, 0)], "k STRING, o INT, v INT")
    for unique in (True, False):
        got = ops.min_max_normalize(df, "k", "v", one_per_key=True, order_by="o", order_is_unique=unique)
        assert rows(got) == [("a", 0.4), ("b", 0.0)]


def test_symmetric_difference_is_one_aggregation(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (3, "x")], "id INT, p STRING")
    b = spark.createDataFrame([(3,), (4,)], "id INT")
    diff = ops.symmetric_difference(a, b, "id")
    assert rows(diff) == [(1,), (2,), (4,)]
    assert rows(ops.symmetric_difference(a, a, "id")) == []
    assert plan(diff).count("Exchange hashpartitioning") == 1 and "Join" not in plan(diff)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 9), max_size=12), st.lists(st.integers(0, 9), max_size=12))
def test_symmetric_difference_property(spark, left, right):
    def frame(ids):
        return spark.createDataFrame([(i,) for i in ids], "id INT")

    want = [(i,) for i in sorted(set(left) ^ set(right))]
    assert rows(ops.symmetric_difference(frame(left), frame(right), "id")) == want
    assert rows(ops.symmetric_difference(frame(right), frame(left), "id")) == want


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-50, 50), min_size=2, max_size=12))
def test_normalized_values_are_within_0_and_1(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "k INT, v INT")
    got = [v for _, v in rows(ops.min_max_normalize(df, "k", "v"))]
    if min(values) == max(values):
        assert got == [None] * len(values)
    else:
        assert all(0 <= v <= 1 for v in got) and {0.0, 1.0} <= set(got)


def test_results_do_not_depend_on_partitions(spark):
    rng = random.Random(7)
    data = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(20)}", i, rng.randrange(-9999, 9999) / 100)
            for i in range(3000)]
    df = spark.createDataFrame(data, "k STRING, i INT, v DOUBLE")
    results = []
    for parts in (1, 3, 8):
        p = df.repartition(parts)
        results.append((
            rows(ops.mean_by(p, "k", "v", scale=2)),
            rows(ops.signed_ratio_by(p, "k", "v", scale=2)),
            rows(ops.argmax(p, "v", "k")),
            rows(ops.min_max_normalize(p, "k", "v", one_per_key=True, order_by="i")),
        ))
    assert results[0] == results[1] == results[2]


# --- text -------------------------------------------------------------------------

TEXTS = ["Don't a1b  stop", "", "123 456", "Été Kelvin\tTab\nnew line", " x ", "cafés"]


def simple_words(text):
    """The tokenizer's rule, one character at a time."""
    kept = "".join(c for c in text if c not in "0123456789")
    letters = "".join(c.lower() if c.isascii() and c.isalpha() else " " for c in kept)
    return letters.split() or [""]


def test_tokens(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i INT, t STRING")
    got = {r.i: r.w for r in df.select("i", tokens("t").alias("w")).collect()}
    assert got == {i: simple_words(t) for i, t in enumerate(TEXTS)}
    assert got[0] == ["don", "t", "ab", "stop"]


def brute_counts(docs):
    counts = {}
    for doc, text in docs:
        counts.setdefault(doc, Counter()).update(w for w in simple_words(text) if w)
    return counts


def brute_max_tf(docs, norm):
    best = {}
    for doc, words in sorted(brute_counts(docs).items()):
        for word, n in words.items():
            tf = n / (len(words) if norm == "distinct" else sum(words.values()))
            seen, top, where = best.get(word, (0, 0.0, None))
            best[word] = (seen + 1, tf, doc) if tf > top else (seen + 1, top, where)
    return sorted((w, seen, doc, tf) for w, (seen, tf, doc) in best.items())


def random_docs(repeat):
    rng = random.Random(3)
    words = ["the", "The", "of", "a1b", "café", "don't", "\n", "42", "sun", "moon"]
    ids = [i // repeat for i in range(60)]
    return [(d, " ".join(rng.choices(words, k=rng.randrange(0, 30)))) for d in ids]


@pytest.mark.parametrize("repeat", [1, 4])
@pytest.mark.parametrize("norm", ["distinct", "total"])
def test_term_operators_against_brute_force(spark, repeat, norm):
    docs = random_docs(repeat)
    df = spark.createDataFrame(docs, "doc INT, t STRING").repartition(5)
    counts = brute_counts(docs)
    want_counts = sorted((d, w, n) for d, c in counts.items() for w, n in c.items())
    choices = [None, False] + ([True] if repeat == 1 else [])
    for one_row in choices:
        got = ops.doc_word_counts(df, "doc", "t", one_row)
        assert sorted(tuple(r) for r in got.collect()) == want_counts
        got = ops.max_tf(df, "doc", "t", norm, one_row).select("word", "docs", "doc", "tf")
        assert sorted(tuple(r) for r in got.collect()) == brute_max_tf(docs, norm)


def test_one_row_documents_are_counted_without_a_shuffle(spark):
    df = spark.createDataFrame([(1, "b a b"), (2, "12 .")], "doc INT, t STRING")
    tf = ops.term_frequency(df, "doc", "t", one_row_per_doc=True)
    assert rows(tf) == [(1, "a", 1, 0.5), (1, "b", 2, 1.0)]
    assert "Exchange" not in plan(tf)
    assert plan(ops.max_tf(df, "doc", "t", one_row_per_doc=True)).count("Exchange") == 1


def test_documents_over_many_rows_share_the_count_shuffle(spark):
    df = spark.createDataFrame([(None, "a a b"), (1, "a"), (1, "b c")], "doc INT, t STRING")
    tf = ops.term_frequency(df, "doc", "t", one_row_per_doc=False)
    got = sorted(((r.doc or 0), r.word, r.n, r.tf) for r in tf.collect())
    assert got == [(0, "a", 2, 1.0), (0, "b", 1, 0.5), (1, "a", 1, 1 / 3), (1, "b", 1, 1 / 3), (1, "c", 1, 1 / 3)]
    assert "ReusedExchange" in plan(tf)
    assert plan(tf).count("Generate explode") == 1  # the texts are tokenized once


def test_hot_and_cold_documents(spark):
    """One document has a third of all rows, thousands of others a few words each."""
    rng = random.Random(5)
    letters = [a + b for a in "abcdefghij" for b in "klmnopqrst"]
    docs = [(-1, " ".join(rng.choices(letters, k=3))) for _ in range(1500)]
    docs += [(d, " ".join(rng.choices(letters, k=2))) for d in range(1500) for _ in range(2)]
    df = spark.createDataFrame(docs, "doc INT, t STRING").repartition(6)
    for norm in ("distinct", "total"):
        got = ops.max_tf(df, "doc", "t", norm).select("word", "docs", "doc", "tf")
        assert sorted(tuple(r) for r in got.collect()) == brute_max_tf(docs, norm)


def test_a_long_document_stays_linear(spark):
    text = " ".join("".join(chr(97 + (i // 26**p) % 26) for p in range(4)) for i in range(40000))
    df = spark.createDataFrame([(1, text)], "doc INT, t STRING")
    assert ops.doc_word_counts(df, "doc", "t", True).count() == 40000


def test_word_counts_and_top_n(spark):
    df = spark.createDataFrame([("b a b",), ("a c d d",), ("7",)], "t STRING")
    counts = ops.word_counts(df, "t")
    assert rows(counts) == [("a", 2), ("b", 2), ("c", 1), ("d", 2)]
    assert ("", 1) in rows(ops.word_counts(df, "t", keep_blank=True))
    assert [r.word for r in ops.top_n(counts, "n", 2, ties="word", ascending_output=False).collect()] == ["a", "b"]
    assert [r.word for r in ops.top_n(counts, "n", 2, ties="word").collect()] == ["b", "a"]
    assert rows(ops.top_distinct_counts(counts, "n", "word", 5)) == [(1, "c"), (2, "d")]


def test_flatten_unpack_layout(spark):
    df = spark.createDataFrame([(1, "a\nb\n"), (2, "x#y"), (3, None)], "i INT, t STRING")
    flat = {r.i: r.t for r in df.select("i", flatten_lines("t").alias("t")).collect()}
    assert flat == {1: "a --- b --- ", 2: "x#y", 3: None}
    assert rows(unpack(df.where("i = 2"), "t", "#", ["l", "r"])) == [(2, "x", "y")]
    assert {r[0] for r in df.select(layout(",", "i", "t", F.lit(""))).collect()} == {"1,a\nb\n,", "2,x#y,", "3,,"}


def test_keep_unless_with_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, "Yes"), (2, None), (None, "No"), (None, None), (1, "No")], "cycle INT, counseling STRING")
    kept = ops.keep_unless(df, "cycle", 1, "counseling", "Yes")
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, [(1, "Yes"), (2, None), (None, "No"), (None, None)]))


def test_top_n_without_ties_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i % 3, f"w{i}") for i in range(30)], "n INT, word STRING")
    answers = {tuple(map(tuple, ops.top_n(df.repartition(k), "n", 4).collect())) for k in (1, 3, 8)}
    assert len(answers) == 1


@pytest.mark.parametrize("name", ["word", "n", "tf", "docs", "_text"])
@pytest.mark.parametrize("one_row", [True, False])
def test_document_columns_of_any_name(spark, name, one_row):
    df = spark.createDataFrame([("d1", "a b a"), ("d2", "b")], f"{name} STRING, t STRING")
    for run in (ops.doc_word_counts, ops.term_frequency, ops.max_tf):
        try:
            got = run(df, name, "t", one_row_per_doc=one_row)
        except ValueError as error:
            assert "clashes" in str(error)
        else:
            assert {r[name] for r in got.collect()} <= {"d1", "d2"} and got.columns.count(name) == 1


def test_repeated_documents_are_right_by_default(spark):
    df = spark.createDataFrame([("d", "a b"), ("d", "a"), ("e", "a")], "doc STRING, t STRING")
    assert {(r.doc, r.word): r.tf for r in ops.term_frequency(df, "doc", "t").collect()} == {("d", "a"): 1.0, ("d", "b"): 0.5, ("e", "a"): 1.0}
    assert {r.tf for r in ops.term_frequency(df, "doc", "t", hot_share=1).collect()} == {1.0, 0.5}


def test_places_beyond_the_scale_are_rounded(spark):
    df = spark.createDataFrame([("k", 0.005), ("k", 0.005)], "k STRING, v DOUBLE")
    assert ops.mean_by(df, "k", "v", scale=2).first()["mean"] == 0.01
