import pytest

import brute
from tallyfold.llm import mixture as op


def plan(sizes, weights=(1, 2, 3)):
    """Targets by capping and resharing until no source is above three times its size."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, target = float(sum(sizes.values())), set(names), {}
    while True:
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
        if not free:
            return target


ROWS = [(i, "a", "x " * (i % 9)) for i in range(200)] + [(300 + i, "B", "y " * 30) for i in range(3)]
ROWS += [(400 + i, None, "z\tz\n" * (i % 5)) for i in range(40)] + [(500, "é", None), (501, "zz", ""), (502, "a", "long " * 100000)]
ROWS += [(7, "a", "same id"), (7, "a", "same id"), (None, "B", "no id"), (None, None, "no id")]


def test_targets_and_sizes(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, source string, text string")
    got = op.taken(df.repartition(5)).collect()
    sizes = {}
    for _, s, t in ROWS:
        sizes[s] = sizes.get(s, 0) + len(brute.WS_WORD.findall(t or ""))
    want = plan(sizes)
    assert sorted(map(repr, ((r.doc_id, r.size) for r in got))) == sorted(repr((d, len(brute.WS_WORD.findall(t or "")))) for d, _, t in ROWS)
    by = {}
    mixed = op.mix(df).collect()
    for r in mixed:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size <= 3 * r.size
        by[r.source] = by.get(r.source, 0) + r.taken
    for s, target in want.items():
        assert abs(by.get(s, 0) - target) <= (100000 if s == "a" else 40)
    assert sum(r.taken for r in got) == sum(by.values())


def test_reruns_and_partitions_agree(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, source string, text string")
    runs = [sorted(map(repr, map(tuple, op.taken(df.repartition(k)).collect()))) for k in (1, 7)]
    assert runs[0] == runs[1]


def test_budgets_nest(spark):
    df = spark.createDataFrame([(i, s, "w " * (1 + i % 7)) for i in range(400) for s in ("a", "b")], "doc_id long, source string, text string")
    small, large = ({(r.doc_id, r.source): r.copies for r in op.mix(df, weights=w).collect()} for w in ((1.0, 3.0), (1.0, 2.0)))
    assert all(large.get(k, 0) >= n for k, n in small.items() if k[1] == "a")


def test_clashing_names_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "s", "a b", 9, 9)], "doc_id long, source string, text string, size int, place int")
    assert [tuple(r) for r in op.taken(df).collect()] == [(1, 2, 2, 2.0, 2)]
    mixed = op.mix(df).first()
    assert mixed["size"] == 2 and mixed["place"] == 9 and mixed["copies"] == 1
    assert op.taken(df.limit(0)).count() == op.mix(df.limit(0)).count() == 0
    assert op.taken(spark.createDataFrame([(1, "s", None)], "doc_id long, source string, text string")).first().taken == 0


def test_equal_and_null_ids_are_taken_apart(spark):
    rows = [(None, "a", "w " * 100)] * 200 + [(5, "a", "x y")] * 40 + [(i, "b", "z " * 500) for i in range(80)] + [(None, "a", None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = op.taken(df.repartition(4), weights=(1.0, 1.0)).collect()
    target = {r.source_size: r.target for r in got}[20080]
    assert abs(sum(r.taken for r in got if r.source_size == 20080) - target) <= 100 and target % 20080 > 5000
    assert len({r.taken for r in got if r["size"] == 100}) == 2  # rows of one id, taken differently


def test_rows_without_words_have_no_copies(spark):
    df = spark.createDataFrame([(i, "s", None if i % 2 else " ") for i in range(20)] + [(99, "s", "a b"), (100, "t", "c " * 1000)], "doc_id long, source string, text string")
    mixed = op.mix(df).collect()
    assert {r.doc_id for r in mixed} == {99, 100} and max(r.copies for r in mixed) <= 3
