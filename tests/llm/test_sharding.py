import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyfold.llm import sharding as op
from tallyfold.llm.common import table


def law(good, bad, drawn):
    return {k: math.comb(good, k) * math.comb(bad, drawn - k) / math.comb(good + bad, drawn)
            for k in range(max(0, drawn - bad), min(drawn, good) + 1)}


def chi_square(counts, expected):
    """The statistic less its degrees of freedom, in standard deviations; classes under 5 are put together."""
    total = sum(counts.values())
    rare = {k for k, p in expected.items() if p * total < 5}
    classes = [(counts.get(k, 0), p * total) for k, p in expected.items() if k not in rare]
    if rare and sum(expected[k] for k in rare) * total >= 1:
        classes.append((sum(counts.get(k, 0) for k in rare), sum(expected[k] for k in rare) * total))
    free = max(1, len(classes) - 1)
    return (sum((c - e) ** 2 / e for c, e in classes) - free) / math.sqrt(2 * free)


@pytest.mark.parametrize("good, bad, drawn", [(5, 7, 4), (0, 9, 3), (9, 0, 3), (9, 4, 0), (30, 50, 25), (3, 100, 103), (200, 300, 470)])
def test_draws_follow_the_law(spark, good, bad, drawn):
    g, b, n = (F.lit(x).cast("long") for x in (good, bad, drawn))
    draws = spark.range(20000).select(op.hypergeometric(g, b, n, op.uniform(F.lit(1), "id")).alias("k"))
    counts = {r.k: r["count"] for r in draws.groupBy("k").count().collect()}
    expected = law(good, bad, drawn)
    assert set(counts) <= set(expected) and chi_square(counts, expected) < 4


def test_large_draws_have_the_mean_and_the_deviation(spark):
    g, b, n = (F.lit(x).cast("long") for x in (10**7, 3 * 10**7, 10**6))
    draws = spark.range(400).select(op.hypergeometric(g, b, n, op.uniform(F.lit(2), "id")).alias("k"))
    mean, deviation = draws.agg(F.avg("k"), F.stddev_pop("k")).first()
    true = math.sqrt(10**6 * 0.25 * 0.75 * (1 - 1 / 40))
    assert abs(mean - 250_000) < 4 * true / 20 and abs(deviation / true - 1) < 0.15


def test_matrix_has_both_margins(spark):
    sizes = [(0, 5), (1, 1), (2, 700), (17, 3), (18, 64), (40, 1000), (4097, 2)]
    blocks = spark.createDataFrame(sizes, "block long, n long")
    capacities = [600, 600, 575, 0]
    got = {r.block: r.counts for r in op.communication_matrix(blocks, capacities).collect()}
    assert {b: sum(c) for b, c in got.items()} == dict(sizes)
    assert [sum(c) for c in zip(*got.values(), strict=True)] == capacities


def test_rows_of_a_block_go_anywhere(spark):
    """Every (block, shard) count of repeated draws has the hypergeometric mean."""
    blocks = spark.createDataFrame([(b, 40) for b in range(6)], "block long, n long")
    sums = Counter()
    for seed in range(12):
        for r in op.communication_matrix(blocks, [80, 80, 80], seed).collect():
            for s, c in enumerate(r.counts):
                sums[r.block, s] += c
    deviation = math.sqrt(12 * 40 / 9 * 2 * 200 / 239)
    assert all(abs(v - 160) < 4.5 * deviation for v in sums.values())


def digest(rows):
    return sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in rows)


def test_query_against_plain_sizes(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(op, "BLOCK_BITS", 3)
    monkeypatch.setattr(op, "BIN_ROWS", 4)
    docs = table(spark, sf_dir, "documents")
    rows = op.digest_rows(docs).collect()
    want = [(False, r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect()]
    assert digest(rows) == sorted(want)
    counts = Counter(r.shard for r in rows)
    assert sorted(counts) == list(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(c)) for s, c in counts.items())
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    rising = sum(a < b for a, b in zip(order, order[1:], strict=False))
    assert abs(rising - len(order) / 2) < 4 * math.sqrt(len(order) / 12)
    assert digest(op.digest_rows(docs).collect()) == digest(rows)


def test_equal_and_null_rows_few_rows_none(spark):
    rows = [(1, "ä")] * 5 + [(None, None)] * 3 + [(None, "")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, shard string")
    got = op.digest_rows(docs).collect()
    assert Counter(r.shard for r in got) == {0: 2, **{s: 1 for s in range(1, 8)}}
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == {(1, 3, zlib.crc32("ä".encode())): 5, (None, 1, 0): 4}
    assert sorted((r.shard, r.slot) for r in op.digest_rows(docs.limit(2)).collect()) == [(0, 0), (1, 0)]
    assert op.digest_rows(docs.limit(0)).count() == 0


def test_whole_rows_and_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}", -1) for i in range(50)], "doc_id long, text string, slot int").repartition(3)
    op.write_shards(docs, f"{tmp_path}/out", shards=3, rows_per_file=5)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(got.columns) == ["doc_id", "shard", "slot", "text"]
    rows = got.collect()
    assert sorted((r.doc_id, r.text) for r in rows) == sorted((i, f"t{i}") for i in range(50))
    assert sorted((r.shard, r.slot) for r in rows) == sorted((s, i) for s in range(3) for i in range(17 if s < 2 else 16))
