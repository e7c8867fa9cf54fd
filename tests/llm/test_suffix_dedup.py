import random

import brute
import numpy as np
import pyarrow.parquet as pq
import pytest

from tallyfold.llm import suffix_dedup as op


def got(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_whole_table_against_brute_force(spark, sf_dir):
    docs = sorted((d["doc_id"], d["text"]) for d in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist())
    want = brute.without_repeats(docs)
    assert got(op.digest_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))) == sorted(map(repr, want))
    assert sum(w[2] for w in want) > 0


def hostile(seed):
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("abé") for _ in range(pick.randrange(1, 9)))
    shared = [" ".join(word() for _ in range(pick.choice([18, 20, 25, 60, 400]))) for _ in range(6)]
    docs = []
    for i in range(40):
        parts = [pick.choice([pick.choice(shared), pick.choice(shared)[pick.randrange(30):], word(), "x" * pick.choice([3, 99, 150])]) for _ in range(pick.randrange(5))]
        docs.append((i * 3 % 41, " ".join(parts)))
    return docs + [(100, None), (101, ""), (102, "ab" * 400), (103, "ab" * 300 + "c"), (104, shared[0] * 3)]


@pytest.mark.parametrize("seed", range(3))
def test_hostile_texts(spark, seed, monkeypatch):
    monkeypatch.setattr(op, "SHARD_BYTES", [300, 2000, 1 << 20][seed])
    monkeypatch.setattr(op, "HOT", [20_000, 3, 20_000][seed])
    monkeypatch.setattr(op, "FLUSH", [200_000, 20, 1][seed])
    docs = hostile(seed)
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, start int, anchor string").repartition(5)
    assert got(op.digest_rows(df)) == sorted(map(repr, brute.without_repeats(sorted(docs, key=lambda d: d[0]))))


def test_repeated_rows_nulls_and_empty_tables(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text), (1, text), (1, text), (2, "short"), (2, "short"), (None, text + " more"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.without_repeats([(1, text), (1, text), (1, text), (2, "short"), (2, "short"), (None, text + " more"), (None, None)])
    assert got(op.digest_rows(df)) == sorted(map(repr, want))
    assert op.digest_rows(df.limit(0)).count() == 0


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(3)
    pieces = [bytes(rng.choice([97, 98], rng.integers(1, 60)).astype(np.uint8)) for _ in range(30)] + [b"a" * 50] * 2
    data = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.cumsum([len(p) for p in pieces])
    starts = ends - [len(p) for p in pieces]
    stop = np.repeat(ends, ends - starts)
    order, place = op.suffix_array(op.byte_keys(data, stop), 4, stop)
    suffix = [bytes(data[i : stop[i]]) for i in range(len(data))]
    assert order.tolist() == sorted(range(len(data)), key=lambda i: (suffix[i], i))
    shared = op.common_prefixes(data, starts, ends, order, place)
    for k in range(1, len(order)):
        a, b = suffix[order[k - 1]], suffix[order[k]]
        assert shared[order[k]] == next((j for j, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert shared[order[0]] == 0


def test_a_text_longer_than_a_cut(monkeypatch):
    monkeypatch.setattr(op, "_CUT", 500)
    rng = np.random.default_rng(0)
    data = rng.choice([97, 98, 99], 5000).astype(np.uint8)
    bounds = np.array([0, 40, 3000, 5000])
    rows, starts, counts, _ = op.segments(data, bounds)
    have = [(r, s + i) for r, s, n in zip(rows, starts, counts, strict=True) for i in range(n)]
    assert sorted(have) == [(r, i) for r in range(3) for i in range(bounds[r + 1] - bounds[r] - 99)]
