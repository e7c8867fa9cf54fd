import random

import brute
import numpy as np
import pyarrow.parquet as pq
import pytest

from tallyfold.llm import simhash as op
from tallyfold.llm.components import components


def test_whole_table_against_brute_force(spark, sf_dir):
    docs = pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()
    fps = [brute.fingerprint(d["text"]) for d in docs]
    want = brute.components([d["doc_id"] for d in docs], lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op.digest_rows(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    assert got == {d["doc_id"]: (f"{f:016x}", w) for d, f, w in zip(docs, fps, want, strict=True)}
    assert any(k != v[1] for k, v in got.items())


@pytest.mark.parametrize("seed", range(2))
def test_links_of_crowded_fingerprints(spark, seed):
    pick = random.Random(seed)
    centres = [0, (1 << 64) - 1, *(pick.getrandbits(64) for _ in range(5))]
    fps = set(centres)
    for _ in range(700):
        x = pick.choice(centres)
        for bit in pick.sample(range(64), pick.choice([1, 2, 2, 3])):
            x ^= 1 << bit
        fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = [tuple(sorted(r)) for r in op.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()]
    want = {tuple(sorted((signed[i], signed[j]))) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2}
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 6])
def test_bit_planes(radius):
    rng = np.random.default_rng(radius)
    left = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False)) for _ in left], np.uint64)
    got = op.within(left, left ^ flips, radius)
    assert got.tolist() == [i for i, f in enumerate(flips.tolist()) if bin(f).count("1") <= radius]


def test_components_of_paths_and_stars(spark):
    pick = random.Random(1)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(5, 5), (None, 3)]
    pairs += [(pick.randrange(200, 260), pick.randrange(200, 260)) for _ in range(40)]
    ids = list(range(300))
    have = {frozenset(p) for p in pairs}
    want = brute.components(ids, lambda i, j: frozenset((i, j)) in have)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert {i: w for i, w in zip(ids, want, strict=True) if i != w} == got


def test_nulls_ties_and_stage(spark):
    long = " ".join(f"w{i % 700}" for i in range(60000))
    rows = [(5, "a b c d", 1), (3, "A b  c\td", 2), (3, "a b c d", 2), (3, "a b c d", 2), (None, "", 3), (9, None, 4), (8, " \n", 5), (7, long, 6), (None, "x y", 7), (2, "x", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int").repartition(3)
    fps = [brute.fingerprint(t) for _, t, _ in rows]
    want = brute.components([r[0] for r in rows], lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 2)
    got = sorted(map(repr, (tuple(r) for r in op.digest_rows(docs).collect())))
    assert got == sorted(repr((r[0], f"{f:016x}", w)) for r, f, w in zip(rows, fps, want, strict=True))
    kept = op.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text[:3]) for r in kept.collect()) == [(0, "x y"), (2, "x"), (3, kept.filter("doc_id = 3").first().text[:3]), (7, "w0 "), (8, " \n")]
    assert op.digest_rows(docs.limit(0)).count() == 0 and op.keep_one(docs.limit(0)).count() == 0
