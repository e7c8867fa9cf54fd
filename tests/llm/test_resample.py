import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import brute
from tallyfold.llm import resample as op
from tallyfold.llm.common import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text):
    words = WORD.findall(brute.ascii_lower(text))
    return len(words), words + [" ".join(words[i : i + 2]) for i in range(len(words) - 1)]


def plain_buckets(text):
    n, features = plain_features(text)
    return n, sorted(zlib.crc32(f.encode()) % 10000 for f in features)


def plain_rows(documents, target):
    """[(doc_id, n_features, weight, score, rank)] of (doc_id, text) rows."""
    source_counts, target_counts = [0] * 10000, [0] * 10000
    for texts, counts in (([t for _, t in documents], source_counts), (target, target_counts)):
        for t in texts:
            for b in plain_buckets(t)[1]:
                counts[b] += 1
    s_all, t_all = sum(source_counts) + 10000, sum(target_counts) + 10000
    gain = [math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(source_counts, target_counts, strict=True)]
    rows = []
    for doc, text in documents:
        n, found = plain_buckets(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], -r[1]))
    for rank, r in enumerate(able[: len(able) * 25 // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_table_against_brute_force(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    want = plain_rows([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in items.collect()])
    assert rows(op.digest_rows(docs, items)) == want and sum(r[4] is not None for r in want) > 10


@pytest.mark.parametrize("text", [
    None, "", "   ", "one", "A b  C", "ÄÖ x y z9_z", "a\x00b\x7fc", "x" * 200 + " b " + "y" * 65 + " " + "z" * 64, "İI ẞ ſ é",
])
def test_features_of_single_texts(text):
    n, found = op.buckets(text, op.Checksums())
    assert (n, sorted(found.tolist())) == plain_buckets(text)


def test_long_texts_are_cut_between_words(monkeypatch):
    pick = random.Random(1)
    text = "".join(pick.choice(["ab", " ", "Cd", ".", "é", "-", "q" * 50]) for _ in range(4000))
    monkeypatch.setattr(op, "PIECE", 7)
    assert "".join(op.pieces(text, 7)) == text and max(map(len, op.pieces(text, 7))) < 1000
    monkeypatch.setattr(op, "pieces", lambda t, cut=op.pieces: cut(t, 7))
    monkeypatch.setattr(op, "WORDS_KEPT", 3)
    n, found = op.buckets(text, op.Checksums())
    assert (n, sorted(found.tolist())) == plain_buckets(text)


def test_nulls_ties_copies_and_clashing_names(spark):
    words = " ".join(f"word{i}" for i in range(30))
    docs = [(1, words), (1, words), (2, words), (None, words), (None, words), (3, None), (4, ""), (5, "few words"), (6, words + " end")]
    frame = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, rank int")
    target = spark.createDataFrame([(words,), (None,)], "text string")
    assert rows(op.resample(frame, target)) == plain_rows(docs, [words, None])
    assert rows(op.resample(frame, target.limit(0))) == plain_rows(docs, [])
    assert op.resample(frame.limit(0), target).count() == 0


def test_ranks_over_many_tasks(spark):
    frame = spark.range(5000).select((F.col("id") % 700).alias("v"), "id").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.id: r.place for r in op.ranked(frame, [F.desc("v"), F.asc("id")], "place").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(range(5000), key=lambda i: (-(i % 700), i))
    assert sorted(got.values()) == list(range(1, 5001))
