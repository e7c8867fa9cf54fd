import random

import brute
import corpus_pipeline as pipeline
import pyarrow.parquet as pq

from tallyfold.llm import similar as op


def test_changed_words_against_brute_force(spark):
    pick = random.Random(3)
    say = lambda n: [f"w{pick.randrange(500)}" for _ in range(n)]
    texts = []
    for n in (5, 6, 12, 40, 40, 150, 150, 400):
        base = say(n)
        texts.append(base)
        for changes in (0, 1, 1, 2, 3, 4, 6, 9):
            copy = list(base)
            for at in pick.sample(range(n), min(changes, n)):
                copy[at] = f"x{pick.randrange(10**6)}"
            texts.append(copy)
    rows = list(enumerate([" ".join(t) for t in texts] + ["", "a b", "a b", "A\tb", "a c"]))
    pick.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id for r in pipeline.keep_one_of_near_duplicates(spark, docs, "").collect()}
    want = brute.one_of_similar(sorted(rows))
    assert got == want and 10 < len(want) < len(rows)


def test_table_against_brute_force(spark, sf_dir):
    rows = [(d["doc_id"], d["text"]) for d in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()]
    got = {r.doc_id for r in op.keep_one(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    assert got == brute.one_of_similar(rows)


def test_nulls_copies_and_columns(spark):
    rows = [(3, "a b c", 1), (3, "a b c", 1), (None, "a b c", 2), (5, None, 3), (4, " ", 4), (6, "a b d", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = op.keep_one(docs)
    assert got.columns == docs.columns and sorted((r.doc_id, r.fp) for r in got.collect()) == [(3, 1), (4, 4), (6, 5)]
    assert op.keep_one(docs.limit(0)).count() == 0
