import random

import brute
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallyfold.llm import decontaminate as op

SCHEMA = "doc_id long, text string, item_id string, n_hit long"  # names that clash with the result's


def rows(df):
    return {(r.doc_id, r.n_words): (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}


def test_whole_table_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = brute.contamination(
        [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()],
        [(r["item_id"], r["text"]) for r in pq.read_table(f"{sf_dir}/benchmark.parquet").to_pylist()],
    )
    got = {r.doc_id: tuple(r)[1:] for r in op.digest_rows(docs, bench).collect()}
    assert got == {doc: v for (doc, _), v in want.items()}
    assert any(v[4] for v in got.values())


@pytest.mark.parametrize("seed", range(3))
def test_random_overlaps(spark, seed):
    pick = random.Random(seed)
    words = ["a", "B", "c9", "é", "Éa", "x", "-", "d_e"]
    text = lambda n: " ".join(pick.choice(words) for _ in range(n))
    items = [(i, text(pick.choice([0, 1, 3, 5, 12, 13, 14, 30]))) for i in range(12)] + [(3, None), (None, text(20)), (99, "Zq zq zq")]
    items += items[:2]
    docs = [(i, text(pick.choice([0, 5, 40])) + " " + (pick.choice(items)[1] or "") + "." + text(3)) for i in range(40)]
    docs += [(900, None), (901, ""), (902, items[0][1] or ""), (None, text(30)), (1, docs[1][1]), (903, "q " * 3000 + text(60))]
    got = op.digest_rows(
        spark.createDataFrame([(d, t, "i", 5) for d, t in docs], SCHEMA).repartition(3),
        spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int"),
    )
    want = brute.contamination(docs, items)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(repr((d, *want[d, t])) for d, t in docs)


def test_empty_tables_and_stage(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (2, None, "s")], "doc_id long, text string, items string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in op.digest_rows(docs, none).collect()] == [0, 0]
    assert op.digest_rows(docs.limit(0), none).count() == 0
    bench = spark.createDataFrame([(7, "a b")], "item_id long, text string")
    kept = op.decontaminate(docs, bench)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.orderBy("doc_id").collect()] == [2]
    assert op.contamination(docs, bench).filter(F.col("contaminated")).count() == 1
