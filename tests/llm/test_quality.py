import brute
import numpy as np
import pyarrow.parquet as pq

from tallyfold.llm import quality as op

NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_base_counts_against_brute_force(spark, sf_dir):
    docs = pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()
    got = op.verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()
    want = {d["doc_id"]: brute.quality_counts(d["text"]) for d in docs if len(d["text"]) < 9000}
    assert {r.doc_id: tuple(r[n] for n in NAMES) for r in got if r.doc_id in want} == want
    assert len(got) == len(docs) and not any(r.kept and r.base_failed for r in got)


def test_held_out_labels(spark, sf_dir):
    """Fitted on half of the labels, right on the other half."""
    sf_dir = f"{sf_dir}/../sf0.01"  # enough labels for both halves
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    other = {r.doc_id: r.quality for r in labels.filter("crc32(string(doc_id)) % 2 = 0").collect()}
    rows = op.verdicts(docs, labels.filter("crc32(string(doc_id)) % 2 = 1")).filter("not base_failed").collect()
    right = [(r.score >= op.CUT) == bool(other[r.doc_id]) for r in rows if r.doc_id in other]
    assert len(right) > 100 and np.mean(right) > 0.95


def test_falling_features_only_lower_the_score():
    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    y = ((x[:, 0] < 0.5) ^ (rng.random(600) < 0.2)).astype(float)
    y[x[:, 0] > 0.9] = 1  # against the constraint
    forest = op.fit(x, y, [0])
    grid = np.linspace(0, 1, 101)
    for row in x[:50]:
        line = np.repeat(row[None], 101, 0)
        line[:, 0] = grid
        assert (np.diff(forest.probability(line)) <= 1e-12).all()
    assert ((forest.probability(x) > 0.5) == (x[:, 0] < 0.5)).mean() > 0.8

    def walk(row, at):
        while forest.feature[at] >= 0:
            at = forest.left[at] if row[forest.feature[at]] <= forest.threshold[at] else forest.right[at]
        return forest.value[at]

    slow = [1 / (1 + np.exp(-(forest.bias + sum(walk(row, r) for r in forest.roots)))) for row in x[:40]]
    assert np.allclose(slow, forest.probability(x[:40]))


def test_nulls_ties_empty_tables_and_stage(spark):
    good = " ".join(f"word{i}" for i in range(80)) + "."
    long = "\n".join(f"line {i} of a long text" for i in range(40000))
    rows = [(1, good, 1), (1, good, 1), (None, None, 2), (3, "", 3), (4, "a b c " * 60, 4), (5, long, 5), (None, good, 6), (6, "x\n \nx\nx", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (4, 0, None), (None, 1, 1), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = op.verdicts(docs, labels)
    short = [(d, t) for d, t, _ in rows if len(t or "") < 9000]
    assert sorted(map(repr, (tuple(r[n] for n in ["doc_id", *NAMES]) for r in got.filter("n_words < 9000").collect()))) == sorted(
        repr((d, *brute.quality_counts(t))) for d, t in short
    )
    # 39,999 lines of "of a long text line": nearly every window repeats, so the base rule fails it
    assert got.filter("n_words > 9000").select("n_words", "n_repeat_words", "base_failed").first() == (240000, 199999, True)
    assert op.verdicts(docs.limit(0), labels).count() == 0
    none = op.keep_good(docs, labels.limit(0))
    assert none.columns == docs.columns and sorted(r.kept for r in none.collect()) == [1, 1, 6]
