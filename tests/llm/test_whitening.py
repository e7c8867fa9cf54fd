import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold.llm import whitening as op
from tallyfold.llm.common import table


def plain(vectors):
    """Fit list, axes (rows) and eigenvalues of the quantised vectors."""
    x = [tuple(math.floor(64 * float(c)) + op.OFFSET for c in v) for v in vectors]
    fit = np.array(sorted(set(x)), dtype=object)
    n, sums = len(fit), fit.sum(0)
    centred = np.array((fit * n - sums) / n, dtype=float)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return x, n, sums, axes.T[::-1], values[::-1]


def check(vectors, rows):
    """``rows`` are the operator's, in the order of the vectors and components."""
    x, n, sums, axes, values = plain(vectors)
    k = max(r.component for r in rows)
    assert len(rows) == k * len(vectors)
    got = np.array([r.whitened for r in rows]).reshape(-1, k)
    want = np.array((np.array(x, dtype=object) * n - sums) / n, dtype=float) @ axes[:k].T / np.sqrt(values[:k])
    sign = np.sign((got * want).sum(0))
    assert np.abs(got * sign - want).max() < 1e-8
    for i, r in enumerate(rows):
        assert r.n == n and r.deviation == sum(int(d) ** 2 for d in np.array(x[i // k], dtype=object) * n - sums)
        assert abs(r.explained / (values[i % k] / values.sum()) - 1) < 1e-10 and r.identity_error < 1e-10
    return k


def test_table_against_dense_eigenvectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").collect()
    got = sorted(op.digest_rows(table(spark, sf_dir, "embeddings")).collect(), key=lambda r: (r.vec_id, r.component))
    rows.sort(key=lambda r: r.vec_id)
    assert check([r.embedding for r in rows], got) == 16


def test_falling_spectrum_stops_before_the_basis_is_full(spark, monkeypatch):
    rng = np.random.default_rng(5)
    data = rng.standard_normal((600, 90)) * np.array([40.0 * 0.7**i + 0.01 for i in range(90)])
    frame = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(data)], "vec_id long, embedding array<double>").repartition(5)
    passes = []
    gram = op.FitList.gram
    monkeypatch.setattr(op.FitList, "gram", lambda self, w: passes.append(w.shape[1]) or gram(self, w))
    got = sorted(op.whitened(frame, components=3, extra=2).collect(), key=lambda r: (r.vec_id, r.component))
    assert check(data, got) == 3 and sum(passes[:-1]) < 90


def test_equal_eigenvalues_are_found_as_often_as_they_occur(spark):
    corners = [[8.0 * s if j == i else 0.0 for j in range(6)] for i in range(6) for s in (1, -1)]
    frame = spark.createDataFrame(list(enumerate(corners)), "vec_id long, embedding array<float>")
    got = op.whitened(frame, components=4, extra=1).collect()
    y = np.array([r.whitened for r in sorted(got, key=lambda r: (r.vec_id, r.component))]).reshape(-1, 4)
    assert np.abs(y.T @ y / 12 - np.eye(4)).max() < 1e-12 and {round(r.explained, 12) for r in got} == {round(1 / 6, 12)}


def test_dropped_rows_copies_widths_and_ids(spark):
    nan, inf = float("nan"), float("inf")
    good = [[0.5, 1.0], [0.5, 1.0], [0.501, 1.001], [-3.0, 2.0], [1e6, -7.0]]
    bad = [None, [nan, 1.0], [1.0, inf], [-inf, 0.0], [None, 1.0], [1e30, 0.0], [1.0], [1.0, 2.0, 3.0], []]
    ids = [7, 7, None, 8, 9]
    rows = [(i, v, "x") for i, v in zip(ids + [0] * len(bad), good + bad, strict=True)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string")
    got = op.whitened(frame).collect()
    assert {r.vec_id for r in got} == {7, None, 8, 9} and {r.n for r in got} == {3}  # 0.5 and 0.501 quantise alike
    assert len(got) == 2 * len(good)
    want = sorted(plain(good)[4][:2] / plain(good)[4].sum(), reverse=True)
    assert np.allclose(sorted({r.explained for r in got}, reverse=True), want)


def test_no_variance_and_no_rows(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert op.whitened(frame).collect() == [] and op.whitened(frame.limit(0)).columns == [
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    none = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert op.whitened(none).collect() == []
    line = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(4)], "vec_id long, embedding array<float>")
    assert {r.component for r in op.whitened(line).collect()} == {1}


@pytest.mark.parametrize("scale", [1, 10**6, 10**12])
def test_deviations_are_exact(scale):
    x = np.array([[3 * scale, -2], [1, scale]], np.int64)
    n, sums = 5 * scale, [7, -scale]
    assert list(op._deviations(x, n, sums)) == [sum((n * int(c) - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in x]


def test_a_deviation_beyond_a_long_is_null(spark):
    frame = spark.createDataFrame([(i, [float(i) * 1e9, 1.0]) for i in range(3)], "vec_id long, embedding array<double>")
    got = op.whitened(frame).select("vec_id", F.col("deviation")).collect()
    assert {r.vec_id: r.deviation for r in got} == {0: None, 1: 0, 2: None}
