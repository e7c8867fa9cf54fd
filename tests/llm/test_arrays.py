import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from tallyfold.llm import arrays as op


@pytest.mark.parametrize("block", [1, 3, 128])
def test_running_values(spark, monkeypatch, block):
    monkeypatch.setattr(op, "BLOCK", block)
    pick = random.Random(block)
    rows = [([pick.randrange(50) for _ in range(n)],) for n in (0, 1, 2, 3, 7, 128, 129, 700)] + [(None,)]
    df = spark.createDataFrame(rows, "v array<int>")
    got = df.select("v", op.running_sums(F.col("v")).alias("sums"), op.running_maxima(F.col("v")).alias("most")).collect()
    for r in got:
        if r.v is not None:
            assert r.sums == list(accumulate(r.v, initial=0))[: len(r.v)]
            assert r.most == list(accumulate(r.v, max, initial=0))[: len(r.v)]


def test_parts_of_a_text(spark, monkeypatch):
    monkeypatch.setattr(op, "CHARS", 5)
    text = "aé😀字x\ny z0123456789\U0001f600end"
    pairs = [(a, b) for a in range(-1, len(text) + 2) for b in range(len(text) + 3)]
    df = spark.createDataFrame([(text, a, b) for a, b in pairs] + [("", 0, 3)], "t string, a int, b int")
    for r in df.select("t", "a", "b", op.part(op.chunks(F.col("t")), F.col("a"), F.col("b")).alias("p")).collect():
        assert r.p == r.t[max(r.a, 0) : max(r.b, 0)]
