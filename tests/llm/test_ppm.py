import math
import random
import re
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow.parquet as pq
import pytest

from tallyfold.llm import ppm as op


def plain_ppm(train, texts, order):
    """Method C with exclusion, one symbol at a time."""
    edge = [256] * order
    symbols = lambda t: edge + list((t or "").encode().lower()) + [256]
    counts = defaultdict(Counter)
    for t in train:
        s = symbols(t)
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts[tuple(s[i - k : i])][s[i]] += 1
    out = []
    for t in texts:
        s, total = symbols(t), 0.0
        for i in range(order, len(s)):
            gone = set()
            for k in range(order, -2, -1):
                if k < 0:
                    total += math.log10(1 / (257 - len(gone)))
                    break
                own = {x: n for x, n in counts.get(tuple(s[i - k : i]), {}).items() if x not in gone}
                if not own:
                    continue
                below = sum(own.values()) + len(own)
                if s[i] in own:
                    total += math.log10(own[s[i]] / below)
                    break
                total += math.log10(len(own) / below)
                gone |= own.keys()
        out.append(total)
    return out


def plain_base(train, text):
    cut = lambda t: re.findall(r"[^\x20\x09-\x0D]+", brute.ascii_lower(t)) + [None]
    counts = Counter(w for t in train for w in cut(t))
    n, v = counts.total(), len(counts)
    words = cut(text)
    return len(words), sum(counts[w] > 0 for w in words), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)


TRAIN = ["abracadabra", "Abra cad", "", None, "le chat et la chatte", "é à é", "aaaaaaaa"]
TEXTS = ["abra", "", None, "ABRACADABRA xyz", "zzz é", "\x00\x01", "chat " * 50, "a"]


def scores(spark, train, texts, order=op.ORDER):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = op.score(docs, spark.createDataFrame([(t,) for t in train], "text string").repartition(3), order=order).collect()
    return [s for _, s in sorted((r.doc_id, r.score) for r in got)]


@pytest.mark.parametrize("order, hot", [(0, 3), (1, 5), (5, 0), (5, 9), (5, 1 << 20)])
def test_scores_against_plain_ppm(spark, monkeypatch, order, hot):
    """Whatever is looked up in tasks, and however often a gram falls back to shorter contexts."""
    monkeypatch.setattr(op, "HOT_GRAMS", hot)
    assert np.allclose(scores(spark, TRAIN, TEXTS, order), plain_ppm(TRAIN, TEXTS, order), rtol=1e-9)


def test_random_texts_against_plain_ppm(spark, monkeypatch):
    monkeypatch.setattr(op, "HOT_GRAMS", 40)
    pick = random.Random(6)
    say = lambda letters: "".join(pick.choice(letters) for _ in range(pick.randrange(60)))
    train, texts = [say("abcd ") for _ in range(30)], [say("abcde ") for _ in range(20)]
    assert np.allclose(scores(spark, train, texts, 3), plain_ppm(train, texts, 3), rtol=1e-9)


def test_prices_are_probabilities(spark):
    """Over all 257 symbols the prices after a context sum to one, known, unknown or partly known."""
    model = op.Model.of(spark.createDataFrame([("abcab abd",), ("xyz",)], "text string"), 3)
    pack = lambda symbols: sum(s << 9 * (3 - i) for i, s in enumerate(symbols))
    for context in (b"cab", b"zab", b"qqb", b"qqq", b"xyz"):
        grams = spark.createDataFrame([(pack([*context, s]),) for s in range(257)], "gram long")
        assert sum(10**r.cost for r in model.priced(grams).collect()) == pytest.approx(1, abs=1e-12)


def test_whole_table(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(op, "HOT", 50)
    monkeypatch.setattr(op, "HOT_GRAMS", 5000)
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    train = [t for i, t in docs.items() if not held[i]]
    got = {r.doc_id: r for r in op.digest_rows(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    assert len(got) == len(docs)
    counts = Counter(w for t in train for w in re.findall(r"[^\x20\x09-\x0D]+", brute.ascii_lower(t)))
    n, v = counts.total() + len(train), len(counts) + 1
    for i, text in docs.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", brute.ascii_lower(text))
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words) + math.log10((len(train) + 0.1) / (n + 0.1 * (v + 1)))
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(words) + 1, sum(counts[w] > 0 for w in words) + 1, n)
        assert r.base_score == pytest.approx(base, rel=1e-9)


def test_held_out_code_length(spark, sf_dir):
    """What the query returns for texts that training did not see is shorter than their words' own code length."""
    docs = spark.read.parquet(f"{sf_dir}/../sf0.1/documents.parquet").select("doc_id", "text").repartition(8)
    held = op.digest_rows(docs).filter("held_out").collect()
    assert len(held) > 500 and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_nulls_ties_and_empty_tables(spark):
    rows = [(1, "a b A", 1.0), (1, "a b A", 1.0), (None, None, None), (2, "", 2.0), (3, "word " * 100000 + "x" * 200000, 3.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    train = ["a b", None, "c\td"]
    got = op.score(docs, spark.createDataFrame([(t,) for t in train], "text string")).collect()
    want = [(d, *plain_base(train, t)) for d, t, _ in rows]
    assert sorted(repr((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3))) for r in got) == sorted(
        repr((*w[:4], round(w[4], 3))) for w in want)
    none = docs.limit(0).select("text")
    assert {r.n_known for r in op.score(docs, none).collect()} == {0}
    assert op.score(docs.limit(0), none).count() == 0
    assert op.score(docs, none).filter("doc_id = 2").first().score == pytest.approx(-math.log10(257))
