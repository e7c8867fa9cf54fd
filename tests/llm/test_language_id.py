import re
import zlib
from collections import Counter

import zstandard
from pyspark.sql import functions as F

from tallyfold.llm import language_id as op


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = op.digest_rows(docs).collect()
    assert len(rows) == len(lang) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    right = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]
    assert len(right) > 100 and sum(right) / len(right) > 0.98


def test_nulls_ties_empty_tables(spark):
    en, de = "the cat and the dog were in the house ", "der hund und die katze waren in dem haus "
    rows = [(1, en * 9, "en"), (2, de * 9, "de"), (3, None, "de"), (4, en * 2000, None), (4, en * 2000, None), (None, "die katze", "x"), (7, "", "en"), (8, "12 !? ½", "fr"), (9, de, "en"), (None, en * 3, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    dictionaries = op.learn(docs.filter("doc_id < 3"))
    assert list(dictionaries) == ["de", "en"]  # equally common: by name
    got = op.identify(docs.withColumnsRenamed({"lang": "score"}), dictionaries)
    assert got.columns == ["doc_id", "text", "lang_pred", "score"]
    found = {(r.doc_id, r.text and r.text[:8]): (r.lang_pred, r.score) for r in got.collect()}
    assert found[4, "the cat "][0] == "en" and found[9, "der hund"][0] == "de" and found[None, "die katz"][0] == "de"
    assert found[3, None] == found[7, ""] == found[8, "12 !? ½"] == ("und", 0.0)
    assert got.count() == len(rows)
    sure = {r.doc_id: r.lang_pred for r in op.identify(docs, dictionaries, min_margin=0.99).collect()}
    assert set(sure.values()) == {"und"}
    assert op.identify(docs.limit(0), dictionaries).count() == 0 and op.learn(docs.limit(0)) == {}
    assert {r.lang_pred for r in op.identify(docs, {}).collect()} == {"und"}
    assert {r.lang_pred for r in op.identify(docs.filter("doc_id = 9"), {"en": b"abc"}).collect()} == {"en"}


def test_query_against_plain_compression(spark, sf_dir):
    """Dictionaries of the documented sample, one compressor call per text and language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in op.digest_rows(docs).collect()}
    rows = docs.select("doc_id", "text", "lang", F.xxhash64("doc_id").alias("place")).collect()
    train = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 and r.lang is not None and r.text]
    samples, counts = {}, Counter(r.lang for r in train)
    for lang in counts:
        left, texts = op.DICTIONARY_BYTES, []
        for r in sorted((r for r in train if r.lang == lang), key=lambda r: r.place)[: op.SAMPLE]:
            if len(r.text.encode()) <= left:
                left -= len(r.text.encode())
                texts.insert(0, " ".join(re.findall(r"[^\W\d_]+", r.text.lower())).encode())
        samples[lang] = b"\n".join(texts)
    order = sorted(samples, key=lambda lang: (-counts[lang], lang))
    for r in rows:
        if not r.text or not any(c.isalpha() for c in r.text):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        data = " ".join(re.findall(r"[^\W\d_]+", r.text.lower())).encode()
        sizes = []
        for lang in order:
            known = zstandard.ZstdCompressionDict(samples[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sizes.append(len(zstandard.ZstdCompressor(op.LEVEL, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False).compress(data)))
        best = sizes.index(min(sizes))
        assert got[r.doc_id].lang_pred == order[best]
        assert abs(got[r.doc_id].score - (1 - min(sizes) / min(sizes[:best] + sizes[best + 1 :]))) < 1e-12


def test_texts_that_do_not_fit_are_passed_over(spark, monkeypatch):
    monkeypatch.setattr(op, "DICTIONARY_BYTES", 100)
    rows = [(i, "ab" * n, "x") for i, n in enumerate((30, 60, 10, 45, 5))] + [(9, "".join(f"{i}q" for i in range(300)), "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    order = [r.doc_id for r in docs.filter("lang = 'x'").orderBy(F.xxhash64("doc_id")).collect()]
    left, want = 100, []
    for i in order:
        if len(rows[i][1]) <= left:
            left -= len(rows[i][1])
            want.insert(0, rows[i][1].encode())
    found = op.learn(docs)
    assert found["x"] == b"\n".join(want) and 0 < len(found["long"]) <= 100
