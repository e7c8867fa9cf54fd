import math
import random
import re

import brute
import pyarrow.parquet as pq

from tallyfold.llm import pii as op


def test_whole_table_against_brute_force(spark, sf_dir):
    docs = pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()
    rows = op.digest_rows(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    assert {r.doc_id: tuple(r)[1:6] for r in rows} == {d["doc_id"]: brute.pii_row(d["text"]) for d in docs}
    assert all(r.spans.startswith(",".join(f"{k}:{a}:{b}" for k, a, b in brute.base_spans(d["text"]))) for r, d in
               zip(sorted(rows, key=lambda r: r.doc_id), sorted(docs, key=lambda d: d["doc_id"]), strict=True))


def test_random_and_hostile_texts(spark):
    pick = random.Random(5)
    bits = ["a", "B9", "é", "@", "@", ".", ".", "_", "-", "+", "1", "22", "255", "256", "007", " ", "\n", "(", ")", "4111111111111111", "😀",
            "a@b.c", "1.2.3.4", "+1 (415) 555-2671", "4111 1111 1111 1111"]
    texts = ["".join(pick.choice(bits) for _ in range(pick.choice([3, 10, 40]))) for _ in range(400)]
    texts += [None, "", "1 " * 30000, "9" * 30000, "a." * 20000 + "@" + "b." * 20000 + "c", "a@b.co_m@x.yy", "1." * 30000, "+1" * 9000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "a@b.c", 2), (0, texts[0], 3)], "doc_id long, text string, base int")
    slow = {i: brute.pii_row(t) for i, t in enumerate(texts) if len(t or "") < 1000}
    got = [(r.doc_id, tuple(r)[1:6]) for r in op.digest_rows(docs).collect()]
    assert len(got) == docs.count() and {i: v for i, v in got if i in slow} == slow
    assert op.digest_rows(docs.limit(0)).count() == 0
    clean = {r.doc_id: r.text for r in op.sanitise(docs).filter("base = 1").collect()}
    assert clean[len(texts) - 3].startswith("[EMAIL]@x.yy") or "[EMAIL]" in clean[len(texts) - 3]
    for i, text in enumerate(texts):
        spans = slow.get(i) and brute.base_spans(text)
        if spans:
            assert "[" in clean[i]
        elif spans == []:
            assert clean[i] == text


def test_disclosing_terms_against_brute_force(spark):
    pick = random.Random(2)
    plain = [f"common{chr(97 + i)}" for i in range(20)]
    say = lambda n: " ".join(pick.choice(plain) for _ in range(n))
    texts = [f"{say(30)} Reginald Quux writes from rq@mail.example {say(30)}" for _ in range(8)]
    texts += [f"{say(20)} Quux {say(9)}", f"{say(20)} quuxes {say(9)}", say(3) + " reginald."]
    texts += [f"{say(40)} {i}" for i in range(200)]
    texts += [f"lonely zebra{chr(97 + i)} +1 (415) 555-26{i:02}" for i in range(10)]
    texts += texts[:8] * 5  # copies are no more evidence
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    distinct = set(texts)
    words = {t: set(re.findall(r"[^\W\d_]{3,}", t.lower())) for t in distinct}
    pairs, holders = {}, {}
    for t in distinct:
        for kind, a, b in brute.base_spans(t):
            entity = (kind, re.sub("[^0-9]", "", t[a:b]) if kind in ("card", "phone") else t[a:b].lower())
            holders.setdefault(entity, set()).add(t)
            for m in re.finditer(r"[^\W\d_]+", t):  # whole words only
                if len(m[0]) >= 3 and (a - op.REACH <= m.start() and m.end() <= a or b <= m.start() and m.end() <= b + op.REACH):
                    pairs.setdefault((entity, m[0].lower()), set()).add(t)
    risky = set()
    for (entity, w), both in pairs.items():
        if len(both) >= op.SUPPORT:
            n_term = sum(w in ws for ws in words.values())
            content = math.log2(len(distinct) / len(holders[entity]))
            if n_term and math.log2(len(distinct) * len(both) / (len(holders[entity]) * n_term)) >= op.DISCLOSURE * content:
                risky.add(w)
    assert {"quux"} <= risky and not risky & set(plain)
    found = op._find_base(docs, "doc_id", "text")
    assert {r.term for r in op.disclosing_terms(found, docs)[0].collect()} == risky
    got = {r.doc_id: r.spans for r in op.digest_rows(docs).collect()}
    for i, text in enumerate(texts):
        base = brute.base_spans(text)
        terms = [("term", m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", text)
                 if m[0].lower() in risky and not any(a < m.end() and m.start() < b for _, a, b in base)]
        assert got[i] == ",".join(f"{k}:{a}:{b}" for k, a, b in base + terms)
    clean = {r.doc_id: r.text for r in op.sanitise(docs).collect()}
    assert "[EMAIL]" in clean[0] and "uux" not in clean[0] and clean[9] == texts[9] and clean[8] == texts[8].replace("Quux", "[TERM]")


def test_edges_of_longer_words_are_no_terms(spark):
    """A name that is also what the reach leaves of longer words beside other entities."""
    far = "x" * (op.REACH - 5)
    texts = [f"{i} ana rq@mail.example end" for i in range(6)]
    texts += [f"{i} banana {far} u{i}@mail.example {far} anatomy and so on" for i in range(40)]
    texts += [f"only words {i}" for i in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = op._find_base(docs, "doc_id", "text")
    beside = {t for r in found.collect() for e in r.entities for t in e.terms}
    assert "ana" in beside and not beside & {"banana", "anatomy", "nana", "anat"}
    assert "ana" in {r.term for r in op.disclosing_terms(found, docs)[0].collect()}
    cut = spark.createDataFrame([(1, "ÉÉÉÉabc@d.eeééé ok fine")], "doc_id long, text string")
    assert op._find_base(cut, "doc_id", "text").first().entities[0].terms == ["fine"]


def test_many_matches_in_one_text(spark):
    text = " ".join(f"a{i}@b.c, word 10.0.{i % 256}.1;" for i in range(12000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert tuple(op.digest_rows(docs).first())[1:6] == brute.pii_row(text)
    assert op.sanitise(docs).first().text == " ".join("[EMAIL], word [IP];" for _ in range(12000))
