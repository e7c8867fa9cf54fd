import brute
import corpus_pipeline as pipeline
from tallyfold.llm import pii, quality
from tallyfold.llm.common import table

from __spark_entry__ import oracle_sql, queries


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_against_plain_versions(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    before = rows(docs)
    after = {}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "source_mixture" or docs.columns == columns
        after[name] = rows(docs)
        assert len(after[name]) == docs.count()

    verdict = quality.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    good = {r.doc_id for r in verdict.filter("kept").collect()}
    assert after["quality_rules"] == {i: before[i] for i in good} and 0 < len(good) < len(before)

    one = brute.one_of_similar([(i, before[i].text) for i in sorted(good)])
    assert after["simhash_near_dedup"] == {i: before[i] for i in one} and len(one) < len(good)

    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    hit = brute.contamination([(i, before[i].text) for i in one], items)
    clean = {i for i in one if not hit[i, before[i].text][4]}
    assert after["benchmark_decontamination"] == {i: before[i] for i in clean} and len(clean) < len(one)

    assert after["pii"].keys() == clean
    for i, r in after["pii"].items():
        spans = brute.base_spans(before[i].text)
        assert not brute.base_spans(r.text) or not spans
        if not spans:
            assert pii.KINDS and (r.text == before[i].text or "[TERM]" in r.text)
        assert tuple(r)[2:] == tuple(before[i])[2:]

    mixed = after["source_mixture"]
    total = sum(len(brute.WS_WORD.findall(r.text)) for r in after["pii"].values())
    assert abs(sum(r.taken for r in mixed.values()) - total) < 0.2 * total
    assert all(r.copies in (1, 2, 3) and r.taken == r.copies * r.size for r in mixed.values())


def test_registered(spark, sf_dir):
    assert queries()["pipeline"] is pipeline.run and "pipeline" not in oracle_sql()
    assert {f"op{n}_" for n in range(1, 14)} <= {name[: name.index("_") + 1] for name in queries() if name.startswith("op")}


def test_an_empty_table_goes_through(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0
