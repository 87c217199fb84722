import zlib

import pytest

import corpus_pipeline
from test_decontaminate import brute as windows
from test_jaccard import brute as near
from veridoc.llm import secrets


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    good = stages["quality classifier"](spark, docs, sf_dir).collect()
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in good}
    held = [i for i in label if zlib.crc32(str(i).encode()) % 5 == 0]
    assert gone and sum((i in gone) == (label[i] == 0) for i in held) >= 0.9 * len(held)

    table = spark.createDataFrame(good, docs.schema)
    single = stages["n-gram Jaccard join"](spark, table, sf_dir).collect()
    assert {r.doc_id for r in single} == {c for c, _ in near([(r.doc_id, r.text) for r in good])}

    table = spark.createDataFrame(single, docs.schema)
    clean = stages["benchmark decontamination"](spark, table, sf_dir).collect()
    assert {r.doc_id for r in clean} == {r.doc_id for r in single if not windows(r.text, items)[1]}

    table = spark.createDataFrame(clean, docs.schema)
    masked = {r.doc_id: r for r in stages["secret scans"](spark, table, sf_dir).collect()}
    for r in clean:
        spans = secrets.find_secrets(r.text)[1]
        assert masked[r.doc_id].text == (secrets.redact(r.text, spans) if spans else r.text)
        assert masked[r.doc_id].n_chars == (len(masked[r.doc_id].text) if spans else r.n_chars)
    assert any(masked[r.doc_id].text != r.text for r in clean)

    last = stages["byte-level BPE"](spark, spark.createDataFrame(list(masked.values()), docs.schema), sf_dir).collect()
    assert len(last) == len(clean) and all(r.lossless for r in last)
    whole = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert whole == {r.doc_id: r.ids_sha256 for r in last}


def test_stages_on_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


@pytest.mark.parametrize("name", ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "secret scans"])
def test_stages_take_nulls_and_repeats(spark, sf_dir, name):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, None, "en", None, None)], spark.read.parquet(f"{sf_dir}/documents.parquet").schema)
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir)
    assert out.columns == docs.columns and out.count() in (0, 4)
