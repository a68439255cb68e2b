"""The pipeline's stages against their own definitions, and the queries' registration."""

import importlib.util
from collections import Counter

import pytest

from cardloom.llm import decontaminate, neardup, pii, quality
from cardloom.llm.registry import queries

corpus_pipeline = pytest.importorskip("corpus_pipeline") if importlib.util.find_spec("corpus_pipeline") else None


def test_names():
    assert sorted(int(k[2:].split("_")[0]) for k in queries()) == list(range(1, 13))


@pytest.mark.skipif(corpus_pipeline is None, reason="no pipeline")
def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    kept = None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        rows = out.collect()
        if name == "quality_rules":
            good = {r.doc_id for r in quality.report(docs).collect() if r.kept}
            assert {r.doc_id for r in rows} == good
        elif name == "near_duplicates":
            assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in neardup.report(docs, neardup.FIVE_WORDS).collect() if r.kept)
        elif name == "decontamination":
            assert {r.doc_id for r in rows} == {r.doc_id for r in decontaminate.report(docs, bench).collect() if not r.contaminated}
        elif name == "personal_data":
            assert len(rows) == docs.count() and not any(pii.base_spans(r.text) for r in rows)
        else:
            assert {r.doc_id for r in rows} == kept
            break
        assert out.columns == docs.columns and 0 < len(rows) <= docs.count()
        kept = {r.doc_id for r in rows}
        docs = spark.createDataFrame(rows, docs.schema)
    whole = {(r.doc_id, r.doc_tokens) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert whole == {(r.doc_id, r.doc_tokens) for r in rows}  # pieces depend on how the table is dealt
