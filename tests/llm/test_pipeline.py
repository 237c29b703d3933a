"""The pipeline stage by stage, and as a whole on the smallest tables."""

import corpus_pipeline as pipeline
import pytest

from tollmill.llm import decontamination, jaccard, quality
from tollmill.llm.common import stored, table

DATA = "/root/testdata/sf0.001"


def test_stages_keep_what_they_should(spark):
    docs = table(spark, DATA, "documents")
    columns = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        before = docs
        docs = stored(stage(spark, before, DATA), name)
        assert docs.columns == columns and docs.schema["n_chars"].dataType == before.schema["n_chars"].dataType
        assert 0 < docs.count() <= before.count()
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "quality":
            score = {r["doc_id"]: r["predicted"] for r in quality.classify(before, quality.fit(before, table(spark, DATA, "labels")), ["doc_id"]).collect()}
            assert ids == {i for i, p in score.items() if p == 1}
        if name == "near_duplicates":
            rows = jaccard.join_components(before).collect()
            assert ids == {r["component_id"] for r in rows} and docs.count() == len(ids)
        if name == "decontamination":
            leaked = {r["doc_id"] for r in decontamination.leaks(before, table(spark, DATA, "benchmark")).collect()}
            assert ids == {r["doc_id"] for r in before.select("doc_id").collect()} - leaked
    last = pipeline.encode(spark, docs, DATA)
    assert {r["doc_id"] for r in last.select("doc_id").collect()} == ids


def test_run(spark):
    assert pipeline.run(spark, DATA).count() > 0


@pytest.mark.parametrize("at", range(5))
def test_edge_cases(spark, documents, clashing, at):
    name, stage = pipeline.STAGES[at]
    empty = documents([], [])
    assert stage(spark, empty, DATA).count() == 0
    out = stage(spark, clashing, DATA)
    assert at == 4 or out.columns == clashing.columns
    assert {r["doc_id"] for r in out.select("doc_id").collect()} <= {0, 1, 2, 3, 6, None}
