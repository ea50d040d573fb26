"""The stages of the pipeline against plain Python, on given and on awkward documents."""

import corpus_pipeline
import pytest
from llm_data import DOCS, documents, edge_texts
from oracle import TESTDATA
from test_llm_jaccard import groups

from tidemark.llm import mixing, quality
from tidemark.llm.common import materialised

SF = f"{TESTDATA}/sf0.001"
NAMES = ["quality_rules", "near_duplicates", "benchmark_decontamination", "target_mixing", "token_records"]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == NAMES
    text = {r.doc_id: r.text for r in docs.collect()}
    columns, kept = docs.columns, set(text)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialised(stage(spark, docs, SF), "stage-test")
        ids = [r.doc_id for r in out.collect()]
        assert out.columns == columns and set(ids) <= kept and ids
        if name == "quality_rules":
            judged = quality.judged(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            assert set(ids) == {r.doc_id for r in judged.where("quality.kept").collect()}
        if name == "near_duplicates":
            before = sorted(kept)
            assert set(ids) == {before[g] for g in groups([text[i] for i in before])}
        if name == "benchmark_decontamination":
            items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            dropped = {i for i in kept if any(item in text[i] for item in items)}
            assert dropped and set(ids) == kept - dropped
        if name == "target_mixing":
            assert max(map(ids.count, ids)) <= mixing.MOST_USES and len(set(ids)) > len(kept) / 2
        else:
            assert len(set(ids)) == len(ids)
        docs, kept = out, set(ids)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted(r.doc_id for r in last) == sorted(r.doc_id for r in docs.collect())
    assert sorted(map(tuple, last)) == sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))


@pytest.mark.parametrize("stage", NAMES)
@pytest.mark.parametrize("rows", [[], edge_texts()], ids=["empty", "awkward"])
def test_stages_take_awkward_documents(spark, stage, rows):
    """Empty tables, NULL ids and texts, repeated rows and columns with the names the stages use inside."""
    docs = documents(spark, rows)
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, SF).collect()
    assert len(out) <= mixing.MOST_USES * len(rows) and (rows or not out)
    if stage == "token_records":
        assert len(out) == len(rows)
    else:
        assert all(list(r.asDict()) == [f.split()[0] for f in DOCS.split(", ")] for r in out)
        assert {(r.doc_id, r.text) for r in out} <= set(rows)
