"""The pipeline's stages in a row, each held against what its operator says of its own input."""

from collections import Counter

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(docs, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    docs.write.parquet(f"file://{path}/documents.parquet")
    return f"file://{path}"


def test_stages_follow_one_another(spark, folder):
    from orograph.functions.tables import load, materialize
    from orograph.llm.minhash import near_duplicates
    from orograph.llm.mixing import mix
    from orograph.llm.quality import quality

    docs = load(spark, folder, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, folder), name)
        seen[name] = (before, docs)
        if name != "sentencepiece":
            assert docs.columns == before.columns
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    before, after = seen["quality"]
    assert ids(after) == ids(quality(before).filter("kept"))
    before, after = seen["near_duplicates"]
    assert ids(after) == Counter(set(ids(near_duplicates(before, shingle=5).filter("kept"))))
    before, after = seen["pii"]
    assert ids(after) == ids(before)
    before, after = seen["mixing"]
    assert set(ids(after)) == set(ids(mix(before).filter("taken > 0")))
    before, after = seen["sentencepiece"]
    assert ids(after) == ids(before)
    assert ids(corpus_pipeline.run(spark, folder)) == ids(after)


def test_run_on_an_empty_table(spark, no_docs, tmp_path):
    no_docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
