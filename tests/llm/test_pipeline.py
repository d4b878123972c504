import corpus_pipeline as pipeline
from lexiloom.llm.scratch import materialize

from .test_operators import FOLDER, brute_components, docs_of


def test_stages(spark, odd):
    docs = docs_of(spark)
    columns, kept = docs.columns, {}
    for name, stage in pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, FOLDER), name)
        kept[name] = docs
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "near_dedup":
            groups = brute_components(before.collect(), 5, 80)
            assert sorted(r.doc_id for r in docs.collect()) == sorted(k for k, (_, c) in groups.items() if k == c)
        if name == "exact_dedup":
            texts = {" ".join(r.text.split()) for r in before.collect()}
            assert docs.count() == len(texts)
    assert {r.doc_id for r in kept["mixing"].collect()} == {r.doc_id for r in kept["near_dedup"].collect()}
    assert kept["pieces"].count() == kept["mixing"].count()


def test_stages_on_odd_rows_and_none(spark, odd):
    for rows in (odd, odd.limit(0)):
        docs = rows
        for name, stage in pipeline.STAGES:
            docs = materialize(stage(spark, docs, FOLDER), name)
