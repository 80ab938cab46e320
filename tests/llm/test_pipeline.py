"""The pipeline's stages on the smallest tables: what goes must go, what stays must stay whole."""

import collections
import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_stages(spark):
    import corpus_pipeline
    from factloom.llm import exact_dedup, jaccard, mixing, store, toxicity

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = collections.Counter(r.doc_id for r in docs.collect())
        out = store.settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, SF), name)
        rows = out.collect()
        after = collections.Counter(r.doc_id for r in rows)
        if name != "packing":
            assert out.columns == columns
        if name == "toxicity":
            score = toxicity.scored(docs, toxicity.trained(docs, labels))
            assert after == {r.doc_id: 1 for r in score.where("predicted = 0").collect()}
        elif name == "exact_dedup":
            assert after == {r.doc_id: 1 for r in exact_dedup.dedup(docs, exact_dedup.earlier_half(docs)).where("kept").collect()}
        elif name == "ngram_jaccard_join":
            assert after == {r.doc_id: 1 for r in jaccard.join(docs).where("doc_id = component_id").collect()}
        elif name == "source_mixing":
            assert after == {r.doc_id: r.times for r in mixing.mix(docs, labels).where("times > 0").collect()}
        else:
            held = collections.Counter()
            for r in rows:
                held[r.doc_id] += r.length
            assert held.keys() == before.keys()
            assert all(held[r.doc_id] == r.doc_tokens * before[r.doc_id] for r in rows)
            assert len({r.sequence_id for r in rows}) == len(rows)
        docs = out
