"""The pipeline on a small table, stage by stage."""

import corpus_pipeline
from conform.llm import toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frames.append(stage(spark, frames[-1], SF).cache())
        assert frames[-1].columns == docs.columns, name
    clean, unique, mixed = frames[1:]
    scored = toxicity.score_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in scored.filter("predicted = 0").collect()}
    ids = [r.doc_id for r in unique.collect()]
    assert len(ids) == len(set(ids)) and set(ids) <= {r.doc_id for r in clean.collect()}
    assert {r.doc_id for r in mixed.collect()} <= set(ids)
    out = corpus_pipeline.run(spark, SF)
    assert out.count() == mixed.count()


def test_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"op{i}" for i in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
