import corpus_pipeline
from actlake.llm import secrets
from actlake.llm.common import documents

D = "/root/testdata/sf0.001"


def test_stages_take_effect_and_run_agrees(spark, tmp_path):
    docs, kept = documents(spark, D), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, D)
        out.write.parquet(str(tmp_path / name))
        kept[name] = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert sorted(kept[name].columns) == sorted(docs.columns)
        docs = kept[name]
    ids = {n: {r.doc_id for r in df.select("doc_id").collect()} for n, df in kept.items()}
    assert ids["quality_classifier"] > ids["exact_dedup"] >= ids["near_dedup"] == ids["secret_scan"] == ids["packing"]
    texts = [r.text for r in kept["exact_dedup"].collect()]
    assert len({" ".join(t.split()) for t in texts}) == len(texts)
    assert secrets.report(kept["secret_scan"], secrets.train(kept["secret_scan"])).where("n_assign + n_access + n_hex > 0").count() == 0
    assert {r.doc_id for r in corpus_pipeline.run(spark, D).collect()} == ids["packing"]


def test_stages_take_an_empty_table(spark):
    docs = documents(spark, D).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, D).count() == 0
