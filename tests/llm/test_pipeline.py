"""The pipeline's stages on the small table: decisions take effect, columns stay, nothing else goes."""

import corpus_pipeline
from threadloom.llm import decontaminate, toxicity
from threadloom.storage import materialize


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "decontamination", "pii", "byte_bpe"]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, before, sf_dir), "test-stage")
        if name == "toxicity":
            model = toxicity.fit(before, spark.read.parquet(f"{sf_dir}/labels.parquet"), folds=None)
            want = {r["doc_id"] for r in toxicity.score(before, model).where("predicted = 0").collect()}
            assert {r["doc_id"] for r in after.select("doc_id").collect()} == want
        if name == "decontamination":
            bad = decontaminate.find_leaks(before, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
            assert after.count() == before.count() - bad.count()
        if name == "pii":
            assert after.count() == before.count() and after.where("text like '%@%.com%'").count() == 0
        if name == "byte_bpe":
            assert after.count() == before.count() and after.where("not round_trip").count() == 0
        else:
            assert after.columns == docs.columns
        before = after


def test_run_equals_stages(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 100
