"""The pipeline's stages on small input."""

from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.llm import mixing, simhash

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "language", "near_duplicates", "mixing", "bpe"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, kept, SF).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        assert after.columns == docs.columns
        if name != "mixing":
            assert after.count() == after.select("doc_id").distinct().count() <= kept.count()
            assert after.exceptAll(kept).count() == 0
        if name == "near_duplicates":
            assert simhash.near_duplicates(after).where("doc_id <> component_id").count() == 0
        if name == "mixing":
            want = {r[0]: len(r[1]) for r in mixing.mix(kept, whole_documents=True).select("doc_id", "draws").collect()}
            got = {r[0]: r[1] for r in after.groupBy("doc_id").count().collect()}
            assert got == {k: v for k, v in want.items() if v}
        kept = after
    out = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert out.count() == kept.count()


def test_odd_rows(spark, docs, empty):
    labels = SF
    for table in (docs, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, labels)
            assert out.columns == table.columns and out.count() <= 2 * table.count()


def test_odd_names(spark, docs):
    """Columns that no schema string could hold ride along."""
    odd = docs.where("doc_id < 9").withColumn("my-col x", F.lit(1)).withColumn("a`b", F.lit("z")).withColumn("c.d", F.lit(2))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns and out.count() <= 2 * odd.count()
