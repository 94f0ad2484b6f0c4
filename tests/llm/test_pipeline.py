"""The pipeline: what each stage takes away, on the smallest tables."""

import corpus_pipeline as cp
from skysift.llm import decontaminate, exact_dedup, ngram_join
from skysift.llm import queries as q

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = q.table(spark, SF, "documents")
    columns, before = docs.columns, docs.count()
    labels = q.table(spark, SF, "labels")
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        left = spark.read.parquet(str(tmp_path / name))
        if k + 1 < len(cp.STAGES):
            assert left.columns == columns
            assert left.join(docs, columns, "left_anti").count() == 0, "rows are whole"
        if name == "quality":
            good = labels.where("quality = 1").select("doc_id").distinct().join(docs, "doc_id")
            assert good.join(left, "doc_id", "left_anti").count() <= 0.02 * good.count()
        if name == "exact_dedup":
            want = exact_dedup.decisions(docs).where("kept").select("doc_id")
            assert left.count() == want.count() and left.join(want, "doc_id", "left_anti").count() == 0
        if name == "near_dedup":
            want = ngram_join.components(docs, size=5, num=80, den=100).where("doc_id = component_id")
            assert left.count() == want.count() and left.join(want, "doc_id", "left_anti").count() == 0
        if name == "decontaminate":
            assert not decontaminate.report(left, q.table(spark, SF, "benchmark")).where("contaminated").count()
        docs = left
    assert 0 < docs.count() < before
    run = cp.run(spark, SF)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, docs.collect()))
