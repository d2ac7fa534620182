"""The pipeline's stages against what the operators decide, on odd rows."""

import corpus_pipeline

from weft.llm import decontaminate, quality


def test_stages(spark, docs, tmp_path, rows):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    long = next(r[1] for r in rows if r[0] == 80).split()
    spark.createDataFrame([(0, " ".join(long[500:540])), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    held = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, held, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        before, held = held, spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(held.count())
        if name != "mixing":
            assert held.columns == before.columns
    assert seen[0] == quality.quality_rules(docs).where("kept").count()
    assert seen == sorted(seen, reverse=True) and seen[2] == seen[1] - 1 and seen[4] == seen[3] == seen[2]
    ids = {r["doc_id"] for r in held.collect()}
    assert 80 not in ids and 40 in ids and not ids & {41, 42, 43, 44, 45}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen[-1]
    assert decontaminate.contaminated_pairs(spark.read.parquet(f"{tmp_path}/secrets"), spark.read.parquet(f"{tmp_path}/benchmark.parquet")).count() == 0
