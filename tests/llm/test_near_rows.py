"""The near-dedup stage decides row by row."""

import corpus_pipeline

A = " ".join(f"a{i}" for i in range(200))
B = " ".join(f"b{i}" for i in range(200))


def test_near_stage_decides_by_row(spark):
    rows = [(1, A), (2, A + " end"), (2, B), (3, B.replace("b9 ", "c9 ")), (5, "other text"), (5, "other text"), (None, A), (None, "alone"), (7, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = corpus_pipeline.near(spark, df, "").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, A), (2, B), (5, "other text"), (None, "alone"), (7, None)]))
    assert got[0].__fields__ == df.columns
    assert corpus_pipeline.near(spark, df.limit(0), "").count() == 0
