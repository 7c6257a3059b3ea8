"""Rows with whole texts reach Python some at a time: JVM and worker both hold a batch."""

import pyarrow as pa
from pyspark.sql import functions as F
from windrow.llm import packing, shared
from windrow.llm.queries import _tokenizer


def test_texts_are_packed_from_small_batches(spark, monkeypatch):
    name, handed = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    usual = spark.conf.get(name)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    def seen(df, *args, **options):
        rows = spark.range(2500, numPartitions=1).mapInArrow(sizes, "n bigint")
        handed.extend(r.n for r in shared.written(rows, "sizes", batch=options.get("batch")).collect())
        return write(df, *args, **options)

    write = packing.written
    monkeypatch.setattr(packing, "written", seen)
    docs = spark.range(2500, numPartitions=1).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"))
    got = packing.pack_documents(docs, _tokenizer("word_bpe_49k.json"))
    assert got.count() == 2500
    assert sum(handed) == 2500 and max(handed) == 1000
    assert spark.conf.get(name) == usual
