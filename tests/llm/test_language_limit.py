"""The language ID stage rejects what is like no learned language, and keeps clean texts."""

import base64
import random
import string

import corpus_pipeline

FOREIGN = [
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem. ",
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью. ",
    "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。" * 3,
]


def test_language_stage_rejects_gibberish(spark):
    rnd = random.Random(3)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    junk = ["".join(rnd.choices(string.ascii_lowercase, k=300)), rnd.randbytes(200).hex(), base64.b64encode(rnd.randbytes(300)).decode()]
    junk += [" ".join("".join(rnd.choices(string.ascii_lowercase, k=rnd.randint(2, 9))) for _ in range(80)), *FOREIGN]
    more = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(junk)], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs.unionByName(more), "").select("doc_id").collect()}
    assert not {-1 - i for i in range(len(junk))} & kept
    there = {r.doc_id for r in docs.where("text rlike '[A-Za-z]'").select("doc_id").collect()}
    assert there <= kept  # short ones too
