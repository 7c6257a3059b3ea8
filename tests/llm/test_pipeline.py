"""The pipeline on a small corpus, stage by stage, against brute force."""

import random

import corpus_pipeline
from pyspark.sql import functions as F
from test_near_stage import alike, sets
from test_operators import components

from windrow.llm.queries import queries


LOWER = {c: c + 32 for c in range(65, 91)}
CLASH = ["score", "lang_pred", "kept", "keep_id", "group_size", "text_sha256", "block", "weight", "copies", "n_tokens", "order_key", "held_out", "row", "set", "wide", "nth__", "id__", "sha__", "s__", "text__", "label", "uid", "piece", "length"]


def corpus(spark, path):
    src = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rnd = random.Random(1)
    rows = [tuple(r) for r in src]
    rows += [(10_000 + i, r.text, r.lang, r.source, r.n_chars) for i, r in enumerate(src[:20])]
    rows += [(20_000, None, None, "s", 0), (20_001, "", "en", "s", 0), (20_002, "12 34", None, None, 5)]
    for i, r in enumerate(x for x in src if len(x.text.split()) > 300):
        w = r.text.split(" ")
        w[rnd.randrange(len(w))] = "changed"
        rows.append((30_000 + i, " ".join(w), r.lang, r.source, 0))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")


def test_stages(spark, tmp_path):
    path = str(tmp_path)
    corpus(spark, path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "mixing", "packing"]
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{path}/{k}")
        docs = spark.read.parquet(f"{path}/{k}")
        kept.append(docs.collect())
    first, exact, near, mixed, packed = kept
    assert not {20_000, 20_001, 20_002} & {r.doc_id for r in first}
    squeeze = lambda t: "".join(t.split())
    best = {}
    for r in first:
        key = (-len(r.text), r.doc_id)
        best[squeeze(r.text)] = min(best.get(squeeze(r.text), key), key)
    assert sorted(r.doc_id for r in exact) == sorted(v[1] for v in best.values())
    exact = sorted(exact, key=lambda r: r.doc_id)
    # five words and a similarity of 0.8, by the shingle sets themselves; the three-bit rule that stood here is op5's, not the stage's
    comp = components([sets(r.text.translate(LOWER)) for r in exact], alike)
    assert sorted(r.doc_id for r in near) == [r.doc_id for i, r in enumerate(exact) if comp[i] == i]
    assert {r.doc_id for r in mixed} == {r.doc_id for r in near}  # sources repeat, none loses a document
    assert {r.doc_id for r in packed} == {r.doc_id for r in mixed}
    assert corpus_pipeline.run(spark, path).count() == len(packed)


def test_queries_are_registered():
    import __spark_entry__

    assert set(queries()) | {"pipeline"} <= set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in queries()} == {f"op{i}" for i in range(1, 11)}


def test_stages_lose_no_row_and_no_column(spark, tmp_path):
    """Repeated ids, rows and clashing names of every result and helper; a very long text; rows without an id."""
    rnd = random.Random(5)
    prose = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang = 'en' AND n_chars > 600").limit(12).collect()]
    a, b, c = prose[:3]
    long = " ".join(rnd.choices(" ".join(prose).split(), k=200_000))
    rows = [(1, a), (2, a), (2, b), (2, c), (7, long), (None, prose[3]), (9, prose[4]), (9, prose[4])]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id bigint, text string, lang string, source string").select("*", *(F.lit(f"own {x}").alias(x) for x in CLASH))
    want = {(1, a), (2, b), (2, c), (7, long), (None, prose[3]), (9, prose[4])}
    docs = df
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, "")
        assert out.columns == df.columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        got = docs.collect()
        assert {(r.doc_id, r.text) for r in got} == (want if k else {(i, t) for i, t in rows}), name
        assert {r[x] for r in got for x in CLASH} == {f"own {x}" for x in CLASH}
        assert len(got) == (len(want) if k else len(rows))  # one source: mixing repeats nothing
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert sum(r.piece == 0 for r in packed) == len(want) and max(r.piece for r in packed) > 50


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0
