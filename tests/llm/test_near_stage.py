"""The near-dedup stage against exact Jaccard similarity of word shingles."""

import random

import corpus_pipeline
from test_operators import components, plain_simhash


def sets(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return 10 * len(a & b) >= 8 * len(a | b)


def test_near_stage_reaches_similar_texts(spark, tmp_path):
    rnd = random.Random(6)
    texts = []
    for k in range(40):
        base = [f"w{rnd.randrange(3000)}" for _ in range(rnd.choice([20, 60, 200, 500]))]
        for _ in range(40 if k == 0 else 4):
            t = list(base)
            for _ in range(rnd.randint(0, max(1, len(t) // 35))):
                t[rnd.randrange(len(t))] = f"x{rnd.randrange(10**6)}"
            texts.append(" ".join(t))
    rnd.shuffle(texts)
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/d")
    s = [sets(t) for t in texts]
    comp = components(s, alike)
    got = corpus_pipeline.near(spark, spark.read.parquet(f"{tmp_path}/d"), str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == [i for i, c in enumerate(comp) if c == i]
    tight = components([plain_simhash(t) for t in texts], lambda a, b: (a ^ b).bit_count() <= 3)
    assert len(got) < len(set(tight))  # three of 64 bits leave near copies
