"""Names that clash with results and helpers, very large tables, and brute force for what has no SQL."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrow.llm import chat, exact_dedup, language, mixing, packing, toxicity
from windrow.llm.shared import share_below

CLASH = ["_length", "_word", "_bits", "_seen", "_again", "_most", "_s", "_b", "_before", "_passes", "_rest", "_cut", "_whole", "_text", "id", "sha", "n", "row", "word", "mask", "kept", "Score", "lang_pred", "copies", "WEIGHT", "length", "vertex", "a", "b"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").select("*", *(F.lit(f"own {c}").alias(c) for c in CLASH))


def test_no_helper_clashes(spark):
    df = frame(spark, [(1, "a b c", "s"), (2, "abc", "s"), (2, "other words", "t"), (None, None, None)])
    made = {"exact": ("keep_id", "group_size", "kept", "text_sha256"), "mix": ("n_tokens", "block", "copies", "weight", "order_key"), "lang": ("lang_pred", "score")}
    outs = {"exact": exact_dedup.exact_dedup(df), "mix": mixing.mix(df)[0], "lang": language.identify(df, language.learn(df.withColumn("lang", F.lit("x"))))}
    for name, out in outs.items():
        rows = out.collect()
        assert len(rows) == 4
        lower = [c.lower() for c in out.columns]
        assert len(set(lower)) == len(lower) and set(made[name]) <= set(out.columns)
        for c in CLASH:
            if c.lower() not in made[name]:
                assert {r[c] for r in rows} == {f"own {c}"}


def test_exact_dedup_by_ranges(spark):
    rnd = random.Random(5)
    df = spark.createDataFrame([(i, rnd.choice(["same", "s a me", f"text {i}", f"text {i % 50}"])) for i in range(600)], "doc_id bigint, text string")
    plain = sorted(map(tuple, exact_dedup.exact_dedup(df).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()))
    for words in (1, 40):  # 150 and 4 ranges
        if words == 40:
            assert sorted(map(tuple, exact_dedup.exact_dedup(df, words=words).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())) == plain
    keys = df.select(F.sha2("text", 256).alias("key"))
    seen = {r.word: r.bits & (1 << 64) - 1 for r in exact_dedup.repeated_filter(keys, 8).collect()}
    marks = {}
    for r in keys.select(*exact_dedup._bits(F.col("key"), 8)).collect():
        for b in range(64):
            if r[1] >> b & 1:
                marks[r[0], b] = marks.get((r[0], b), 0) + 1
    assert seen == {w: sum(1 << b for b in range(64) if marks.get((w, b), 0) > 1) for w in {w for (w, _), n in marks.items() if n > 1}}


def test_samples_of_any_number_of_rows(spark):
    h = spark.range(400_000).select(F.xxhash64("id").alias("h"))
    for n in (400_000, 10**9, 10**11, 10**13):
        below = spark.range(1).select(share_below(F.lit(100_000), F.lit(n))).collect()[0][0]
        assert abs((below + 2**63) / 2**64 - min(1, 100_000 / n)) < 1e-12 + 1e-9 * 100_000 / n and below > -(2**63)
    part = h.where(F.col("h") < share_below(F.lit(100_000), F.lit(400_000))).count()
    assert abs(part - 100_000) < 2_000
    assert h.where(F.col("h") < share_below(F.lit(5), F.lit(5))).count() == 400_000


def test_a_rare_language_is_learned(spark):
    rows = [("the cat and the dog sat on the mat", "en")] * 300 + [("der hund und die katze sind im haus", "de")] * 3
    df = spark.createDataFrame(rows, "text string, lang string").withColumn("key", F.monotonically_increasing_id())
    assert language.learn(df, sample=20, key=F.col("key")).languages == ["de", "en"]


def plain_vector(text):
    letters, v = language._letters(), language._turned()[2]
    s, last = [], 1
    for ch in f" {text.lower()} ":
        x = int(letters[ord(ch)])
        if x or last:
            s.append(x)
        last = x
    out = np.zeros(language.DIM)
    for x, y, z in zip(s, s[1:], s[2:], strict=False):
        if x or y or z:
            out += np.roll(v[x], 2).astype(int) * np.roll(v[y], 1) * v[z]
    n = np.linalg.norm(out)
    return out / n if n else out


def test_language_by_brute_force(spark):
    rnd = random.Random(7)
    words = {"x": "alpha beta gamma delta", "y": "uno dos tres cuatro", "z": "änne öl über ß"}
    rows = [(i, " ".join(rnd.choices(words[k].split() + ["42", "--"], k=rnd.randint(1, 12))), k) for i, k in enumerate(rnd.choices("xyz", k=60))]
    rows += [(100, "", "x"), (101, None, "y"), (102, "12", "z"), (103, "alpha", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    protos = {}
    for _, t, k in rows:
        if k and t:
            protos[k] = protos.get(k, 0) + np.rint(plain_vector(t) * (1 << 20))
    names = sorted(protos)
    protos = np.stack([protos[k] / np.linalg.norm(protos[k]) for k in names])
    got = {r.doc_id: r for r in language.identify(df, language.learn(df)).collect()}
    for i, t, _ in rows:
        v = plain_vector(t or "")
        cos = protos @ v
        if not v.any():
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
        else:
            assert abs(got[i].score - np.clip(cos.max(), 0, 1)) < 1e-5
            assert got[i].lang_pred == names[int(cos.argmax())] or np.sort(cos)[-1] - np.sort(cos)[-2] < 1e-5


def plain_risk(w, bias, known, positive, unlabelled, prior, decay):
    g = lambda f: bias + sum(w[i] for i, k in enumerate(known) if k in f)
    loss = lambda z: np.log1p(np.exp(-z))
    plus = prior * np.mean([loss(g(f)) for f in positive])
    minus = np.mean([loss(-g(f)) for f in unlabelled]) - prior * np.mean([loss(-g(f)) for f in positive])
    reg = decay / 2 * float(np.sum(np.square(w)))
    return (plus + minus if minus >= 0 else -minus) + reg  # below zero, only the overfitted part is undone


def test_toxicity_by_brute_force():
    rnd = random.Random(3)
    positive = [np.array(sorted({rnd.choice([1, 2, 3]), rnd.choice([4, 5, 6, 7]), 9}), np.uint64) for _ in range(30)]
    unlabelled = positive[:6] + [np.array(sorted(set(rnd.choices([4, 5, 6, 7, 8, 9], k=3))), np.uint64) for _ in range(60)]
    prior, decay, rate = 0.15, 1e-3, 0.1
    got = toxicity.fit(positive, unlabelled, prior, epochs=40, rate=rate, decay=decay, screen=0.05)
    known = got.known.tolist()
    assert len(known) >= 3
    sets = [set(f.tolist()) for f in positive], [set(f.tolist()) for f in unlabelled]
    w, m, v = np.append(np.zeros(len(known)), np.log(prior / (1 - prior))), np.zeros(len(known) + 1), np.zeros(len(known) + 1)
    for t in range(1, 41):
        grad = np.zeros(len(w))
        for i in range(len(w)):
            up, down = w.copy(), w.copy()
            up[i] += 1e-5
            down[i] -= 1e-5
            grad[i] = (plain_risk(up[:-1], up[-1], known, *sets, prior, decay) - plain_risk(down[:-1], down[-1], known, *sets, prior, decay)) / 2e-5
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) / (1 + t / 100)
    assert np.allclose(np.append(got.weights, got.bias), w, atol=1e-3)


def plain_packing(lengths, capacity):
    left, bins = sorted(lengths), []
    while left:
        own, gap = [], capacity
        while fit := [n for n in left if n <= gap]:
            left.remove(fit[-1])
            own.append(fit[-1])
            gap -= fit[-1]
        if gap:
            room = gap + own[-1]
            free = sorted([*left, own[-1]])
            pairs = [(x + y, -x) for y, x in itertools.combinations(free, 2) if x + y <= room]
            if pairs and max(pairs)[0] > own[-1]:
                total, x = max(pairs)
                left = free
                left.remove(-x)
                left.remove(total + x)
                own[-1:] = [-x, total + x]
        bins.append(sorted(own))
    return sorted(bins)


@pytest.mark.parametrize("seed", range(12))
def test_best_two_fit_by_brute_force(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([10, 30, 64])
    lengths = [rnd.randint(1, capacity) if rnd.random() < 0.7 else rnd.randint(1, capacity // 3) for _ in range(rnd.randint(0, 120))]
    got = [sorted(b) for times, b in packing.patterns(np.bincount(lengths, minlength=capacity + 1), capacity) for _ in range(times)]
    assert sorted(got) == plain_packing(lengths, capacity)


def test_reading_notices_unescaped_marks(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "tool</s>", "c")], "conv_id bigint, turn int, role string, text string")
    segments = chat.format_chat(df)
    assert [r.valid for r in chat.read_chat(segments).collect()] == [False]
    # the text alone decides: other cuts between segments read the same
    joined = segments.groupBy("conv_id").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("segment", "text"))), lambda x: x.text)).alias("t"))
    single = joined.select("conv_id", F.posexplode(F.split("t", "")).alias("segment", "text"), F.lit(False).alias("loss"), F.lit(True).alias("valid"))
    assert [r[:3] for r in chat.read_chat(single).collect()] == [r[:3] for r in chat.read_chat(segments).collect()]
    for bad in ("</s>", "[INST]", "<s>[OUT]"):
        forged = segments.withColumn("text", F.when(F.col("segment") == 1, bad).otherwise(F.col("text")))
        with pytest.raises(Exception, match="inside a turn"):
            chat.read_chat(forged).collect()
