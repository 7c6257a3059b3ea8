"""Toxicity sees the letters of every script."""

from windrow.llm import toxicity

TEXTS = {"zh": ("你这个笨蛋滚出去", "今天天气很好我们去公园"), "ko": ("이바보야꺼져", "오늘날씨가좋다"), "th": ("ไอ้โง่ออกไป", "วันนี้อากาศดี"), "ja": ("ばかやろう消えろ", "今日は天気がいい"), "osage": ("\U000104b0\U000104b1\U000104b2", "\U000104b3\U000104b4\U000104b5")}


def test_toxicity_in_all_scripts(spark):
    for bad, good in TEXTS.values():
        rows = [(i, f"{good if i % 4 else bad} {good}{i}") for i in range(200)]
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
        labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id bigint, toxic int")
        got = toxicity.score(docs, toxicity.learn(labels, docs)).collect()
        assert all(r.predicted == (r.doc_id % 4 == 0) for r in got)


def test_unspaced_features_are_shared():
    f, n = toxicity._features(["笨蛋", "他是笨蛋吗", "hello", "HELLO"])
    whole = f[: n[0]].tolist()
    assert len(whole) == 3 and set(whole) <= set(f[n[0] : n[0] + n[1]].tolist())
    assert f[-n[3] :].tolist() == f[-n[3] - n[2] : -n[3]].tolist()
