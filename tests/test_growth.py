"""Steps whose cost once grew faster than their input, against plain loops, at sizes that the old ways did not get through."""

import random
import time


def test_boxes_of_a_full_frame(spark):
    """Many kept boxes: the kept box that a box votes for is looked for once, not once for each kept box (not ended in 60 s before)."""
    from windrow.operators import framing

    rnd = random.Random(1)
    spots = [(20 * (i % 25), 20 * (i // 25)) for i in range(500)]
    raw = [(1, 1, n, x + rnd.randrange(2), y, 10, 12) for n, (x, y) in enumerate(spots + [rnd.choice(spots) for _ in range(700)])]
    kept = []
    for _, _, _, x, y, w, h in raw:
        for z in kept:
            both = max(0, min(z[0] + z[2], x + w) - max(z[0], x)) * max(0, min(z[1] + z[3], y + h) - max(z[1], y))
            if both / (z[2] * z[3] + w * h - both) > 0.4:
                z[4] += 1
                break
        else:
            kept.append([x, y, w, h, 1])
    began = time.time()
    got = framing.merged_boxes(spark.createDataFrame(raw, "episode_id bigint, k int, n bigint, x int, y int, w int, h int")).collect()
    assert [[r.x, r.y, r.w, r.h, r.votes] for r in got] == kept
    assert time.time() - began < 30


def test_ward_at_length():
    """Three far groups of 4,000 rows, many of them equal: cubic time before (not ended in 60 s)."""
    import numpy as np

    from windrow.operators import speakers

    rng = np.random.default_rng(2)
    own = rng.integers(0, 3, 4000)
    x = rng.normal(size=(4000, 8)).round(1) + 20 * np.eye(8)[own]
    x[own == 0] = x[np.flatnonzero(own == 0)[0]]
    began = time.time()
    two, three, four = found = speakers.ward(x, [2, 3, 4])
    assert time.time() - began < 30
    assert len({*zip(own, three, strict=True)}) == 3 and len({*zip(own, two, strict=True)}) == 3 and len({*zip(own, four, strict=True)}) == 4
    assert np.argmax(speakers.silhouettes(x, found)) == 1


def test_ward_is_greedy():
    """The chain of nearest neighbours against merging the cheapest pair of all, again and again."""
    import numpy as np

    from windrow.operators import speakers

    rng = np.random.default_rng(3)
    for n in (3, 9, 40):
        x = rng.normal(size=(n, 4))
        groups = [[i] for i in range(n)]
        while len(groups) > 2:
            _, a, b = min((len(p) * len(q) / (len(p) + len(q)) * ((x[p].mean(0) - x[q].mean(0)) ** 2).sum(), i, j) for i, p in enumerate(groups) for j, q in enumerate(groups) if i < j)
            groups[a] += groups.pop(b)
        assert {frozenset(g) for g in groups} == {frozenset(np.flatnonzero(speakers.ward(x, [2])[0] == k)) for k in (0, 1)}


def test_tracks_of_many_short_shots(spark):
    """Shots are streamed: 8,000 of them were 8,000 calls of Python before (not ended in 20 s)."""
    from pyspark.sql import functions as F

    from windrow.operators import framing

    rnd = random.Random(4)
    track = [(e, k, k * 0.25, rnd.randrange(64) / 64) for e in range(20) for k in range(1200)]
    frames = spark.createDataFrame(track, "episode_id bigint, k int, t double, center_x double").withColumn("confident", F.lit(True)).withColumn("motion", F.lit(-1.0))
    cuts = frames.where("k % 3 = 0").selectExpr("episode_id", "cast(k / 3 AS int) AS shot", "t AS start", "t + 0.75D AS end")
    began = time.time()
    got = {(r.episode_id, r.k): r.center_x for r in framing.crop_path(frames, cuts, 0.1).collect()}
    assert time.time() - began < 20
    xs = {(e, k): x for e, k, _, x in track}
    for e, k in xs:
        own = [xs[e, k - k % 3 + n] for n in range(3)]
        if k % 3 == 0:
            mid = [sorted(own[min(max(n + o, 0), 2)] for o in (-1, 0, 1))[1] for n in range(3)]
            smooth, at, eased = [sum(mid[min(max(n + o, 0), 2)] for o in (-1, 0, 1)) / 3 for n in range(3)], None, []
            for y in smooth:
                at = y if at is None else at + (y - at) * 0.22 if abs(y - at) > 0.01 else at
                eased.append(at)
        assert abs(got[e, k] - min(max(eased[k % 3], 0.1), 0.9)) < 1e-9


def test_windows_of_dense_speech(spark):
    """Up to 300 lines a window: a window's sums were folded over its lines before (not ended in 100 s)."""
    from windrow.config import PROSE
    from windrow.operators import scoring

    rnd = random.Random(5)
    words = ["harbor", "engine", "why", "the", "secret", "money", "because", "listen"]
    rows = [(1, k, k * 0.25, k * 0.25 + 0.25, f"{rnd.choice(words)} {rnd.choice(words)} {k % 7}" + rnd.choice(".?,"), "a") for k in range(1500)]
    feats = scoring.features(spark.createDataFrame(rows, "episode_id bigint, seg int, start double, end double, text string, speaker string"), PROSE)
    scoring.candidate_windows(feats, PROSE).where("j < 5").count()
    began = time.time()
    got = scoring.candidate_windows(feats, PROSE).selectExpr("count(*) AS n", "sum(n) AS lines", "sum(round(distinctiveness, 6)) AS d", "count_if(raised) AS raised").first()
    took = time.time() - began
    assert got.n == sum(min(1500 - i, 300) - 59 for i in range(1500 - 59)) and got.d > 0
    assert took < 40


def test_tasks_follow_the_files(spark, monkeypatch, tmp_path):
    """More files, more tasks, whatever the number of shuffle partitions: it was that number before."""
    from windrow.sources import views

    spark.range(20000).selectExpr("id AS conv_id", "0L AS turn", "'user' AS role", "concat('Say ', uuid(), '.') AS text").write.parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(views, "TASK_BYTES", 1 << 16)
    segments = views.derived_segments(spark, str(tmp_path))
    assert segments.rdd.getNumPartitions() >= 10
    assert segments.count() == 20000
    assert views.dealt(spark.createDataFrame([(1,)], "k int"), "k").rdd.getNumPartitions() == 4
