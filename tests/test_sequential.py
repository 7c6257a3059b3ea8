"""Operators that are greedy or sequential by definition, against plain loops on random input."""

import random
import statistics

from pyspark.sql import functions as F

from windrow.config import PROSE, Lexicon
from windrow.functions import lexicon
from windrow.operators import captions, export, framing, scoring, selection, timeline, topics


def windows(seed, n=60, episodes=3):
    rnd = random.Random(seed)
    out = []
    for e in range(episodes):
        for i in range(n):
            s = rnd.randrange(0, 400) / 2
            out.append((e, i, i + 3, s, s + rnd.randrange(30, 120) / 2, rnd.randrange(0, 40) / 4, float(rnd.randrange(0, 20)) / 2, 0.0))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "episode_id bigint, i int, j int, start double, end double, raw_score double, score double, percentile double")


def test_near_duplicates(spark):
    rows = windows(1)
    got = {(r.episode_id, r.i) for r in selection.near_duplicates_dropped(frame(spark, rows), keep=25).collect()}
    want = set()
    for e in range(3):
        kept = []
        for r in sorted((r for r in rows if r[0] == e), key=lambda r: (-r[5], r[1], r[2])):
            if len(kept) < 25 and not any(abs(r[3] - k[3]) < 3 and abs(r[4] - k[4]) < 3 for k in kept):
                kept.append(r)
        want |= {(e, r[1]) for r in kept}
    assert got == want


def pick(rows, n, rejected=()):
    out = []
    for r in sorted(rows, key=lambda r: (-r[6], -r[5], r[1], r[2])):
        if len(out) < n and (r[3], r[4]) not in rejected and not any(r[3] < k[4] and k[3] < r[4] for k in out):
            out.append(r)
    return sorted(out, key=lambda r: r[3])


def test_selection_and_regeneration(spark):
    rows = windows(2)
    pool = frame(spark, rows)
    picks = selection.chosen(pool, 4)
    by = {e: [r for r in rows if r[0] == e] for e in range(3)}
    got = {(r.episode_id, r.clip): r.i for r in picks.collect()}
    assert got == {(e, k + 1): r[1] for e in by for k, r in enumerate(pick(by[e], 4))}
    alternatives = selection.alternatives(pool, picks, 2, "different").collect()
    new = {(r.episode_id, r.clip): r.i for r in selection.regenerated(pool, picks, 2).collect()}
    again = {(r.episode_id, r.clip): r.i for r in selection.regenerated_all(pool, picks, 4).collect()}
    reserve = {r.episode_id: r.reserve for r in selection.reserve_counts(pool, picks).collect()}
    for e, own in by.items():
        chosen = pick(own, 4)
        cur, keep = chosen[1], [c for k, c in enumerate(chosen) if k != 1]
        share = lambda r: max(0.0, min(r[4], cur[4]) - max(r[3], cur[3])) / min(r[4] - r[3], cur[4] - cur[3])  # noqa: B023, E731
        free = [r for r in sorted(own, key=lambda r: (-r[6], -r[5], r[1], r[2])) if (r[3], r[4]) != (cur[3], cur[4]) and not any(r[3] < k[4] and k[3] < r[4] for k in keep)]
        other = [r for r in free if share(r) <= 0.3]
        assert [r.i for r in sorted((a for a in alternatives if a.episode_id == e), key=lambda a: a.choice)] == [r[1] for r in other]
        best = (other or [r for r in free if share(r) >= 0.3])[:1]
        assert {k: v for k, v in new.items() if k[0] == e} == {(e, k + 1): r[1] for k, r in enumerate(sorted([*keep, *best], key=lambda r: r[3]))}
        assert {k: v for k, v in again.items() if k[0] == e} == {(e, k + 1): r[1] for k, r in enumerate(pick(own, 4, {(c[3], c[4]) for c in chosen}))}
        assert reserve[e] == sum((r[3], r[4]) not in {(c[3], c[4]) for c in chosen} for r in own)


def timed(seed, n=300):
    rnd = random.Random(seed)
    out, t = [], 0.0
    for i in range(n):
        t += rnd.choice([0, 0, 0, 0.25, 0.5, 0.75, 1, 2, 3, 6])
        out.append((1, i, t, t + 0.25, rnd.choice(["a", "19", ".5", "%", "word", "-", "...", ",7", "x"])))
        t += 0.25
    return out


def test_chunks_and_tokens(spark):
    rows = timed(3)
    df = spark.createDataFrame(rows, "episode_id bigint, pos int, start double, end double, text string")
    chunks, cur = [], []
    for r in rows:
        if cur and (r[2] - cur[-1][3] > 0.7 or len(cur) == 3):
            chunks.append(cur)
            cur = []
        cur.append(r)
    chunks.append(cur)
    got = {r.pos: (r.chunk, r.nth) for r in captions.chunks(df).collect()}
    assert got == {r[1]: (k, j) for k, c in enumerate(chunks) for j, r in enumerate(c)}
    out = []
    for _, pos, a, b, text in rows:
        if out and ((text[0] in ".,:%-/" and text[1:2].isdigit() and out[-1][3][-1].isdigit()) or not any(ch.isalnum() for ch in text)):
            out[-1] = (out[-1][0], out[-1][1], b, out[-1][3] + text)
        else:
            out.append((pos, a, b, text))
    assert sorted((r.pos, r.start, r.end, r.text) for r in captions.merged_tokens(df).collect()) == out


def test_cuts(spark):
    rows = timed(4)
    df = spark.createDataFrame(rows, "episode_id bigint, pos int, start double, end double, text string")
    clips = [(1, k, 20.0 * k + 0.1, 20.0 * k + 18.3) for k in range(1, 15)]
    lines = timeline.timelines(df, spark.createDataFrame(clips, "episode_id bigint, clip int, start double, end double"))
    got = {r.clip: r for r in lines.collect()}
    moved = {}
    for r in timeline.shifted_words(df, lines).collect():
        moved.setdefault(r.clip, []).append(r)
    for _, clip, s, e in clips:
        inside = [r for r in rows if r[3] > s and r[2] < e]
        gaps = [(max(a[3], s), min(b[2], e)) for a, b in zip(inside, inside[1:], strict=False)]
        budget, cut = (e - s) * 0.12, []
        for a, b in sorted((g for g in gaps if g[1] - g[0] >= 1.5), key=lambda g: (-(g[1] - g[0]), g[0])):
            if budget >= 0.1:
                to = min(b - 0.2, a + 0.2 + budget)
                cut.append((a + 0.2, to))
                budget -= to - a - 0.2
        spans, at = [], s
        for a, b in sorted(cut):
            spans.append((at, a))
            at = b
        spans.append((at, e))
        assert [(round(x.start, 9), round(x.end, 9)) for x in got[clip].spans] == [(round(a, 9), round(b, 9)) for a, b in spans]
        assert got[clip].removed <= (e - s) * 0.12 + 1e-9
        times = [w.start for w in sorted(moved.get(clip, []), key=lambda w: w.pos)]
        assert times == sorted(times)
    user = spark.sql("SELECT array(struct(5D AS a, 9D AS b), struct(-3D AS a, 2D AS b), struct(3D AS a, 3.05D AS b)) AS v, 0D AS s, 8D AS e")
    assert [tuple(x) for x in user.selectExpr(f"{timeline.user_spans('v', 's', 'e')} AS x").first().x] == [(0, 2), (5, 8)]


def test_segment_modes(spark):
    rnd = random.Random(5)
    shots, t = [], 0.0
    for k in range(80):
        d = rnd.choice([0.5, 1.0, 1.25, 1.5, 2.0, 4.0])
        shots.append((1, k, t, t + d, rnd.random() < 0.5, 0.5))
        t += d
    clips = [(1, c, 9.0 * c + 0.3, 9.0 * c + 9.1) for c in range(12)] + [(2, 0, 0.0, 5.0)]
    got = framing.segment_modes(spark.createDataFrame(shots, "episode_id bigint, shot int, start double, end double, is_static boolean, center double"), spark.createDataFrame(clips, "episode_id bigint, clip int, start double, end double")).collect()
    for e, clip, s, z in clips:
        runs = []
        for _, _, a, b, static, _ in shots if e == 1 else []:
            a, b, mode = max(a, s), min(b, z), "blur" if static else "face"
            if b > a and runs and runs[-1][2] == mode:
                runs[-1][1] = b
            elif b > a:
                runs.append([a, b, mode])
        out = []
        for a, b, mode in runs:
            if out and (b - a < 1.5 or out[-1][2] == mode):
                out[-1][1] = b
            else:
                out.append([a, b, mode])
        out = out or [[s, z, "face"]]
        out[0][0], out[-1][1] = s, z
        assert [[r.start, r.end, r.mode] for r in sorted(got, key=lambda r: r.run) if (r.episode_id, r.clip) == (e, clip)] == out


def test_smoothing(spark):
    rnd = random.Random(6)
    for n in (1, 2, 3, 4, 8, 30):
        x = [rnd.random() for _ in range(n)]
        df = spark.createDataFrame([(1, k, k * 0.25, v, True, 0.0) for k, v in enumerate(x)], "episode_id bigint, k int, t double, center_x double, confident boolean, motion double")
        got = sorted(framing.smoothed(df).collect(), key=lambda r: r.k)
        smooth = x
        if n >= 3:
            pad = lambda v, w, i: [v[min(max(p, 0), n - 1)] for p in range(i - w // 2, i + w // 2 + 1)]  # noqa: B023, E731
            odd = n if n % 2 else n - 1
            med = [statistics.median(pad(x, min(9, odd), i)) for i in range(n)]
            smooth = [statistics.fmean(pad(med, min(5, odd), i)) for i in range(n)]
        at, eased = smooth[0], []
        for v in smooth:
            at = at + (v - at) * 0.22 if abs(v - at) > 0.01 else at
            eased.append(at)
        assert all(abs(r.smooth - a) < 1e-9 and abs(r.eased - b) < 1e-9 for r, a, b in zip(got, smooth, eased, strict=True))


def spoken(seed, n=160):
    rnd = random.Random(seed)
    vocab = [[f"{c}{w}" for w in ("lphabet", "nother", "ppear", "rticle", "ngine", "ssue")] for c in "abcdefgh"]
    rows, t = [], 0.0
    for k in range(n):
        words = rnd.choices(vocab[k // 20], k=rnd.randint(2, 9)) + rnd.choices(["is", "that", "to the", "Name", "it"], k=rnd.randint(0, 2))
        rnd.shuffle(words)
        d = len(" ".join(words).split()) * 0.25
        rows.append((1, k, t, t + d, " ".join(words) + rnd.choice([".", "!", "?", "...", ""]), None))
        t += d + rnd.choice([0.25, 0.5])
    return rows


def test_extension(spark):
    rows = spoken(7)
    feats = scoring.features(spark.createDataFrame(rows, "episode_id bigint, seg int, start double, end double, text string, speaker string"), PROSE)
    f = sorted(feats.collect(), key=lambda r: r.seg)
    levels = topics.levels(feats, PROSE)
    lim = topics.thresholds(levels).first()
    bounds = sorted(r.t for r in topics.boundaries(topics.depths(topics.gap_similarity(feats, PROSE))).collect())
    stop = PROSE.bank("stopwords")
    bag = lambda segs: [w for s in segs for w in s.tok if len(w) >= 4 and w not in stop]

    def cosine(a, b):
        a, b = ({w: x.count(w) for w in x} for x in (a, b))
        dot = sum(v * b.get(w, 0) for w, v in a.items())
        return dot / (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5 if a and b else 0.0

    ahead = lambda t: [s for s in f if t <= s.start < t + 20]

    def unfinished(body, end):
        window = [s for s in body if s.end >= end - 12]
        last = max((k for k, s in enumerate(window) if s.opens), default=None)
        if last is None:
            return False
        return sum(s.content for s in window[last + 1 :]) < 10 or any(s.opens for s in f if end <= s.start < end + 8)

    clips = [(1, k + 1, f[a].start, f[b].end) for k, (a, b) in enumerate((a, a + n) for a in range(0, 130, 3) for n in (8, 14))]
    want = {}
    for _, clip, s, e in clips:
        tail = bag(x for x in f if x.start >= max(e - 25, s) and x.end <= e)
        if cosine(tail, bag(ahead(e))) < lim.high or any(s + 20 < b < e for b in bounds):
            continue
        cap = min(e + 75, s + 150)
        cap = min([cap, *(b for b in bounds if e + 1 < b <= cap)])
        turn = next((x.end for x in f if e + 6 <= x.end <= cap and cosine(tail, bag(ahead(x.end))) <= lim.low), None)
        if turn is None:
            continue
        ends = [x.end for x in f if e < x.end <= turn and x.clean and not unfinished([y for y in f if y.start >= s and y.end <= x.end], x.end)]
        if ends and ends[-1] > e + 1:
            want[clip] = ends[-1]
    got = {r.clip: r.end for r in topics.extended(spark.createDataFrame(clips, "episode_id bigint, clip int, start double, end double"), feats, PROSE).collect()}
    assert want and got == want


def test_lexicon(spark):
    lex = Lexicon({"new york": "Gotham City", "teh": "the", "a b c": "abc"}, ("sutradara", "keiten"))
    text = spark.createDataFrame([("Teh cat in NEW YORK, new yorker.",), (None,)], "text string")
    assert [r.t for r in text.select(lexicon.corrected_text(F.col("text"), lex).alias("t")).collect()] == ["The cat in GOTHAM CITY, new yorker.", None]
    words = spark.createDataFrame([(1, k, float(k), k + 1.0, w) for k, w in enumerate(["New", "york!", "teh", "a", "b", "c.", "a"])], "episode_id bigint, pos int, start double, end double, text string")
    got = [(r.start, r.end, r.text) for r in sorted(lexicon.corrected_words(words, lex).collect(), key=lambda r: r.pos)]
    assert got == [(0, 1.2, "Gotham"), (1.2, 2, "City!"), (2, 3, "the"), (3, 6, "abc."), (6, 7, "a")]
    snap = spark.createDataFrame([("Sutradaraa,",), ("cat",), ("KEITEM",)], "w string").select(lexicon.snapped(F.col("w"), lex).alias("w"))
    assert [r.w for r in snap.collect()] == ["Sutradara,", "cat", "KEITEN"]


def test_seats_and_crops(spark):
    rows = [(1, k, 0.25 + 0.01 * (k % 3), 0.4, 0.1, 0.2) for k in range(20)] + [(1, k, 0.75, 0.4, 0.1, 0.2) for k in range(12)] + [(1, 3, 0.5, 0.4, 0.1, 0.2)]
    seats = framing.seats(spark.createDataFrame(rows, "episode_id bigint, k int, cx double, cy double, w double, h double"), 30)
    assert [(r.seat, round(r.center_x, 2), r.samples) for r in sorted(seats.collect(), key=lambda r: r.seat)] == [(0, 0.26, 20), (1, 0.75, 12)]
    crops = framing.split_crops(seats, 1260, 720).collect()
    assert all(c.w % 2 == 0 and c.h % 2 == 0 and 0 <= c.x <= 1260 - c.w and 0 <= c.y <= 720 - c.h for c in crops)
    box = seats.selectExpr(f"{framing.mouth_box(1260, 720)} AS b").first().b
    assert 0 <= box.x0 < box.x1 <= 1260 and 0 <= box.y0 < box.y1 <= 720
    a = spark.sql(f"SELECT {framing.iou('a', 'b')} AS v FROM (SELECT struct(0 AS x, 0 AS y, 2 AS w, 2 AS h) AS a, struct(1 AS x, 1 AS y, 2 AS w, 2 AS h) AS b)")
    assert abs(a.first().v - 1 / 7) < 1e-12


def test_numbers_and_stale(spark):
    picks = spark.createDataFrame([(1, 0.0, 9.0), (1, 10.0, 19.0), (1, 20.0, 29.0)], "episode_id bigint, start double, end double")
    slots = spark.createDataFrame([(1, 1, 20.001, 29.0), (1, 3, 50.0, 60.0)], "episode_id bigint, index int, start double, end double")
    assert {r.start: r.clip for r in export.numbered(picks, slots).collect()} == {0.0: 2, 10.0: 3, 20.0: 1}
    done = spark.createDataFrame([(1, "f", 1.0, 2.0, ""), (1, "g", 1.0, 2.0, "")], "episode_id bigint, filename string, start double, end double, edit string")
    new = spark.createDataFrame([(1, "f", 5.0, 6.0, "x")], done.schema)
    assert {(r.filename, r.start) for r in export.mark_rendered(done, new).collect()} == {("f", 5.0), ("g", 1.0)}
    assert [r.filename for r in export.keep_rendered(done, new).collect()] == ["f"]
