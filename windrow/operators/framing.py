"""Crop paths, shots, framing modes, cover frames and seats over sampled tracks (episode_id, k, t, center_x, confident, motion)."""

from __future__ import annotations

from bisect import insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.views import BUCKET, MEET, dealt, q, stretches

STATIC_MOTION, MIN_RUN = 1.2, 1.5


def center_at(frames: DataFrame, points: DataFrame) -> DataFrame:
    """points (episode_id, t) with the crop centre: linear between the keyframes around, the first or last beyond them, 0.5
    without any. An as-of join in one sorted pass: points and keyframes are one stream, and each point sees the nearest of
    both sides; nothing is paired by range."""
    both = frames.selectExpr("episode_id", "t", "center_x AS x", "1 AS frame").unionByName(points.selectExpr("episode_id", "t", "cast(NULL AS double) AS x", "0 AS frame"))
    return q(
        frames.sparkSession,
        """
        WITH near AS (
          SELECT *, last_value(CASE WHEN frame = 1 THEN struct(t, x) END, true) OVER (PARTITION BY episode_id ORDER BY t, frame DESC ROWS UNBOUNDED PRECEDING) AS a,
            last_value(CASE WHEN frame = 1 THEN struct(t, x) END, true) OVER (PARTITION BY episode_id ORDER BY t DESC, frame DESC ROWS UNBOUNDED PRECEDING) AS b FROM {both})
        SELECT episode_id, t, CASE WHEN a IS NULL AND b IS NULL THEN 0.5D WHEN a IS NULL THEN b.x WHEN b IS NULL THEN a.x WHEN b.t <= a.t THEN a.x ELSE a.x + (b.x - a.x) * ((t - a.t) / (b.t - a.t)) END AS center
        FROM near WHERE frame = 0
        """,
        both=dealt(both, "episode_id"),
    )


def crop_commands(frames: DataFrame, clips: DataFrame, scaled_width: int, out_width: int, rate: float = 20.0) -> DataFrame:
    """(episode_id, clip, k, line): the crop position `rate` times a second of each clip."""
    grid = clips.selectExpr("episode_id", "clip", "start", f"explode(sequence(0, cast(ceil((end - start) * {rate}D) AS int) - 1)) AS k").selectExpr("*", f"start + k / {rate}D AS t")
    at = center_at(frames, grid.select("episode_id", "t").distinct())
    x = f"least(greatest(cast(bround(center * {scaled_width} - {out_width / 2}D) AS int), 0), {max(0, scaled_width - out_width)})"
    return dealt(grid, "episode_id", "t").join(at, ["episode_id", "t"]).selectExpr("episode_id", "clip", "k", f"format_string('%.3f crop x %d;', t - start, {x}) AS line")


def frames_at(frames: DataFrame, wants: DataFrame) -> DataFrame:
    """wants (episode_id, want) with the first frame at or after each: a forward as-of join in one sorted pass."""
    both = frames.selectExpr("episode_id", "t AS at", "t", "k").unionByName(wants.selectExpr("episode_id", "want - 1e-9D AS at", "cast(NULL AS double) AS t", "cast(NULL AS int) AS k", "want"), allowMissingColumns=True)
    return q(
        frames.sparkSession,
        "SELECT episode_id, want, n.k AS k, n.t AS t FROM (SELECT *, first_value(CASE WHEN k IS NOT NULL THEN struct(k, t) END, true) OVER (PARTITION BY episode_id ORDER BY at, want NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM {both}) WHERE k IS NULL AND n IS NOT NULL",
        both=both,
    )


def shots(frames: DataFrame, cut: str = "opens_shot", least: float = 0.5) -> DataFrame:
    """(episode_id, shot, start, end): a frame with `cut` opens a shot; a shot shorter than `least` joins the one before."""
    return q(
        frames.sparkSession,
        f"""
        WITH opened AS (SELECT *, max(t) OVER (PARTITION BY episode_id) + 0.25D AS last, sum(CASE WHEN {cut} AND k > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY episode_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS raw FROM {{frames}}),
        runs AS (SELECT episode_id, raw, min(t) AS a, max(last) AS last FROM opened GROUP BY episode_id, raw),
        ends AS (SELECT *, coalesce(lead(a) OVER (PARTITION BY episode_id ORDER BY raw), last) AS b FROM runs),
        kept AS (SELECT *, sum(CASE WHEN b - a < {least}D AND raw > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY episode_id ORDER BY raw ROWS UNBOUNDED PRECEDING) AS run FROM ends)
        SELECT episode_id, cast(run - 1 AS int) AS shot, min(a) AS start, max(b) AS end FROM kept GROUP BY episode_id, run
        """,
        frames=frames,
    )


def histogram_cuts(hists: DataFrame, threshold: float = 0.45) -> DataFrame:
    """hists (episode_id, k, t, hist) with opens_shot: the correlation with the histogram before is lower than 1 - threshold."""
    mean = lambda a: f"aggregate({a}, 0D, (s, x) -> s + x) / size({a})"
    rows = q(hists.sparkSession, "SELECT *, lag(h) OVER (PARTITION BY episode_id ORDER BY k) AS p FROM (SELECT episode_id, k, t, transform(hist, x -> cast(x AS double)) AS h FROM {hists})", hists=hists)
    rows = rows.selectExpr("episode_id", "k", "t", "h", "p", f"{mean('h')} AS mh", f"{mean('p')} AS mp")
    dot = lambda a, ma, b, mb: f"aggregate(zip_with({a}, {b}, (x, y) -> (x - {ma}) * (y - {mb})), 0D, (s, x) -> s + x)"
    corr = f"({dot('h', 'mh', 'p', 'mp')} / sqrt({dot('h', 'mh', 'h', 'mh')} * {dot('p', 'mp', 'p', 'mp')}))"
    return rows.selectExpr("episode_id", "k", "t", f"CASE WHEN p IS NULL THEN NULL ELSE 1 - {corr} END AS distance").selectExpr("*", f"coalesce(distance > {threshold}D, false) AS opens_shot")


def by_shot(frames: DataFrame, cuts: DataFrame) -> DataFrame:
    """frames with the shot that holds them: shots tile the track, so each frame takes the last shot start before it."""
    both = frames.withColumn("s", frames["t"] * 0 - 1).unionByName(cuts.selectExpr("episode_id", "start AS t", "cast(shot AS double) AS s"), allowMissingColumns=True)
    return q(
        frames.sparkSession,
        "SELECT * FROM (SELECT * EXCEPT (s), s AS own, cast(last_value(CASE WHEN s >= 0 THEN s END, true) OVER (PARTITION BY episode_id ORDER BY t, s DESC ROWS UNBOUNDED PRECEDING) AS int) AS shot FROM {both}) WHERE own < 0",
        both=both,
    ).drop("own")


def static_shots(frames: DataFrame, cuts: DataFrame) -> DataFrame:
    """shots with is_static (no confident frame, three measured motions or more, their median under 1.2) and center (its median)."""
    held = by_shot(frames, cuts)
    return q(
        frames.sparkSession,
        f"""
        WITH seen AS (
          SELECT episode_id, shot, bool_or(confident) AS sure, count(CASE WHEN motion >= 0 THEN 1 END) AS n, median(CASE WHEN motion >= 0 THEN motion END) AS med,
            coalesce(median(CASE WHEN confident THEN center_x END), median(center_x)) AS center FROM {{held}} GROUP BY episode_id, shot)
        SELECT c.*, coalesce(NOT sure AND n >= 3 AND med < {STATIC_MOTION}D, false) AS is_static, center FROM {{cuts}} c LEFT JOIN seen USING (episode_id, shot)
        """,
        held=held, cuts=cuts,
    )


def flattened(frames: DataFrame, cuts: DataFrame) -> DataFrame:
    """frames whose centre is their shot's: its median, or the middle of a static shot."""
    kinds = static_shots(frames, cuts).select("episode_id", "shot", "is_static", "center")
    return by_shot(frames, cuts).join(kinds, ["episode_id", "shot"]).selectExpr("episode_id", "k", "t", "shot", "CASE WHEN is_static THEN 0.5D ELSE center END AS center_x", "confident")


def segment_modes(kinds: DataFrame, clips: DataFrame, base: str = "face", graphic: str = "blur") -> DataFrame:
    """(episode_id, clip, run, start, end, mode): a clip's shots by mode, neighbours of one mode merged, runs shorter than 1.5 s given
    to the one before, and the clip's ends kept."""
    return q(
        kinds.sparkSession,
        f"""
        WITH cut AS (SELECT c.episode_id, c.clip, c.start AS s, c.end AS e, k.shot, greatest(k.start, c.start) AS a, least(k.end, c.end) AS b, CASE WHEN k.is_static THEN '{graphic}' ELSE '{base}' END AS mode
          FROM {{clips}} c JOIN {{kinds}} k ON k.episode_id = c.episode_id AND k.start < c.end AND k.end > c.start),
        first AS (SELECT *, sum(CASE WHEN mode = before THEN 0 ELSE 1 END) OVER (PARTITION BY episode_id, clip ORDER BY shot ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(mode) OVER (PARTITION BY episode_id, clip ORDER BY shot) AS before FROM cut)),
        runs AS (SELECT episode_id, clip, run, min(s) AS s, max(e) AS e, min(a) AS a, max(b) AS b, min(mode) AS mode FROM first GROUP BY episode_id, clip, run),
        kept AS (SELECT *, run = 1 OR b - a >= {MIN_RUN}D AS keeps FROM runs),
        modes AS (SELECT *, last_value(CASE WHEN keeps THEN mode END, true) OVER (PARTITION BY episode_id, clip ORDER BY run ROWS UNBOUNDED PRECEDING) AS now FROM kept),
        second AS (SELECT *, sum(CASE WHEN now = was THEN 0 ELSE 1 END) OVER (PARTITION BY episode_id, clip ORDER BY run ROWS UNBOUNDED PRECEDING) AS part FROM (SELECT *, lag(now) OVER (PARTITION BY episode_id, clip ORDER BY run) AS was FROM modes)),
        parts AS (SELECT episode_id, clip, cast(part - 1 AS int) AS run, min(s) AS s, max(e) AS e, min(a) AS a, max(b) AS b, min(now) AS mode, max(part) OVER (PARTITION BY episode_id, clip) AS n FROM second GROUP BY episode_id, clip, part),
        found AS (SELECT episode_id, clip, run, CASE WHEN run = 0 THEN s ELSE a END AS start, CASE WHEN run = n - 1 THEN e ELSE b END AS end, mode FROM parts)
        SELECT * FROM found UNION ALL SELECT c.episode_id, c.clip, 0, c.start, c.end, '{base}' FROM {{clips}} c LEFT ANTI JOIN found f ON f.episode_id = c.episode_id AND f.clip = c.clip
        """,
        kinds=kinds, clips=clips,
    )


def planned_runs(modes: DataFrame, lines: DataFrame) -> DataFrame:
    """(episode_id, clip, run, start, end, mode): what to encode: kept spans cut by mode, touching runs of one mode merged."""
    spans = lines.selectExpr("episode_id", "clip", "explode(spans) AS s")
    return q(
        modes.sparkSession,
        """
        WITH cut AS (SELECT m.episode_id, m.clip, greatest(m.start, p.s.start) AS a, least(m.end, p.s.end) AS b, m.mode FROM {modes} m JOIN {spans} p ON p.episode_id = m.episode_id AND p.clip = m.clip AND p.s.start < m.end AND p.s.end > m.start),
        seen AS (SELECT *, lag(b) OVER w AS b0, lag(mode) OVER w AS m0 FROM cut WINDOW w AS (PARTITION BY episode_id, clip ORDER BY a)),
        runs AS (SELECT *, sum(CASE WHEN mode = m0 AND abs(a - b0) < 1e-6D THEN 0 ELSE 1 END) OVER (PARTITION BY episode_id, clip ORDER BY a ROWS UNBOUNDED PRECEDING) AS run FROM seen)
        SELECT episode_id, clip, cast(run - 1 AS int) AS run, min(a) AS start, max(b) AS end, min(mode) AS mode FROM runs GROUP BY episode_id, clip, run
        """,
        modes=modes, spans=spans,
    )


def recommended(frames: DataFrame, cuts: DataFrame, min_detection: float = 0.4, cut_heavy: float = 8.0) -> DataFrame:
    """(episode_id, detection_rate, median_shot, mode)."""
    return q(
        frames.sparkSession,
        f"""
        WITH rate AS (SELECT episode_id, avg(cast(confident AS double)) AS detection_rate FROM {{frames}} GROUP BY episode_id), med AS (SELECT episode_id, median(end - start) AS median_shot FROM {{cuts}} GROUP BY episode_id)
        SELECT episode_id, detection_rate, median_shot, CASE WHEN detection_rate < {min_detection}D THEN 'blur' WHEN coalesce(median_shot, 999D) < {cut_heavy}D THEN 'per_shot' ELSE 'face' END AS mode FROM rate LEFT JOIN med USING (episode_id)
        """,
        frames=frames, cuts=cuts,
    )


def smoothed(frames: DataFrame) -> DataFrame:
    """frames with smooth (a running median of 9, then a running mean of 5, the ends repeated) and eased (a follower that moves
    22 % of the way to it, and only if it is more than 0.01 off).

    Medians and means slide over rows; only the follower, whose place hangs on the one before, is a loop over a task's numbers as they stream
    by, in which each episode's first row starts anew."""
    s = frames.sparkSession

    def near(column: str, width: int) -> str:
        half = f"{width} div 2"
        return f"""filter(transform(sequence(-{width // 2}, {width // 2}), o -> CASE WHEN abs(o) <= w{width} div 2 THEN
          CASE WHEN i + o < 0 THEN first_ WHEN i + o > n - 1 THEN last_ ELSE {column}[least(i, {half}) + o] END END), x -> x IS NOT NULL)"""

    odd = "least({0}, n - CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END)"
    w = "WINDOW e AS (PARTITION BY episode_id ORDER BY k), a AS (PARTITION BY episode_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    rows = q(s, f"SELECT episode_id, k, t, center_x AS x, cast(row_number() OVER e - 1 AS int) AS i, cast(count(*) OVER a AS int) AS n, first_value(center_x) OVER a AS first_, last_value(center_x) OVER a AS last_, collect_list(center_x) OVER (PARTITION BY episode_id ORDER BY k ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS xs FROM {{frames}} {w}", frames=frames)
    rows = rows.selectExpr("*", f"{odd.format(9)} AS w9", f"{odd.format(5)} AS w5")
    rows = rows.selectExpr("* EXCEPT (xs)", f"CASE WHEN n < 3 THEN x ELSE array_sort({near('xs', 9)})[w9 div 2] END AS med")
    rows = q(s, f"SELECT * EXCEPT (first_, last_), first_value(med) OVER a AS first_, last_value(med) OVER a AS last_, collect_list(med) OVER (PARTITION BY episode_id ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS ms FROM {{rows}} {w}", rows=rows)
    rows = rows.selectExpr("episode_id", "k", "t", f"CASE WHEN n < 3 THEN x ELSE aggregate({near('ms', 5)}, 0D, (s, y) -> s + y) / w5 END AS smooth", "i")

    def follow(batches):  # noqa: ANN001, ANN202
        at = None
        for batch in batches:
            eased = []
            for y, i in zip(batch.column("smooth").to_numpy(zero_copy_only=False).tolist(), batch.column("i").to_pylist(), strict=True):
                at = y if i == 0 else at + (y - at) * 0.22 if abs(y - at) > 0.01 else at
                eased.append(at)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(eased, pa.float64(), from_pandas=True)], [*names, "eased"])

    names = ["episode_id", "k", "t", "smooth"]
    kind = frames.schema["episode_id"].dataType.simpleString()
    # the windows above deal an episode to one task, in this order
    return rows.sortWithinPartitions("episode_id", "k").mapInArrow(follow, f"episode_id {kind}, k int, t double, smooth double, eased double")


def jerkiness(frames: DataFrame, column: str = "center_x") -> DataFrame:
    return q(frames.sparkSession, f"SELECT episode_id, coalesce(avg(abs({column} - 2 * a + b)), 0D) AS jerkiness FROM (SELECT episode_id, {column}, lag({column}) OVER w AS a, lag({column}, 2) OVER w AS b FROM {{frames}} WINDOW w AS (PARTITION BY episode_id ORDER BY k)) GROUP BY episode_id", frames=frames)


def stillness(frames: DataFrame, partition: str = "episode_id") -> DataFrame:
    """frames with stillness: minus the mean measured motion and four times the spread of centres over two frames either side."""
    return q(frames.sparkSession, f"SELECT *, -(coalesce(avg(CASE WHEN motion >= 0 THEN motion END) OVER w, 0D) + (max(center_x) OVER w - min(center_x) OVER w) * 4D) AS stillness FROM {{frames}} WINDOW w AS (PARTITION BY {partition} ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)", frames=frames)


def cover_times(frames: DataFrame, clips: DataFrame, spoken: DataFrame | None = None, edge: float = 1.0) -> DataFrame:
    """(episode_id, clip, t): the frame to show for a clip: still, on a good caption line, early. Only confident frames count, and if
    any of those has a caption on screen, only those. Of equal scores the later time wins; clips without one have no row."""
    s = frames.sparkSession
    inner = q(
        s,
        f"""
        WITH held AS (SELECT c.clip, c.start AS s, c.end AS e, f.*, f.t >= c.start + {edge}D AND f.t <= c.end - {edge}D AS mid FROM {{clips}} c JOIN {{frames}} f ON {MEET.format('f', 'c')} AND f.t BETWEEN c.start AND c.end),
        any AS (SELECT *, bool_or(mid) OVER (PARTITION BY episode_id, clip) AS has_mid FROM held)
        SELECT * EXCEPT (bucket, bucket0) FROM any WHERE mid OR NOT has_mid
        """,
        frames=stretches(frames, "t", "t"), clips=stretches(clips),
    )
    still = q(s, "SELECT *, min(t) OVER (PARTITION BY episode_id, clip) AS t0 FROM {rows}", rows=stillness(inner, "episode_id, clip")).where("confident")
    if spoken is not None:
        lines = stretches(spoken.selectExpr("episode_id", "pos", "start AS a", "end AS b", "value"), "a", "b")
        still = stretches(still, "t", "t")
        still = q(s, "SELECT f.episode_id, f.clip, f.t, f.t0, f.stillness, min_by(l.value, l.pos) AS value FROM {still} f LEFT JOIN {lines} l ON " + MEET.format("f", "l") + " AND f.t BETWEEN l.a AND l.b AND l.b > f.s AND l.a < f.e GROUP BY f.episode_id, f.clip, f.t, f.t0, f.stillness", still=still, lines=lines)
    else:
        still = still.selectExpr("episode_id", "clip", "t", "t0", "stillness", "cast(NULL AS double) AS value")
    return q(
        s,
        """
        WITH best AS (SELECT *, max(value IS NOT NULL) OVER (PARTITION BY episode_id, clip) AS said FROM {still})
        SELECT episode_id, clip, max(struct(round(stillness + coalesce(value, 0D) * 8D - (t - t0) * 0.02D, 9) AS score, t)).t AS t FROM best WHERE value IS NOT NULL OR NOT said GROUP BY episode_id, clip
        """,
        still=still,
    )


def speakers_at(words: DataFrame, turns: DataFrame) -> DataFrame:
    """words with the speaker of the first turn that holds their midpoint; null where none does. A word meets the turns of its
    BUCKET-second stretch, not its episode's."""
    turns = turns.where("end > start").selectExpr("episode_id", "turn", "speaker", "start", "end", f"explode(sequence(cast(floor(start / {BUCKET}D) AS bigint), cast(floor(end / {BUCKET}D) AS bigint))) AS bucket")
    words = words.selectExpr("episode_id", "pos", "(start + end) / 2 AS mid").selectExpr("*", f"cast(floor(mid / {BUCKET}D) AS bigint) AS bucket")
    return q(
        words.sparkSession,
        "SELECT w.episode_id, w.pos, min_by(t.speaker, t.turn) AS speaker FROM {words} w LEFT JOIN {turns} t ON t.episode_id = w.episode_id AND t.bucket = w.bucket AND w.mid >= t.start AND w.mid < t.end GROUP BY w.episode_id, w.pos",
        words=words, turns=turns,
    )


def speaker_summary(turns: DataFrame) -> DataFrame:
    """(episode_id, speaker, seconds, changes): speaking time of each, and the episode's changes of speaker."""
    return q(
        turns.sparkSession,
        """
        WITH seen AS (SELECT *, CASE WHEN lag(speaker) OVER (PARTITION BY episode_id ORDER BY turn) <> speaker THEN 1 ELSE 0 END AS change FROM {turns}),
        total AS (SELECT episode_id, sum(change) AS changes FROM seen GROUP BY episode_id)
        SELECT episode_id, speaker, seconds, changes FROM (SELECT episode_id, speaker, sum(end - start) AS seconds FROM seen GROUP BY episode_id, speaker) JOIN total USING (episode_id)
        """,
        turns=turns,
    )


def active_speakers(energy: DataFrame, margin: float = 1.25, quiet: float = 35.0, window: int = 7) -> DataFrame:
    """energy (episode_id, k, t, seat, energy) -> (episode_id, k, t, seat): who speaks, null for nobody.

    Energies are smoothed (running mean of 7, ends repeated) and divided by the seat's median. The loudest seat takes over when it is `margin`
    times the next; nobody speaks while it is near its quiet floor; otherwise the last decision holds. Smoothed energies are
    rounded to 1e-9, so that equal ones stay equal whatever the order of additions."""
    half = window // 2
    return q(
        energy.sparkSession,
        f"""
        WITH ends AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY episode_id, seat) AS n, first_value(energy) OVER w AS e0, last_value(energy) OVER (PARTITION BY episode_id, seat ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS e1,
            sum(energy) OVER (PARTITION BY episode_id, seat ORDER BY k ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING) AS near FROM {{energy}} WINDOW w AS (PARTITION BY episode_id, seat ORDER BY k)),
        smooth AS (SELECT episode_id, k, t, seat, round(CASE WHEN n < {window} THEN energy ELSE (near + e0 * greatest(0, {half} + 1 - r) + e1 * greatest(0, r + {half} - n)) / {window} END, 9) AS e FROM ends),
        scale AS (SELECT episode_id, seat, CASE WHEN median(e) = 0 THEN 1e-6D ELSE median(e) END AS med, percentile(e, {quiet / 100}D) AS floor FROM smooth GROUP BY episode_id, seat),
        norm AS (SELECT s.episode_id, k, t, seat, round(e / med, 9) AS v, round(floor / med, 9) AS floor FROM smooth s JOIN scale USING (episode_id, seat)),
        top AS (SELECT *, row_number() OVER w AS place, coalesce(lead(v) OVER w, 0D) AS next FROM norm WINDOW w AS (PARTITION BY episode_id, k ORDER BY v DESC, seat)),
        says AS (SELECT episode_id, k, t, CASE WHEN v < round(floor * 1.05D, 9) THEN -1 WHEN next <= 0 OR v > round(next * {margin}D, 9) THEN seat END AS says FROM top WHERE place = 1)
        SELECT episode_id, k, t, nullif(last_value(says, true) OVER (PARTITION BY episode_id ORDER BY k ROWS UNBOUNDED PRECEDING), -1) AS seat FROM says
        """,
        energy=energy,
    )


def dominant_seats(series: DataFrame, clips: DataFrame) -> DataFrame:
    """(episode_id, clip, seat): who speaks most in a clip; of equal counts who spoke first. Null without anybody."""
    return q(
        series.sparkSession,
        """
        WITH n AS (SELECT c.episode_id, c.clip, s.seat, count(s.seat) AS n, min(s.t) AS first FROM {clips} c LEFT JOIN {series} s ON s.episode_id = c.episode_id AND s.seat IS NOT NULL AND s.t >= c.start AND s.t < c.end GROUP BY c.episode_id, c.clip, s.seat)
        SELECT episode_id, clip, max_by(seat, struct(n, -first)) AS seat FROM n GROUP BY episode_id, clip
        """,
        series=series, clips=clips,
    )


def seats(detections: DataFrame, samples: int, tolerance: float = 0.10, min_share: float = 0.35) -> DataFrame:
    """detections (episode_id, k, cx, cy, w, h) -> seats: each detection joins the first group whose running median is within `tolerance`;
    groups with too few are dropped; medians are reported. Order decides who joins what, so that is one grouped task an episode, over
    sorted lists; the medians are SQL."""
    kind = detections.schema["episode_id"].dataType.simpleString()

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["k", "cx", "cy"])
        groups: list[list[float]] = []
        joined = []
        for x in rows["cx"].tolist():
            home = next((n for n, g in enumerate(groups) if abs((g[(len(g) - 1) // 2] + g[len(g) // 2]) / 2 - x) < tolerance), len(groups))
            if home == len(groups):
                groups.append([])
            insort(groups[home], x)
            joined.append(home)
        return rows.assign(home=joined)

    rows = detections.select("episode_id", *(F.col(c).cast("double").alias(c) for c in ("k", "cx", "cy", "w", "h")))
    rows = rows.groupBy("episode_id").applyInPandas(join, f"episode_id {kind}, k double, cx double, cy double, w double, h double, home int")
    found = q(rows.sparkSession, "SELECT episode_id, home, median(cx) AS center_x, median(cy) AS center_y, median(w) AS width, median(h) AS height, cast(count(*) AS int) AS samples FROM {rows} GROUP BY episode_id, home", rows=rows).where(f"samples >= {max(3, round(samples * min_share))}")
    return q(rows.sparkSession, "SELECT episode_id, cast(row_number() OVER (PARTITION BY episode_id ORDER BY center_x, home) - 1 AS int) AS seat, center_x, center_y, width, height, samples FROM {found}", found=found)


def iou(a: str, b: str) -> str:
    """Intersection over union of two boxes (structs of x, y, w, h), as an expression."""
    w = f"greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x))"
    h = f"greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y))"
    return f"({w} * {h}) / cast({a}.w * {a}.h + {b}.w * {b}.h - {w} * {h} AS double)"


def ranked_detections(rows: DataFrame, frame_w: int, frame_h: int) -> DataFrame:
    """rows (episode_id, k, x, y, w, h, skin, votes): plausible faces with score and place in their frame."""
    return q(
        rows.sparkSession,
        f"""
        WITH ok AS (SELECT *, (w * h) * (0.5D + skin) * (1D + 0.25D * (votes - 1)) AS score FROM {{rows}} WHERE w / {float(frame_w)}D BETWEEN 0.02D AND 0.6D AND (y + h / 2D) / {float(frame_h)}D <= 0.72D AND skin >= 0.25D)
        SELECT *, cast(row_number() OVER (PARTITION BY episode_id, k ORDER BY score DESC, x, y, w, h) AS int) AS place FROM ok
        """,
        rows=rows,
    )


def mouth_box(frame_w: int, frame_h: int) -> str:
    """A seat's mouth, as a struct expression over center_x, center_y, width, height."""
    cut = lambda x: f"cast({x} AS int)"
    return f"struct(greatest(0, {cut(f'center_x * {frame_w} - width * {frame_w} * 0.3D')}) AS x0, greatest(0, {cut(f'center_y * {frame_h} + height * {frame_h} * 0.05D')}) AS y0, least({frame_w}, {cut(f'center_x * {frame_w} + width * {frame_w} * 0.3D')}) AS x1, least({frame_h}, {cut(f'center_y * {frame_h} + height * {frame_h} * 0.45D')}) AS y1)"


def split_crops(seat_rows: DataFrame, src_w: int, src_h: int, panels: int = 2, zoom: float = 1.9, target: float = 0.36) -> DataFrame:
    """(episode_id, seat, x, y, w, h): equal crops around the most seen seats."""
    aspect = 9.0 / (16.0 / panels)
    return q(
        seat_rows.sparkSession,
        f"""
        WITH most AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY samples DESC, seat) AS place FROM {{seat_rows}}),
        sized AS (SELECT *, least({float(src_h)}D, max(height * {src_h}) OVER (PARTITION BY episode_id) * {zoom * 2.2}D) AS ch0 FROM most WHERE place <= {panels}),
        boxes AS (SELECT *, least(ch0 * {aspect}D, {float(src_w)}D) AS cw, CASE WHEN ch0 * {aspect}D > {src_w} THEN {src_w} / {aspect}D ELSE ch0 END AS ch FROM sized)
        SELECT episode_id, seat, cast(greatest(0D, least(center_x * {src_w} - cw / 2, {src_w} - cw)) AS int) AS x, cast(greatest(0D, least(center_y * {src_h} - ch * {target}D, {src_h} - ch)) AS int) AS y, cast(cw AS int) & ~1 AS w, cast(ch AS int) & ~1 AS h FROM boxes
        """,
        seat_rows=seat_rows,
    )


def merged_boxes(rows: DataFrame, overlap: float = 0.4) -> DataFrame:
    """rows (episode_id, k, n, x, y, w, h): raw boxes of a frame in the order found -> kept boxes with votes: a box that overlaps a kept one
    by more than `overlap` (intersection over union) votes for the first such, and is gone."""
    side = "greatest(0, least(z.x1, b.x1) - greatest(z.x, b.x)) * greatest(0, least(z.y1, b.y1) - greatest(z.y, b.y))"
    # the first kept box that a box meets is looked for once: the one-element list binds it for both branches
    first = f"aggregate(kept, struct(0 AS i, 0 AS at), (f, z) -> CASE WHEN f.at > 0 THEN f WHEN {side} / cast(z.area + b.area - {side} AS double) > {overlap}D THEN struct(f.i + 1 AS i, f.i + 1 AS at) ELSE struct(f.i + 1 AS i, 0 AS at) END, f -> f.at)"
    fold = f"""aggregate(boxes, filter(transform(boxes, b -> struct(b.x, b.y, b.w, b.h, b.x1, b.y1, b.area, 1 AS votes)), z -> false),
      (kept, b) -> element_at(transform(array({first}), f -> CASE WHEN f = 0 THEN array_append(kept, struct(b.x, b.y, b.w, b.h, b.x1, b.y1, b.area, 1 AS votes))
        ELSE concat(slice(kept, 1, f - 1), array(struct(kept[f - 1].x, kept[f - 1].y, kept[f - 1].w, kept[f - 1].h, kept[f - 1].x1, kept[f - 1].y1, kept[f - 1].area, kept[f - 1].votes + 1 AS votes)), slice(kept, f + 1, size(kept))) END), 1),
      kept -> transform(kept, z -> struct(z.x, z.y, z.w, z.h, z.votes)))"""
    return q(rows.sparkSession, f"SELECT episode_id, k, inline({fold}) FROM (SELECT episode_id, k, array_sort(collect_list(struct(n, x, y, w, h, x + w AS x1, y + h AS y1, w * h AS area))) AS boxes FROM {{rows}} GROUP BY episode_id, k)", rows=rows)


def tracked(samples: DataFrame, faces: DataFrame, near: float = 0.12) -> DataFrame:
    """samples (episode_id, k, t, motion) and faces (episode_id, k, center_x, score) -> raw track: the best face, or the first that is near
    the last position and scores more than half as much; without faces the last position holds (first 0.5), not confident.
    The choice hangs on the one before, so an episode's faces stream through one task."""
    s = samples.sparkSession
    lists = q(s, "SELECT episode_id, k, transform(array_sort(collect_list(struct(-score AS a, center_x AS x))), z -> struct(z.x AS x, -z.a AS score)) AS faces FROM {faces} GROUP BY episode_id, k", faces=faces)
    rows = q(s, "SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY k) AS i FROM (SELECT s.episode_id, s.k, s.t, s.motion, l.faces.x AS xs, l.faces.score AS scores FROM {samples} s LEFT JOIN {lists} l USING (episode_id, k))", samples=samples, lists=lists)

    def run(batches):  # noqa: ANN001, ANN202
        last = None
        for batch in batches:
            xs, scores = batch.column("xs"), batch.column("scores")
            ends = np.cumsum(xs.value_lengths().fill_null(0).to_numpy()).tolist()
            xs, scores = (c.flatten().to_numpy(zero_copy_only=False).tolist() for c in (xs, scores))
            center, sure, a = [], [], 0
            for b, i in zip(ends, batch.column("i").to_pylist(), strict=True):
                if i == 1:
                    last = None
                if b > a:
                    best = a
                    if last is not None:
                        best = next((f for f in range(a, b) if abs(xs[f] - last) < near and scores[f] > scores[a] * 0.5), a)
                    last = xs[best]
                center.append(last if last is not None else 0.5)
                sure.append(b > a)
                a = b
            yield pa.RecordBatch.from_arrays([batch.column("episode_id"), batch.column("k"), batch.column("t"), pa.array(center, pa.float64(), from_pandas=True), pa.array(sure), batch.column("motion")], ["episode_id", "k", "t", "center_x", "confident", "motion"])

    kind = samples.schema["episode_id"].dataType.simpleString()
    return rows.sortWithinPartitions("episode_id", "k").mapInArrow(run, f"episode_id {kind}, k int, t double, center_x double, confident boolean, motion double")


def crop_path(track: DataFrame, cuts: DataFrame, half: float) -> DataFrame:
    """A raw track smoothed and eased within each shot, and kept inside the frame: half is half the crop's width, as a share."""
    held = by_shot(track, cuts)
    own = held.selectExpr("struct(episode_id, shot) AS episode_id", "k", "t", "center_x")
    eased = smoothed(own).selectExpr("episode_id.episode_id AS episode_id", "k", f"least(greatest(eased, {half}D), {1 - half}D) AS center_x")
    return track.select("episode_id", "k", "t", "confident", "motion").join(eased, ["episode_id", "k"])
