"""DuckDB SQL that restates the queries of `extra`, and the lexicon's."""

from __future__ import annotations

import math

SEGMENT_COLUMNS = 'episode_id, seg, start, "end", text, speaker'


def values(rows: list[tuple], columns: str) -> str:
    def one(x: object) -> str:
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else "NULL" if x is None else str(x)

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) v({columns})"


TAGS = """SELECT *, CASE WHEN pos % 11 <> 0 THEN CASE pos % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END END AS b, pos % 11 <> 0 AND pos % 4 = 1 AS i, pos % 11 <> 0 AND pos % 5 = 2 AS f, pos % 11 <> 0 AND pos % 6 = 1 AS s, pos % 11 <> 0 AND pos % 7 = 3 AS c FROM words"""
TAG = r"""CASE WHEN b IS NOT NULL THEN '\b' || {b} ELSE '' END || CASE WHEN i THEN '{i}' ELSE '' END || CASE WHEN f THEN '\fn{f}' ELSE '' END || CASE WHEN s THEN '\fs{s}' ELSE '' END || CASE WHEN c THEN '\c&H00{c}' ELSE '' END"""
EDITS = """ed AS (SELECT episode_id, clip, CASE WHEN clip % 2 = 0 THEN start + 0.5::DOUBLE END AS s, CASE WHEN clip % 3 = 0 THEN "end" - 0.25::DOUBLE END AS e, CASE WHEN clip % 5 = 0 THEN 3.5::DOUBLE END AS g FROM clips WHERE clip % 2 = 0 OR clip % 3 = 0 OR clip % 5 = 0)"""
SEATS = "seats AS (SELECT s_suppkey % 20 AS episode_id, CAST(s_suppkey // 20 AS INT) AS seat, (s_suppkey * 37 % 64) / 64::DOUBLE AS cx, (s_suppkey * 53 % 64) / 64::DOUBLE AS cy, (8 + s_suppkey % 16) / 128::DOUBLE AS wd, (8 + s_suppkey % 32) / 128::DOUBLE AS ht, 1000 - s_suppkey % 400 AS samples FROM supplier)"
# a panel of 9:8, zoomed to 4.18 seat heights, its centre at 36 % of its height
CROPS = """top2 AS (SELECT * FROM seats QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY samples DESC, seat) <= 2),
    hh AS (SELECT *, least(720.0::DOUBLE, max(ht * 720) OVER (PARTITION BY episode_id) * 4.18::DOUBLE) AS h0 FROM top2),
    cr AS (SELECT *, least(h0 * 1.125::DOUBLE, 1280.0::DOUBLE) AS w, CASE WHEN h0 * 1.125 > 1280 THEN 1280 / 1.125::DOUBLE ELSE h0 END AS h FROM hh)"""
BOXES = "bx AS (SELECT l_orderkey, l_linenumber, l_partkey % 40 AS ax, l_suppkey % 30 AS ay, 10 + l_partkey % 17 AS aw, 10 + l_suppkey % 13 AS ah, l_orderkey % 40 AS bx, l_linenumber % 30 AS by_, 10 + l_orderkey % 17 AS bw, 10 + l_linenumber % 13 AS bh FROM lineitem), ov AS (SELECT *, greatest(0, least(ax + aw, bx + bw) - greatest(ax, bx)) * greatest(0, least(ay + ah, by_ + bh) - greatest(ay, by_)) AS o FROM bx)"
MEL = f"""edge AS (SELECT CAST(i AS INT) AS i, CAST(floor(513 * (700 * (pow(10, (lo + (hi - lo) * i / 27.0::DOUBLE) / 2595) - 1)) / 16000) AS INT) AS b FROM range(0, 28) r(i), (SELECT 2595 * log10(1 + 50 / 700::DOUBLE) AS lo, 2595 * log10(1 + 8000 / 700::DOUBLE) AS hi)),
    tri AS (SELECT l.i AS filter, l.b AS a, CASE WHEN m.b = l.b THEN l.b + 1 ELSE m.b END AS b, h.b AS c0 FROM edge l JOIN edge m ON m.i = l.i + 1 JOIN edge h ON h.i = l.i + 2),
    tr2 AS (SELECT filter, a, b, CASE WHEN c0 = b THEN b + 1 ELSE c0 END AS c FROM tri),
    mel AS (SELECT filter, CAST(bin AS INT) AS bin, CASE WHEN bin < b THEN (bin - a) / (b - a)::DOUBLE ELSE (c - bin) / (c - b)::DOUBLE END AS weight FROM tr2, range(0, 257) r(bin) WHERE bin >= a AND bin < c)"""
MFCC = f"""sig AS (SELECT s_suppkey, CAST(n AS INT) AS n, ((n * (s_suppkey % 37 + 3) * 7919 + n * n) % 2001) / 1000::DOUBLE - 1 AS x FROM supplier, range(0, 560) r(n)),
    pre AS (SELECT s_suppkey, n, x - 0.97::DOUBLE * coalesce(lag(x) OVER (PARTITION BY s_suppkey ORDER BY n), 0) AS x FROM sig),
    fr AS (SELECT s_suppkey, CAST(f AS INT) AS frame, n - f * 160 AS n, x * (0.54::DOUBLE - 0.46::DOUBLE * cos(2 * pi() * (n - f * 160) / 399)) AS x FROM pre, range(0, 2) r(f) WHERE n - f * 160 BETWEEN 0 AND 399),
    turn AS (SELECT CAST(m AS INT) AS m, cos(2 * pi() * m / 512) AS c, sin(2 * pi() * m / 512) AS s FROM range(0, 512) r(m)),
    pw AS (SELECT s_suppkey, frame, bin, (pow(sum(x * c), 2) + pow(sum(x * s), 2)) / 512 AS p FROM fr, (SELECT CAST(bin AS INT) AS bin FROM range(0, 257) r(bin)) k JOIN turn ON m = (k.bin * n) % 512 GROUP BY ALL),
    en AS (SELECT s_suppkey, frame, filter, sum(p * weight) AS e FROM pw JOIN mel USING (bin) GROUP BY ALL),
    lg AS (SELECT s_suppkey, frame, filter, ln(CASE WHEN e = 0 THEN {2.0**-52} ELSE e END) AS e FROM en)"""
# a running median and mean with clamped places, and the follower one frame after another
SMOOTH = """nf AS (SELECT episode_id, k, t, center_x AS x, count(*) OVER (PARTITION BY episode_id) AS n FROM frames),
    wd AS (SELECT *, least(9, n - (n % 2 = 0)::INT) // 2 AS h9, least(5, n - (n % 2 = 0)::INT) // 2 AS h5 FROM nf),
    md AS (SELECT a.episode_id, a.k, a.t, a.n, a.h5, CASE WHEN a.n < 3 THEN a.x ELSE median(b.x) END AS m FROM (SELECT *, unnest(range(-h9, h9 + 1)) AS o FROM wd) a JOIN nf b ON b.episode_id = a.episode_id AND b.k = greatest(0, least(a.n - 1, a.k + a.o)) GROUP BY a.episode_id, a.k, a.t, a.n, a.h5, a.x),
    sm AS MATERIALIZED (SELECT a.episode_id, a.k, a.t, CASE WHEN a.n < 3 THEN a.m ELSE avg(b.m) END AS s FROM (SELECT *, unnest(range(-h5, h5 + 1)) AS o FROM md) a JOIN md b ON b.episode_id = a.episode_id AND b.k = greatest(0, least(a.n - 1, a.k + a.o)) GROUP BY a.episode_id, a.k, a.t, a.n, a.m),
    ea AS (SELECT episode_id, k, s AS e FROM sm WHERE k = 0 UNION ALL SELECT e.episode_id, s.k, CASE WHEN abs(s.s - e.e) > 0.01 THEN e.e + (s.s - e.e) * 0.22::DOUBLE ELSE e.e END FROM ea e JOIN sm s ON s.episode_id = e.episode_id AND s.k = e.k + 1)"""
# runs of shots one after another
MODES = """pc AS MATERIALIZED (SELECT c.episode_id, c.clip, greatest(k.start, c.start) AS a, least(k."end", c."end") AS b, CASE WHEN k.st THEN 'blur' ELSE 'face' END AS mode, row_number() OVER (PARTITION BY c.episode_id, c.clip ORDER BY k.shot) AS r FROM tclips c JOIN kinds k ON k.episode_id = c.episode_id AND k.start < c."end" AND k."end" > c.start),
    f1 AS (SELECT episode_id, clip, r, [{'a': a, 'b': b, 'm': mode}] AS runs FROM pc WHERE r = 1
      UNION ALL SELECT f.episode_id, f.clip, p.r, CASE WHEN f.runs[-1].m = p.mode THEN list_append(f.runs[:-2], {'a': f.runs[-1].a, 'b': p.b, 'm': p.mode}) ELSE list_append(f.runs, {'a': p.a, 'b': p.b, 'm': p.mode}) END FROM f1 f JOIN pc p ON p.episode_id = f.episode_id AND p.clip = f.clip AND p.r = f.r + 1),
    l1 AS MATERIALIZED (SELECT episode_id, clip, arg_max(runs, r) AS runs FROM f1 GROUP BY ALL),
    f2 AS (SELECT episode_id, clip, 1 AS r, runs, runs[:1] AS kept FROM l1
      UNION ALL SELECT episode_id, clip, r + 1, runs, CASE WHEN runs[r + 1].b - runs[r + 1].a < 1.5 OR kept[-1].m = runs[r + 1].m THEN list_append(kept[:-2], {'a': kept[-1].a, 'b': runs[r + 1].b, 'm': kept[-1].m}) ELSE list_append(kept, runs[r + 1]) END FROM f2 WHERE r < len(runs)),
    l2 AS (SELECT episode_id, clip, arg_max(kept, r) AS kept FROM f2 GROUP BY ALL),
    un AS (SELECT episode_id, clip, len(kept) AS n, unnest(kept) AS z, generate_subscripts(kept, 1) AS i FROM l2)"""
COVER = """held_ AS (SELECT c.clip, c.start AS s, c."end" AS e, f.*, f.t BETWEEN c.start + 1 AND c."end" - 1 AS mid FROM tclips c JOIN frames f ON f.episode_id = c.episode_id AND f.t BETWEEN c.start AND c."end"),
    inn AS (SELECT *, row_number() OVER (PARTITION BY episode_id, clip ORDER BY t) AS r, min(t) OVER (PARTITION BY episode_id, clip) AS t0 FROM (SELECT * FROM held_ h WHERE mid OR NOT EXISTS (SELECT 1 FROM held_ x WHERE x.episode_id = h.episode_id AND x.clip = h.clip AND x.mid))),
    sti AS (SELECT a.episode_id, a.clip, a.s, a.e, a.t, a.t0, a.confident, -(coalesce(avg(b.motion) FILTER (WHERE b.motion >= 0), 0) + (max(b.center_x) - min(b.center_x)) * 4) AS still FROM inn a JOIN inn b ON b.episode_id = a.episode_id AND b.clip = a.clip AND abs(a.r - b.r) <= 2 GROUP BY ALL),
    val AS (SELECT x.episode_id, x.clip, x.t, x.t0, x.still, (SELECT arg_min(l.value, l.pos) FROM spoken l WHERE l.episode_id = x.episode_id AND x.t BETWEEN l.start AND l."end" AND l."end" > x.s AND l.start < x.e) AS value FROM sti x WHERE x.confident),
    cand AS (SELECT *, round(still + coalesce(value, 0) * 8 - (t - t0) * 0.02::DOUBLE, 9) AS score FROM val v WHERE value IS NOT NULL OR NOT EXISTS (SELECT 1 FROM val y WHERE y.episode_id = v.episode_id AND y.clip = v.clip AND y.value IS NOT NULL))"""
MERGED = """bo AS MATERIALIZED (SELECT l_orderkey % 16 AS episode_id, CAST(l_orderkey % 997 AS INT) AS k, CAST(l_partkey % 40 AS INT) AS x, CAST(l_suppkey % 30 AS INT) AS y, CAST(l_quantity + 20 AS INT) AS w, CAST(l_quantity + 30 AS INT) AS h, row_number() OVER (PARTITION BY l_orderkey % 16, l_orderkey % 997 ORDER BY l_orderkey * 8 + l_linenumber, l_partkey % 40, l_suppkey % 30, l_quantity) AS r FROM lineitem),
    kb AS (SELECT episode_id, k, r, [{'x': x, 'y': y, 'w': w, 'h': h, 'v': 1}] AS kept FROM bo WHERE r = 1
      UNION ALL SELECT g.episode_id, g.k, g.r, CASE WHEN hit IS NULL THEN list_append(kept, {'x': x, 'y': y, 'w': w, 'h': h, 'v': 1}) ELSE list_transform(kept, lambda z, i: {'x': z.x, 'y': z.y, 'w': z.w, 'h': z.h, 'v': z.v + (i = hit)::INT}) END
      FROM (SELECT f.episode_id, f.k, b.r, f.kept, b.x, b.y, b.w, b.h, nullif(list_position(list_transform(f.kept, lambda z: (greatest(0, least(z.x + z.w, b.x + b.w) - greatest(z.x, b.x)) * greatest(0, least(z.y + z.h, b.y + b.h) - greatest(z.y, b.y)))::DOUBLE
        / (z.w * z.h + b.w * b.h - greatest(0, least(z.x + z.w, b.x + b.w) - greatest(z.x, b.x)) * greatest(0, least(z.y + z.h, b.y + b.h) - greatest(z.y, b.y))) > 0.4), true), 0) AS hit FROM kb f JOIN bo b ON b.episode_id = f.episode_id AND b.k = f.k AND b.r = f.r + 1) g),
    lb AS (SELECT episode_id, k, unnest(arg_max(kept, r)) AS z FROM kb GROUP BY episode_id, k)"""
# the face followed one frame after another, then SMOOTH within each shot
TRACK = """fo AS (SELECT episode_id, k, CASE WHEN confident THEN center_x END AS x FROM frames WHERE k = 0
      UNION ALL SELECT o.episode_id, f.k, CASE WHEN NOT f.confident THEN o.x WHEN o.x IS NULL OR abs(f.center_x - o.x) < 0.12 THEN f.center_x WHEN abs(1 - f.center_x - o.x) < 0.12 THEN 1 - f.center_x ELSE f.center_x END FROM fo o JOIN frames f ON f.episode_id = o.episode_id AND f.k = o.k + 1),
    whole AS MATERIALIZED (SELECT * FROM frames),
    part AS MATERIALIZED (SELECT f.episode_id * 100000 + s.shot AS episode_id, row_number() OVER (PARTITION BY f.episode_id, s.shot ORDER BY f.k) - 1 AS k, f.k AS t, coalesce(o.x, 0.5) AS center_x FROM whole f JOIN fo o ON o.episode_id = f.episode_id AND o.k = f.k JOIN shots s ON s.episode_id = f.episode_id AND f.t >= s.start AND f.t < s."end")"""
EXTENDED = """lim AS (SELECT episode_id, quantile_cont(level, 0.65) AS high, quantile_cont(level, 0.25) AS low FROM levels GROUP BY ALL),
    own AS (SELECT episode_id, clip, start, "end", greatest("end" - 25, start) AS fl FROM clips),
    c0 AS (SELECT o.episode_id, o.clip, w.word, sum((w.start >= o.fl AND w."end" <= o."end")::INT) AS l, sum((w.start >= o."end" AND w.start < o."end" + 20)::INT) AS r FROM own o JOIN cw w ON w.episode_id = o.episode_id AND w.start >= o.fl AND w.start < o."end" + 20 GROUP BY ALL),
    l0 AS (SELECT episode_id, clip, CASE WHEN sum(l * l) > 0 AND sum(r * r) > 0 THEN sum(l * r) / (sqrt(sum(l * l)::DOUBLE) * sqrt(sum(r * r)::DOUBLE)) ELSE 0 END AS level FROM c0 GROUP BY ALL),
    go0 AS (SELECT o.*, m.low FROM own o JOIN lim m USING (episode_id) LEFT JOIN l0 USING (episode_id, clip) WHERE coalesce(l0.level, 0) >= m.high AND NOT EXISTS (SELECT 1 FROM bounds b WHERE b.episode_id = o.episode_id AND b.t > o.start + 20 AND b.t < o."end")),
    go1 AS (SELECT g.*, least("end" + 75, start + 150) AS cap0 FROM go0 g),
    go2 AS (SELECT g.*, coalesce((SELECT min(b.t) FROM bounds b WHERE b.episode_id = g.episode_id AND b.t > g."end" + 1 AND b.t <= g.cap0), g.cap0) AS cap FROM go1 g),
    st0 AS (SELECT g.episode_id, g.clip, g.low, g.fl, g."end" AS e, f."end" AS t FROM go2 g JOIN feats f ON f.episode_id = g.episode_id AND f."end" >= g."end" + 6 AND f."end" <= g.cap),
    st1 AS (SELECT s.episode_id, s.clip, s.low, s.t, w.word, sum((w.start >= s.fl AND w."end" <= s.e)::INT) AS l, sum((w.start >= s.t AND w.start < s.t + 20)::INT) AS r FROM st0 s LEFT JOIN cw w ON w.episode_id = s.episode_id GROUP BY ALL),
    st2 AS (SELECT episode_id, clip, low, t, CASE WHEN sum(l * l) > 0 AND sum(r * r) > 0 THEN sum(l * r) / (sqrt(sum(l * l)::DOUBLE) * sqrt(sum(r * r)::DOUBLE)) ELSE 0 END AS level FROM st1 GROUP BY ALL),
    tu AS (SELECT episode_id, clip, min(t) AS turn FROM st2 WHERE level <= low GROUP BY ALL),
    la AS (SELECT g.episode_id, g.clip, g.start, g."end", f."end" AS ne, f.seg FROM go2 g JOIN tu USING (episode_id, clip) JOIN feats f ON f.episode_id = g.episode_id AND f."end" > g."end" AND f."end" <= tu.turn AND f.clean),
    lo AS (SELECT l.*, (SELECT max(o.seg) FROM feats o WHERE o.episode_id = l.episode_id AND o.opens AND o.start >= l.start AND o."end" <= l.ne AND o."end" >= l.ne - {closing}) AS o FROM la l),
    ok AS (SELECT * FROM lo l WHERE o IS NULL OR ((SELECT coalesce(sum(f.content), 0) FROM feats f WHERE f.episode_id = l.episode_id AND f.seg > l.o AND f.seg <= l.seg) >= {payload} AND NOT EXISTS (SELECT 1 FROM feats n WHERE n.episode_id = l.episode_id AND n.opens AND n.start >= l.ne AND n.start < l.ne + {spill})))"""
# titles: a word after another into lines
TITLES = """tl AS MATERIALIZED (SELECT episode_id, seg, length(upper_) AS len, list_filter(regexp_split_to_array(upper_, '\\s+'), lambda w: w <> '') AS w FROM (SELECT episode_id, seg, upper(replace(text, 'ß', 'SS')) AS upper_ FROM segments)),
    tt AS (SELECT *, greatest(1, len // least(3, greatest(1, CAST(ceil(len / 18.0) AS INT)))) AS target FROM tl),
    wr AS (SELECT episode_id, seg, 0 AS r, w, target, CAST([] AS VARCHAR[]) AS lines, '' AS cur, 0 AS used FROM tt
      UNION ALL SELECT episode_id, seg, r + 1, w, target,
        CASE WHEN len(lines) < 3 AND cur <> '' AND length(cur) + 1 + length(w[r + 1]) > greatest(target, length(w[r + 1])) THEN list_append(lines, cur) ELSE lines END,
        CASE WHEN len(lines) = 3 THEN cur WHEN cur = '' OR length(cur) + 1 + length(w[r + 1]) > greatest(target, length(w[r + 1])) THEN w[r + 1] ELSE cur || ' ' || w[r + 1] END,
        CASE WHEN len(lines) < 3 AND cur <> '' AND length(cur) + 1 + length(w[r + 1]) > greatest(target, length(w[r + 1])) THEN used + len(string_split(cur, ' ')) ELSE used END FROM wr WHERE r < len(w)),
    fin AS (SELECT * FROM wr WHERE r = len(w))"""
# a detection after another into groups
GROUPS = """dt AS MATERIALIZED (SELECT episode_id, center_x AS x, row_number() OVER (PARTITION BY episode_id ORDER BY k) AS r FROM frames WHERE confident),
    gr AS (SELECT episode_id, r, [[x]] AS g FROM dt WHERE r = 1
      UNION ALL SELECT episode_id, r, CASE WHEN hit = 0 THEN list_append(g, [x]) ELSE list_transform(g, lambda l, i: CASE WHEN i = hit THEN list_append(l, x) ELSE l END) END
      FROM (SELECT o.episode_id, d.r, o.g, d.x, coalesce(list_position(list_transform(o.g, lambda l: abs(list_median(l) - d.x) < 0.1), true), 0) AS hit FROM gr o JOIN dt d ON d.episode_id = o.episode_id AND d.r = o.r + 1)),
    ug AS (SELECT episode_id, unnest(arg_max(g, r)) AS l FROM gr GROUP BY episode_id)"""
HEIGHTS = [720, 1280, 1920]


def _tags() -> list[tuple]:
    rows = []
    for h in HEIGHTS:
        k = h / 1920
        size, thick, spread = max(14, round(64 * k)), max(0.5, 3.5 * k), 6.0 * k
        up, move = max(2, int(size * 0.6)), "{\\move(540,%d,540,1500,0,150)\\fad(150,0)}"
        zoom = "{\\fscx%d\\fscy%d\\t(0,150,\\fscx100\\fscy100)}"
        own = {"none": "", "pop": zoom % (60, 60), "zoom": zoom % (130, 130), "fade": "{\\fad(150,0)}", "blur": f"{{\\blur{size * 0.12:.1f}\\t(0,150,\\blur0)}}", "rise": move % (1500 + up), "drop": move % (1500 - up)}
        colour = "&H0020FF10" if h > 1500 else "&H00000000"
        glow = f"{{\\bord{max(thick, spread):.1f}\\blur{spread:.1f}\\3c{colour}}}" if h > 1000 else ""
        rows += [(n, h, t, "" if n in ("rise", "drop") else t, glow) for n, t in own.items()]
    return rows


def more(segments: str, clips: str, words: str, plat: str, plan: str, slots: str, frames: str, shots: str, static: str, track_clips: str, tokens: str, spoken: str, topic: tuple, pack, with_) -> dict[str, str]:  # noqa: ANN001
    plain = "trim(lower(regexp_replace({}, '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g')))"
    shape = "(CASE WHEN substr({0}, 1, 1) = upper(substr({0}, 1, 1)) AND substr({0}, 1, 1) <> lower(substr({0}, 1, 1)) THEN CASE WHEN {0} = upper({0}) THEN upper({1}) ELSE upper({1}[1]) || {1}[2:] END ELSE {1} END)"
    return {
        "transcript_segments": with_(segments) + f" SELECT {SEGMENT_COLUMNS} FROM segments",
        "transcript_words": with_(segments, words) + ' SELECT episode_id, pos, start, "end", text, confidence FROM wd1',
        "state_roundtrip": with_(segments, clips, slots) + """ SELECT 'slot' AS kind, episode_id, index, start, "end", true AS usable, false AS usable_after_change, false AS void, true AS void_after_change FROM slots
          UNION ALL SELECT 'rejected', episode_id, 0, start, "end", true, false, false, true FROM clips WHERE clip % 4 = 2""",
        "rendered_files": with_(segments, clips, plat, plan) + """ SELECT p.episode_id, p.filename, c.start + CASE WHEN p.clip % 3 = 1 THEN 0.5 ELSE 0 END::DOUBLE AS start, c."end", CASE WHEN p.clip % 3 = 1 THEN 'x' ELSE '' END AS edit
          FROM plans p JOIN clips c USING (episode_id, clip) WHERE p.platform IN ('reels', 'square') AND (p.platform = 'square' OR p.clip % 2 = 0)""",
        "clip_edits": with_(segments, clips, EDITS) + ' SELECT c.episode_id, c.clip, coalesce(s, c.start) AS start, coalesce(e, c."end") AS "end", g AS gain_db FROM clips c LEFT JOIN ed USING (episode_id, clip) WHERE c."end" - c.start > 3',
        "edit_fingerprints": with_(segments, clips, EDITS) + """ SELECT episode_id, clip, substr(sha1('{"end": ' || coalesce(e::VARCHAR, 'null') || ', "gain_db": ' || coalesce(g::VARCHAR, 'null') || ', "keep_spans": null, "start": ' || coalesce(s::VARCHAR, 'null') || ', "words": null}'), 1, 12) AS fingerprint FROM ed""",
        "word_style_tags": with_(segments, words, "tg AS (" + TAGS + ")", "op AS (SELECT episode_id, pos, " + TAG.format(b="b", i="\\i1", f="Anton", s="48", c="EFAB12") + " AS o, " + TAG.format(b="1", i="\\i0", f="Anton", s="76", c="FFFFFF") + " AS c FROM tg)")
        + " SELECT episode_id, pos, CASE WHEN o = '' THEN '' ELSE '{' || o || '}' END AS opening, CASE WHEN c = '' THEN '' ELSE '{' || c || '}' END AS closing FROM op",
        "typed_steps": with_(segments, 'ch AS (SELECT episode_id, seg, start, "end", text, CAST(p AS INT) AS p FROM (SELECT *, unnest(range(1, length(text) + 1)) AS p FROM segments) WHERE trim(text[p]) <> \'\')', "st AS (SELECT *, row_number() OVER (PARTITION BY episode_id, seg ORDER BY p) - 1 AS n, count(*) OVER (PARTITION BY episode_id, seg) AS m FROM ch)")
        + ', ti AS (SELECT *, least(0.4::DOUBLE, "end" - start) / m AS step FROM st) SELECT episode_id, seg, round(start + step * n, 6) AS from_, round(CASE WHEN n = m - 1 THEN "end" ELSE start + step * (n + 1) END, 6) AS to_, text[1:p] AS shown FROM ti',
        "entrance_tags": values(_tags(), "animation, height, placed, unplaced, glow"),
        "output_sizes": values([(r, q, *wh, round(w * wh[1] / 1080) // 2 * 2, w) for r, a, b in (("9:16", (720, 1280), (1080, 1920)), ("1:1", (1280, 1280), (1920, 1920)), ("4:5", (1024, 1280), (1536, 1920)), ("16:9", (1280, 720), (1920, 1080))) for q, wh in (("720p", a), ("1080p", b), ("odd", b)) for w in (1440, 1920, 2538)], "ratio, resolution, w, h, scaled, src_w"),
        "pack_words": values([("intensity_markers", w) for w in ("banget", "edan", "gila", "gokil", "kaget", "parah", "shock")] + [("stakes_markers", "boncos")] + [("first_person", w) for w in ("aku", "gua", "gue", "gw", "saya")] + [("weight", "3.0"), ("payload", "7"), ("name", "own")], "bank, word"),
        "lexicon_terms": values([(k, t, "Says Sutradara, keiten, gotham, the.") for k, t in enumerate(("Sutradara", "keiten", "gotham", "the"))], "k, term, prompt"),
        "split_views": with_(SEATS, CROPS) + " SELECT episode_id, seat, CAST(trunc(greatest(0, least(cx * 1280 - w / 2, 1280 - w))) AS INT) AS x, CAST(trunc(greatest(0, least(cy * 720 - h * 0.36::DOUBLE, 720 - h))) AS INT) AS y, CAST(trunc(w) AS INT) // 2 * 2 AS w, CAST(trunc(h) AS INT) // 2 * 2 AS h FROM cr",
        "mouth_boxes": with_(SEATS) + " SELECT episode_id, seat, CAST(greatest(0, trunc(cx * 1280 - wd * 1280 * 0.3::DOUBLE)) AS INT) AS x0, CAST(greatest(0, trunc(cy * 720 + ht * 720 * 0.05::DOUBLE)) AS INT) AS y0, CAST(least(1280, trunc(cx * 1280 + wd * 1280 * 0.3::DOUBLE)) AS INT) AS x1, CAST(least(720, trunc(cy * 720 + ht * 720 * 0.45::DOUBLE)) AS INT) AS y1 FROM seats",
        "box_overlaps": with_(BOXES) + " SELECT l_orderkey, l_linenumber, round(o / (aw * ah + bw * bh - o)::DOUBLE, 9) AS iou FROM ov",
        "remaining_times": "WITH x AS (SELECT o_orderkey, CAST(o_orderkey % 5 AS INT) AS done, (o_orderkey % 97)::DOUBLE AS spent FROM orders) SELECT o_orderkey, CASE WHEN done < 1 THEN '' WHEN spent / done * (9 - done) < 90 THEN printf('  about %.0fs left', spent / done * (9 - done)) ELSE printf('  about %.0fm left', spent / done * (9 - done) / 60) END AS \"left\" FROM x",
        "mel_weights": with_(MEL) + " SELECT filter, bin, round(weight, 9) AS weight FROM mel WHERE weight <> 0",
        "mfcc_frames": with_(MEL, MFCC) + f" SELECT s_suppkey, frame, CAST(k AS INT) AS k, round(sum(e * cos(pi() * k * (2 * filter + 1) / 52)) * CASE WHEN k = 0 THEN {math.sqrt(1 / 26)} ELSE {math.sqrt(2 / 26)} END, 6) AS value FROM lg, range(0, 13) r(k) GROUP BY s_suppkey, frame, k",
        "smoothed_path": with_(frames, SMOOTH) + " SELECT s.episode_id, s.k, s.t, round(s.s, 6) AS smooth, round(e.e, 6) AS eased FROM sm s JOIN ea e USING (episode_id, k)",
        "segment_modes": with_(frames, shots, static, track_clips, MODES) + """ SELECT u.episode_id, u.clip, CAST(i - 1 AS INT) AS run, CASE WHEN i = 1 THEN c.start ELSE z.a END AS start, CASE WHEN i = n THEN c."end" ELSE z.b END AS "end", z.m AS mode FROM un u JOIN tclips c USING (episode_id, clip)
          UNION ALL SELECT episode_id, clip, 0, start, "end", 'face' FROM tclips c WHERE NOT EXISTS (SELECT 1 FROM un u WHERE u.episode_id = c.episode_id AND u.clip = c.clip)""",
        "cover_time": with_(frames, track_clips, segments, words, tokens, spoken, COVER) + " SELECT DISTINCT ON (episode_id, clip) episode_id, clip, t FROM cand ORDER BY episode_id, clip, score DESC, t DESC",
        "seat_clusters": with_(frames, GROUPS) + " SELECT episode_id, CAST(row_number() OVER (PARTITION BY episode_id ORDER BY list_median(l)) - 1 AS INT) AS seat, list_median(l) AS center_x, 0.5::DOUBLE AS center_y, 0.125::DOUBLE AS width, 0.25::DOUBLE AS height, CAST(len(l) AS INT) AS samples FROM ug WHERE len(l) >= 3",
        "merged_boxes": with_(MERGED) + " SELECT episode_id, k, z.x AS x, z.y AS y, z.w AS w, z.h AS h, z.v AS votes FROM lb",
        "tracked_path": with_(frames, shots, TRACK, SMOOTH.replace("FROM frames)", "FROM part)")) + " SELECT f.episode_id, f.k, f.t, f.confident, round(least(greatest(e.e, 0.158203125), 0.841796875), 6) AS center_x FROM sm s JOIN ea e ON e.episode_id = s.episode_id AND e.k = s.k JOIN whole f ON f.episode_id = s.episode_id // 100000 AND f.k = s.t",
        "clip_extension": with_(*topic, clips, EXTENDED.format(closing=pack.closing_window, payload=pack.payload_words, spill=min(pack.spillover_window, 20))) + ' SELECT episode_id, clip, start, max(ne) AS "end", max(ne) - "end" AS added FROM ok GROUP BY episode_id, clip, start, "end" HAVING max(ne) > "end" + 1',
        "wrapped_titles": with_(segments, TITLES) + """ SELECT episode_id, seg, array_to_string(CASE WHEN len(lines) < 3 THEN CASE WHEN cur <> '' THEN list_append(lines, cur) ELSE lines END WHEN used < len(w) THEN list_append(lines[:2], regexp_replace(lines[3], '[,;:]+$', '') || '...') ELSE lines END, '|') AS lines FROM fin""",
        # the cursor: a phrase of two words is taken whole, any other word by itself
        "lexicon_words": with_(segments, words, 'nx AS (SELECT *, lead(text) OVER (PARTITION BY episode_id ORDER BY pos) AS t2, lead("end") OVER (PARTITION BY episode_id ORDER BY pos) AS e2 FROM wd1)',
            f"mt AS (SELECT *, CASE {plain.format(chr(116) + 'ext || chr(32) || t2')} WHEN 'the that' THEN 'Thethat' WHEN 'le la' THEN 'La' WHEN 'in der' THEN 'inder' END AS new FROM nx)",
            "cur AS (SELECT episode_id, min(pos) AS pos FROM mt GROUP BY ALL UNION ALL SELECT c.episode_id, c.pos + CASE WHEN m.new IS NULL THEN 1 ELSE 2 END FROM cur c JOIN mt m ON m.episode_id = c.episode_id AND m.pos = c.pos WHERE c.pos < (SELECT max(z.pos) FROM mt z))")
        + f""" SELECT m.episode_id, CAST(row_number() OVER (PARTITION BY m.episode_id ORDER BY m.pos) - 1 AS INT) AS pos, round(m.start, 3) AS start, round(CASE WHEN new IS NULL THEN m."end" ELSE e2 END, 3) AS "end",
          CASE WHEN new IS NULL THEN text ELSE {shape.format('text', 'new')} || regexp_extract(t2, '[.,!?;:]+$') END AS text FROM cur JOIN mt m USING (episode_id, pos)""",
    }
