"""DuckDB SQL that restates the queries of the catalogue: plain joins where the engine slides frames, no code in common."""

from __future__ import annotations

from ..config import PROSE, Pack
from .extra_oracles import more

P = PROSE


def arr(bank: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in bank) + "]"


def phrase(bank: list[str]) -> str:
    return "(^|[^a-z])(" + "|".join(p.replace(" ", r"\s+") for p in bank) + ")([^a-z]|$)"


def segments(of: str = "conversations") -> str:
    src = "SELECT conv_id AS episode_id, turn, role, coalesce(text, '') AS text FROM conversations" if of == "conversations" else "SELECT doc_id AS episode_id, 0 AS turn, source AS role, coalesce(text, '') AS text FROM documents"
    return rf"""
    turns AS ({src}),
    cutup AS (SELECT episode_id, turn, role, regexp_extract_all(text, '[^.!?]+[.!?]*') AS parts FROM turns),
    single AS (SELECT episode_id, turn, role, len(parts) AS n, unnest(parts) AS part, generate_subscripts(parts, 1) AS k FROM cutup),
    asked AS (SELECT episode_id, turn, k, role AS speaker, CASE WHEN role = 'user' AND k = n THEN regexp_replace(part, '[.]$', '?') ELSE part END AS part FROM single),
    clean_ AS (SELECT episode_id, turn, k, speaker, regexp_replace(part, '^\s+|\s+$', '', 'g') AS text FROM asked),
    numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY episode_id ORDER BY turn, k) - 1 AS INT) AS seg, len(regexp_split_to_array(text, '\s+')) AS n_words FROM clean_ WHERE length(text) > 0),
    timed AS (SELECT *, n_words * 0.25::DOUBLE AS dur, CASE seg % 4 WHEN 0 THEN 0.25::DOUBLE WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 0.75::DOUBLE ELSE 2::DOUBLE END AS gap FROM numbered),
    placed AS (SELECT *, sum(dur + gap) OVER (PARTITION BY episode_id ORDER BY seg) - dur - gap AS start FROM timed),
    segments AS (SELECT episode_id, seg, start, start + dur AS "end", text, speaker FROM placed)"""


def dangles(raw: str, p: Pack) -> str:
    last = f"coalesce(list_max(list_transform({raw}, lambda w, i: CASE WHEN list_contains({arr(p.bank('speech_act_verbs'))}, lower(w)) THEN i ELSE 0 END)), 0)"
    return f"({last} > 0 AND len(list_filter({raw}[{last} + 1:], lambda w: length(w) >= 3 AND NOT list_contains({arr(p.bank('empty_after_verb'))}, lower(w)) AND NOT regexp_matches(w[1], '[A-Z]'))) = 0)"


def content(tok: str, *banks: list[str]) -> str:
    return f"len(list_filter({tok}, lambda w: length(w) >= 4 AND NOT list_contains({arr(sorted({w for b in banks for w in b}))}, w)))"


def features(p: Pack = P) -> str:
    stop, lead = p.bank("stopwords"), arr(p.bank("lead_in_endings"))
    return rf"""
    f0 AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM segments),
    f1 AS (SELECT *, lower(t) AS low, regexp_extract_all(lower(t), '[a-z'']+') AS tok, regexp_extract_all(t, '[A-Za-z'']+') AS raw, regexp_extract_all(lower(t), '[A-Za-z'']+') AS lowraw FROM f0),
    f2 AS (SELECT *, CAST({content('tok', stop)} AS INT) AS content, {dangles('raw', p)} AS dangles, {dangles('lowraw', p)} AS dangles_low,
      t LIKE '%?' OR regexp_matches(low, '{phrase(p.bank("question_openers"))}') AS asks, t LIKE '%?' AS is_question,
      list_position(list_transform(tok, lambda w: list_contains({arr(p.bank("discourse_particles"))}, w)), false) AS told_at FROM f1),
    f3 AS (SELECT *, CASE WHEN coalesce(told_at, 0) = 0 THEN [] ELSE tok[told_at:] END AS told FROM f2),
    feats AS (SELECT episode_id, seg, start, "end", text, speaker, t, low, tok, content, dangles, asks, is_question,
      regexp_matches(low, '{phrase(p.bank("promise_markers"))}') OR dangles_low OR (asks AND content >= {p.question_min_content}) AS opens,
      NOT dangles_low AND len(told) > 0 AND NOT list_contains({arr(p.bank("back_references"))}, coalesce(told[1], '')) AND {content('told', stop)} >= CASE WHEN asks THEN {p.opening_min_content_question} ELSE {p.opening_min_content} END AS stands,
      regexp_matches(t, '[.!]$') AND t NOT LIKE '%..' AND NOT list_contains({lead}, coalesce(tok[-1], '')) AND NOT dangles AND content >= 2 AS clean,
      t LIKE '%?' OR NOT regexp_matches(t, '[.!?…]$') OR list_contains({lead}, coalesce(tok[-1], '')) OR content < 2 OR dangles AS unfinished FROM f3)"""


def windows(p: Pack = P) -> str:
    return f"""
    win AS (SELECT a.episode_id, a.seg AS i, b.seg AS j, a.start, b."end" FROM feats a JOIN feats b ON a.episode_id = b.episode_id AND b.seg >= a.seg AND b."end" - a.start BETWEEN 15 AND 75
      WHERE NOT EXISTS (SELECT 1 FROM feats x WHERE x.episode_id = a.episode_id AND x.seg BETWEEN a.seg AND b.seg AND x."end" - a.start > 75)),
    body AS (SELECT w.episode_id, w.i, w.j, w.start, w."end", string_agg(f.t, ' ' ORDER BY f.seg) AS text, CAST(count(*) AS INT) AS n, CAST(sum((f.content < 3)::INT) AS BIGINT) AS short,
        max(f.seg) FILTER (WHERE f.opens AND f."end" >= w."end" - {p.closing_window}) AS last_open, min(f.seg) FILTER (WHERE f.is_question) AS question
      FROM win w JOIN feats f ON f.episode_id = w.episode_id AND f.seg BETWEEN w.i AND w.j GROUP BY ALL),
    sums AS (SELECT b.*, coalesce(sum(f.content) FILTER (WHERE f.seg > b.last_open), 0) AS payload, coalesce(sum(f.content) FILTER (WHERE f.seg > b.question), 0) AS after_question
      FROM body b JOIN feats f ON f.episode_id = b.episode_id AND f.seg BETWEEN b.i AND b.j GROUP BY ALL),
    spill AS (SELECT DISTINCT w.episode_id, w.j FROM win w JOIN feats f ON f.episode_id = w.episode_id AND f.seg BETWEEN w.j + 1 AND w.j + 7 AND f.opens AND f.start < w."end" + {p.spillover_window})"""


def scores(p: Pack = P) -> str:
    w = p.weights
    hits = lambda bank: f"len(list_filter({arr(p.bank(bank))}, lambda m: contains(low, m)))"
    stop = arr(p.bank("stopwords"))
    starts = " OR ".join(f"starts_with(o.low, '{x}') OR contains(' ' || o.low || ' ', ' {x} ')" for x in p.bank("question_words"))
    own = " OR ".join(f"contains(' ' || b.low || ' ', ' {x} ')" for x in p.bank("first_person"))
    return rf"""
    terms AS (SELECT episode_id, seg, unnest(list_filter(tok, lambda w: length(w) >= 3 AND NOT list_contains({stop}, w))) AS token FROM feats),
    tf AS (SELECT episode_id, token, count(*) AS n FROM terms GROUP BY ALL),
    total AS (SELECT episode_id, sum(n) AS n FROM tf GROUP BY ALL),
    wt AS (SELECT DISTINCT w.episode_id, w.i, w.j, t.token FROM win w JOIN terms t ON t.episode_id = w.episode_id AND t.seg BETWEEN w.i AND w.j),
    idf AS (SELECT wt.episode_id, wt.i, wt.j, avg(ln((total.n + 1) / tf.n::DOUBLE)) AS m FROM wt JOIN tf USING (episode_id, token) JOIN total USING (episode_id) GROUP BY ALL),
    lowered AS (SELECT *, lower(text) AS low FROM sums),
    sig AS (SELECT b.episode_id, b.i, b.j, b.start, b."end", b.text,
      CASE WHEN o.low LIKE '%?' OR {starts} THEN {w['opening_question']} ELSE 0 END::DOUBLE AS opening_question,
      (least({hits('curiosity_markers').replace('low', 'b.low')}, 2) * {w['curiosity_marker']})::DOUBLE AS curiosity_marker,
      (least({hits('contrarian_markers').replace('low', 'b.low')}, 2) * {w['contrarian_marker']})::DOUBLE AS contrarian_marker,
      (least({hits('intensity_markers').replace('low', 'b.low')}, 2) * {w['intensity_marker']})::DOUBLE AS intensity_marker,
      CASE WHEN regexp_matches(b.text, '\d') OR regexp_matches(b.low, '\b({"|".join(p.bank("quantity_words"))})\b') THEN {w['has_number']} ELSE 0 END::DOUBLE AS has_number,
      (least({hits('stakes_markers').replace('low', 'b.low')}, 3) * {w['stakes']}::DOUBLE)::DOUBLE AS stakes,
      CASE WHEN {own} THEN {w['personal_story']} * least({hits('past_markers').replace('low', 'b.low')}, 2) / 2.0 ELSE 0 END::DOUBLE AS personal_story,
      coalesce(idf.m, 0) * ({w['topic_distinctiveness']}::DOUBLE / 3) AS topic_distinctiveness,
      CASE WHEN z.unfinished OR (b.last_open IS NOT NULL AND (b.payload < {p.payload_words} OR spill.j IS NOT NULL)) THEN {w['ends_incomplete']} ELSE 0 END::DOUBLE AS ends_incomplete,
      CASE WHEN b.short * 2 > b.n THEN {w['chatter']}::DOUBLE * (b.short / b.n::DOUBLE - 0.5::DOUBLE) / 0.5::DOUBLE ELSE 0 END AS chatter,
      CASE WHEN b.question - b.i < greatest(1, b.n // 3) AND b.after_question >= 12 THEN {w['answered_question']} ELSE 0 END::DOUBLE AS answered_question,
      CASE WHEN NOT list_contains({stop}, coalesce(o.tok[1], '')) AND o.content >= 2 THEN {w['self_contained_opening']} ELSE 0 END::DOUBLE AS self_contained_opening
      FROM lowered b JOIN feats o ON o.episode_id = b.episode_id AND o.seg = b.i JOIN feats z ON z.episode_id = b.episode_id AND z.seg = b.j
      LEFT JOIN idf ON idf.episode_id = b.episode_id AND idf.i = b.i AND idf.j = b.j LEFT JOIN spill ON spill.episode_id = b.episode_id AND spill.j = b.j),
    scores AS (SELECT *, opening_question + curiosity_marker + contrarian_marker + intensity_marker + has_number + stakes + personal_story + topic_distinctiveness + ends_incomplete + chatter + answered_question + self_contained_opening AS raw_score FROM sig)"""


SIGNALS = ("opening_question", "curiosity_marker", "contrarian_marker", "intensity_marker", "has_number", "stakes", "personal_story", "topic_distinctiveness", "ends_incomplete", "chatter", "answered_question", "self_contained_opening")
CALIBRATED = """
    raws AS (SELECT episode_id, i, j, start, "end", round(raw_score, 6) AS raw_score FROM scores),
    fit AS (SELECT episode_id, median(raw_score) AS med, max(raw_score) AS top, min(raw_score) AS low FROM raws GROUP BY ALL),
    cal AS (SELECT r.*, round(least(10, greatest(0, CASE WHEN raw_score >= med AND top > med THEN 5 + 5 * (raw_score - med) / (top - med) WHEN med > low THEN 5 * (raw_score - low) / (med - low) ELSE 5 END)), 1) AS score,
      round((SELECT count(*) FROM raws x WHERE x.episode_id = r.episode_id AND x.raw_score < r.raw_score) * 100.0::DOUBLE / (SELECT count(*) FROM raws x WHERE x.episode_id = r.episode_id), 6) AS percentile
      FROM raws r JOIN fit USING (episode_id))"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts)


ORACLES: dict[str, str] = {
    "segments_from_turns": _with(segments()) + " SELECT * FROM segments",
    "segments_from_documents": _with(segments("documents")) + " SELECT * FROM segments",
    "words_timeline": _with(segments()) + r""", w AS (SELECT episode_id, seg, start AS s0, unnest(regexp_split_to_array(text, '\s+')) AS text, generate_subscripts(regexp_split_to_array(text, '\s+'), 1) - 1 AS k FROM segments)
      SELECT episode_id, CAST(row_number() OVER (PARTITION BY episode_id ORDER BY seg, k) - 1 AS INT) AS pos, s0 + k * 0.25::DOUBLE AS start, s0 + (k + 1) * 0.25::DOUBLE AS "end", text, 1::DOUBLE - ((length(text) + k) % 8) / 8::DOUBLE AS confidence, seg FROM w""",
    "segment_predicates": _with(segments(), features()) + " SELECT episode_id, seg, content, dangles, asks, opens, stands, clean, unfinished FROM feats",
    "term_frequencies": _with(segments(), features()) + f" SELECT episode_id, token, count(*) AS n FROM (SELECT episode_id, unnest(list_filter(tok, lambda w: length(w) >= 3 AND NOT list_contains({arr(P.bank('stopwords'))}, w))) AS token FROM feats) GROUP BY ALL",
    "candidate_windows": _with(segments(), features(), windows()) + """ SELECT episode_id, i, j, start, "end", n, short, last_open IS NOT NULL AS raised,
        CAST(CASE WHEN last_open IS NOT NULL THEN payload ELSE -1 END AS BIGINT) AS payload FROM sums""",
    "window_scores": _with(segments(), features(), windows(), scores()) + " SELECT episode_id, i, j, " + ", ".join(f"round({k}, 6) AS {k}" for k in SIGNALS) + ", round(raw_score, 6) AS raw_score FROM scores",
    "calibrated_scores": _with(segments(), features(), windows(), scores(), CALIBRATED) + " SELECT episode_id, i, j, raw_score, score, percentile FROM cal",
    "explain_text": _with(segments(), features(), windows(), scores()) + """ SELECT episode_id, i, j, coalesce(string_agg(format('{} (+{:.1f})', name, v), '; ' ORDER BY v DESC, name) FILTER (WHERE v > 0), 'no strong signals') AS why
      FROM (SELECT episode_id, i, j, unnest([""" + ", ".join(f"'{k}'" for k in SIGNALS) + "]) AS name, unnest([" + ", ".join(f"round({k}, 1)" for k in SIGNALS) + "]) AS v FROM scores) GROUP BY episode_id, i, j",
}

# --- text over documents ---------------------------------------------------------------------------------------------

DOCS = "docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"
TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def hits(low: str, bank: str) -> str:
    return f"CAST(len(list_filter({arr(P.bank(bank))}, lambda m: contains({low}, m))) AS INT)"


def shortened(t: str, most: int) -> str:
    parts = rf"regexp_split_to_array({TRIM.format(t)}, '\s+')"
    return f"CASE WHEN len({parts}) <= {most} THEN {t} ELSE regexp_replace(array_to_string({parts}[:{most}], ' '), '[,;:]+$', '') || '...' END"


def copy_lines(src: str) -> str:
    c = content(r"regexp_extract_all(lower(s), '[a-z'']+')", P.bank("stopwords"), P.bank("filler"))
    cut = rf"list_filter(list_transform(string_split(regexp_replace({TRIM.format('text')}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: {TRIM.format('s')}), lambda s: s <> '')"
    return rf"""
    cl0 AS (SELECT *, {cut} AS s_ FROM {src}),
    cl1 AS (SELECT *, coalesce(list_filter(s_[1:3], lambda s: s LIKE '%?' AND {c} >= 3)[1], list_filter(s_[1:4], lambda s: {c} >= 3)[1], s_[1], '') AS h_, array_to_string(s_[1:3], ' ') AS d_ FROM cl0),
    cl2 AS (SELECT *, {shortened('h_', 14)} AS hook, {shortened('d_', 40)} AS description FROM cl1),
    cl3 AS (SELECT *, regexp_replace(hook, '[?.!]+$', '') AS t_ FROM cl2),
    copied AS (SELECT *, {shortened('t_', 10)} AS title FROM cl3)"""


def keywords(src: str, keys: str, limit: int) -> str:
    banned = arr(sorted({*P.bank("stopwords"), *P.bank("filler")}))
    return f"""
    kw0 AS (SELECT {keys}, unnest(list_filter(regexp_extract_all(lower(text), '[a-z'']+'), lambda w: length(w) >= 4 AND NOT list_contains({banned}, w))) AS word FROM {src}),
    kw1 AS (SELECT {keys}, word, count(*) AS n FROM kw0 GROUP BY ALL),
    kw AS (SELECT *, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, word) AS INT) AS place FROM kw1 QUALIFY place <= {limit})"""


def tags(src: str, keys: str) -> str:
    join = " AND ".join(f"t.{k.strip()} = d.{k.strip()}" for k in keys.split(","))
    return keywords(src, keys, 8) + rf""",
    tg AS (SELECT {keys}, list('#' || regexp_replace(word, '[^a-z0-9]', '', 'g') ORDER BY place) AS l FROM kw GROUP BY {keys}),
    tagged AS (SELECT d.*, list_filter(coalesce(t.l, []), lambda x: length(x) > 3) AS l FROM {src} d LEFT JOIN tg t ON {join}),
    hashed AS (SELECT * EXCLUDE (l), array_to_string(list_concat(['#podcast', '#shorts', '#fyp'], list_filter(l, lambda x, i: list_position(l, x) = i AND NOT list_contains(['#podcast', '#shorts', '#fyp'], x)))[:8], ' ') AS hashtags FROM tagged)"""


NAMES = rf"""array_to_string(list_sort(list_distinct(list_transform(list_filter(flatten(list_transform(regexp_split_to_array({TRIM.format('text')}, '[.!?]\s*'), lambda s: regexp_extract_all(s, '[A-Za-z][A-Za-z'']*')[2:])),
  lambda w: regexp_matches(w[1], '[A-Z]') AND length(w) >= 4 AND NOT list_contains({arr(P.bank('not_names'))}, lower(w))), lambda w: lower(w)))), ' ')"""
BARE = "bare AS (SELECT episode_id, seg, start, \"end\", CASE WHEN episode_id % 3 = 0 THEN text ELSE regexp_replace(text, '[.!?,]+$', '') END AS text FROM segments)"
CLIPS = 'clips AS (SELECT episode_id, CAST(floor(seg / 8) + 1 AS INT) AS clip, min(start) AS start, max("end") AS "end" FROM segments GROUP BY episode_id, floor(seg / 8))'
WORDS = r"""wd0 AS (SELECT episode_id, seg, start AS s0, unnest(regexp_split_to_array(text, '\s+')) AS text, generate_subscripts(regexp_split_to_array(text, '\s+'), 1) - 1 AS k FROM segments),
    wd1 AS (SELECT episode_id, CAST(row_number() OVER (PARTITION BY episode_id ORDER BY seg, k) - 1 AS INT) AS pos, s0 + k * 0.25::DOUBLE AS start, s0 + (k + 1) * 0.25::DOUBLE AS "end", text, 1::DOUBLE - ((length(text) + k) % 8) / 8::DOUBLE AS confidence FROM wd0),
    words AS (SELECT episode_id, pos, start, "end", CASE pos % 17 WHEN 3 THEN '19' WHEN 4 THEN '.000' WHEN 9 THEN '%' ELSE text END AS text, confidence FROM wd1)"""
GAPS = """ins AS (SELECT c.episode_id, c.clip, c.start AS s, c."end" AS e, w.pos, w.start, w."end" FROM clips c JOIN words w ON w.episode_id = c.episode_id AND w."end" > c.start AND w.start < c."end"),
    gaps AS (SELECT a.episode_id, a.clip, a.pos, greatest(a."end", a.s) AS gap_start, least(b.start, a.e) AS gap_end FROM ins a JOIN ins b ON b.episode_id = a.episode_id AND b.clip = a.clip AND b.pos = a.pos + 1 WHERE least(b.start, a.e) - greatest(a."end", a.s) > 0)"""
# the budget is spent one gap after another here, by recursion
CUTS = """lg AS (SELECT g.episode_id, g.clip, g.gap_start, g.gap_end - g.gap_start AS len, (c."end" - c.start) * 0.12::DOUBLE AS budget, row_number() OVER (PARTITION BY g.episode_id, g.clip ORDER BY g.gap_end - g.gap_start DESC, g.gap_start) AS r
      FROM gaps g JOIN clips c ON c.episode_id = g.episode_id AND c.clip = g.clip WHERE g.gap_end - g.gap_start >= 1.5),
    spend AS (
      SELECT episode_id, clip, r, gap_start, CASE WHEN budget < 0.1 THEN 0 ELSE least(len - 0.4::DOUBLE, budget) END AS cut, budget - CASE WHEN budget < 0.1 THEN 0 ELSE least(len - 0.4::DOUBLE, budget) END AS rest FROM lg WHERE r = 1
      UNION ALL SELECT l.episode_id, l.clip, l.r, l.gap_start, CASE WHEN s.rest < 0.1 THEN 0 ELSE least(l.len - 0.4::DOUBLE, s.rest) END, s.rest - CASE WHEN s.rest < 0.1 THEN 0 ELSE least(l.len - 0.4::DOUBLE, s.rest) END
      FROM spend s JOIN lg l ON l.episode_id = s.episode_id AND l.clip = s.clip AND l.r = s.r + 1),
    cuts AS (SELECT episode_id, clip, gap_start + 0.2::DOUBLE AS cut_from, gap_start + 0.2::DOUBLE + cut AS cut_to FROM spend WHERE cut > 0)"""
SPANS = """pts AS (SELECT episode_id, clip, cut_to AS a FROM cuts UNION ALL SELECT episode_id, clip, start FROM clips),
    spans AS (SELECT p.episode_id, p.clip, p.a, coalesce((SELECT min(x.cut_from) FROM cuts x WHERE x.episode_id = p.episode_id AND x.clip = p.clip AND x.cut_from >= p.a), c."end") AS b FROM pts p JOIN clips c ON c.episode_id = p.episode_id AND c.clip = p.clip),
    kept AS (SELECT *, CAST(row_number() OVER (PARTITION BY episode_id, clip ORDER BY a) - 1 AS INT) AS k FROM spans WHERE b > a)"""
TOKENS = r"""mt0 AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t0 FROM words),
    mt1 AS (SELECT *, lag(t0) OVER (PARTITION BY episode_id ORDER BY pos) AS before FROM mt0),
    mt2 AS (SELECT *, before IS NOT NULL AND t0 <> '' AND ((regexp_matches(t0, '^[.,:%\-/][0-9]') AND regexp_matches(before, '[0-9]$')) OR NOT regexp_matches(t0, '[\p{L}\p{N}]')) AS glued FROM mt1),
    mt3 AS (SELECT *, sum((NOT glued)::INT) OVER (PARTITION BY episode_id ORDER BY pos) AS run FROM mt2),
    merged AS (SELECT episode_id, min(pos) AS pos, min(start) AS start, arg_max("end", pos) AS "end", string_agg(t0, '' ORDER BY pos) AS text FROM mt3 GROUP BY episode_id, run)"""
CHUNKS = """ch0 AS (SELECT *, CASE WHEN start - lag("end") OVER (PARTITION BY episode_id ORDER BY pos) > 0.7 THEN 1 ELSE 0 END AS cut FROM {src}),
    ch1 AS (SELECT *, sum(cut) OVER (PARTITION BY episode_id ORDER BY pos) AS island FROM ch0),
    ch2 AS (SELECT *, CAST((row_number() OVER (PARTITION BY episode_id, island ORDER BY pos) - 1) % {n} AS INT) AS nth FROM ch1),
    chunked AS (SELECT *, CAST(sum((nth = 0)::INT) OVER (PARTITION BY episode_id ORDER BY pos) - 1 AS INT) AS chunk FROM ch2)"""


def spoken() -> str:
    weak = arr(sorted({*P.bank("stopwords"), *P.bank("filler"), *P.bank("weak_words")}))
    loaded = sorted({w for b in ("stakes_markers", "curiosity_markers", "contrarian_markers", "intensity_markers") for w in P.bank(b)})
    one, many = arr([w for w in loaded if " " not in w]), arr([w for w in loaded if " " in w])
    return CHUNKS.format(src="merged", n=3) + rf""",
    ln AS (SELECT episode_id, chunk, max("end") AS chunk_end, max(nth) AS last, string_agg(text, ' ' ORDER BY pos) AS line FROM chunked GROUP BY ALL),
    lp AS (SELECT *, list_transform(list_filter(regexp_split_to_array({TRIM.format('line')}, '\s+'), lambda w: regexp_matches(w, '[\p{{L}}\p{{N}}]')), lambda w: lower(regexp_replace(w, '^[.,!?:;"''\-]+|[.,!?:;"''\-]+$', '', 'g'))) AS p FROM ln),
    lu AS (SELECT *, len(list_filter(p, lambda w: regexp_matches(w, '[0-9]'))) > 0 AND (contains(line, '%') OR list_has_any(p, {arr(P.bank('quantity_words'))})) AS united FROM lp),
    lv AS (SELECT *, CASE WHEN len(p) = 0 THEN 0 ELSE (len(list_filter(p, lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN united ELSE NOT list_contains({weak}, w) AND length(w) >= 4 END)) / len(p)::DOUBLE
        * CASE WHEN len(p) < 2 THEN 0.5 ELSE 1 END::DOUBLE * CASE WHEN len(list_distinct(p)) < len(p) THEN 0.5 ELSE 1 END::DOUBLE
        + CASE WHEN united OR list_has_any(p, {one}) OR len(list_filter({many}, lambda m: contains(lower(line), m))) > 0 THEN 0.35 ELSE 0 END::DOUBLE) * CASE WHEN length({TRIM.format('line')}) > 44 THEN 0.5 ELSE 1 END::DOUBLE END AS value FROM lu),
    spoken AS (SELECT c.episode_id, c.pos, c.chunk, c.start, CASE WHEN c.nth = l.last THEN l.chunk_end ELSE c."end" END AS "end", l.line, l.value FROM chunked c JOIN lv l ON l.episode_id = c.episode_id AND l.chunk = c.chunk)"""


ASS = "format('{{}}:{{:02d}}:{{:05.2f}}', CAST(floor({0} / 3600) AS INT), CAST(floor(({0} % 3600) / 60) AS INT), {0} % 60)"
BASE = (segments(), CLIPS, WORDS)

# --- topics ----------------------------------------------------------------------------------------------------------


def topic_words(src: str) -> str:
    stop = arr(P.bank("stopwords"))
    lists = f"list_filter(regexp_extract_all(lower(text), '[a-z'']+'), lambda w: length(w) >= 4 AND NOT list_contains({stop}, w))"
    return f"""
    cw AS (SELECT episode_id, seg, start, "end", unnest({lists}) AS word, generate_subscripts({lists}, 1) AS k FROM {src})"""


GAPSIM = """cb AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY episode_id ORDER BY seg, k) - 1) / 12) AS INT) AS b, (row_number() OVER (PARTITION BY episode_id ORDER BY seg, k) - 1) % 12 AS r, count(*) OVER (PARTITION BY episode_id) AS total FROM cw QUALIFY total >= 132),
    bl AS (SELECT DISTINCT episode_id, b, CAST(ceil(total / 12.0) AS INT) AS n FROM cb),
    gp AS (SELECT episode_id, b AS gap FROM bl WHERE b >= 5 AND b < n - 5),
    bag AS (SELECT g.episode_id, g.gap, c.word, sum((c.b < g.gap)::INT) AS l, sum((c.b >= g.gap)::INT) AS r FROM gp g JOIN cb c ON c.episode_id = g.episode_id AND c.b BETWEEN g.gap - 5 AND g.gap + 4 GROUP BY ALL),
    sims AS (SELECT episode_id, gap, round(sum(l * r) / (sqrt(sum(l * l)::DOUBLE) * sqrt(sum(r * r)::DOUBLE)), 9) AS sim FROM bag GROUP BY ALL),
    gaps_ AS (SELECT s.episode_id, s.gap, c."end" AS t, s.sim FROM sims s JOIN cb c ON c.episode_id = s.episode_id AND c.b = s.gap AND c.r = 0)"""
# peaks by climbing one gap at a time
DEPTHS = """climb_l AS (SELECT episode_id, gap, gap AS at, sim AS peak FROM gaps_ UNION ALL SELECT c.episode_id, c.gap, g.gap, g.sim FROM climb_l c JOIN gaps_ g ON g.episode_id = c.episode_id AND g.gap = c.at - 1 AND g.sim >= c.peak),
    climb_r AS (SELECT episode_id, gap, gap AS at, sim AS peak FROM gaps_ UNION ALL SELECT c.episode_id, c.gap, g.gap, g.sim FROM climb_r c JOIN gaps_ g ON g.episode_id = c.episode_id AND g.gap = c.at + 1 AND g.sim >= c.peak),
    pl AS (SELECT episode_id, gap, max(peak) AS l FROM climb_l GROUP BY ALL), pr AS (SELECT episode_id, gap, max(peak) AS r FROM climb_r GROUP BY ALL),
    depths AS (SELECT g.*, (l - sim) + (r - sim) AS depth FROM gaps_ g JOIN pl USING (episode_id, gap) JOIN pr USING (episode_id, gap))"""
BOUNDS = """th AS (SELECT episode_id, avg(depth) + 0.4 * stddev_pop(depth) AS threshold FROM depths GROUP BY ALL),
    bounds AS (SELECT d.episode_id, d.gap, d.t FROM depths d JOIN th USING (episode_id) WHERE d.depth > threshold AND NOT EXISTS (SELECT 1 FROM depths x WHERE x.episode_id = d.episode_id AND abs(x.gap - d.gap) = 1 AND x.depth > d.depth))"""
LEVELS = """span AS (SELECT episode_id, min(start) AS first, max("end") AS last FROM segments GROUP BY ALL),
    grid AS (SELECT episode_id, CAST(k AS INT) AS point, first + 25 + 5 * k AS t FROM (SELECT *, unnest(range(0, 100000)) AS k FROM span) WHERE first + 25 + 5 * k < last - 20),
    side AS (SELECT p.episode_id, p.point, w.word, sum((w.start >= p.t - 25 AND w."end" <= p.t)::INT) AS l, sum((w.start >= p.t AND w.start < p.t + 20)::INT) AS r FROM grid p JOIN cw w ON w.episode_id = p.episode_id AND w.start >= p.t - 25 AND w.start < p.t + 20 GROUP BY ALL),
    lev AS (SELECT episode_id, point, sum(l * r) AS lr, sum(l * l) AS ll, sum(r * r) AS rr FROM side GROUP BY ALL),
    levels AS (SELECT g.episode_id, g.point, g.t, CASE WHEN ll > 0 AND rr > 0 THEN lr / (sqrt(ll::DOUBLE) * sqrt(rr::DOUBLE)) ELSE 0 END AS level FROM grid g LEFT JOIN lev USING (episode_id, point))"""

# --- export, state, tracks -------------------------------------------------------------------------------------------

PLAT = """plat AS (SELECT * FROM (VALUES ('tiktok', 'TikTok', '9:16', 0.10, 0.20, 0.0, 0.14, 5.0, 600.0), ('reels', 'Instagram Reels', '9:16', 0.09, 0.22, 0.0, 0.13, 5.0, 180.0), ('shorts', 'YouTube Shorts', '9:16', 0.08, 0.17, 0.0, 0.13, 5.0, 180.0),
    ('feed', 'Instagram feed', '4:5', 0.0, 0.06, 0.0, 0.0, 5.0, 90.0), ('square', 'Square post', '1:1', 0.0, 0.06, 0.0, 0.0, 5.0, NULL), ('youtube', 'YouTube landscape', '16:9', 0.0, 0.10, 0.0, 0.0, 5.0, NULL)) v(key, name, ratio, top_ui, bottom_ui, left_ui, right_ui, lo, hi))"""
PLAN = "plans AS (SELECT c.episode_id, c.clip, p.key AS platform, 'clip_' || lpad(c.clip::VARCHAR, 2, '0') || '_' || p.key || '.mp4' AS filename, p.ratio, '1080p' AS resolution, 'punch@' || p.key AS style FROM clips c, plat p WHERE c.\"end\" - c.start >= p.lo AND (p.hi IS NULL OR c.\"end\" - c.start <= p.hi))"
SLOTS = 'slots AS (SELECT episode_id, 20 - clip AS index, start + CASE WHEN episode_id % 3 = 0 AND clip = 1 THEN 0.25 ELSE 0 END::DOUBLE AS start, "end" FROM clips WHERE clip % 2 = 1)'
FRAMES = """frames AS (SELECT user_id AS episode_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS k, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * 0.25::DOUBLE AS t,
      floor((value - floor(value)) * 1024) / 1024::DOUBLE AS center_x, event_type NOT IN ('error', 'view') AS confident, CASE WHEN event_type = 'click' THEN -1 ELSE floor(value * 4) % 16 / 4::DOUBLE END::DOUBLE AS motion, event_type = 'signup' AS opens_shot FROM events)"""
TCLIPS = "tclips AS (SELECT episode_id, CAST(c + 1 AS INT) AS clip, c * 4::DOUBLE + 0.125::DOUBLE AS start, c * 4::DOUBLE + 3.625::DOUBLE AS \"end\" FROM (SELECT episode_id, unnest(range(0, CAST(floor(max(t) / 4) AS INT) + 1)) AS c FROM frames GROUP BY episode_id))"
CENTER = """cen AS (SELECT p.episode_id, p.t, (SELECT max(f.t) FROM frames f WHERE f.episode_id = p.episode_id AND f.t <= p.t) AS ta, (SELECT min(f.t) FROM frames f WHERE f.episode_id = p.episode_id AND f.t >= p.t) AS tb FROM pts_ p),
    centers AS (SELECT c.episode_id, c.t, CASE WHEN a.t IS NULL THEN b.center_x WHEN b.t IS NULL OR b.t <= a.t THEN a.center_x ELSE a.center_x + (b.center_x - a.center_x) * ((c.t - a.t) / (b.t - a.t)) END AS center
      FROM cen c LEFT JOIN frames a ON a.episode_id = c.episode_id AND a.t = c.ta LEFT JOIN frames b ON b.episode_id = c.episode_id AND b.t = c.tb)"""
SHOTS = """sh0 AS (SELECT *, max(t) OVER (PARTITION BY episode_id) + 0.25::DOUBLE AS last, sum((opens_shot AND k > 0)::INT) OVER (PARTITION BY episode_id ORDER BY k) AS raw FROM frames),
    sh1 AS (SELECT episode_id, raw, min(t) AS a, max(last) AS last FROM sh0 GROUP BY ALL),
    sh2 AS (SELECT *, coalesce(lead(a) OVER (PARTITION BY episode_id ORDER BY raw), last) AS b FROM sh1),
    sh3 AS (SELECT *, sum(CASE WHEN b - a < 0.5 AND raw > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY episode_id ORDER BY raw) AS run FROM sh2),
    shots AS (SELECT episode_id, CAST(run - 1 AS INT) AS shot, min(a) AS start, max(b) AS "end" FROM sh3 GROUP BY episode_id, run)"""
STATIC = """held AS (SELECT f.*, s.shot FROM frames f JOIN shots s ON s.episode_id = f.episode_id AND f.t >= s.start AND f.t < s."end"),
    kinds AS (SELECT s.episode_id, s.shot, s.start, s."end", NOT bool_or(h.confident) AND count(*) FILTER (WHERE h.motion >= 0) >= 3 AND median(h.motion) FILTER (WHERE h.motion >= 0) < 1.2 AS st, coalesce(median(h.center_x) FILTER (WHERE h.confident), median(h.center_x)) AS center FROM shots s JOIN held h ON h.episode_id = s.episode_id AND h.shot = s.shot GROUP BY ALL)"""
ENERGY = """en AS (SELECT episode_id, k, t, seat, (center_x * 7 + seat * 0.25::DOUBLE + greatest(motion, 0) * (seat + 1)) % 4 + 0.125::DOUBLE AS energy FROM (SELECT *, unnest([0, 1, 2]) AS seat FROM frames)),
    mx AS (SELECT episode_id, max(k) AS m FROM frames GROUP BY ALL),
    sm AS (SELECT e.episode_id, e.k, e.t, e.seat, round(avg(x.energy), 9) AS e FROM (SELECT e.*, m, unnest(range(-3, 4)) AS o FROM en e JOIN mx USING (episode_id)) e JOIN en x ON x.episode_id = e.episode_id AND x.seat = e.seat AND x.k = greatest(0, least(e.m, e.k + e.o)) GROUP BY ALL),
    sc AS (SELECT episode_id, seat, median(e) AS med, quantile_cont(e, 0.35) AS floor_ FROM sm GROUP BY ALL),
    nm AS (SELECT s.episode_id, k, t, seat, round(e / med, 9) AS v, round(floor_ / med, 9) AS f FROM sm s JOIN sc USING (episode_id, seat)),
    tp AS (SELECT episode_id, k, t, arg_max(struct_pack(seat := seat, v := v, f := f), (v, -seat)) AS top, coalesce(list(v ORDER BY v DESC)[2], 0) AS nxt FROM nm GROUP BY ALL),
    sy AS (SELECT episode_id, k, t, CASE WHEN top.v < round(top.f * 1.05::DOUBLE, 9) THEN -1 WHEN nxt <= 0 OR top.v > round(nxt * 1.25::DOUBLE, 9) THEN top.seat END AS says FROM tp),
    series AS (SELECT episode_id, k, t, nullif(last_value(says IGNORE NULLS) OVER (PARTITION BY episode_id ORDER BY k), -1) AS seat FROM sy)"""
TURNS = 'turns_ AS (SELECT episode_id, seg AS turn, speaker, start, "end" - CASE WHEN seg % 5 = 0 THEN 1 ELSE 0 END::DOUBLE AS "end" FROM segments)'

ORACLES |= {
    "marker_hits": _with("docs AS (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents)") + " SELECT doc_id, " + ", ".join(f"{hits('low', b)} AS {b}" for b in ("curiosity_markers", "contrarian_markers", "intensity_markers", "stakes_markers", "past_markers")) + f", regexp_matches(low, '{phrase(P.bank('question_openers'))}') AS opener, regexp_matches(low, '{phrase(P.bank('promise_markers'))}') AS promise FROM docs",
    "hook_lines": _with(DOCS, copy_lines("docs")) + " SELECT doc_id, hook, title, description FROM copied",
    "clip_keywords": _with(DOCS, keywords("docs", "doc_id", 6)) + " SELECT * FROM kw",
    "clip_hashtags": _with(DOCS, tags("docs", "doc_id")) + " SELECT doc_id, hashtags FROM hashed",
    "names_in_line": _with(segments()) + f" SELECT episode_id, seg, {NAMES} AS names FROM segments",
    "punctuation_share": _with(segments(), BARE) + " SELECT episode_id, avg(regexp_matches(text, '[.!?…,]$')::INT) AS share, avg(regexp_matches(text, '[.!?…,]$')::INT) < 0.2 AS needs FROM bare GROUP BY ALL",
    "repunctuated_segments": _with(segments(), BARE) + ", sh AS (SELECT episode_id, avg(regexp_matches(text, '[.!?…,]$')::INT) < 0.2 AS needs FROM bare GROUP BY ALL) SELECT b.episode_id, b.seg, CASE WHEN needs AND b.text <> '' AND NOT regexp_matches(b.text, '[.!?…,]$') AND (n.seg IS NULL OR n.start - b.\"end\" >= 0.35) THEN b.text || '.' ELSE b.text END AS text FROM bare b JOIN sh USING (episode_id) LEFT JOIN bare n ON n.episode_id = b.episode_id AND n.seg = b.seg + 1",
    "caption_packs": _with(segments(), CLIPS, "src AS (SELECT c.episode_id, c.clip, c.start, c.\"end\", string_agg(f.text, ' ' ORDER BY f.seg) AS text FROM clips c JOIN segments f ON f.episode_id = c.episode_id AND f.start >= c.start AND f.\"end\" <= c.\"end\" GROUP BY ALL)", copy_lines("src"), tags("src", "episode_id, clip"))
    + """ SELECT c.episode_id, c.clip, hook, title, description, hashtags, round(c.start, 2) AS start, round(c."end", 2) AS "end", 7.5::DOUBLE AS score, 'no strong signals' AS why,
      format('# Clip {:02d}  ({:.1f}s - {:.1f}s, hot 7.5/10)', c.clip, c.start, c."end") || chr(10) || chr(10) || 'HOOK' || chr(10) || hook || chr(10) || chr(10) || 'TITLE' || chr(10) || title || chr(10) || chr(10) || 'DESCRIPTION' || chr(10) || description || chr(10) || chr(10) || 'HASHTAGS' || chr(10) || hashtags
      || chr(10) || chr(10) || 'WHY THIS CLIP' || chr(10) || 'no strong signals' || chr(10) || chr(10) || '---' || chr(10) || 'Drafts, not finished copy. Read them before posting.' || chr(10) AS body FROM copied c JOIN hashed h ON h.episode_id = c.episode_id AND h.clip = c.clip""",
    "word_gaps": _with(*BASE, GAPS) + " SELECT * FROM gaps",
    "deadair_cuts": _with(*BASE, GAPS, CUTS) + " SELECT episode_id, clip, round(cut_from, 6) AS cut_from, round(cut_to, 6) AS cut_to FROM cuts",
    "deadair_timeline": _with(*BASE, GAPS, CUTS, SPANS) + " SELECT c.episode_id, c.clip, CAST(count(*) AS INT) AS n_spans, round(sum(b - a), 6) AS duration, CAST(count(*) - 1 AS INT) AS cuts, round(greatest(0, c.\"end\" - c.start - sum(b - a)), 6) AS removed FROM clips c JOIN kept k ON k.episode_id = c.episode_id AND k.clip = c.clip GROUP BY c.episode_id, c.clip, c.start, c.\"end\"",
    "deadair_tails": _with(segments(), "clips0 AS" + CLIPS.removeprefix("clips AS"), 'clips AS (SELECT episode_id, clip, start - 3 AS start, "end" + 40.03125::DOUBLE AS "end" FROM clips0 UNION ALL SELECT episode_id, max(clip) + 1000, max("end") - 0.25::DOUBLE, max("end") + 60 FROM clips0 GROUP BY episode_id)', WORDS, GAPS, CUTS, SPANS)
    + " SELECT c.episode_id, c.clip, CAST(count(*) AS INT) AS n_spans, round(sum(b - a), 6) AS duration, CAST(count(*) - 1 AS INT) AS cuts, round(greatest(0, c.\"end\" - c.start - sum(b - a)), 6) AS removed FROM clips c JOIN kept k ON k.episode_id = c.episode_id AND k.clip = c.clip GROUP BY c.episode_id, c.clip, c.start, c.\"end\"",
    "remapped_words": _with(*BASE, GAPS, CUTS, SPANS) + """, mapped AS (SELECT i.episode_id, i.clip, i.pos, w.text, sum(greatest(0, least(i.start - a, b - a))) AS start, sum(greatest(0, least(i."end" - a, b - a))) AS "end", row_number() OVER (PARTITION BY i.episode_id, i.clip ORDER BY i.pos) AS r
      FROM ins i JOIN kept k ON k.episode_id = i.episode_id AND k.clip = i.clip JOIN words w ON w.episode_id = i.episode_id AND w.pos = i.pos GROUP BY i.episode_id, i.clip, i.pos, w.text)
      SELECT episode_id, clip, pos, text, round(start, 6) AS start, round("end", 6) AS "end" FROM mapped WHERE "end" > start OR r = 1""",
    "preview_slices": _with(*BASE, GAPS, CUTS, SPANS) + """, el AS (SELECT *, b - a AS len, coalesce(sum(b - a) OVER (PARTITION BY episode_id, clip ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM kept)
      SELECT episode_id, clip, k, round(a + greatest(0, 2.0 - first), 6) AS from_, round(a + least(len, 7.0 - first), 6) AS to_ FROM el WHERE first + len > 2.0 AND first < 7.0 AND a + least(len, 7.0 - first) > a + greatest(0, 2.0 - first)""",
    "merged_tokens": _with(segments(), WORDS, TOKENS) + " SELECT * FROM merged",
    "caption_chunks": _with(segments(), WORDS, TOKENS, CHUNKS.format(src="merged", n=3)) + " SELECT episode_id, pos, chunk, nth FROM chunked",
    "spoken_windows": _with(segments(), WORDS, TOKENS, spoken()) + ' SELECT episode_id, pos, chunk, start, "end", line, round(value, 9) AS value FROM spoken',
    "subtitle_events": _with(segments(), WORDS, TOKENS, CHUNKS.format(src="merged", n=2)) + rf""" SELECT c.episode_id, c.pos, 'Dialogue: 0,' || {ASS.format('c.start').replace('{{', '{').replace('}}', '}')} || ',' || {ASS.format('c."end"').replace('{{', '{').replace('}}', '}')} || ',Cap,,0,0,0,,' ||
      string_agg(CASE WHEN x.pos = c.pos THEN '{{\c&H006AFF39}}' || upper(replace(x.text, 'ß', 'SS')) || '{{\c&H00FFFFFF}}' ELSE upper(replace(x.text, 'ß', 'SS')) END, ' ' ORDER BY x.pos) AS line FROM chunked c JOIN chunked x ON x.episode_id = c.episode_id AND x.chunk = c.chunk GROUP BY c.episode_id, c.pos, c.start, c."end" """,
    "uncertain_words": _with(segments(), WORDS) + " SELECT episode_id, pos, text, confidence FROM words WHERE confidence < 0.6",
    "topic_gaps": _with(segments("documents"), topic_words("segments"), GAPSIM) + " SELECT * FROM gaps_",
    "topic_depths": _with(segments("documents"), topic_words("segments"), GAPSIM, DEPTHS) + " SELECT episode_id, gap, t, round(depth, 6) AS depth FROM depths",
    "topic_boundaries": _with(segments("documents"), topic_words("segments"), GAPSIM, DEPTHS, BOUNDS) + " SELECT * FROM bounds",
    "topic_levels": _with(segments(), topic_words("segments"), LEVELS) + " SELECT episode_id, point, t, round(level, 9) AS level FROM levels",
    "topic_thresholds": _with(segments(), topic_words("segments"), LEVELS) + " SELECT episode_id, round(quantile_cont(level, 0.65), 6) AS high, round(quantile_cont(level, 0.25), 6) AS low FROM levels GROUP BY ALL",
    "opening_shift": _with(segments(), features(), CLIPS) + f""", fs AS (SELECT *, string_split({NAMES}, ' ') AS names FROM feats), fst AS (SELECT c.*, (SELECT arg_min(f.stands, f.seg) FROM fs f WHERE f.episode_id = c.episode_id AND f.start >= c.start AND f."end" <= c."end") AS ok FROM clips c),
      mv AS (SELECT c.*, (SELECT min(f.start) FROM fs f WHERE f.episode_id = c.episode_id AND f.start > c.start AND f.start <= least(c.start + 25, c."end" - 20) AND f.stands) AS ns FROM fst c WHERE NOT ok),
      tok AS (SELECT m.episode_id, m.clip, f.start < m.ns AS before, unnest(f.names) AS w, true AS name FROM mv m JOIN fs f ON f.episode_id = m.episode_id AND f.start >= m.start AND f."end" <= m."end" UNION ALL SELECT m.episode_id, m.clip, f.start < m.ns, unnest(f.tok), false FROM mv m JOIN fs f ON f.episode_id = m.episode_id AND f.start >= m.start AND f."end" <= m."end")
      SELECT episode_id, clip, ns AS start, "end", ns - start AS removed FROM mv m WHERE ns IS NOT NULL AND NOT EXISTS (SELECT 1 FROM tok a WHERE a.episode_id = m.episode_id AND a.clip = m.clip AND a.before AND a.name AND a.w <> '' AND NOT EXISTS (SELECT 1 FROM tok b WHERE b.episode_id = m.episode_id AND b.clip = m.clip AND NOT b.before AND b.w = a.w))""",
    "platform_margins": _with(PLAT) + " SELECT key, round(least(0.45, bottom_ui + 0.03), 6)::DOUBLE AS bottom_margin, round(least(0.3, greatest(left_ui, right_ui) + 0.03), 6)::DOUBLE AS side_margin, round(least(0.35, top_ui + 0.03), 6)::DOUBLE AS title_top_margin FROM plat",
    "export_plan": _with(segments(), CLIPS, PLAT, PLAN) + " SELECT * FROM plans",
    "export_rejected": _with(segments(), CLIPS, PLAT) + """ SELECT c.episode_id, c.clip, format('{:.0f}', c."end" - c.start) || 's fits none of: Instagram Reels 5-180.0s, Instagram feed 5-90.0s' AS reason FROM clips c WHERE NOT EXISTS (SELECT 1 FROM plat p WHERE p.key IN ('feed', 'reels') AND c."end" - c.start >= p.lo AND c."end" - c.start <= p.hi)""",
    "session_restore": _with(segments(), CLIPS, SLOTS) + """, fd AS (SELECT s.episode_id, s.index, c.clip, c.start, c."end" FROM slots s LEFT JOIN clips c ON c.episode_id = s.episode_id AND round(c.start, 2) = round(s.start, 2) AND round(c."end", 2) = round(s."end", 2))
      SELECT episode_id, index, clip AS i, clip AS j, start, "end" FROM fd WHERE episode_id NOT IN (SELECT episode_id FROM fd WHERE clip IS NULL)""",
    "clip_numbers": _with(segments(), CLIPS, SLOTS) + """, hd AS (SELECT c.episode_id, c.start, c."end", s.index AS held FROM clips c LEFT JOIN slots s ON s.episode_id = c.episode_id AND s.start = c.start AND s."end" = c."end"),
      nn AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY start) AS r FROM hd WHERE held IS NULL),
      fr AS (SELECT episode_id, x, row_number() OVER (PARTITION BY episode_id ORDER BY x) AS r FROM (SELECT DISTINCT episode_id, unnest(range(1, 200)) AS x FROM hd) f WHERE NOT EXISTS (SELECT 1 FROM hd h WHERE h.episode_id = f.episode_id AND h.held = f.x))
      SELECT h.episode_id, h.start, h."end", CAST(coalesce(h.held, fr.x) AS INT) AS clip FROM hd h LEFT JOIN nn ON nn.episode_id = h.episode_id AND nn.start = h.start LEFT JOIN fr ON fr.episode_id = nn.episode_id AND fr.r = nn.r""",
    "stale_files": _with(segments(), CLIPS, PLAT, PLAN) + " SELECT episode_id, clip, platform, filename FROM plans WHERE platform IN ('reels', 'square') AND NOT (clip % 3 <> 0 AND NOT (clip % 3 = 1 AND platform = 'square'))",
    "crop_center_at": _with(FRAMES, "pts_ AS (SELECT DISTINCT episode_id, t + 0.0625::DOUBLE * (k % 4) - 0.125::DOUBLE AS t FROM frames)", CENTER) + " SELECT episode_id, t, round(center, 9) AS center FROM centers",
    "sendcmd_lines": _with(FRAMES, TCLIPS, 'gr AS (SELECT episode_id, clip, start, CAST(k AS INT) AS k, start + k / 4.0::DOUBLE AS t FROM (SELECT *, unnest(range(0, CAST(ceil(("end" - start) * 4) AS INT))) AS k FROM tclips))', "pts_ AS (SELECT DISTINCT episode_id, t FROM gr)", CENTER)
    + " SELECT g.episode_id, g.clip, g.k, format('{:.3f} crop x {};', g.t - g.start, CAST(least(greatest(round_even(c.center * 1920 - 304, 0), 0), 1312) AS INT)) AS line FROM gr g JOIN centers c ON c.episode_id = g.episode_id AND c.t = g.t",
    "frames_at": _with(FRAMES) + ", wt AS (SELECT episode_id, t - 0.1875::DOUBLE AS want FROM frames WHERE k % 3 = 0) SELECT w.episode_id, w.want, min(f.k) AS k, min(f.t) AS t FROM wt w JOIN frames f ON f.episode_id = w.episode_id AND f.t >= w.want - 1e-9 GROUP BY ALL",
    "folded_shots": _with(FRAMES, SHOTS) + " SELECT * FROM shots",
    "shots_from_histograms": """WITH h AS (SELECT label AS episode_id, vec_id AS k, embedding::DOUBLE[] AS h FROM embeddings), p AS (SELECT *, lag(h) OVER (PARTITION BY episode_id ORDER BY k) AS p FROM h),
      x AS (SELECT episode_id, k, unnest(h) AS a, unnest(p) AS b FROM p WHERE p IS NOT NULL), c AS (SELECT episode_id, k, round(1 - corr(a, b), 4) AS distance, 1 - corr(a, b) > 0.45 AS o FROM x GROUP BY ALL)
      SELECT p.episode_id, p.k, p.k * 0.25::DOUBLE AS t, c.distance, coalesce(c.o, false) AS opens_shot FROM p LEFT JOIN c USING (episode_id, k)""",
    "static_shots": _with(FRAMES, SHOTS, STATIC) + ' SELECT episode_id, shot, start, "end", st AS is_static, center FROM kinds',
    "flattened_path": _with(FRAMES, SHOTS, STATIC) + " SELECT h.episode_id, h.k, h.t, h.shot, CASE WHEN k.st THEN 0.5 ELSE k.center END::DOUBLE AS center_x, h.confident FROM held h JOIN kinds k ON k.episode_id = h.episode_id AND k.shot = h.shot",
    "framing_mode": _with(FRAMES, SHOTS) + ", r AS (SELECT episode_id, avg(confident::INT) AS d FROM frames GROUP BY ALL), m AS (SELECT episode_id, median(\"end\" - start) AS med FROM shots GROUP BY ALL) SELECT episode_id, round(d, 9) AS detection_rate, med AS median_shot, CASE WHEN d < 0.4 THEN 'blur' WHEN med < 8 THEN 'per_shot' ELSE 'face' END AS mode FROM r JOIN m USING (episode_id)",
    "path_jerkiness": _with(FRAMES) + " SELECT a.episode_id, round(avg(abs(a.center_x - 2 * b.center_x + c.center_x)), 9) AS jerkiness FROM frames a JOIN frames b ON b.episode_id = a.episode_id AND b.k = a.k - 1 JOIN frames c ON c.episode_id = a.episode_id AND c.k = a.k - 2 GROUP BY ALL",
    "frame_stillness": _with(FRAMES) + " SELECT a.episode_id, a.k, round(-(coalesce(avg(b.motion) FILTER (WHERE b.motion >= 0), 0) + (max(b.center_x) - min(b.center_x)) * 4), 9) AS stillness FROM frames a JOIN frames b ON b.episode_id = a.episode_id AND abs(a.k - b.k) <= 2 GROUP BY a.episode_id, a.k",
    "active_speaker": _with(FRAMES, ENERGY) + " SELECT episode_id, k, t, CAST(coalesce(seat, -1) AS INT) AS seat FROM series",
    "dominant_seat": _with(FRAMES, ENERGY, TCLIPS) + ", n AS (SELECT c.episode_id, c.clip, s.seat, count(*) AS n, min(s.t) AS f FROM tclips c JOIN series s ON s.episode_id = c.episode_id AND s.seat IS NOT NULL AND s.t >= c.start AND s.t < c.\"end\" GROUP BY ALL), w AS (SELECT DISTINCT ON (episode_id, clip) episode_id, clip, seat FROM n ORDER BY episode_id, clip, n DESC, f) SELECT c.episode_id, c.clip, CAST(coalesce(w.seat, -1) AS INT) AS seat FROM tclips c LEFT JOIN w ON w.episode_id = c.episode_id AND w.clip = c.clip",
    "speaker_of_word": _with(segments(), WORDS, TURNS) + ' SELECT w.episode_id, w.pos, arg_min(t.speaker, t.turn) AS speaker FROM words w LEFT JOIN turns_ t ON t.episode_id = w.episode_id AND (w.start + w."end") / 2 >= t.start AND (w.start + w."end") / 2 < t."end" GROUP BY w.episode_id, w.pos',
    "speaker_summary": _with(segments(), TURNS) + ', ch AS (SELECT a.episode_id, count(*) FILTER (WHERE a.speaker <> b.speaker) AS changes FROM turns_ a LEFT JOIN turns_ b ON b.episode_id = a.episode_id AND b.turn = a.turn - 1 GROUP BY ALL) SELECT t.episode_id, t.speaker, sum(t."end" - t.start) AS seconds, ch.changes FROM turns_ t JOIN ch USING (episode_id) GROUP BY ALL',
    "ranked_detections": """WITH d AS (SELECT l_orderkey % 16 AS episode_id, l_orderkey AS k, CAST(l_partkey % 400 AS INT) AS x, CAST(l_suppkey % 300 AS INT) AS y, CAST(l_quantity * 8 AS INT) AS w, CAST(l_quantity * 6 AS INT) AS h, l_linenumber / 8::DOUBLE AS skin, l_linenumber % 3 + 1 AS votes FROM lineitem),
      ok AS (SELECT *, (w * h) * (0.5::DOUBLE + skin) * (1 + 0.25::DOUBLE * (votes - 1)) AS score FROM d WHERE w / 640::DOUBLE BETWEEN 0.02 AND 0.6 AND (y + h / 2::DOUBLE) / 360 <= 0.72 AND skin >= 0.25)
      SELECT episode_id, k, x, y, w, h, score, CAST(row_number() OVER (PARTITION BY episode_id, k ORDER BY score DESC, x, y, w, h) AS INT) AS place FROM ok""",
    "loudness_gain": """SELECT id, integrated, true_peak, "range", gain, filters, is_quiet, is_dynamic FROM (VALUES (1, -23.4::DOUBLE, -3.1::DOUBLE, 15.2::DOUBLE, 9.4::DOUBLE, 'volume=9.40dB,alimiter=limit=0.8913:attack=5:release=50:level=disabled', true, true), (2, NULL, NULL, NULL, 0::DOUBLE, NULL, NULL, NULL), (3, NULL, NULL, NULL, 0::DOUBLE, NULL, NULL, NULL),
      (4, -14.2::DOUBLE, -0.2::DOUBLE, 3.0::DOUBLE, -14::DOUBLE - -14.2::DOUBLE, 'alimiter=limit=0.8913:attack=5:release=50:level=disabled', false, false), (5, -40.0::DOUBLE, -10.0::DOUBLE, 3.0::DOUBLE, 12::DOUBLE, 'volume=12.00dB,alimiter=limit=0.8913:attack=5:release=50:level=disabled', true, false)) v(id, integrated, true_peak, "range", gain, filters, is_quiet, is_dynamic)""",
}

# --- greedy steps, one row after another by recursion ----------------------------------------------------------------

SCORED = (segments(), features(), windows(), scores(), CALIBRATED)
POOL = """ord AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY raw_score DESC, i, j) AS r FROM cal),
    fold AS (SELECT episode_id, r, [{'s': start, 'e': "end", 'r': r}] AS kept FROM ord WHERE r = 1
      UNION ALL SELECT f.episode_id, o.r, CASE WHEN len(f.kept) >= 400 OR len(list_filter(f.kept, lambda k: abs(k.s - o.start) < 3 AND abs(k.e - o."end") < 3)) > 0 THEN f.kept ELSE list_append(f.kept, {'s': o.start, 'e': o."end", 'r': o.r}) END
      FROM fold f JOIN ord o ON o.episode_id = f.episode_id AND o.r = f.r + 1),
    lastf AS (SELECT episode_id, arg_max(kept, r) AS kept FROM fold GROUP BY episode_id),
    pl AS (SELECT episode_id, unnest(kept).r AS r, generate_subscripts(kept, 1) AS place FROM lastf),
    pool AS MATERIALIZED (SELECT o.episode_id, o.i, o.j, o.start, o."end", CAST(p.place AS INT) AS place, o.raw_score, o.score, o.percentile FROM ord o JOIN pl p ON p.episode_id = o.episode_id AND p.r = o.r)"""


def picks(name: str, src: str, n: int) -> str:
    return f"""{name}_o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY score DESC, raw_score DESC, i, j) AS r FROM {src}),
    {name}_f AS (SELECT episode_id, r, [{{'s': start, 'e': "end", 'i': i, 'j': j}}] AS kept FROM {name}_o WHERE r = 1
      UNION ALL SELECT f.episode_id, o.r, CASE WHEN len(f.kept) >= {n} OR len(list_filter(f.kept, lambda k: o.start < k.e AND k.s < o."end")) > 0 THEN f.kept ELSE list_append(f.kept, {{'s': o.start, 'e': o."end", 'i': o.i, 'j': o.j}}) END
      FROM {name}_f f JOIN {name}_o o ON o.episode_id = f.episode_id AND o.r = f.r + 1),
    {name}_l AS (SELECT episode_id, arg_max(kept, r) AS kept FROM {name}_f GROUP BY episode_id),
    {name}_u AS (SELECT episode_id, unnest(kept) AS c FROM {name}_l),
    {name} AS MATERIALIZED (SELECT episode_id, c.i AS i, c.j AS j, c.s AS start, c.e AS "end", CAST(row_number() OVER (PARTITION BY episode_id ORDER BY c.s) AS INT) AS clip FROM {name}_u)"""


def options(mode: str) -> str:
    return f"""SELECT p.*, greatest(0, least(p."end", o."end") - greatest(p.start, o.start)) / least(p."end" - p.start, o."end" - o.start) AS shared FROM pool p JOIN picked o ON o.episode_id = p.episode_id AND o.clip = 1
      WHERE NOT (p.start = o.start AND p."end" = o."end") AND NOT EXISTS (SELECT 1 FROM picked c WHERE c.episode_id = p.episode_id AND c.clip <> 1 AND p.start < c."end" AND c.start < p."end") AND shared {'<=' if mode == 'different' else '>='} 0.3"""


OVERLAPPED = segments().replace("segments AS", "segments0 AS") + """,
    segments AS (SELECT episode_id, seg, CASE WHEN seg % 5 = 3 THEN lag(start, 1, start) OVER (PARTITION BY episode_id ORDER BY seg) ELSE start END AS start, "end" + CASE WHEN seg % 7 = 2 THEN 30 ELSE 0 END::DOUBLE AS "end", text, speaker FROM segments0)"""
ORACLES["overlapped_windows"] = _with(OVERLAPPED, features(), windows(), scores()) + ' SELECT episode_id, i, j, start, "end", ' + ", ".join(f"round({k}, 6) AS {k}" for k in SIGNALS) + ", round(raw_score, 6) AS raw_score FROM scores"

_BEST = "ORDER BY score DESC, raw_score DESC, i, j"
ORACLES |= {
    "pool_dedupe": _with(*SCORED, POOL) + " SELECT * FROM pool",
    "nms_selection": _with(*SCORED, POOL, picks("picked", "pool", 5)) + " SELECT * FROM picked",
    "reserve_count": _with(*SCORED, POOL, picks("picked", "pool", 5)) + ' SELECT p.episode_id, count(*) AS pool, count(*) - count(c.clip) AS reserve FROM pool p LEFT JOIN (SELECT DISTINCT episode_id, start, "end", 1 AS clip FROM picked) c ON c.episode_id = p.episode_id AND c.start = p.start AND c."end" = p."end" GROUP BY p.episode_id',
    "regenerate_retime": _with(*SCORED, POOL, picks("picked", "pool", 5)) + f' SELECT episode_id, i, j, start, "end", score, round(shared, 6) AS shared, CAST(row_number() OVER (PARTITION BY episode_id {_BEST}) AS INT) AS choice FROM ({options("retime")})',
    "regenerate_different": _with(*SCORED, POOL, picks("picked", "pool", 5)) + f""", opt AS (SELECT *, 0 AS turn FROM ({options("different")}) UNION ALL SELECT *, 1 AS turn FROM ({options("retime")})),
      one AS (SELECT DISTINCT ON (episode_id) episode_id, i, j, start, "end" FROM opt ORDER BY episode_id, turn, score DESC, raw_score DESC, i, j), al AS (SELECT episode_id, i, j, start, "end" FROM picked WHERE clip <> 1 UNION ALL SELECT * FROM one)
      SELECT *, CAST(row_number() OVER (PARTITION BY episode_id ORDER BY start) AS INT) AS clip FROM al""",
    "regenerate_all": _with(*SCORED, POOL, picks("picked", "pool", 5), 'spare AS (SELECT p.* FROM pool p WHERE NOT EXISTS (SELECT 1 FROM picked c WHERE c.episode_id = p.episode_id AND c.start = p.start AND c."end" = p."end"))', picks("fresh", "spare", 5)) + " SELECT * FROM fresh",
    "speaker_agreement": """WITH p AS (SELECT user_id % 8 AS episode_id, event_type AS a, CAST(floor(value * 4) AS INT) % 5 AS b FROM events), c AS (SELECT episode_id, a, b, count(*)::DOUBLE AS n FROM p GROUP BY ALL),
      t AS (SELECT episode_id, sum(n * (n - 1) / 2) AS c, sum(n) AS n FROM c GROUP BY ALL), x AS (SELECT episode_id, sum(n * (n - 1) / 2) AS a, sum(m) AS m FROM (SELECT episode_id, a, sum(n) AS n, max(n) AS m FROM c GROUP BY ALL) GROUP BY episode_id),
      y AS (SELECT episode_id, sum(n * (n - 1) / 2) AS b FROM (SELECT episode_id, b, sum(n) AS n FROM c GROUP BY ALL) GROUP BY episode_id)
      SELECT episode_id, round(m / n, 9) AS share, round((c - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2)), 9) AS ari FROM t JOIN x USING (episode_id) JOIN y USING (episode_id)""",
    "decoder_diagnostics": """WITH h AS (SELECT label AS episode_id, vec_id AS k, embedding::DOUBLE[] AS h FROM embeddings), p AS (SELECT *, lag(h) OVER (PARTITION BY episode_id ORDER BY k) AS p FROM h),
      x AS (SELECT episode_id, k, unnest(h) AS a, unnest(p) AS b FROM p WHERE p IS NOT NULL), c AS (SELECT episode_id, k, 1 - corr(a, b) AS d FROM x GROUP BY ALL)
      SELECT episode_id, count(*) AS frames, count(*) FILTER (WHERE abs(d) < 1e-9) AS repeats, round(median(d), 4) AS median, round(quantile_cont(d, 0.95), 4) AS p95, round(max(d), 4) AS top FROM c GROUP BY ALL""",
}

ORACLES |= more(segments(), CLIPS, WORDS, PLAT, PLAN, SLOTS, FRAMES, SHOTS, STATIC, TCLIPS, TOKENS, spoken(), (segments(), features(), topic_words("segments"), GAPSIM, DEPTHS, BOUNDS, LEVELS), P, _with)
