"""Caption copy: hooks, keywords, hashtags and whole packs; caption chunks and subtitle events."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..config import Pack, Style
from ..functions import text as T
from ..sources.views import q


def copy_lines(clips: DataFrame, pack: Pack, text_col: str = "text") -> DataFrame:
    """clips with hook, title and description.

    hook: the first question among three sentences that has three content words, else the first of four sentences that has
    them, else the first sentence; 14 words at most. title: the hook's first ten. description: three sentences, 40 words."""
    c = lambda s: f"size({T.content(T.tokens(s), pack.bank('stopwords'), pack.bank('filler'))})"
    rows = clips.selectExpr("*", f"{T.sentences(text_col)} AS _s")
    rows = rows.selectExpr("*", f"coalesce(try_element_at(filter(slice(_s, 1, 3), s -> endswith(s, '?') AND {c('s')} >= 3), 1), try_element_at(filter(slice(_s, 1, 4), s -> {c('s')} >= 3), 1), try_element_at(_s, 1), '') AS _h", "array_join(slice(_s, 1, 3), ' ') AS _d")
    rows = rows.selectExpr("*", f"{T.shortened('_h', 14)} AS hook", f"{T.shortened('_d', 40)} AS description").selectExpr("*", "regexp_replace(hook, '[?.!]+$', '') AS _t")
    return rows.selectExpr("*", f"{T.shortened('_t', 10)} AS title").drop("_s", "_h", "_d", "_t")


def keywords(clips: DataFrame, pack: Pack, keys: tuple[str, ...], text_col: str = "text", limit: int = 6) -> DataFrame:
    """(keys, word, n, place): the most frequent content words, ties in alphabetical order."""
    k = ", ".join(keys)
    toks = clips.selectExpr(*keys, f"explode({T.content(T.tokens(text_col), pack.bank('stopwords'), pack.bank('filler'))}) AS word")
    return q(
        clips.sparkSession,
        f"SELECT * FROM (SELECT {k}, word, n, cast(row_number() OVER (PARTITION BY {k} ORDER BY n DESC, word) AS int) AS place FROM (SELECT {k}, word, count(*) AS n FROM {{toks}} GROUP BY {k}, word)) WHERE place <= {limit}",
        toks=toks,
    )


def hashtags(clips: DataFrame, pack: Pack, keys: tuple[str, ...], base: tuple[str, ...] = ("#podcast", "#shorts", "#fyp"), limit: int = 8, text_col: str = "text") -> DataFrame:
    """(keys, hashtags): the base tags, then keywords of three letters or more as tags, each once, `limit` in all."""
    k = ", ".join(keys)
    words = keywords(clips, pack, keys, text_col, limit)
    lists = q(clips.sparkSession, f"SELECT {k}, transform(array_sort(collect_list(struct(place, word))), x -> concat('#', regexp_replace(x.word, '[^a-z0-9]', ''))) AS tags FROM {{words}} GROUP BY {k}", words=words)
    first = T.words(list(base))
    rows = clips.select(*keys).join(lists, list(keys), "left")
    return rows.selectExpr(*keys, f"slice(array_distinct(concat({first}, filter(coalesce(tags, array()), t -> length(t) > 3))), 1, {limit}) AS hashtags")


def packs(clips: DataFrame, pack: Pack) -> DataFrame:
    """Caption packs of clips (episode_id, clip, start, end, text, score, why), with their text rendering."""
    keys = ("episode_id", "clip")
    rows = copy_lines(clips, pack).join(hashtags(clips, pack, keys), list(keys))
    body = "# Clip %02d  (%.1fs - %.1fs, hot %s/10)\n\nHOOK\n%s\n\nTITLE\n%s\n\nDESCRIPTION\n%s\n\nHASHTAGS\n%s\n\nWHY THIS CLIP\n%s\n\n---\nDrafts, not finished copy. Read them before posting.\n"
    return rows.selectExpr("episode_id", "clip", "hook", "title", "description", "hashtags", "round(start, 2) AS start", "round(end, 2) AS end", "score", "why", f"format_string({T.lit(body)}, clip, bround(start, 1), bround(end, 1), cast(score AS string), hook, title, description, array_join(hashtags, ' '), why) AS body")


def write_packs(rows: DataFrame, path: str) -> None:
    """All packs as JSON, and each clip's text in a folder of its own."""
    rows.drop("body").write.json(f"{path}/caption_packs")
    rows.selectExpr("episode_id", "clip", "body AS value").write.partitionBy("episode_id", "clip").text(f"{path}/caption_text")


def merged_tokens(words: DataFrame) -> DataFrame:
    """Words with number fragments (`19` `.000`) and punctuation put back on the word before: (episode_id, pos, start, end, text)."""
    glue = "pos0 AND text0 <> '' AND ((fragment AND before rlike '\\\\d$') OR NOT spoken)"
    rows = words.selectExpr("*", f"{T.trimmed('text')} AS text0").selectExpr("*", "text0 rlike '^[.,:%\\\\-/]\\\\d' AS fragment", "text0 rlike '[\\\\p{L}\\\\p{N}]' AS spoken")
    return q(
        words.sparkSession,
        f"""
        WITH seen AS (SELECT *, row_number() OVER e > 1 AS pos0, lag(text0) OVER e AS before FROM {{rows}} WINDOW e AS (PARTITION BY episode_id ORDER BY pos)),
        runs AS (SELECT *, sum(CASE WHEN {glue} THEN 0 ELSE 1 END) OVER (PARTITION BY episode_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM seen)
        SELECT episode_id, min(pos) AS pos, min(start) AS start, max_by(end, pos) AS end, CASE WHEN count(*) = 1 THEN min(text) ELSE array_join(transform(array_sort(collect_list(struct(pos, text0))), x -> x.text0), '') END AS text
        FROM runs GROUP BY episode_id, run
        """,
        rows=rows,
    )


def chunks(words: DataFrame, per_chunk: int = 3, max_gap: float = 0.7) -> DataFrame:
    """words with chunk (from 0 in each episode) and nth (from 0 in each chunk): a chunk ends at a pause or when it is full."""
    return q(
        words.sparkSession,
        f"""
        WITH gaps AS (SELECT *, CASE WHEN start - lag(end) OVER e > {max_gap}D THEN 1 ELSE 0 END AS cut FROM {{words}} WINDOW e AS (PARTITION BY episode_id ORDER BY pos)),
        islands AS (SELECT *, sum(cut) OVER (PARTITION BY episode_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM gaps),
        placed AS (SELECT *, row_number() OVER (PARTITION BY episode_id, island ORDER BY pos) - 1 AS r FROM islands),
        firsts AS (SELECT *, cast(r % {per_chunk} AS int) AS nth FROM placed)
        SELECT episode_id, pos, start, end, text, cast(sum(CASE WHEN nth = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY episode_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1 AS int) AS chunk, nth FROM firsts
        """,
        words=words,
    )


def line_value(t: str, pack: Pack) -> str:
    """How much of a caption line carries content, as an expression over an already trimmed line t.

    Share of content words; halved for a lone word and for repeats; 0.35 more with a loaded word or a number with its
    unit; halved beyond 44 characters."""
    weak = T.words(sorted({*pack.bank("stopwords"), *pack.bank("filler"), *pack.bank("weak_words")}))
    loaded = sorted({w for b in ("stakes_markers", "curiosity_markers", "contrarian_markers", "intensity_markers") for w in pack.bank(b)})
    single, multi = T.words([w for w in loaded if " " not in w]), T.words([w for w in loaded if " " in w])
    united = f"(exists(p, w -> w rlike '\\\\d') AND (contains(t, '%') OR arrays_overlap(p, {T.words(pack.bank('quantity_words'))})))"
    value = f"""aggregate(array(struct({t} AS t, transform(filter(split({t}, '\\\\s+'), w -> w rlike '[\\\\p{{L}}\\\\p{{N}}]'), w -> lower(regexp_replace(w, '^[.,!?:;"\\'\\\\-]+|[.,!?:;"\\'\\\\-]+$', ''))) AS p)), 0D, (z, x) -> CASE WHEN size(x.p) = 0 THEN 0D ELSE
      (size(filter(x.p, w -> CASE WHEN w rlike '\\\\d' THEN {united} ELSE NOT array_contains({weak}, w) AND length(w) >= 4 END)) / cast(size(x.p) AS double)
       * CASE WHEN size(x.p) < 2 THEN 0.5D ELSE 1D END * CASE WHEN size(array_distinct(x.p)) < size(x.p) THEN 0.5D ELSE 1D END
       + CASE WHEN {united} OR arrays_overlap(x.p, {single}) OR exists({multi}, m -> contains(lower(x.t), m)) THEN 0.35D ELSE 0D END) * CASE WHEN length(x.t) > 44 THEN 0.5D ELSE 1D END END)"""
    return value.replace("exists(p,", "exists(x.p,").replace("contains(t,", "contains(x.t,").replace("arrays_overlap(p,", "arrays_overlap(x.p,")


def spoken(words: DataFrame, pack: Pack, per_chunk: int = 3) -> DataFrame:
    """When each word is on screen (the last of a chunk until the chunk ends) and the value of its chunk's line."""
    rows = chunks(words, per_chunk)
    lines = q(words.sparkSession, "SELECT episode_id, chunk, max(end) AS chunk_end, max(nth) AS last, array_join(transform(array_sort(collect_list(struct(pos, text))), x -> x.text), ' ') AS line FROM {rows} GROUP BY episode_id, chunk", rows=rows)
    lines = lines.selectExpr("*", f"{T.trimmed('line')} AS line0").selectExpr("episode_id", "chunk", "chunk_end", "last", "line", f"{line_value('line0', pack)} AS value")
    return q(words.sparkSession, "SELECT r.episode_id, r.pos, r.chunk, r.start, CASE WHEN r.nth = l.last THEN l.chunk_end ELSE r.end END AS end, l.line, l.value FROM {rows} r JOIN {lines} l USING (episode_id, chunk)", rows=rows, lines=lines)


def events(words: DataFrame, style: Style, height: int = 1920, clip_start: float = 0.0) -> DataFrame:
    """Subtitle events (episode_id, pos, line): each word's chunk with that word in the highlight colour."""
    style = style.scaled(height)
    shifted = merged_tokens(words).selectExpr("episode_id", "pos", f"start - {clip_start}D AS start", f"end - {clip_start}D AS end", "upper(text) AS text" if style.uppercase else "text")
    rows = chunks(shifted, style.words_per_chunk)
    lists = q(words.sparkSession, "SELECT episode_id, chunk, array_sort(collect_list(struct(nth, text))) AS line FROM {rows} GROUP BY episode_id, chunk", rows=rows)
    high, low = T.lit("{\\c" + T.ass_color(style.highlight) + "}"), T.lit("{\\c" + T.ass_color(style.primary) + "}")
    both = rows.join(lists, ["episode_id", "chunk"])
    return both.selectExpr("episode_id", "pos", f"concat('Dialogue: 0,', {T.ass_time('start')}, ',', {T.ass_time('end')}, ',Cap,,0,0,0,,', array_join(transform(line, x -> CASE WHEN x.nth = nth THEN concat({high}, x.text, {low}) ELSE x.text END), ' ')) AS line")


def wrapped_title(t: str, per_line: int, max_lines: int = 3) -> str:
    """A title in balanced lines, as an expression: a fold over its words. Words that do not fit leave an ellipsis."""
    w = f"filter(split({t}, '\\\\s+'), w -> w <> '')"
    needed = f"least({max_lines}, greatest(1, cast(ceil(length({t}) / {float(per_line)}D) AS int)))"
    target = f"greatest(1, cast(floor(length({t}) / {needed}) AS int))"
    start = "cast(struct(array() AS lines, '' AS cur, 0 AS used) AS struct<lines: array<string>, cur: string, used: int>)"
    step = f"""(a, w) -> CASE WHEN size(a.lines) = {max_lines} THEN a
      WHEN a.cur <> '' AND length(a.cur) + 1 + length(w) > greatest({target}, length(w)) THEN struct(concat(a.lines, array(a.cur)) AS lines, w AS cur, a.used + size(split(a.cur, ' ')) AS used)
      ELSE struct(a.lines AS lines, CASE WHEN a.cur = '' THEN w ELSE concat(a.cur, ' ', w) END AS cur, a.used AS used) END"""
    end = f"""a -> CASE WHEN size(a.lines) < {max_lines} AND a.cur <> '' THEN concat(a.lines, array(a.cur))
      WHEN size(a.lines) = {max_lines} AND a.used < size({w}) THEN concat(slice(a.lines, 1, {max_lines} - 1), array(concat(regexp_replace(element_at(a.lines, -1), '[,;:]+$', ''), '...'))) ELSE a.lines END"""
    return f"aggregate({w}, {start}, {step}, {end})"
