"""Pauses, cuts and the timelines they leave; every clip is a row (episode_id, clip, start, end)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.views import MEET, q, stretches

# Pauses from MIN_GAP on are shortened to KEEP, largest first, by at most MAX_FRACTION of the clip; cuts of MIN_CUT at least.
MIN_GAP, KEEP, MAX_FRACTION, MIN_CUT = 1.5, 0.4, 0.12, 0.1


def gaps(words: DataFrame, clips: DataFrame) -> DataFrame:
    """Silence between neighbouring words of a clip: (episode_id, clip, pos, gap_start, gap_end). What is before its first word and after
    its last is no gap."""
    return q(
        words.sparkSession,
        """
        WITH inside AS (SELECT c.episode_id, c.clip, c.start AS s, c.end AS e, w.pos, w.start, w.end FROM {clips} c JOIN {words} w ON """ + MEET.format("w", "c") + """ AND w.end > c.start AND w.start < c.end),
        pairs AS (SELECT episode_id, clip, pos, greatest(end, s) AS gap_start, lead(start) OVER (PARTITION BY episode_id, clip ORDER BY pos) AS next, e FROM inside)
        SELECT episode_id, clip, pos, gap_start, least(next, e) AS gap_end FROM pairs WHERE next IS NOT NULL AND least(next, e) > gap_start
        """,
        words=stretches(words), clips=stretches(clips),
    )


def cuts(words: DataFrame, clips: DataFrame) -> DataFrame:
    """(episode_id, clip, cut_from, cut_to): what a clip loses. The budget that is left for a pause is a running sum over longer ones."""
    found = gaps(words, clips)
    return q(
        words.sparkSession,
        f"""
        WITH long AS (SELECT g.*, gap_end - gap_start AS len, (c.end - c.start) * {MAX_FRACTION}D AS budget FROM {{found}} g JOIN {{clips}} c USING (episode_id, clip) WHERE gap_end - gap_start >= {MIN_GAP}D),
        want AS (SELECT *, len - {KEEP}D AS want, coalesce(sum(len - {KEEP}D) OVER (PARTITION BY episode_id, clip ORDER BY len DESC, gap_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0D) AS before FROM long WHERE len - {KEEP}D >= {MIN_CUT}D)
        SELECT episode_id, clip, gap_start + {KEEP / 2}D AS cut_from, gap_start + {KEEP / 2}D + least(want, budget - before) AS cut_to FROM want WHERE budget - before >= {MIN_CUT}D
        """,
        found=found, clips=clips,
    )


def timelines(words: DataFrame, clips: DataFrame) -> DataFrame:
    """clips with spans (what is kept, in order), duration, removed and cuts."""
    lost = cuts(words, clips)
    rows = q(
        words.sparkSession,
        """
        WITH lists AS (SELECT episode_id, clip, array_sort(collect_list(struct(cut_from, cut_to))) AS lost FROM {lost} GROUP BY episode_id, clip)
        SELECT c.*, coalesce(lost, array()) AS lost FROM {clips} c LEFT JOIN lists USING (episode_id, clip)
        """,
        lost=lost, clips=clips,
    )
    spans = "filter(zip_with(concat(array(start), transform(lost, x -> x.cut_to)), concat(transform(lost, x -> x.cut_from), array(end)), (a, b) -> struct(a AS start, b AS end)), s -> s.end > s.start)"
    rows = rows.selectExpr("*", f"{spans} AS spans").drop("lost")
    return rows.selectExpr("*", "aggregate(spans, 0D, (a, s) -> a + s.end - s.start) AS duration", "greatest(0, size(spans) - 1) AS cuts").selectExpr("*", "greatest(0D, end - start - duration) AS removed")


def user_spans(spans: str, start: str, end: str) -> str:
    """Spans set by hand, clamped to the clip, too short ones dropped, in order; the whole clip if none is left."""
    kept = f"array_sort(filter(transform({spans}, span_ -> struct(greatest(span_.a, {start}) AS start, least(span_.b, {end}) AS end)), span_ -> span_.end - span_.start > {MIN_CUT}D))"
    return f"CASE WHEN size({kept}) = 0 THEN array(struct({start} AS start, {end} AS end)) ELSE {kept} END"


def remap(t: str, spans: str = "spans") -> str:
    """Source time on the cut timeline: what is kept before it."""
    return f"aggregate({spans}, 0D, (kept_, span_) -> kept_ + greatest(0D, least({t} - span_.start, span_.end - span_.start)))"


def shifted_words(words: DataFrame, lines: DataFrame) -> DataFrame:
    """Words of each clip on its cut timeline; those that a cut swallows go, unless nothing comes before them."""
    rows = q(words.sparkSession, "SELECT c.episode_id, c.clip, c.spans, w.pos, w.start AS s0, w.end AS e0, w.text FROM {lines} c JOIN {words} w ON " + MEET.format("w", "c") + " AND w.end > c.start AND w.start < c.end", words=stretches(words), lines=stretches(lines))
    rows = rows.selectExpr("episode_id", "clip", "pos", "text", f"{remap('s0')} AS start", f"{remap('e0')} AS end")
    return q(words.sparkSession, "SELECT episode_id, clip, pos, text, start, end FROM (SELECT *, row_number() OVER (PARTITION BY episode_id, clip ORDER BY pos) AS r FROM {rows}) WHERE end > start OR r = 1", rows=rows)


def slices(lines: DataFrame, a: float, b: float) -> DataFrame:
    """The source ranges under seconds a to b of each cut timeline: (episode_id, clip, k, from_, to_)."""
    rows = lines.selectExpr("episode_id", "clip", "posexplode(spans) AS (k, s)")
    return q(
        lines.sparkSession,
        f"""
        WITH run AS (SELECT episode_id, clip, k, s.start AS start, s.end - s.start AS len, sum(s.end - s.start) OVER (PARTITION BY episode_id, clip ORDER BY k ROWS UNBOUNDED PRECEDING) - (s.end - s.start) AS first FROM {{rows}}),
        cut AS (SELECT episode_id, clip, k, start + greatest(0D, {float(a)}D - first) AS from_, start + least(len, {float(b)}D - first) AS to_ FROM run WHERE first + len > {float(a)}D AND first < {float(b)}D)
        SELECT * FROM cut WHERE to_ > from_
        """,
        rows=rows,
    )


def described(lines: DataFrame) -> DataFrame:
    """timelines with a line for people; empty where nothing was cut."""
    return lines.selectExpr("*", "CASE WHEN cuts = 0 THEN '' ELSE format_string('%.1fs of dead air out across %d cut%s', removed, cuts, CASE WHEN cuts > 1 THEN 's' ELSE '' END) END AS note")
