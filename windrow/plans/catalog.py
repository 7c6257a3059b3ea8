"""The engine's queries over the synthetic tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PROSE, STYLES, Lexicon
from ..functions import audio, lexicon
from ..functions import text as T
from ..operators import captions, export, framing, punctuation, scoring, selection, speakers, timeline, topics
from ..sources import views
from ..sources.staging import settled

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _segments(s: SparkSession, d: str) -> DataFrame:
    return views.derived_segments(s, d)


def _features(s: SparkSession, d: str) -> DataFrame:
    return scoring.features(_segments(s, d), PROSE, dealt=True)


def _scores(s: SparkSession, d: str) -> DataFrame:
    return scoring.scored(scoring.candidate_windows(_features(s, d), PROSE), PROSE)


@query
def segments_from_turns(s: SparkSession, d: str) -> DataFrame:
    return _segments(s, d)


@query
def segments_from_documents(s: SparkSession, d: str) -> DataFrame:
    return views.derived_segments(s, d, "documents")


@query
def words_timeline(s: SparkSession, d: str) -> DataFrame:
    return views.derived_words(_segments(s, d))


@query
def segment_predicates(s: SparkSession, d: str) -> DataFrame:
    return _features(s, d).select("episode_id", "seg", "content", "dangles", "asks", "opens", "stands", "clean", "unfinished")


@query
def term_frequencies(s: SparkSession, d: str) -> DataFrame:
    return scoring.term_frequencies(_segments(s, d), PROSE)


@query
def candidate_windows(s: SparkSession, d: str) -> DataFrame:
    return scoring.candidate_windows(_features(s, d), PROSE).select("episode_id", "i", "j", "start", "end", "n", "short", "raised", "payload").selectExpr("episode_id", "i", "j", "start", "end", "n", "short", "raised", "CASE WHEN raised THEN payload ELSE -1 END AS payload")


@query
def window_scores(s: SparkSession, d: str) -> DataFrame:
    rows = _scores(s, d)
    return rows.selectExpr("episode_id", "i", "j", *(f"round({k}, 6) AS {k}" for k in scoring.SIGNALS), "round(raw_score, 6) AS raw_score")


def _overlapped(s: SparkSession, d: str) -> DataFrame:
    """Segments of speakers who talk over each other: some start together with the one before, some end after the next ones."""
    return views.q(s, "SELECT episode_id, seg, CASE WHEN seg % 5 = 3 THEN lag(start, 1, start) OVER (PARTITION BY episode_id ORDER BY seg) ELSE start END AS start, end + CASE WHEN seg % 7 = 2 THEN 30D ELSE 0D END AS end, text, speaker FROM {f}", f=_segments(s, d))


@query
def overlapped_windows(s: SparkSession, d: str) -> DataFrame:
    rows = scoring.scored(scoring.candidate_windows(scoring.features(_overlapped(s, d), PROSE, dealt=True), PROSE), PROSE)
    return rows.selectExpr("episode_id", "i", "j", "start", "end", *(f"round({k}, 6) AS {k}" for k in scoring.SIGNALS), "round(raw_score, 6) AS raw_score")


@query
def calibrated_scores(s: SparkSession, d: str) -> DataFrame:
    # raw scores are rounded before they are ranked, so that ties do not hang on the order of additions
    rows = _scores(s, d).selectExpr("episode_id", "i", "j", "start", "end", "round(raw_score, 6) AS raw_score")
    return scoring.calibrated(rows).selectExpr("episode_id", "i", "j", "raw_score", "score", "percentile")


@query
def explain_text(s: SparkSession, d: str) -> DataFrame:
    rows = scoring.explained(_scores(s, d))
    return rows.select("episode_id", "i", "j", "why")


def _pool(s: SparkSession, d: str) -> DataFrame:
    rows = _scores(s, d).selectExpr("episode_id", "i", "j", "start", "end", "round(raw_score, 6) AS raw_score")
    return settled(selection.near_duplicates_dropped(scoring.calibrated(rows)), "pool")


@query
def pool_dedupe(s: SparkSession, d: str) -> DataFrame:
    return _pool(s, d).select("episode_id", "i", "j", "start", "end", "place", "raw_score", "score", "percentile")


@query
def nms_selection(s: SparkSession, d: str) -> DataFrame:
    return selection.chosen(_pool(s, d), 5)


@query
def regenerate_different(s: SparkSession, d: str) -> DataFrame:
    pool = _pool(s, d)
    return selection.regenerated(pool, selection.chosen(pool, 5), 1, "different")


@query
def regenerate_retime(s: SparkSession, d: str) -> DataFrame:
    pool = _pool(s, d)
    return selection.alternatives(pool, selection.chosen(pool, 5), 1, "retime").selectExpr("episode_id", "i", "j", "start", "end", "score", "round(shared, 6) AS shared", "choice")


@query
def regenerate_all(s: SparkSession, d: str) -> DataFrame:
    pool = _pool(s, d)
    return selection.regenerated_all(pool, selection.chosen(pool, 5), 5)


@query
def reserve_count(s: SparkSession, d: str) -> DataFrame:
    pool = _pool(s, d)
    return selection.reserve_counts(pool, selection.chosen(pool, 5))


# --- text over documents ---------------------------------------------------------------------------------------------


def _documents(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/documents.parquet").selectExpr("doc_id", "coalesce(text, '') AS text")


@query
def marker_hits(s: SparkSession, d: str) -> DataFrame:
    rows = _documents(s, d).selectExpr("doc_id", "lower(text) AS low")
    banks = ("curiosity_markers", "contrarian_markers", "intensity_markers", "stakes_markers", "past_markers")
    return rows.selectExpr("doc_id", *(f"{T.hits('low', PROSE.bank(b))} AS {b}" for b in banks), f"{T.has_phrase('low', PROSE.bank('question_openers'))} AS opener", f"{T.has_phrase('low', PROSE.bank('promise_markers'))} AS promise")


@query
def hook_lines(s: SparkSession, d: str) -> DataFrame:
    return captions.copy_lines(_documents(s, d), PROSE).select("doc_id", "hook", "title", "description")


@query
def clip_keywords(s: SparkSession, d: str) -> DataFrame:
    return captions.keywords(_documents(s, d), PROSE, ("doc_id",))


@query
def clip_hashtags(s: SparkSession, d: str) -> DataFrame:
    return captions.hashtags(_documents(s, d), PROSE, ("doc_id",)).selectExpr("doc_id", "array_join(hashtags, ' ') AS hashtags")


@query
def names_in_line(s: SparkSession, d: str) -> DataFrame:
    return _segments(s, d).selectExpr("episode_id", "seg", f"array_join({T.names('text', PROSE)}, ' ') AS names")


@query
def punctuation_share(s: SparkSession, d: str) -> DataFrame:
    return punctuation.share(punctuation.stripped(_segments(s, d)))


@query
def repunctuated_segments(s: SparkSession, d: str) -> DataFrame:
    return punctuation.restored(punctuation.stripped(_segments(s, d))).select("episode_id", "seg", "text")


@query
def wrapped_titles(s: SparkSession, d: str) -> DataFrame:
    rows = _segments(s, d).selectExpr("episode_id", "seg", "upper(text) AS title")
    return rows.selectExpr("episode_id", "seg", f"array_join({captions.wrapped_title('title', 18)}, '|') AS lines")


@query
def caption_packs(s: SparkSession, d: str) -> DataFrame:
    clips = views.q(s, "SELECT c.episode_id, c.clip, c.start, c.end, array_join(transform(array_sort(collect_list(struct(f.seg, f.text))), x -> x.text), ' ') AS text, 7.5D AS score, 'no strong signals' AS why FROM {c} c JOIN {f} f ON f.episode_id = c.episode_id AND f.start >= c.start AND f.end <= c.end GROUP BY c.episode_id, c.clip, c.start, c.end", c=_clips(s, d), f=_segments(s, d))
    return captions.packs(clips, PROSE).selectExpr("episode_id", "clip", "hook", "title", "description", "array_join(hashtags, ' ') AS hashtags", "start", "end", "score", "why", "body")


# --- clips, pauses and captions over words ---------------------------------------------------------------------------


def _clips(s: SparkSession, d: str) -> DataFrame:
    """Every eight segments are a clip."""
    return views.q(s, "SELECT episode_id, cast(floor(seg / 8) + 1 AS int) AS clip, min(start) AS start, max(end) AS end FROM {f} GROUP BY episode_id, floor(seg / 8)", f=_segments(s, d))


def _words(s: SparkSession, d: str) -> DataFrame:
    """Words, some of them made into number fragments and lone signs."""
    return views.derived_words(_segments(s, d)).selectExpr("episode_id", "pos", "start", "end", "CASE pos % 17 WHEN 3 THEN '19' WHEN 4 THEN '.000' WHEN 9 THEN '%' ELSE text END AS text", "confidence")


@query
def word_gaps(s: SparkSession, d: str) -> DataFrame:
    return timeline.gaps(_words(s, d), _clips(s, d))


@query
def deadair_cuts(s: SparkSession, d: str) -> DataFrame:
    return timeline.cuts(_words(s, d), _clips(s, d)).selectExpr("episode_id", "clip", "round(cut_from, 6) AS cut_from", "round(cut_to, 6) AS cut_to")


@query
def deadair_timeline(s: SparkSession, d: str) -> DataFrame:
    rows = timeline.described(timeline.timelines(_words(s, d), _clips(s, d)))
    return rows.selectExpr("episode_id", "clip", "size(spans) AS n_spans", "round(duration, 6) AS duration", "cuts", "round(removed, 6) AS removed")


@query
def deadair_tails(s: SparkSession, d: str) -> DataFrame:
    """Clips with silence before the first word and after the last, and clips of one word."""
    clips = views.q(s, "SELECT episode_id, clip, start - 3D AS start, end + 40.03125D AS end FROM {c} UNION ALL SELECT episode_id, max(clip) + 1000, max(end) - 0.25D, max(end) + 60D FROM {c} GROUP BY episode_id", c=_clips(s, d))
    rows = timeline.described(timeline.timelines(_words(s, d), clips))
    return rows.selectExpr("episode_id", "clip", "size(spans) AS n_spans", "round(duration, 6) AS duration", "cuts", "round(removed, 6) AS removed")


@query
def remapped_words(s: SparkSession, d: str) -> DataFrame:
    words = _words(s, d)
    rows = timeline.shifted_words(words, timeline.timelines(words, _clips(s, d)))
    return rows.selectExpr("episode_id", "clip", "pos", "text", "round(start, 6) AS start", "round(end, 6) AS end")


@query
def preview_slices(s: SparkSession, d: str) -> DataFrame:
    rows = timeline.slices(timeline.timelines(_words(s, d), _clips(s, d)), 2.0, 7.0)
    return rows.selectExpr("episode_id", "clip", "k", "round(from_, 6) AS from_", "round(to_, 6) AS to_")


@query
def merged_tokens(s: SparkSession, d: str) -> DataFrame:
    return captions.merged_tokens(_words(s, d))


@query
def caption_chunks(s: SparkSession, d: str) -> DataFrame:
    return captions.chunks(captions.merged_tokens(_words(s, d))).select("episode_id", "pos", "chunk", "nth")


@query
def spoken_windows(s: SparkSession, d: str) -> DataFrame:
    return captions.spoken(captions.merged_tokens(_words(s, d)), PROSE).selectExpr("episode_id", "pos", "chunk", "start", "end", "line", "round(value, 9) AS value")


@query
def subtitle_events(s: SparkSession, d: str) -> DataFrame:
    return captions.events(_words(s, d), STYLES["punch"])


@query
def uncertain_words(s: SparkSession, d: str) -> DataFrame:
    return _words(s, d).where("confidence < 0.6").select("episode_id", "pos", "text", "confidence")


# --- topics ----------------------------------------------------------------------------------------------------------


@query
def topic_gaps(s: SparkSession, d: str) -> DataFrame:
    return topics.gap_similarity(views.derived_segments(s, d, "documents"), PROSE).selectExpr("episode_id", "gap", "t", "round(sim, 9) AS sim")


def _depths(s: SparkSession, d: str) -> DataFrame:
    # similarities are rounded first, so that comparing neighbours does not hang on the last bit
    return topics.depths(topics.gap_similarity(views.derived_segments(s, d, "documents"), PROSE).selectExpr("episode_id", "gap", "t", "round(sim, 9) AS sim"))


@query
def topic_depths(s: SparkSession, d: str) -> DataFrame:
    return _depths(s, d).selectExpr("episode_id", "gap", "t", "round(depth, 6) AS depth")


@query
def topic_boundaries(s: SparkSession, d: str) -> DataFrame:
    return topics.boundaries(_depths(s, d))


@query
def topic_levels(s: SparkSession, d: str) -> DataFrame:
    return topics.levels(_segments(s, d), PROSE).selectExpr("episode_id", "point", "t", "round(level, 9) AS level")


@query
def topic_thresholds(s: SparkSession, d: str) -> DataFrame:
    return topics.thresholds(topics.levels(_segments(s, d), PROSE)).selectExpr("episode_id", "round(high, 6) AS high", "round(low, 6) AS low")


@query
def clip_extension(s: SparkSession, d: str) -> DataFrame:
    return topics.extended(_clips(s, d), settled(_features(s, d), "features"), PROSE)


@query
def opening_shift(s: SparkSession, d: str) -> DataFrame:
    return topics.real_openings(_clips(s, d), _features(s, d))


# --- export and state ------------------------------------------------------------------------------------------------


@query
def platform_margins(s: SparkSession, d: str) -> DataFrame:
    return export.caption_margins(export.platforms(s)).selectExpr("key", "round(bottom_margin, 6) AS bottom_margin", "round(side_margin, 6) AS side_margin", "round(title_top_margin, 6) AS title_top_margin")


@query
def export_plan(s: SparkSession, d: str) -> DataFrame:
    return export.plan(_clips(s, d), export.platforms(s))


@query
def export_rejected(s: SparkSession, d: str) -> DataFrame:
    return export.unplaced(_clips(s, d), export.platforms(s, ("feed", "reels")))


def _slots(s: SparkSession, d: str) -> DataFrame:
    """Stored slots: every other clip, numbered backwards; in every third episode one that the pool no longer has."""
    return _clips(s, d).where("clip % 2 = 1").selectExpr("episode_id", "20 - clip AS index", "start + CASE WHEN episode_id % 3 = 0 AND clip = 1 THEN 0.25D ELSE 0D END AS start", "end")


@query
def session_restore(s: SparkSession, d: str) -> DataFrame:
    pool = _clips(s, d).selectExpr("episode_id", "clip AS i", "clip AS j", "start", "end")
    return export.restored(_slots(s, d), pool)


@query
def clip_numbers(s: SparkSession, d: str) -> DataFrame:
    return export.numbered(_clips(s, d).select("episode_id", "start", "end"), _slots(s, d))


@query
def stale_files(s: SparkSession, d: str) -> DataFrame:
    clips = _clips(s, d)
    plans = export.plan(clips, export.platforms(s, ("reels", "square")))
    done = plans.join(clips, ["episode_id", "clip"]).where("clip % 3 <> 0").selectExpr("episode_id", "filename", "round(start + CASE WHEN clip % 3 = 1 AND platform = 'square' THEN 0.5D ELSE 0D END, 2) AS start", "round(end, 2) AS end", "'' AS edit")
    return export.stale(plans, clips, done)


# --- tracks ----------------------------------------------------------------------------------------------------------


def _track_clips(s: SparkSession, d: str) -> DataFrame:
    ends = views.q(s, "SELECT episode_id, max(t) AS last FROM {f} GROUP BY episode_id", f=views.keyframes(s, d))
    return ends.selectExpr("episode_id", "explode(sequence(0, cast(floor(last / 4) AS int))) AS c").selectExpr("episode_id", "c + 1 AS clip", "c * 4D + 0.125D AS start", "c * 4D + 3.625D AS end")


def _shots(s: SparkSession, d: str) -> DataFrame:
    return framing.shots(views.keyframes(s, d))


@query
def crop_center_at(s: SparkSession, d: str) -> DataFrame:
    frames = views.keyframes(s, d)
    points = frames.selectExpr("episode_id", "t + 0.0625D * (k % 4) - 0.125D AS t").distinct()
    return framing.center_at(frames, points).selectExpr("episode_id", "t", "round(center, 9) AS center")


@query
def sendcmd_lines(s: SparkSession, d: str) -> DataFrame:
    return framing.crop_commands(views.keyframes(s, d), _track_clips(s, d), 1920, 608, 4.0)


@query
def frames_at(s: SparkSession, d: str) -> DataFrame:
    frames = views.keyframes(s, d)
    return framing.frames_at(frames, frames.where("k % 3 = 0").selectExpr("episode_id", "t - 0.1875D AS want"))


@query
def folded_shots(s: SparkSession, d: str) -> DataFrame:
    return _shots(s, d)


@query
def shots_from_histograms(s: SparkSession, d: str) -> DataFrame:
    rows = s.read.parquet(f"{d}/embeddings.parquet").selectExpr("label AS episode_id", "vec_id AS k", "vec_id * 0.25D AS t", "embedding AS hist")
    return framing.histogram_cuts(rows).selectExpr("episode_id", "k", "t", "round(distance, 4) AS distance", "opens_shot")


@query
def static_shots(s: SparkSession, d: str) -> DataFrame:
    return framing.static_shots(views.keyframes(s, d), _shots(s, d))


@query
def flattened_path(s: SparkSession, d: str) -> DataFrame:
    return framing.flattened(views.keyframes(s, d), _shots(s, d))


@query
def segment_modes(s: SparkSession, d: str) -> DataFrame:
    return framing.segment_modes(framing.static_shots(views.keyframes(s, d), _shots(s, d)), _track_clips(s, d))


@query
def framing_mode(s: SparkSession, d: str) -> DataFrame:
    return framing.recommended(views.keyframes(s, d), _shots(s, d)).selectExpr("episode_id", "round(detection_rate, 9) AS detection_rate", "median_shot", "mode")


@query
def smoothed_path(s: SparkSession, d: str) -> DataFrame:
    return framing.smoothed(views.keyframes(s, d)).selectExpr("episode_id", "k", "t", "round(smooth, 6) AS smooth", "round(eased, 6) AS eased")


@query
def path_jerkiness(s: SparkSession, d: str) -> DataFrame:
    return framing.jerkiness(views.keyframes(s, d)).selectExpr("episode_id", "round(jerkiness, 9) AS jerkiness")


@query
def frame_stillness(s: SparkSession, d: str) -> DataFrame:
    return framing.stillness(views.keyframes(s, d)).selectExpr("episode_id", "k", "round(stillness, 9) AS stillness")


@query
def cover_time(s: SparkSession, d: str) -> DataFrame:
    return framing.cover_times(views.keyframes(s, d), _track_clips(s, d), captions.spoken(captions.merged_tokens(_words(s, d)), PROSE))


def _energy(s: SparkSession, d: str) -> DataFrame:
    return views.keyframes(s, d).selectExpr("episode_id", "k", "t", "explode(array(0, 1, 2)) AS seat", "center_x", "motion").selectExpr("episode_id", "k", "t", "seat", "(center_x * 7 + seat * 0.25D + greatest(motion, 0D) * (seat + 1)) % 4 + 0.125D AS energy")


@query
def active_speaker(s: SparkSession, d: str) -> DataFrame:
    return framing.active_speakers(_energy(s, d)).selectExpr("episode_id", "k", "t", "coalesce(seat, -1) AS seat")


@query
def dominant_seat(s: SparkSession, d: str) -> DataFrame:
    return framing.dominant_seats(framing.active_speakers(_energy(s, d)), _track_clips(s, d)).selectExpr("episode_id", "clip", "coalesce(seat, -1) AS seat")


def _turns(s: SparkSession, d: str) -> DataFrame:
    return _segments(s, d).selectExpr("episode_id", "seg AS turn", "speaker", "start", "end - CASE WHEN seg % 5 = 0 THEN 1D ELSE 0D END AS end")


@query
def speaker_of_word(s: SparkSession, d: str) -> DataFrame:
    return framing.speakers_at(_words(s, d), _turns(s, d))


@query
def speaker_summary(s: SparkSession, d: str) -> DataFrame:
    return framing.speaker_summary(_turns(s, d))


@query
def seat_clusters(s: SparkSession, d: str) -> DataFrame:
    rows = views.keyframes(s, d).where("confident").selectExpr("episode_id", "k", "center_x AS cx", "0.5D AS cy", "0.125D AS w", "0.25D AS h")
    return framing.seats(rows, 30, min_share=0.1)


@query
def ranked_detections(s: SparkSession, d: str) -> DataFrame:
    rows = s.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_orderkey % 16 AS episode_id", "l_orderkey AS k", "cast(l_partkey % 400 AS int) AS x", "cast(l_suppkey % 300 AS int) AS y", "cast(l_quantity * 8 AS int) AS w", "cast(l_quantity * 6 AS int) AS h", "cast(l_linenumber AS double) / 8 AS skin", "cast(l_linenumber % 3 + 1 AS int) AS votes")
    return framing.ranked_detections(rows, 640, 360).select("episode_id", "k", "x", "y", "w", "h", "score", "place")


@query
def lexicon_text(s: SparkSession, d: str) -> DataFrame:
    return _segments(s, d).select("episode_id", "seg", lexicon.corrected_text(F.col("text"), LEXICON).alias("text"))


@query
def lexicon_words(s: SparkSession, d: str) -> DataFrame:
    return lexicon.corrected_words(views.derived_words(_segments(s, d)), LEXICON)


@query
def fuzzy_snap(s: SparkSession, d: str) -> DataFrame:
    return views.derived_words(_segments(s, d)).select("episode_id", "pos", lexicon.snapped(F.col("text"), LEXICON).alias("text"))


_LOUDNESS = [(1, "x [Parsed]\n{\n\"input_i\" : \"-23.40\",\n\"input_tp\" : \"-3.10\",\n\"input_lra\" : \"15.20\"\n}\n"), (2, "{\"input_i\" : \"-inf\", \"input_tp\" : \"-inf\", \"input_lra\" : \"0.00\"}"), (3, "nothing"), (4, "{\"input_i\" : \"-14.20\", \"input_tp\" : \"-0.20\", \"input_lra\" : \"3.00\"}"), (5, "{\"input_i\" : \"-40.00\", \"input_tp\" : \"-10.00\", \"input_lra\" : \"3.00\"}")]


@query
def loudness_gain(s: SparkSession, d: str) -> DataFrame:
    return audio.levelled(audio.parsed(s.createDataFrame(_LOUDNESS, "id int, raw string"))).drop("raw")


LEXICON = Lexicon({"the that": "Thethat", "le la": "La", "in der": "inder"}, ("thing", "keiten", "ungen", "mente"))


@query
def speaker_agreement(s: SparkSession, d: str) -> DataFrame:
    pairs = s.read.parquet(f"{d}/events.parquet").selectExpr("user_id % 8 AS episode_id", "event_type AS a", "cast(floor(value * 4) AS int) % 5 AS b")
    return speakers.agreement(pairs).selectExpr("episode_id", "round(share, 9) AS share", "round(ari, 9) AS ari")


@query
def decoder_diagnostics(s: SparkSession, d: str) -> DataFrame:
    rows = s.read.parquet(f"{d}/embeddings.parquet").selectExpr("label AS episode_id", "vec_id AS k", "vec_id * 0.25D AS t", "embedding AS hist")
    return speakers.histogram_distances(framing.histogram_cuts(rows)).selectExpr("episode_id", "frames", "repeats", "round(median, 4) AS median", "round(p95, 4) AS p95", "round(top, 4) AS top")


@query
def diarized_turns(s: SparkSession, d: str) -> DataFrame:
    rows = s.read.parquet(f"{d}/embeddings.parquet").selectExpr("label AS episode_id", "cast(vec_id AS int) AS seg", "vec_id * 1D AS start", "vec_id + 0.9D AS end", "CASE WHEN vec_id % 7 <> 0 THEN transform(embedding, x -> cast(x AS double)) END AS embedding")
    return speakers.diarized(rows)


@query
def tracked_path(s: SparkSession, d: str) -> DataFrame:
    frames = views.keyframes(s, d)
    faces = frames.where("confident").selectExpr("episode_id", "k", "explode(array(struct(center_x AS x, 1D AS score), struct(1 - center_x AS x, 0.75D AS score))) AS f").selectExpr("episode_id", "k", "f.x AS center_x", "f.score AS score")
    track = settled(framing.tracked(frames.select("episode_id", "k", "t", "motion"), faces), "track")
    return framing.crop_path(track, _shots(s, d), 0.158203125).selectExpr("episode_id", "k", "t", "confident", "round(center_x, 6) AS center_x")


@query
def merged_boxes(s: SparkSession, d: str) -> DataFrame:
    rows = s.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_orderkey % 16 AS episode_id", "cast(l_orderkey % 997 AS int) AS k", "l_orderkey * 8 + l_linenumber AS n", "cast(l_partkey % 40 AS int) AS x", "cast(l_suppkey % 30 AS int) AS y", "cast(l_quantity + 20 AS int) AS w", "cast(l_quantity + 30 AS int) AS h")
    return framing.merged_boxes(rows)


from . import extra  # noqa: E402, F401  (adds its queries)
