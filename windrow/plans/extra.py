"""Queries for what the catalogue's other queries only use on the way: readers, state, edits, tags, sizes, seats, cepstra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import INDONESIAN, STYLES, Lexicon, Style
from ..functions import audio, subtitles
from ..operators import export, framing
from ..sources import views
from ..sources.staging import folder
from . import lifecycle
from .catalog import _clips, _segments, _slots, _words, query


def _lines(s: SparkSession, d: str) -> str:
    """The derived transcripts as JSON lines in the shared folder."""
    segments = _segments(s, d)
    path = folder(s, "transcripts")
    rows = views.q(
        s,
        """
        WITH a AS (SELECT episode_id, array_sort(collect_list(struct(seg, start, end, text, speaker))) AS x FROM {f} GROUP BY episode_id),
        b AS (SELECT episode_id, array_sort(collect_list(struct(pos, start, end, text, confidence))) AS y FROM {w} GROUP BY episode_id)
        SELECT cast(episode_id AS string) AS episode_id, transform(x, z -> struct(z.start, z.end, z.text, z.speaker)) AS segments,
          transform(y, z -> struct(z.start, z.end, z.text, CASE WHEN z.confidence < 1 THEN z.confidence END AS confidence)) AS words FROM a JOIN b USING (episode_id)
        """,
        f=segments, w=views.derived_words(segments),
    )
    rows.select(F.to_json(F.struct("*"))).write.text(path)
    return path


@query
def transcript_segments(s: SparkSession, d: str) -> DataFrame:
    return views.read_transcript_lines(s, _lines(s, d))[0].withColumn("episode_id", F.col("episode_id").cast("bigint"))


@query
def transcript_words(s: SparkSession, d: str) -> DataFrame:
    return views.read_transcript_lines(s, _lines(s, d))[1].withColumn("episode_id", F.col("episode_id").cast("bigint"))


@query
def state_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """Slots and rejected windows saved and read back, with whether the state still fits what is asked for."""
    state = export.State(s, folder(s, "state"))
    rejected = _clips(s, d).where("clip % 4 = 2").select("episode_id", "start", "end")
    state.save({"slots": _slots(s, d), "rejected": rejected}, {"clips": 5, "min_duration": 15.0}, {"style": "punch"})
    tables, settings, recipe = state.load()
    slots = tables["slots"].selectExpr("'slot' AS kind", "episode_id", "index", "start", "end")
    rows = slots.unionByName(tables["rejected"].selectExpr("'rejected' AS kind", "episode_id", "0 AS index", "start", "end"))
    same, other = (export.usable(settings, {"clips": 5, "min_duration": x}) for x in (15.0, 20.0))
    kept, void = (export.adopt_recipe(recipe, {"style": x})[1] for x in ("punch", "calm"))
    return rows.select("*", F.lit(same).alias("usable"), F.lit(other).alias("usable_after_change"), F.lit(kept).alias("void"), F.lit(void).alias("void_after_change"))


@query
def rendered_files(s: SparkSession, d: str) -> DataFrame:
    """Files marked as rendered, some again at other times, and only those kept that are still planned."""
    plans = export.plan(_clips(s, d), export.platforms(s, ("reels", "square")))
    timed = plans.join(_clips(s, d), ["episode_id", "clip"])
    done = timed.selectExpr("episode_id", "clip", "filename", "start", "end", "'' AS edit")
    again = done.where("clip % 3 = 1").selectExpr("episode_id", "filename", "start + 0.5D AS start", "end", "'x' AS edit")
    marked = export.mark_rendered(done.drop("clip"), again)
    return export.keep_rendered(marked, timed.where("platform = 'square' OR clip % 2 = 0").select("episode_id", "filename"))


def _edits(s: SparkSession, d: str) -> DataFrame:
    body = "concat('{\"unknown\": 1, ', array_join(filter(array(CASE WHEN clip % 2 = 0 THEN concat('\"start\": ', start + 0.5D) END, CASE WHEN clip % 3 = 0 THEN concat('\"end\": ', end - 0.25D) END, CASE WHEN clip % 5 = 0 THEN '\"gain_db\": 3.5' END), x -> x IS NOT NULL), ', '), '}')"
    return _clips(s, d).where("clip % 2 = 0 OR clip % 3 = 0 OR clip % 5 = 0").selectExpr("episode_id", "cast(clip AS string) AS clip", f"{body} AS edit")


@query
def clip_edits(s: SparkSession, d: str) -> DataFrame:
    rows = export.edited(_clips(s, d).where("end - start > 3"), export.edits(_edits(s, d)))
    return rows.selectExpr("episode_id", "clip", "start", "end", "edit.gain_db AS gain_db")


@query
def edit_fingerprints(s: SparkSession, d: str) -> DataFrame:
    return _edits(s, d).select("episode_id", F.col("clip").cast("int").alias("clip"), export.fingerprints(F.col("edit")).alias("fingerprint"))


@query
def word_style_tags(s: SparkSession, d: str) -> DataFrame:
    style = "CASE WHEN pos % 11 = 0 THEN NULL ELSE named_struct('bold', CASE pos % 3 WHEN 0 THEN true WHEN 1 THEN false END, 'italic', pos % 4 = 1, 'font', CASE pos % 5 WHEN 2 THEN 'Anton' WHEN 3 THEN '' END, 'size', CASE pos % 6 WHEN 1 THEN 48 WHEN 2 THEN 0 END, 'color', CASE pos % 7 WHEN 3 THEN '#12aBef' END) END"
    opening, closing = subtitles.word_tags(STYLES["punch"])
    return _words(s, d).selectExpr("episode_id", "pos", f"{style} AS style").selectExpr("episode_id", "pos", f"{opening} AS opening", f"{closing} AS closing")


@query
def typed_steps(s: SparkSession, d: str) -> DataFrame:
    rows = _segments(s, d).selectExpr("episode_id", "seg", f"inline({_TYPED})")
    return rows.selectExpr("episode_id", "seg", "round(from_, 6) AS from_", "round(to_, 6) AS to_", "shown")


_TYPED = subtitles.typed("text", "start", "end", 400)


@query
def entrance_tags(s: SparkSession, d: str) -> DataFrame:
    """The entrance and glow tags of every animation at each frame height."""
    rows = []
    for height in (720, 1280, 1920):
        for name in ("none", "pop", "zoom", "fade", "blur", "rise", "drop"):
            style = Style(animation=name, glow=height > 1000, glow_color="#10fF20" if height > 1500 else None).scaled(height)
            rows.append((name, height, subtitles.entrance(style, (540, 1500)), subtitles.entrance(style), subtitles.glow_tag(style)))
    return s.createDataFrame(rows, "animation string, height int, placed string, unplaced string, glow string")


@query
def output_sizes(s: SparkSession, d: str) -> DataFrame:
    rows = [(r, h, *subtitles.target_size(r, h), subtitles.scaled_width(w, 1080, subtitles.target_size(r, h)[1]), w) for r in subtitles.RATIOS for h in ("720p", "1080p", "odd") for w in (1440, 1920, 2538)]
    return s.createDataFrame(rows, "ratio string, resolution string, w int, h int, scaled int, src_w int")


@query
def pack_words(s: SparkSession, d: str) -> DataFrame:
    """The built-in pack with a document laid over it."""
    pack = INDONESIAN.merged({"name": "own", "markers": {"+intensity": ["Edan", "gila"], "stakes": ["Boncos"], "no such bank": ["x"]}, "weights": {"stakes": 3, "nothing": 1}, "thresholds": {"payload_words": 7}})
    rows = [(b, w) for b in ("intensity_markers", "stakes_markers", "first_person") for w in pack.bank(b)] + [("weight", f"{pack.weights['stakes']}"), ("payload", f"{pack.payload_words}"), ("name", pack.name)]
    return s.createDataFrame(rows, "bank string, word string")


@query
def lexicon_terms(s: SparkSession, d: str) -> DataFrame:
    lexicon = Lexicon({"new york": "Gotham", "teh": "the", "x": "KEITEN"}, ("Sutradara", "keiten", "gotham"), prompt_prefix="Says")
    return s.createDataFrame([(k, t, lexicon.prompt()) for k, t in enumerate(lexicon.terms())], "k int, term string, prompt string")


def _seats(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/supplier.parquet").selectExpr("s_suppkey % 20 AS episode_id", "cast(s_suppkey div 20 AS int) AS seat", "(s_suppkey * 37 % 64) / 64D AS center_x", "(s_suppkey * 53 % 64) / 64D AS center_y", "(8 + s_suppkey % 16) / 128D AS width", "(8 + s_suppkey % 32) / 128D AS height", "cast(1000 - s_suppkey % 400 AS bigint) AS samples")


@query
def split_views(s: SparkSession, d: str) -> DataFrame:
    return framing.split_crops(_seats(s, d), 1280, 720)


@query
def mouth_boxes(s: SparkSession, d: str) -> DataFrame:
    return _seats(s, d).selectExpr("episode_id", "seat", f"{framing.mouth_box(1280, 720)} AS b").select("episode_id", "seat", "b.*")


@query
def box_overlaps(s: SparkSession, d: str) -> DataFrame:
    box = "named_struct('x', cast({0} % 40 AS int), 'y', cast({1} % 30 AS int), 'w', cast(10 + {0} % 17 AS int), 'h', cast(10 + {1} % 13 AS int))"
    rows = s.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_orderkey", "l_linenumber", f"{box.format('l_partkey', 'l_suppkey')} AS a", f"{box.format('l_orderkey', 'l_linenumber')} AS b")
    return rows.selectExpr("l_orderkey", "l_linenumber", f"round({framing.iou('a', 'b')}, 9) AS iou")


@query
def remaining_times(s: SparkSession, d: str) -> DataFrame:
    rows = s.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey", "cast(o_orderkey % 5 AS int) AS done", "cast(o_orderkey % 97 AS double) AS spent")
    return rows.selectExpr("o_orderkey", f"{lifecycle.remaining('spent', 'done', '9')} AS left")


@query
def mel_weights(s: SparkSession, d: str) -> DataFrame:
    rows = [(m, k, float(w)) for rate, n in ((16_000, 26),) for m, row in enumerate(audio.mel_filters(n, 512, rate)) for k, w in enumerate(row) if w]
    return s.createDataFrame(rows, "filter int, bin int, weight double").withColumn("weight", F.round("weight", 9))


@query
def mfcc_frames(s: SparkSession, d: str) -> DataFrame:
    """Cepstra of a made-up signal for each supplier: 560 samples, two frames; and their mean and deviation over a longer one."""
    rows = s.read.parquet(f"{d}/supplier.parquet").selectExpr("s_suppkey", "transform(sequence(0, 559), n -> ((n * (s_suppkey % 37 + 3) * 7919 + n * n) % 2001) / 1000D - 1D) AS signal")
    return rows.select("s_suppkey", F.posexplode(audio.cepstra(F.col("signal"))).alias("frame", "c")).select("s_suppkey", "frame", F.posexplode("c").alias("k", "value")).withColumn("value", F.round("value", 6))
