"""A dry run from transcripts to clips, export plans and caption packs, with resumable state."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

from ..config import INDONESIAN, Pack
from ..operators import captions, export, punctuation, scoring, selection, timeline, topics
from ..sources.staging import settled
from ..sources.views import q


@dataclass(frozen=True)
class Settings:
    """What a run is asked for. Unknown names are ignored by `of`."""

    out: str = ""
    clips: int = 5
    min_duration: float = 15.0
    max_duration: float = 75.0
    hard_max: float = 150.0
    no_extend: bool = False
    no_trim_silence: bool = False
    fresh: bool = False
    platforms: str = "tiktok,reels,shorts"
    style: str = "punch"
    resolution: str = "720p"

    @classmethod
    def of(cls, values: dict) -> Settings:
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in values.items() if k in known})

    def decides_pool(self) -> dict:
        return {"clips": self.clips, "min_duration": self.min_duration, "max_duration": self.max_duration}


@dataclass(frozen=True)
class Result:
    pool: DataFrame
    clips: DataFrame
    timelines: DataFrame
    plan: DataFrame
    unplaced: DataFrame
    packs: DataFrame


def remaining(spent: str, done: str, total: str) -> str:
    """What to say of the time left, as an expression over seconds spent and files done; nothing before the first file is done."""
    left = f"{spent} / {done} * ({total} - {done})"
    return f"CASE WHEN {done} < 1 THEN '' WHEN {left} < 90 THEN format_string('  about %.0fs left', rint({left})) ELSE format_string('  about %.0fm left', rint({left} / 60)) END"


class Stopped(Exception):
    pass


def dry_run(spark: SparkSession, segments: DataFrame, words: DataFrame, settings: Settings | None = None, pack: Pack = INDONESIAN, edits: DataFrame | None = None, rejected: DataFrame | None = None, on_progress: Callable[[str], None] | None = None, should_stop: Callable[[], bool] | None = None) -> Result:
    """All stages up to, and without, media work, for every episode of segments and words at once.

    Punctuation is repaired where it lacks; all windows are scored and calibrated, near duplicates collapse, clips are chosen (or
    restored from settings.out), numbered, extended to their subject's end unless they would run into the next clip,
    moved to a real opening, edited, trimmed of dead air and planned for each platform.

    rejected (episode_id, start, end): windows that were turned down. They are remembered in settings.out with those of earlier runs, and
    none is chosen again while the settings that decide the pool stay the same."""
    settings = settings or Settings()
    said, stop = on_progress or (lambda _: None), should_stop or (lambda: False)

    def stage(name: str) -> None:
        if stop():
            raise Stopped(name)
        said(name)

    stage("features")
    feats = settled(scoring.features(punctuation.restored(segments), pack), "features")
    stage("scoring")
    scores = settled(scoring.explained(scoring.calibrated(scoring.scored(scoring.candidate_windows(feats, pack, settings.min_duration, settings.max_duration), pack))), "scores")
    pool = settled(selection.near_duplicates_dropped(scores), "pool")
    stage("selection")
    state = export.State(spark, settings.out) if settings.out else None
    stored = state.load() if state and not settings.fresh else None
    fits = bool(stored) and export.usable(stored[1], settings.decides_pool())
    turned = stored[0].get("rejected") if fits else None
    if rejected is not None:
        turned = rejected.select("episode_id", "start", "end") if turned is None else turned.unionByName(rejected.select("episode_id", "start", "end")).distinct()
    turned = settled(turned, "rejected") if turned is not None else None
    picks = settled(selection.chosen(pool, settings.clips, turned), "picks")
    slots = stored[0].get("slots") if fits else None
    if slots is not None and rejected is not None:  # an episode with a clip turned down is chosen anew
        slots = slots.join(rejected.select("episode_id").distinct(), "episode_id", "left_anti")
    if slots is not None:
        old = settled(export.restored(slots, pool).selectExpr("episode_id", "i", "j", "start", "end", "cast(index AS int) AS clip"), "restored")
        picks = settled(old.unionByName(picks.join(old.select("episode_id").distinct(), "episode_id", "left_anti")), "picks")
    clips = picks.join(scores.select("episode_id", "i", "j", "score", "why"), ["episode_id", "i", "j"])
    if not settings.no_extend:
        stage("boundaries")
        longer = settled(topics.extended(picks, feats, pack, settings.hard_max), "longer")
        longer = q(spark, "SELECT e.episode_id, e.clip, e.end AS new_end FROM {e} e LEFT ANTI JOIN {p} p ON p.episode_id = e.episode_id AND p.start > e.end - e.added AND p.start < e.end", e=longer, p=picks)
        clips = settled(q(spark, "SELECT c.* EXCEPT (end), coalesce(l.new_end, c.end) AS end FROM {c} c LEFT JOIN {l} l USING (episode_id, clip)", c=clips, l=longer), "clips")
        moved = topics.real_openings(clips.select("episode_id", "clip", "start", "end"), feats).selectExpr("episode_id", "clip", "start AS new_start")
        moved = settled(moved, "moved")
        clips = q(spark, "SELECT c.* EXCEPT (start), coalesce(m.new_start, c.start) AS start FROM {c} c LEFT JOIN {m} m USING (episode_id, clip)", c=clips, m=moved)
    if edits is not None:
        clips = export.edited(clips, edits).drop("edit")
    clips = settled(clips.select("episode_id", "clip", "i", "j", "start", "end", "score", "why"), "clips")
    stage("planning")
    lines = settled(timeline.timelines(words, clips), "timelines") if not settings.no_trim_silence else clips.selectExpr("*", "array(struct(start, end)) AS spans", "end - start AS duration", "0 AS cuts", "0D AS removed")
    rows = export.platforms(spark, tuple(settings.platforms.split(",")))
    texts = q(spark, "SELECT c.episode_id, c.clip, c.start, c.end, c.score, c.why, array_join(transform(array_sort(collect_list(struct(f.seg, f.t))), x -> x.t), ' ') AS text FROM {c} c JOIN {f} f ON f.episode_id = c.episode_id AND f.start >= c.start AND f.end <= c.end GROUP BY ALL", c=clips, f=feats)
    packs = captions.packs(texts, pack)
    if state:
        found = picks.selectExpr("episode_id", "clip AS index", "start", "end")
        tables = {"slots": settled(found, "slots")} | ({"rejected": turned} if turned is not None else {})
        state.save(tables, settings.decides_pool(), {"style": settings.style, "resolution": settings.resolution})
        export.preview(clips).write.mode("overwrite").json(f"{settings.out.rstrip('/')}/dry_run")
    stage("done")
    return Result(pool, clips, lines, export.plan(clips, rows, settings.style, settings.resolution), export.unplaced(clips, rows), packs)
