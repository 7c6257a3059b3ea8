"""Export planning, clip numbers, edits and resumable state."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PLATFORM_COLUMNS, PLATFORMS
from ..sources.views import q


def platforms(spark: SparkSession, keys: tuple[str, ...] | None = None) -> DataFrame:
    """The platform dimension (six rows at most). An unknown key is an error."""
    known = {p[0]: p for p in PLATFORMS}
    if bad := [k for k in keys or () if k not in known]:
        raise ValueError(f"unknown platforms: {', '.join(bad)}; known: {', '.join(sorted(known))}")
    return spark.createDataFrame([known[k] for k in (keys or known)], PLATFORM_COLUMNS)


def caption_margins(rows: DataFrame, headroom: float = 0.03) -> DataFrame:
    """Platforms with their caption margins as shares of the frame."""
    return rows.selectExpr("key", f"least(0.45D, bottom_ui + {headroom}D) AS bottom_margin", f"least(0.3D, greatest(left_ui, right_ui) + {headroom}D) AS side_margin", f"least(0.35D, top_ui + {headroom}D) AS title_top_margin")


def plan(clips: DataFrame, rows: DataFrame, style: str = "punch", resolution: str = "1080p") -> DataFrame:
    """One row for each output file: clips (with clip number) joined to the platforms whose length limits they meet."""
    return q(
        clips.sparkSession,
        f"""
        SELECT /*+ BROADCAST(p) */ c.episode_id, c.clip, p.key AS platform, format_string('clip_%02d_%s.mp4', c.clip, p.key) AS filename, p.ratio, '{resolution}' AS resolution, concat('{style}@', p.key) AS style
        FROM {{clips}} c JOIN {{rows}} p ON c.end - c.start >= p.min_duration AND (p.max_duration IS NULL OR c.end - c.start <= p.max_duration)
        """,
        clips=clips, rows=rows,
    )


def unplaced(clips: DataFrame, rows: DataFrame) -> DataFrame:
    """Clips that no platform takes, with the reason."""
    return q(
        clips.sparkSession,
        """
        WITH lim AS (SELECT array_join(transform(array_sort(collect_list(struct(name, min_duration, max_duration))), x -> format_string('%s %.0f-%ss', x.name, x.min_duration, coalesce(cast(x.max_duration AS string), 'unlimited'))), ', ') AS all FROM {rows})
        SELECT c.episode_id, c.clip, format_string('%.0fs fits none of: %s', bround(c.end - c.start), lim.all) AS reason FROM {clips} c CROSS JOIN lim
        WHERE NOT EXISTS (SELECT 1 FROM {rows} p WHERE c.end - c.start >= p.min_duration AND (p.max_duration IS NULL OR c.end - c.start <= p.max_duration))
        """,
        clips=clips, rows=rows,
    )


def restored(slots: DataFrame, pool: DataFrame) -> DataFrame:
    """slots (episode_id, index, start, end) found in the pool by their rounded times (of equal keys the last wins). An
    episode with any slot that is not found is not restored at all."""
    return q(
        slots.sparkSession,
        """
        WITH keyed AS (SELECT episode_id, round(start, 2) AS ks, round(end, 2) AS ke, max_by(struct(i, j, start, end), struct(i, j)) AS c FROM {pool} GROUP BY episode_id, round(start, 2), round(end, 2)),
        found AS (SELECT s.episode_id, s.index, k.c FROM {slots} s LEFT JOIN keyed k ON k.episode_id = s.episode_id AND k.ks = round(s.start, 2) AND k.ke = round(s.end, 2)),
        whole AS (SELECT episode_id FROM found GROUP BY episode_id HAVING bool_and(c IS NOT NULL))
        SELECT episode_id, index, c.i AS i, c.j AS j, c.start AS start, c.end AS end FROM found JOIN whole USING (episode_id)
        """,
        slots=slots, pool=pool,
    )


def numbered(picks: DataFrame, slots: DataFrame) -> DataFrame:
    """picks (episode_id, start, end) with clip numbers: a pick that a slot holds keeps its number, the others get the smallest
    numbers that no held pick has, by time."""
    return q(
        picks.sparkSession,
        """
        WITH held AS (SELECT p.episode_id, p.start, p.end, max(s.index) AS held FROM {picks} p LEFT JOIN {slots} s ON s.episode_id = p.episode_id AND round(s.start, 2) = round(p.start, 2) AND round(s.end, 2) = round(p.end, 2) GROUP BY p.episode_id, p.start, p.end),
        ordered AS (SELECT *, sum(CASE WHEN held IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY episode_id ORDER BY start, end ROWS UNBOUNDED PRECEDING) AS nth FROM held),
        taken AS (SELECT episode_id, collect_set(held) AS taken, count(*) AS n FROM held GROUP BY episode_id),
        free AS (SELECT episode_id, filter(sequence(1, cast(n AS int) + size(taken) + 1), x -> NOT array_contains(taken, x)) AS free FROM taken)
        SELECT episode_id, start, end, coalesce(held, try_element_at(free, cast(nth AS int))) AS clip FROM ordered JOIN free USING (episode_id)
        """,
        picks=picks, slots=slots,
    )


def stale(plans: DataFrame, clips: DataFrame, rendered: DataFrame) -> DataFrame:
    """Planned files that are not rendered yet, or were from other times or another edit.

    rendered: (episode_id, filename, start, end, edit), with an empty edit for none; clips may have an edit column."""
    edit = "c.edit" if "edit" in clips.columns else "''"
    return q(
        plans.sparkSession,
        f"""
        SELECT p.episode_id, p.clip, p.platform, p.filename FROM {{plans}} p JOIN {{clips}} c USING (episode_id, clip)
        LEFT ANTI JOIN {{rendered}} r ON r.episode_id = p.episode_id AND r.filename = p.filename AND r.start = round(c.start, 2) AND r.end = round(c.end, 2) AND r.edit = {edit}
        """,
        plans=plans, clips=clips, rendered=rendered,
    )


def mark_rendered(rendered: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert: the new rows, and the old ones of other files."""
    return new.unionByName(rendered.join(new.select("episode_id", "filename"), ["episode_id", "filename"], "left_anti"))


def keep_rendered(rendered: DataFrame, files: DataFrame) -> DataFrame:
    return rendered.join(files.select("episode_id", "filename"), ["episode_id", "filename"], "left_semi")


def adopt_recipe(stored: dict, wanted: dict) -> tuple[dict, bool]:
    """The recipe to go on with, and whether everything rendered under the stored one is void."""
    return dict(wanted), bool(stored) and stored != wanted


def usable(stored: dict, wanted: dict) -> bool:
    return all(stored.get(k) == v for k, v in wanted.items())


EDIT = ("start", "end", "keep_spans", "gain_db", "words")
EDIT_SCHEMA = "start double, end double, keep_spans array<array<double>>, gain_db double, words array<struct<start: double, end: double, text: string, style: struct<bold: boolean, italic: boolean, font: string, size: int, color: string>>>"


def edits(rows: DataFrame, column: str = "edit") -> DataFrame:
    """rows whose JSON edits are read into `edit`: unknown fields are ignored, missing ones null; clip numbers may be text."""
    return rows.selectExpr(f"* EXCEPT ({column}, clip)", "cast(clip AS int) AS clip", f"from_json({column}, '{EDIT_SCHEMA}') AS edit")


def fingerprint(edit: dict) -> str:
    """Twelve hex digits for an edit; empty for one that changes nothing. Stored next to a file's times, byte for byte."""
    own = {k: edit.get(k) for k in EDIT}
    if all(v is None for v in own.values()):
        return ""
    return hashlib.sha1(json.dumps(own, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:12]


def fingerprints(edit: Column) -> Column:
    """fingerprint of a column of JSON edits; null counts as none."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fingerprint(json.loads(t) if t else {}))

    return run(edit)


def edited(clips: DataFrame, rows: DataFrame) -> DataFrame:
    """clips with the start and end that edits (episode_id, clip, edit) set; a clip under one second is an error."""
    out = q(clips.sparkSession, "SELECT c.* EXCEPT (start, end), coalesce(e.edit.start, c.start) AS start, coalesce(e.edit.end, c.end) AS end, e.edit FROM {clips} c LEFT JOIN {rows} e USING (episode_id, clip)", clips=clips, rows=rows)
    return out.selectExpr("* EXCEPT (end)", "CASE WHEN (edit.start IS NOT NULL OR edit.end IS NOT NULL) AND end - start < 1 THEN raise_error(format_string('clip %d would be %.1fs long', clip, end - start)) ELSE end END AS end")


def preview(clips: DataFrame) -> DataFrame:
    """The dry run's rows by clip number."""
    return clips.selectExpr("episode_id", "clip", "round(start, 2) AS start", "round(end, 2) AS end", "round(end - start, 2) AS duration", "* EXCEPT (episode_id, clip, start, end)").orderBy("episode_id", "clip")


class State:
    """A run's state as tables in a folder: slots, rejected, rendered, recipe, settings. Missing or unreadable: None."""

    TABLES = ("slots", "rejected", "rendered")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def save(self, tables: dict[str, DataFrame], settings: dict, recipe: dict) -> None:
        for name in self.TABLES:
            if name in tables:
                tables[name].write.mode("overwrite").parquet(f"{self.path}/{name}")
        self.spark.createDataFrame([(json.dumps(settings), json.dumps(recipe))], "settings string, recipe string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/meta")

    def load(self) -> tuple[dict[str, DataFrame], dict, dict] | None:
        from pyspark.errors import PySparkException

        try:
            meta = self.spark.read.parquet(f"{self.path}/meta").collect()[0]
            found = {}
            for name in self.TABLES:
                try:
                    found[name] = self.spark.read.parquet(f"{self.path}/{name}")
                except PySparkException:
                    continue
            return found, json.loads(meta["settings"]), json.loads(meta["recipe"])
        except (PySparkException, IndexError, ValueError):
            return None
