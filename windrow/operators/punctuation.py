"""Sentence ends that a transcript lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import text as T
from ..sources.views import q

# An episode with fewer ends than this share is repaired; a silence this long ends a sentence.
ENOUGH, PAUSE = 0.2, 0.35
_ENDS = "rlike '[.!?…,]$'"


def stripped(segments: DataFrame) -> DataFrame:
    """For queries: segments whose punctuation is gone in two episodes of three."""
    return segments.selectExpr("episode_id", "seg", "start", "end", "CASE WHEN episode_id % 3 = 0 THEN text ELSE regexp_replace(text, '[.!?,]+$', '') END AS text", "speaker")


def share(segments: DataFrame) -> DataFrame:
    """(episode_id, share, needs): how many segments end in . ! ? … or a comma, and whether that is too few."""
    rows = segments.selectExpr("episode_id", f"cast({T.trimmed('text')} {_ENDS} AS double) AS e")
    return q(segments.sparkSession, f"SELECT episode_id, avg(e) AS share, avg(e) < {ENOUGH}D AS needs FROM {{rows}} GROUP BY episode_id", rows=rows)


def restored(segments: DataFrame) -> DataFrame:
    """Segments of episodes that need it get a full stop before a pause and at the end; others stay as they are."""
    rows = segments.selectExpr("*", f"{T.trimmed('text')} AS t")
    return q(
        segments.sparkSession,
        f"""
        WITH seen AS (SELECT *, lead(start) OVER (PARTITION BY episode_id ORDER BY seg) - end AS gap, avg(cast(t {_ENDS} AS double)) OVER (PARTITION BY episode_id) < {ENOUGH}D AS needs FROM {{rows}})
        SELECT episode_id, seg, start, end, CASE WHEN needs AND t <> '' AND NOT t {_ENDS} AND coalesce(gap, {PAUSE}D) >= {PAUSE}D THEN concat(t, '.') ELSE text END AS text, speaker FROM seen
        """,
        rows=rows,
    )
