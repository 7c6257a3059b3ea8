"""Greedy de-duplication, non-overlapping selection and replacement of candidates."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.views import q


def near_duplicates_dropped(scores: DataFrame, keep: int = 400, within: float = 3.0) -> DataFrame:
    """The pool: by raw score (then i, j), a window stays if none that stays starts and ends within `within` seconds of it;
    `keep` at most for each episode. Greedy by definition, so an episode's windows stream through one task in that order, as numbers only;
    what stays is held by cells of `within` seconds, of which a window meets nine. scores: calibrated."""

    def pick(batches):  # noqa: ANN001, ANN202
        cells: dict[tuple[float, float], list[tuple[float, float]]] = {}
        n = 0
        for batch in batches:
            at, places = [], []
            for r, (place, s, e) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("place", "start", "end")), strict=True)):
                if place == 1:
                    cells, n = {}, 0
                if n == keep:
                    continue
                x, y = s // within, e // within
                if not any(abs(a - s) < within and abs(b - e) < within for u in (x - 1, x, x + 1) for v in (y - 1, y, y + 1) for a, b in cells.get((u, v), ())):
                    cells.setdefault((x, y), []).append((s, e))
                    n += 1
                    at.append(r)
                    places.append(n)
            kept = batch.take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([*kept.columns[:-1], pa.array(places, pa.int32())], batch.schema.names)

    rows = scores.select("episode_id", "i", "j", "start", "end", "raw_score", "score", "percentile")
    out = T.StructType([*rows.schema.fields, T.StructField("place", T.IntegerType())])
    rows = q(rows.sparkSession, "SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY raw_score DESC, i, j) AS place FROM {rows}", rows=rows)
    # the window deals an episode to one task, in this order
    return rows.sortWithinPartitions("episode_id", F.desc("raw_score"), "i", "j").mapInArrow(pick, out)


_FOLD = """
aggregate({order}, cast(array() AS array<struct<start: double, end: double, i: int, j: int>>),
  (kept, c) -> CASE WHEN size(kept) >= {n} OR exists(kept, k -> c.start < k.end AND k.start < c.end) THEN kept
               ELSE concat(kept, array(struct(c.start AS start, c.end AS end, c.i AS i, c.j AS j))) END)
"""


def chosen(pool: DataFrame, n: int = 10, rejected: DataFrame | None = None) -> DataFrame:
    """Non-overlapping picks for each episode, best calibrated score first (ties: raw score, then i, j), numbered by time.

    A fold over the pool's intervals, which `near_duplicates_dropped` bounds. rejected: (episode_id, start, end) to leave out."""
    s = pool.sparkSession
    rows = pool
    if rejected is not None:
        rows = q(s, "SELECT p.* FROM {rows} p LEFT ANTI JOIN {rejected} r ON p.episode_id = r.episode_id AND round(p.start, 2) = round(r.start, 2) AND round(p.end, 2) = round(r.end, 2)", rows=rows, rejected=rejected)
    lists = q(s, "SELECT episode_id, array_sort(collect_list(struct(-score AS a, -raw_score AS b, i, j, start, end))) AS ranked FROM {rows} GROUP BY episode_id", rows=rows)
    picks = lists.selectExpr("episode_id", f"explode({_FOLD.format(order='ranked', n=n)}) AS c")
    return q(s, "SELECT episode_id, c.i AS i, c.j AS j, c.start AS start, c.end AS end, cast(row_number() OVER (PARTITION BY episode_id ORDER BY c.start) AS int) AS clip FROM {picks}", picks=picks)


def alternatives(pool: DataFrame, picks: DataFrame, clip: int = 1, mode: str = "different", rejected: DataFrame | None = None) -> DataFrame:
    """Ranked replacements for one clip of each episode: not rejected, not the clip itself, clear of the other clips, and sharing
    at most 0.3 of the shorter duration with it (different) or at least that (retime)."""
    s = pool.sparkSession
    test = "shared <= 0.3D" if mode == "different" else "shared >= 0.3D"
    gone = picks.where(f"clip = {clip}").select("episode_id", "start", "end")
    if rejected is not None:
        gone = gone.unionByName(rejected.select("episode_id", "start", "end"))
    return q(
        s,
        """
        WITH own AS (SELECT episode_id, start AS s0, end AS e0 FROM {picks} WHERE clip = """ + str(clip) + """),
        free AS (
          SELECT p.* FROM {pool} p
          LEFT ANTI JOIN {gone} g ON p.episode_id = g.episode_id AND round(p.start, 2) = round(g.start, 2) AND round(p.end, 2) = round(g.end, 2)
          LEFT ANTI JOIN {picks} c ON p.episode_id = c.episode_id AND c.clip <> """ + str(clip) + """ AND p.start < c.end AND c.start < p.end),
        shared AS (
          SELECT f.*, greatest(0D, least(f.end, o.e0) - greatest(f.start, o.s0)) / least(f.end - f.start, o.e0 - o.s0) AS shared FROM free f JOIN own o USING (episode_id))
        SELECT episode_id, i, j, start, end, score, shared, cast(row_number() OVER (PARTITION BY episode_id ORDER BY score DESC, raw_score DESC, i, j) AS int) AS choice FROM shared WHERE """ + test,
        picks=picks, pool=pool, gone=gone,
    )


def regenerated(pool: DataFrame, picks: DataFrame, clip: int = 1, mode: str = "different") -> DataFrame:
    """picks with one clip replaced by its best alternative; `different` falls back to `retime`; without any, the clip goes."""
    s = pool.sparkSession
    first = alternatives(pool, picks, clip, mode).where("choice = 1").selectExpr("episode_id", "i", "j", "start", "end", "0 AS turn")
    options = first
    if mode == "different":
        options = first.unionByName(alternatives(pool, picks, clip, "retime").where("choice = 1").selectExpr("episode_id", "i", "j", "start", "end", "1 AS turn"))
    best = q(s, "SELECT episode_id, b.i AS i, b.j AS j, b.start AS start, b.end AS end FROM (SELECT episode_id, min_by(struct(i, j, start, end), turn) AS b FROM {options} GROUP BY episode_id)", options=options)
    rest = picks.where(f"clip <> {clip}").select("episode_id", "i", "j", "start", "end")
    rows = rest.unionByName(best)
    return q(s, "SELECT episode_id, i, j, start, end, cast(row_number() OVER (PARTITION BY episode_id ORDER BY start) AS int) AS clip FROM {rows}", rows=rows)


def regenerated_all(pool: DataFrame, picks: DataFrame, n: int = 10) -> DataFrame:
    """A whole new choice: every pick is rejected."""
    return chosen(pool, n, picks.select("episode_id", "start", "end"))


def reserve_counts(pool: DataFrame, picks: DataFrame) -> DataFrame:
    """How many of the pool are neither picked nor equal to a pick."""
    rows = q(pool.sparkSession, "SELECT p.episode_id, c.clip FROM {pool} p LEFT JOIN (SELECT DISTINCT episode_id, start, end, 1 AS clip FROM {picks}) c ON p.episode_id = c.episode_id AND round(p.start, 2) = round(c.start, 2) AND round(p.end, 2) = round(c.end, 2)", pool=pool, picks=picks)
    return q(pool.sparkSession, "SELECT episode_id, count(*) AS pool, count(*) - count(clip) AS reserve FROM {rows} GROUP BY episode_id", rows=rows)


def ranked(scores: DataFrame, n: int = 10) -> DataFrame:
    """The plain ranking: non-overlapping windows, best provisional score first (ties: i, j), without a pool or calibration."""
    return chosen(scores.selectExpr("episode_id", "i", "j", "start", "end", "provisional AS score", "0D AS raw_score"), n)
