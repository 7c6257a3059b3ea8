"""Engine tables. On transcripts they are read from files; over the synthetic tables they are derived by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SEGMENT = "struct<start: double, end: double, text: string, speaker: string>"
WORD = "struct<start: double, end: double, text: string, confidence: double>"


def q(spark: SparkSession, text: str, **frames: object) -> DataFrame:
    """SQL over DataFrames named in braces."""
    return spark.sql(text, **frames)


#: Seconds of the stretches of time that joins on time go by.
BUCKET = 30.0


def stretches(df: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """df's rows once for each stretch of time (`bucket`) that they are in, with the first one (`bucket0`). Two intervals that overlap share the
    stretch greatest(bucket0, bucket0) exactly once, so they meet there and not in all their episode."""
    at = lambda x: f"cast(floor({x} / {BUCKET}D) AS bigint)"
    return df.where(f"{end} >= {start}").selectExpr("*", f"explode(sequence({at(start)}, {at(end)})) AS bucket", f"{at(start)} AS bucket0")


#: The condition under which rows a and b of `stretches` are to be compared.
MEET = "{0}.episode_id = {1}.episode_id AND {0}.bucket = {1}.bucket AND {0}.bucket = greatest({0}.bucket0, {1}.bucket0)"


#: Bytes of the files behind a table for which `dealt` makes a task.
TASK_BYTES = 4 << 20


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt to tasks by keys, the more tasks the larger the files that it comes from (the session's number of shuffle partitions at least),
    so that what a task sorts and holds does not grow with the input."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-size // TASK_BYTES)) if size < 1 << 50 else least, *keys)  # without files Spark says a huge size


def read_transcripts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(segments, words) of transcript files: one JSON object each, with `segments` and `words`, both mandatory.

    episode_id is the file's name. A missing speaker is null and a missing confidence 1.0."""
    raw = spark.read.schema(f"segments array<{SEGMENT}>, words array<{WORD}>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    return _opened(raw.selectExpr("regexp_extract(_metadata.file_name, '([^/]*?)([.]json)?$', 1) AS episode_id", "segments", "words"))


def read_transcript_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """read_transcripts for files of one transcript a line, each with its `episode_id`: files split, so that any number is read in parallel."""
    return _opened(spark.read.schema(f"episode_id string, segments array<{SEGMENT}>, words array<{WORD}>").option("mode", "FAILFAST").json(path))


def _opened(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    raw = raw.selectExpr("episode_id", "CASE WHEN segments IS NULL OR words IS NULL THEN raise_error('a transcript needs segments and words') ELSE segments END AS segments", "words")
    segments = raw.selectExpr("episode_id", "posexplode(segments) AS (seg, s)").selectExpr("episode_id", "seg", "s.start", "s.end", "s.text", "s.speaker")
    words = raw.selectExpr("episode_id", "posexplode(words) AS (pos, w)").selectExpr("episode_id", "pos", "w.start", "w.end", "w.text", "coalesce(w.confidence, 1D) AS confidence")
    return segments, words


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments of files that hold a bare JSON array of them."""
    rows = spark.read.schema("start double, end double, text string, speaker string").option("multiLine", True).json(path)
    rows = rows.selectExpr("regexp_extract(_metadata.file_name, '([^/]*?)([.]json)?$', 1) AS episode_id", "*")
    return q(rows.sparkSession, "SELECT episode_id, cast(row_number() OVER (PARTITION BY episode_id ORDER BY start, end) - 1 AS int) AS seg, start, end, text, speaker FROM {rows}", rows=rows)


def derived_segments(spark: SparkSession, sf_dir: str, of: str = "conversations") -> DataFrame:
    """Sentences of the table's texts on a synthetic clock: 0.25 s a word and, by seg % 4, 0.25, 0.5, 0.75 or 2 s of silence after.

    What follows a text's last stop is a sentence too. All times are multiples of 1/4, so sums are exact in any order. The last sentence of a user's turn becomes a question."""
    if of == "conversations":
        turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").selectExpr("conv_id AS episode_id", "turn", "role", "coalesce(text, '') AS text")
    else:
        turns = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id AS episode_id", "0L AS turn", "source AS role", "coalesce(text, '') AS text")
    parts = dealt(turns, "episode_id").selectExpr("episode_id", "turn", "role", "regexp_extract_all(text, '[^.!?]+[.!?]*', 0) AS parts")
    rows = parts.selectExpr("episode_id", "turn", "role", "size(parts) AS n", "posexplode(parts) AS (k, part)")
    rows = rows.selectExpr("episode_id", "turn", "k", "role AS speaker", "CASE WHEN role = 'user' AND k = n - 1 THEN regexp_replace(part, '[.]$', '?') ELSE part END AS part")
    rows = rows.selectExpr("episode_id", "turn", "k", "speaker", "regexp_replace(part, '^\\\\s+|\\\\s+$', '') AS text").where("length(text) > 0")
    return q(
        spark,
        """
        WITH numbered AS (SELECT *, cast(row_number() OVER (PARTITION BY episode_id ORDER BY turn, k) - 1 AS int) AS seg, size(split(text, '\\\\s+')) AS n_words FROM {rows}),
        timed AS (SELECT *, n_words * 0.25D AS dur, CASE seg % 4 WHEN 0 THEN 0.25D WHEN 1 THEN 0.5D WHEN 2 THEN 0.75D ELSE 2D END AS gap FROM numbered),
        placed AS (SELECT *, sum(dur + gap) OVER (PARTITION BY episode_id ORDER BY seg ROWS UNBOUNDED PRECEDING) - dur - gap AS start FROM timed)
        SELECT episode_id, seg, start, start + dur AS end, text, speaker FROM placed
        """,
        rows=rows,
    )


def derived_words(segments: DataFrame) -> DataFrame:
    """Words of the segments, 0.25 s each; confidence falls with the word's length and place."""
    rows = segments.selectExpr("episode_id", "seg", "start AS s0", "posexplode(split(text, '\\\\s+')) AS (k, text)")
    return q(
        rows.sparkSession,
        """
        SELECT episode_id, cast(row_number() OVER (PARTITION BY episode_id ORDER BY seg, k) - 1 AS int) AS pos, s0 + k * 0.25D AS start, s0 + (k + 1) * 0.25D AS end,
          text, 1D - ((length(text) + k) % 8) / 8D AS confidence, seg FROM {rows}
        """,
        rows=rows,
    )


def keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One track for each user of events: four samples a second."""
    events = dealt(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value"), "user_id")
    return q(
        spark,
        """
        SELECT user_id AS episode_id, cast(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS int) AS k,
          (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * 0.25D AS t,
          floor((value - floor(value)) * 1024) / 1024D AS center_x, event_type NOT IN ('error', 'view') AS confident,
          CASE WHEN event_type = 'click' THEN -1D ELSE floor(value * 4) % 16 / 4D END AS motion, event_type = 'signup' AS opens_shot FROM {events}
        """,
        events=events,
    )
