"""An extension: the batch operators over transcripts that arrive as a stream of segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Pack
from ..operators.scoring import features

SCHEMA = "episode_id bigint, seg int, start double, end double, text string, speaker string, said_at timestamp"


def read(spark: SparkSession, path: str, files: int = 16) -> DataFrame:
    """Segments from JSON lines files as they are put into a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).json(path)


def speech_sessions(segments: DataFrame, pause: str = "30 seconds", late: str = "2 minutes") -> DataFrame:
    """(episode_id, start, end, segments, words): runs of speech with no longer pause than `pause`; rows later than `late` are dropped."""
    rows = segments.withWatermark("said_at", late).withColumn("n", F.size(F.split("text", r"\s+")))
    runs = rows.groupBy("episode_id", F.session_window("said_at", pause).alias("w")).agg(F.count("*").alias("segments"), F.sum("n").alias("words"))
    return runs.select("episode_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "segments", "words")


def keep_features(segments: DataFrame, pack: Pack, path: str, checkpoint: str) -> StreamingQuery:
    """Segment features appended to a table, one batch after another, each written once: a batch goes to a folder of its own
    that a repeated run of it replaces."""

    def each(batch: DataFrame, number: int) -> None:
        features(batch.drop("said_at"), pack).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return segments.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
