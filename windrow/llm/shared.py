"""Places and helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only a session that names none (a local test) gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = tempfile.mkdtemp(prefix="windrow-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Folders that `written` has made and nothing has dropped, in the order they were made.
_made: list[str] = []


@contextlib.contextmanager
def small_batches(spark: SparkSession, most: int | None) -> Iterator[None]:
    """What is run meanwhile hands Python `most` rows at once, if the session would hand it more."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = int(spark.conf.get(name))
    if most is None or 0 < usual <= most:
        yield
        return
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, str(usual))


def written(df: DataFrame, label: str, by: str | None = None, batch: int | None = None, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder (in a folder for each value of the column `by`), read again: cuts lineage, survives
    lost executors. batch: rows that Python gets at once, for rows with whole texts, which JVM and worker both hold."""
    path = f"{shared_dir(df.sparkSession)}/windrow-{label}-{uuid.uuid4().hex}"
    out = df.write.options(**options)
    with small_batches(df.sparkSession, batch):
        (out.partitionBy(by) if by else out).parquet(path)
    _made.append(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._windrow_path = path
    return found


def mark() -> int:
    """To be given to drop_since: tables written from now on."""
    return len(_made)


def drop_since(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Deletes the tables written since the mark but for those of `keep`. Whatever is still to be read must be written or kept."""
    kept = {getattr(x, "_windrow_path", None) for x in keep}
    gone = [x for x in _made[since:] if x not in kept]
    _made[since:] = [x for x in _made[since:] if x in kept]
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in gone:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def put_aside(df: DataFrame, made: tuple[str, ...], keep: list[str] | None = None) -> tuple[list[Column], list[Column]]:
    """Columns of df (`keep`, by default all, but for those named like one of `made`, in any case) under names that no result or
    helper has, and the same columns under their own names again."""
    names = [c for c in (keep if keep is not None else df.columns) if c.lower() not in made]
    return [df[f"`{c}`"].alias(f"own_{i}__") for i, c in enumerate(names)], [F.col(f"own_{i}__").alias(c) for i, c in enumerate(names)]


def share_below(most: Column, there: Column) -> Column:
    """The bigint below which a share most / there of all xxhash64 values lies, for any number of rows (1e11 rows still leave `most`)."""
    return (F.lit(-(2.0**63)) + F.least(F.lit(1.0), most / there) * F.lit(2.0**64 - 2.0**12)).cast("bigint")


#: In a Python worker: what drops the tables that an operator keeps there between tasks, by the operator's name.
_held: dict[str, Callable[[], None]] = {}


def holds(name: str, drop: Callable[[], None]) -> None:
    _held[name] = drop


def holding(name: str) -> None:
    """At the start of a worker's task: drops the tables of other operators that ran in the same worker, and gives memory that
    tasks before have freed back to the system. Workers outlive tasks, so what they keep would add up over a pipeline's stages."""
    for other, drop in _held.items():
        if other != name:
            drop()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def importable(spark: SparkSession) -> None:
    """Python workers find this package where the driver found it."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH")) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
