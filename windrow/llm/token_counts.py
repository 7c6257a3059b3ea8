"""Token counts by a compiled finite-state tokenizer (see lexing)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexing import transducer
from .shared import holding, importable


def count_tokens(df: DataFrame, tokenizer_path: str, text_col: str = "text", id_col: str = "doc_id", limit: int = 1024) -> DataFrame:
    """One row for each row of df: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty: 0 bytes, 0 tokens. Ids may be null or repeat; each row is counted by itself, and
    columns other than the id and the text are not read. An empty table gives an empty table. Long texts are taken
    in blocks, so memory is bounded by a block and the longest single pretoken. No shuffle.
    """
    importable(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding("lexing")
        machine = transducer(tokenizer_path)
        for batch in batches:
            n = machine.counts(batch.column("text").to_pylist())
            size = pa.compute.binary_length(batch.column("text")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), size, pa.array(n, pa.int64()), pa.array(n > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    out = rows.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
