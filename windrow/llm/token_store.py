"""Token ids on disk: independent Huffman-coded blocks with bit-offset checkpoints.

A store is a folder of two Parquet tables. `code` has the code length of each id that occurs; canonical order makes
the codewords. `blocks` has, for each range part and in ascending document order within it, blocks of whole pieces:
the pieces' document ids, numbers and token counts, their code bits (each piece starts at a byte) and, for each further
256 tokens of a piece, a checkpoint (distance in bits from the one before). A block decodes by itself, and all
its checkpoints decode at once.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .huffman import STRIDE, Code, crc_join
from .lexing import transducer
from .shared import drop_since, holding, importable, mark, partitions, shared_dir, written

#: Tokens of a piece at most, and of a block once it is closed.
PIECE = BLOCK_TOKENS = 1 << 16
_BLOCK = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int64())), ("uids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())), ("last", pa.list_(pa.bool_())), ("counts", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("payload", pa.binary()), ("marks", pa.binary())])
_BLOCK_DDL = "part int, first bigint, n_tokens bigint, ids array<bigint>, uids array<bigint>, pieces array<int>, last array<boolean>, counts array<int>, sizes array<int>, payload binary, marks binary"


def _tokenized(df: DataFrame, tokenizer_path: str, end_id: int | None, text_col: str, id_col: str) -> DataFrame:
    """Pieces of the documents' ids, low and high bytes apart. uid tells documents of the same id apart."""
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding("lexing")
        machine, uid = transducer(tokenizer_path), TaskContext.get().partitionId() << 33
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                ids, counts = machine.encode(batch.column("text").to_pylist())
                out: list[list] = [[], [], [], [], [], [], []]
                at = 0
                for doc, n in zip(batch.column("id").to_pylist(), counts.tolist(), strict=True):
                    own = ids[at : at + n]
                    if end_id is not None:
                        own = np.append(own, np.uint32(end_id))
                    for j, a in enumerate(range(0, max(len(own), 1), PIECE)):
                        x = own[a : a + PIECE]
                        for col, v in zip(out, (doc, uid, j, a + PIECE >= len(own), len(x), (x & 255).astype(np.uint8).tobytes(), (x >> 8).astype("<u2" if machine.vocabulary > 65536 else np.uint8).tobytes()), strict=True):
                            col.append(v)
                    at += n
                    uid += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["id", "uid", "piece", "last", "n", "lo", "hi"])

    return rows.mapInArrow(run, "id bigint, uid bigint, piece int, last boolean, n int, lo binary, hi binary")


def _joined(lo: bytes, hi: bytes) -> np.ndarray:
    low = np.frombuffer(lo, np.uint8).astype(np.uint32)
    return low | np.frombuffer(hi, np.uint8 if len(hi) == len(lo) else "<u2").astype(np.uint32) << 8


def _counted(pieces: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Global counts of the ids: a row for each id at most comes to the driver, which the vocabulary bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for lo, hi in zip(batch.column("lo").to_pylist(), batch.column("hi").to_pylist(), strict=True):
                n = np.bincount(_joined(lo, hi), minlength=len(total))
                n[: len(total)] += total
                total = n
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], names=["token", "n"])

    rows = pieces.select("lo", "hi").mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).collect()
    rows.sort()
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)


def write_tokens(df: DataFrame, tokenizer_path: str, path: str | None = None, end_id: int | None = 0, text_col: str = "text", id_col: str = "doc_id", limit: int = 16) -> str:
    """Writes the ids of all documents in ascending id order; returns the store's path.

    A null text counts as empty; end_id (if any) follows each document. Documents of a null id come first; those that
    share an id keep the order they were read in, each with its own place. An empty table makes an empty store. Other columns are
    not read. Texts are tokenized once, into a table in the shared folder; what is shuffled into id order is coded.
    """
    spark = df.sparkSession
    importable(spark)
    path = path or f"{shared_dir(spark)}/windrow-tokens-{uuid.uuid4().hex}"
    since = mark()
    pieces = written(_tokenized(df, tokenizer_path, end_id, text_col, id_col), "ids", compression="zstd")
    code = Code.of(*_counted(pieces), limit)
    spark.createDataFrame(list(zip(code.ids.tolist(), code.bits.tolist(), strict=True)), "token bigint, bits bigint").coalesce(1).write.parquet(f"{path}/code")
    n = partitions(spark)
    bounds = np.unique(np.array(pieces.where("piece = 0").approxQuantile("id", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else [], np.float64))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [code.encode(_joined(lo, hi)) for lo, hi in zip(batch.column("lo").to_pylist(), batch.column("hi").to_pylist(), strict=True)]
            part = np.searchsorted(bounds, batch.column("id").fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), side="left")
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *(batch.column(c) for c in ("id", "uid", "piece", "last", "n")), pa.array([x for x, _ in done], pa.binary()), pa.array([x for _, x in done], pa.binary())], names=["part", "id", "uid", "piece", "last", "n", "payload", "marks"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, rows, held = 0, [], 0

        def block() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            got = {"part": cols[0][0], "first": first, "n_tokens": held, "ids": cols[1], "uids": cols[2], "pieces": cols[3], "last": cols[4], "counts": cols[5], "sizes": [len(x) for x in cols[6]], "payload": b"".join(cols[6]), "marks": b"".join(cols[7])}
            return pa.RecordBatch.from_pylist([got], schema=_BLOCK)

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                rows.append(row)
                held += row[5]
                if held >= BLOCK_TOKENS:
                    yield block()
                    first, held = first + held, 0
                    rows.clear()
        if rows:
            yield block()

    placed = pieces.mapInArrow(coded, "part int, id bigint, uid bigint, piece int, last boolean, n int, payload binary, marks binary")
    placed = placed.repartitionById(n, F.col("part")).sortWithinPartitions("part", F.col("id").asc_nulls_first(), "uid", "piece")
    placed.mapInArrow(packed, _BLOCK_DDL).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    drop_since(spark, since)
    return path


def _lanes(counts: np.ndarray, sizes: np.ndarray, marks: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each checkpoint's lane starts (in bits) and how many ids it has."""
    per = np.maximum((counts + STRIDE - 1) // STRIDE, 1)
    total = int(per.sum())
    piece = np.repeat(np.arange(len(counts)), per)
    nth = np.arange(total) - np.repeat(np.cumsum(per) - per, per)
    step = np.zeros(total, np.int64)
    step[nth > 0] = marks
    run = np.cumsum(step)
    run -= np.repeat(run[np.cumsum(per) - per], per)
    start = (base + np.cumsum(sizes) - sizes) * 8
    return start[piece] + run, np.minimum(counts[piece] - nth * STRIDE, STRIDE)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Decodes a store: a row for each document with doc_id, start (ids of all documents before it), n_tokens and
    ids_crc32; with_ids: a row for each piece instead, with doc_id, piece, start, n_tokens and ids.

    What reaches the driver is a total for each range part and the code's lengths."""
    importable(spark)
    code_rows = spark.read.parquet(f"{path}/code").collect()
    code = Code(np.array([r[0] for r in code_rows], np.int64), np.array([r[1] for r in code_rows], np.int64))
    blocks = spark.read.schema(_BLOCK_DDL).parquet(f"{path}/blocks")
    totals = sorted(blocks.groupBy("part").agg(F.sum("n_tokens")).collect())
    before, base = 0, {}
    for part, n in totals:
        base[part] = before
        before += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 32):
                b = whole.slice(k, 32).to_pydict()
                starts, lanes, at = [], [], 0
                for counts, sizes, payload, marks in zip(b["counts"], b["sizes"], b["payload"], b["marks"], strict=True):
                    s, m = _lanes(np.array(counts, np.int64), np.array(sizes, np.int64), np.frombuffer(marks, "<u2").astype(np.int64), at)
                    starts.append(s)
                    lanes.append(m)
                    at += len(payload)
                ids = code.decode(b"".join(b["payload"]), np.concatenate(starts), np.concatenate(lanes)).astype("<u4")
                counts = np.array([n for x in b["counts"] for n in x], np.int64)
                first = np.concatenate([base[p] + f + np.cumsum([0, *x[:-1]]) for p, f, x in zip(b["part"], b["first"], b["counts"], strict=True)])
                cut = np.concatenate([[0], np.cumsum(counts)])
                flat = lambda name: [x for y in b[name] for x in y]  # noqa: B023, E731
                if with_ids:
                    found = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids, pa.int64()))
                else:
                    found = pa.array([zlib.crc32(ids[i:j]) for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(flat("ids"), pa.int64()), pa.array(flat("uids"), pa.int64()), pa.array(flat("pieces"), pa.int32()), pa.array(flat("last"), pa.bool_()), pa.array(first, pa.int64()), pa.array(counts, pa.int64()), found], names=["doc_id", "uid", "piece", "last", "start", "n_tokens", "found"])

    kind = "array<bigint>" if with_ids else "bigint"
    got = blocks.mapInArrow(run, f"doc_id bigint, uid bigint, piece int, last boolean, start bigint, n_tokens bigint, found {kind}")
    if with_ids:
        return got.select("doc_id", "piece", "start", "n_tokens", F.col("found").alias("ids"))
    long = blocks.where(F.exists("last", lambda x: ~x)).limit(1).count() > 0
    one = got.where("piece = 0 AND last").select("doc_id", "start", "n_tokens", F.col("found").alias("ids_crc32"))
    if not long:
        return one

    def join(key: tuple, batch: pa.Table) -> pa.Table:
        rows = sorted(zip(*(batch.column(c).to_pylist() for c in ("piece", "start", "n_tokens", "found", "doc_id")), strict=True))
        crc = 0
        for _, _, n, c, _ in rows:
            crc = crc_join(crc, c, n * 4)
        return pa.table({"doc_id": pa.array([rows[0][4]], pa.int64()), "start": [rows[0][1]], "n_tokens": [sum(r[2] for r in rows)], "ids_crc32": [crc]})

    more = got.where("NOT (piece = 0 AND last)").groupBy("uid").applyInArrow(join, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return one.unionByName(more)
