"""Best-two-fit packing of pieces into sequences of fixed capacity.

Pieces have whole lengths from 1 to the capacity, so all that the packer has to know is how many there are of each
length: `capacity` numbers at most, whatever the corpus. It makes sequence patterns from them on the driver: fill
greedily with the largest piece that still fits; then take out the smallest and put in two unpacked pieces if those fit
the expanded gap more tightly; and use the pattern as often as pieces last. Every pattern runs a length short, so there
are few of them. The r-th piece of a length then finds its sequence and offset by its rank alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lexing import transducer
from .shared import holding, importable, partitions, written

#: Documents that are taken together.
_ROWS = 1000


def cut_pieces(df: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Each document's ids (null text: empty) with end_id after them, cut into pieces of capacity, the last one shorter:
    doc_id, uid (tells rows of the same doc_id apart), piece, start, length, ids_crc32. Other columns are not read."""
    importable(df.sparkSession)
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        holding("lexing")
        machine, uid = transducer(tokenizer_path), TaskContext.get().partitionId() << 33
        for whole in batches:
            for k in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(k, _ROWS)
                ids, counts = machine.encode(batch.column("text").to_pylist())
                out: list[list] = [[], [], [], [], [], []]
                at = 0
                for doc, n in zip(batch.column("id").to_pylist(), counts.tolist(), strict=True):
                    own = np.append(ids[at : at + n], np.uint32(end_id)).astype("<u4")
                    for j, a in enumerate(range(0, n + 1, capacity)):
                        x = own[a : a + capacity]
                        for col, v in zip(out, (doc, uid, j, a, len(x), zlib.crc32(x)), strict=True):
                            col.append(v)
                    at += n
                    uid += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "uid", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id bigint, uid bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def patterns(counts: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """counts[n]: pieces of length n. Returns (how often, lengths in order) until all pieces are used."""
    left = counts.astype(np.int64).copy()
    grid = np.arange(capacity + 1)
    out = []
    while left.any():
        fits = np.maximum.accumulate(np.where(left > 0, grid, 0))
        used: dict[int, int] = {}
        bin_: list[int] = []

        def take(n: int) -> None:
            used[n] = used.get(n, 0) + 1
            bin_.append(n)

        def largest(most: int) -> int:
            n = int(fits[most])
            while n and left[n] <= used.get(n, 0):
                n = int(fits[n - 1])
            return n

        gap = capacity
        while gap and (n := largest(gap)):
            take(n)
            gap -= n
        if gap:
            small = bin_[-1]
            room, spare = gap + small, left.copy()
            for n, k in used.items():
                spare[n] -= k
            spare[small] += 1
            have = np.flatnonzero(spare[: room + 1] > 0)
            have = have[have > 0]
            near = np.maximum.accumulate(np.where(spare > 0, grid, 0))
            other = near[np.minimum(room - have, have)]
            same = (other == have) & (spare[have] < 2)
            other[same] = near[have[same] - 1]
            total = np.where(other > 0, have + other, 0)
            if len(total) and (best := int(total.argmax())) >= 0 and total[best] > small:
                bin_.pop()
                used[small] -= 1
                take(int(have[best]))
                take(int(other[best]))
        times = min(int(left[n]) // k for n, k in used.items() if k)
        for n, k in used.items():
            left[n] -= times * k
        out.append((times, bin_))
    return out


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """pieces (with an integer length from 1 to capacity, and columns that tell rows apart) with sequence_id and offset.

    Sequences are gapless from 0. Rows of one length are ranked in salted cells, so no length makes a large task. Equal rows
    get different places. A length that is null or out of range is an error. An empty table gives an empty one.
    pieces is read three times: pass a written table.
    """
    spark = pieces.sparkSession
    importable(spark)
    cols = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    rows = pieces.select(*cols)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*cols), F.lit(partitions(spark))).cast("int"))
    found = rows.groupBy("length").count().collect()  # a row for each length: capacity bounds them
    counts = np.zeros(capacity + 1, np.int64)
    for n, k in found:
        if n is None or not 1 <= n <= capacity:
            raise ValueError(f"{k} pieces of length {n}")
        counts[n] = k
    used, first = np.zeros(capacity + 1, np.int64), 0
    keys, bases, uses, slots, offsets = [], [], [], [], []
    for times, bin_ in patterns(counts, capacity):
        at: dict[int, list[int]] = {}
        place = 0
        for n in bin_:
            at.setdefault(n, []).append(place)
            place += n
        for n, places in at.items():
            keys.append((n << 44) + int(used[n]))
            bases.append(first)
            uses.append(len(places))
            slots.append(len(offsets))
            offsets += places
            used[n] += times * len(places)
        first += times
    order = np.argsort(np.array(keys, np.int64))
    key, base, use, slot, offset = np.array(keys, np.int64)[order], np.array(bases, np.int64)[order], np.array(uses, np.int64)[order], np.array(slots, np.int64)[order], np.array(offsets, np.int64)
    schema = rows.schema.add("sequence_id", "long").add("offset", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            i = np.searchsorted(key, (n << 44) + rank, side="right") - 1
            k = rank - (key[i] & ((1 << 44) - 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in cols), pa.array(base[i] + k // use[i], pa.int64()), pa.array(offset[slot[i] + k % use[i]], pa.int64())], names=[*cols, "sequence_id", "offset"])

    cells = salted.groupBy("length", "_salt").count()
    cells = cells.withColumn("_before", F.sum("count").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)))
    cells = cells.select("length", "_salt", F.coalesce("_before", F.lit(0)).alias("_before"))
    ranked = salted.withColumn("_nth", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*cols)))
    ranked = ranked.join(cells, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_nth") - 1)
    return ranked.select(*cols, "_rank").mapInArrow(run, schema)


def pack_documents(df: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """cut_pieces, then pack. Documents that share an id are packed each by itself."""
    return pack(written(cut_pieces(df, tokenizer_path, capacity, end_id, text_col, id_col), "pieces", batch=_ROWS), capacity)
