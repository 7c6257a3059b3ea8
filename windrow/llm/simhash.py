"""SimHash near-duplicates: fingerprints, a binary-trie self-join (see trie), and components of its links."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_since, holding, importable, mark, written
from .trie import contracted, join_dealt, spread

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Shingles whose votes are counted together, and rows of an Arrow batch that are taken together.
_PART, _ROWS = 1 << 14, 1000
#: Rows of two numbers that are sent to all tasks, so that a join leaves texts where they are.
_FEW = 1 << 18


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """Bit i is set if it is in over half of the XXH64 hashes of the text's word shingles, repeats included."""
    import xxhash

    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    w = text.encode().lower().split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    votes = np.zeros(64, np.int64)
    for a in range(0, n, _PART):
        part = w[a : min(a + _PART, n) + words - 1]
        hashes = [digest(b" ".join(x)) for x in zip(*(part[i:] for i in range(words)), strict=False)] if len(w) >= words else [digest(b" ".join(w))]
        votes += _votes(np.array(hashes, np.uint64))
    return int.from_bytes(np.packbits(votes * 2 > n, bitorder="little").tobytes(), "little")


def _votes(h: np.ndarray) -> np.ndarray:
    """How many of h have each bit; counted in bytes, 255 rows at a time."""
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0).sum(0, dtype=np.int64)


def fingerprints(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed bigint), a row for each row of df; ids keep their type.

    Null text: empty, fingerprint 0. A-Z are lower-cased, words are `[^\\x20\\x09-\\x0D]+`; fewer words than a shingle has make one
    shingle. Texts of any length: votes are counted in parts. Repeated rows stay repeated, other columns are not read, an
    empty table gives an empty one."""
    importable(df.sparkSession)
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding("simhash")
        for batch in (whole.slice(k, _ROWS) for whole in batches for k in range(0, whole.num_rows, _ROWS)):
            fp = np.array([fingerprint(x, words, seed) for x in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64), pa.int64())], names=["doc_id", "fp"])

    return rows.mapInArrow(run, rows.select("doc_id").schema.add("fp", "long"))


def linked(distinct: DataFrame, budget: int = 3) -> DataFrame:
    """distinct: fp, each once. Returns (fp, label) for each fp that has a link; equal labels: connected."""
    keys = distinct.select(F.lit(0).alias("lane"), F.col("fp").alias("key"), F.xxhash64("fp").alias("vertex"))  # one to one on bigints
    edges = join_dealt(spread(keys, distinct.count(), 1, 64, budget), 64, budget).where("b IS NOT NULL")
    return distinct.select("fp", F.xxhash64("fp").alias("label")).join(contracted(edges), "label").select("fp", F.col("to").alias("label"))


def near_duplicates(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = 3, budget: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links between
    fingerprints that differ in at most `budget` bits, the document's own id included. Ids may be of any type that has an order.

    Equal fingerprints are one vertex, so copies never become pairs. Null or empty texts have fingerprint 0 and link
    like any other. Null ids are never smallest; a component of null ids only has component_id null. Repeated
    rows stay repeated. Other columns are not read; an empty table gives an empty one.
    """
    since = mark()
    docs = written(fingerprints(df, text_col, id_col, words, seed), "fingerprints")
    distinct = written(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    labels = written(linked(distinct, budget), "labels")
    known = written(distinct.join(labels, "fp", "left"), "known")
    least = written(known.where("label IS NOT NULL").groupBy("label").agg(F.min("least").alias("reached")), "least")
    final = written(known.join(least, "label", "left").select("fp", F.coalesce("reached", "least").alias("component_id")), "final")
    drop_since(df.sparkSession, since, docs, final)
    return docs.join(final, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Similarity of shingle sets.


@dataclass(frozen=True)
class Plan:
    """A wide fingerprint, read as `tables` keys of `bits` bits, each joined on a trie of its own with a budget of `budget` bits.

    A bit differs between two sets of Jaccard similarity s with chance acos(2s / (1 + s)) / pi, each bit by itself."""

    tables: int
    bits: int
    budget: int
    #: Differing bits of the whole fingerprint beyond which no pair is looked at: five deviations over what is expected.
    most: int

    @property
    def words(self) -> int:
        return -(-self.tables * self.bits // 64)


def _within(bits: int, budget: int, chance: float) -> float:
    return math.fsum(math.comb(bits, k) * chance**k * (1 - chance) ** (bits - k) for k in range(budget + 1))


def plan(n: int, least: float = 0.8, miss: float = 1e-3, budget: int = 3) -> Plan:
    """For n different sets: keys so long that one set in twenty at most has a random partner within budget, and as many
    as leave a pair of similarity `least` out with chance `miss` at most."""
    chance = math.acos(2 * least / (1 + least)) / math.pi
    bits = next(b for b in (*range(24, 64, 4), 62) if n * _within(b, budget, 0.5) <= 0.05 or b == 62)
    tables = max(1, math.ceil(math.log(miss) / math.log1p(-_within(bits, budget, chance))))
    whole = -(-tables * bits // 64) * 64
    return Plan(tables, bits, budget, math.ceil(whole * chance + 5 * math.sqrt(whole * chance * (1 - chance))))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    return x * _ODD ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The distinct word shingles, as sorted 64-bit names. Words as in fingerprints; fewer than a shingle has make one shingle."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    size = min(words, len(w))
    out = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        out = _mix(out + h[k : k + len(out)])
    return np.unique(out)


def wide(names: np.ndarray, longs: int) -> np.ndarray:
    """A fingerprint of 64 * longs bits of a set of names: bit i is set if it is in over half of the names' i-th bits."""
    out = np.zeros(longs, "<u8")
    for k in range(longs):
        seed = np.uint64((k + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1)
        votes = np.zeros(64, np.int64)
        for a in range(0, len(names), _PART):
            votes += _votes(_mix(names[a : a + _PART] ^ seed))
        out[k] = np.packbits(votes * 2 > len(names), bitorder="little").view("<u8")[0]
    return out


def _marked(texts: DataFrame, words: int, how: Plan) -> DataFrame:
    """texts: (row, text). (row, set, wide): the name of the text's shingle set and its wide fingerprint; an empty set has none, as it is
    like no other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        holding("simhash")
        for batch in (whole.slice(k, _ROWS) for whole in batches for k in range(0, whole.num_rows, _ROWS)):
            sets = [shingles(x, words) for x in batch.column("text").to_pylist()]
            names = np.array([xxhash.xxh3_64_intdigest(s.astype("<u8").tobytes()) for s in sets], np.uint64)
            wides = pa.array([wide(s, how.words).tobytes() if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(names.view(np.int64)), wides], names=["row", "set", "wide"])

    return texts.select("row", "text").mapInArrow(run, "row bigint, set bigint, wide binary")


def _keys(how: Plan) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    """What makes of a batch of (set, wide) the plan's keys of each wide fingerprint: (lane, key, vertex)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n = batch.num_rows
        if not n:
            return
        x = np.frombuffer(b"".join(batch.column("wide").to_pylist()), "<u8").reshape(n, how.words)
        for t in range(how.tables):
            at, shift = divmod(t * how.bits, 64)
            key = x[:, at] >> np.uint64(shift)
            if shift + how.bits > 64:
                key = key | x[:, at + 1] << np.uint64(64 - shift)
            key &= np.uint64((1 << how.bits) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t), pa.int32()), pa.array(key.view(np.int64)), batch.column("set")], names=["lane", "key", "vertex"])

    return run


def _held(pairs: DataFrame, of: DataFrame, value: str, check) -> DataFrame:  # noqa: ANN001
    """The pairs (a, b) for whose values x, y, of the sets a and b, check(x, y) holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding("simhash")
        for batch in (whole.slice(k, _ROWS) for whole in batches for k in range(0, whole.num_rows, _ROWS)):
            told = [check(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(told, pa.bool_()))

    rows = pairs.join(of.selectExpr("set AS a", f"{value} AS x"), "a").join(of.selectExpr("set AS b", f"{value} AS y"), "b")
    return rows.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def similar_sets(sets: DataFrame, texts: DataFrame, how: Plan, words: int = 5, least: float = 0.8) -> DataFrame:
    """sets: (set, wide, row), each different shingle set once, with the row that has it in texts: (row, text). (label, to): sets that are
    linked to others, and the same `to` for those connected by links of Jaccard similarity `least` or more.

    Candidates come from the plan's tries; the wide fingerprints and then the sets themselves decide. In a first pass, each group
    of candidates gives one pair a set, with the group's smallest set; a second asks for every candidate between different
    components of what the first one proved. So no candidate is lost to a bound."""
    spark, since = sets.sparkSession, mark()
    importable(spark)
    wides = sets.where("wide IS NOT NULL").select("set", "wide")
    keys, lanes = _keys(how), 2 * how.tables  # each key with either half first
    found = written(join_dealt(spread(wides, sets.count(), lanes, how.bits, how.budget, keys), how.bits, how.budget), "candidates")

    def few(x: bytes, y: bytes) -> bool:
        return (int.from_bytes(x, "little") ^ int.from_bytes(y, "little")).bit_count() <= how.most

    def alike(x: bytes, y: bytes) -> bool:
        x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
        if min(len(x), len(y)) < least * max(len(x), len(y)):
            return False
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both >= least * (len(x) + len(y) - both)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding("simhash")
        for batch in (whole.slice(k, _ROWS) for whole in batches for k in range(0, whole.num_rows, _ROWS)):
            names = pa.array([shingles(x, words).astype("<u8").tobytes() for x in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("set"), names], names=["set", "names"])

    def proven(pairs: DataFrame) -> DataFrame:
        pairs = written(_held(pairs.distinct(), wides, "wide", few), "pairs")
        wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct().join(sets.select("set", "row"), "set"), "wanted")
        wanted = F.broadcast(wanted) if wanted.count() <= _FEW else wanted
        names = written(texts.join(wanted, "row").select("set", "text").mapInArrow(listed, "set bigint, names binary"), "names", batch=_ROWS)
        return written(_held(pairs, names, "names", alike), "links")

    links = proven(found.where("b IS NOT NULL"))
    label = contracted(links)
    out = found.where("b IS NULL").select(F.col("a").alias("vertex")).distinct()
    open_ = written(out.join(label.withColumnRenamed("label", "vertex"), "vertex", "left").select("vertex", F.coalesce("to", "vertex").alias("label")), "open")
    n = open_.count()
    if n:
        asked = wides.join(open_.select(F.col("vertex").alias("set")), "set", "left_semi").select("set", "wide")
        rest = spread(asked, n, lanes, how.bits, how.budget, keys).join(open_, "vertex")
        label = contracted(links.union(proven(written(join_dealt(rest, how.bits, how.budget, labelled=True), "rest"))))
    drop_since(spark, since, label)
    return label


def near_copies_dropped(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = 5, least: float = 0.8, how: Plan | None = None) -> DataFrame:
    """The rows of df that stay when of each group of near copies only one does.

    Texts whose sets of word shingles have a Jaccard similarity of `least` or more are linked (similar_sets), groups are components of
    links, and the row of the smallest id stays, of one id's the one of the smallest hash of its text; null ids come
    last. Decided row by row: of repeated rows one stays, and an id's other texts are judged by themselves. Null texts are
    empty, and empty ones are one group. Texts of any length. df may have any columns, and keeps them; it is read several times: pass
    a table. An empty table gives an empty one."""
    spark, since = df.sparkSession, mark()
    importable(spark)
    own = {c: f"own_{i}" for i, c in enumerate(df.columns)}  # the rows, under names that are nobody's
    rows = df.select(*(F.col(f"`{c}`").alias(o) for c, o in own.items()), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "rows")
    text, id_ = (F.col(next(o for c, o in own.items() if c.lower() == x.lower())) for x in (text_col, id_col))
    how = how or plan(rows.count(), least)
    texts = rows.select("row", text.alias("text"))
    sets = written(_marked(texts, words, how), "sets", batch=_ROWS)
    place = F.struct(id_.isNull().alias("none"), id_.alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text"), "row").alias("first")
    placed = sets.join(rows.select("row", place), "row")
    one = written(placed.groupBy("set").agg(F.min("first").alias("first"), F.first("wide").alias("wide")), "one")
    group = similar_sets(one.select("set", "wide", F.col("first.row").alias("row")), texts, how, words, least)
    told = one.join(group.withColumnRenamed("label", "set"), "set", "left").groupBy(F.coalesce("to", "set").alias("group")).agg(F.min("first").alias("first"))
    kept = written(told.select(F.col("first.row").alias("row")), "kept")
    gone = written(sets.select("row").join(kept, "row", "left_anti"), "gone")
    drop_since(spark, since, rows, gone)
    gone = F.broadcast(gone) if gone.count() <= _FEW else gone
    return rows.join(gone, "row", "left_anti").select(*(F.col(o).alias(c) for c, o in own.items()))
