"""Toxicity by non-negative positive-unlabelled learning, in numpy.

Labels confirm some toxic texts; what has no such label is unlabelled, not clean. With the share p of toxic texts among
all, the risk of a scorer g is p E+[l(g)] + max(0, Eu[l(-g)] - p E+[l(-g)]): the second part estimates the risk on clean
texts from unlabelled ones, and is kept from going below zero, where it would only fit noise.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexing import BLOCK, END, LETTER, character_numbers, named
from .shared import holds, importable, share_below

#: Lengths of the word beginnings that count besides whole words (runs of letters, lower case).
STEMS = (4, 5, 6, 7)
#: Lengths of the character n-grams that count in scripts written without spaces.
GRAMS = (1, 2, 3)
#: Blocks of these scripts, and of Hangul, whose words carry their particles: Thai and Lao, Tibetan, Burmese, Hangul, Khmer, Chinese and
#: Japanese, and what is above U+FFFF of them.
_UNSPACED = ((0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1100, 0x11FF), (0x1780, 0x17FF), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x318F), (0x31A0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA960, 0xA97F), (0xAA60, 0xAA7F), (0xAC00, 0xD7FF), (0xF900, 0xFAFF), (0xFF66, 0xFFDC), (0x16FE0, 0x18CFF), (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF))
#: Confirmed texts that a feature must occur in.
LEAST = 5
#: Share of toxic texts among a feature's that lets it be learned, and features that are looked at, the commonest of confirmed texts.
SCREEN, KNOWN = 0.3, 1 << 18
#: Texts whose features are made together.
_ROWS = 1000


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each character of Unicode: LETTER or END, the random number of its lower case, and whether its script has no spaces."""
    kind, low, unspaced = np.full(0x110000, END, np.uint8), np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)
    for a, b in _UNSPACED:
        unspaced[a : b + 1] = True
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha() or (unspaced[c] and unicodedata.category(ch)[0] == "M"):
            kind[c] = LETTER
            if len(ch.lower()) == 1:
                low[c] = ord(ch.lower())
    return kind, character_numbers(0)[low], unspaced & (kind == LETTER)


def _drop() -> None:
    _letters.cache_clear()


holds("toxicity", _drop)


def _features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of the texts, as 64-bit names, one text after another, and how many each has."""
    kind, random, unspaced = _letters()
    found: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)
    parts: list[list[np.ndarray]] = [[] for _ in texts]

    def run(text: str, owners: list[int], stops: np.ndarray) -> None:
        cp = np.frombuffer(text.encode("utf-32-le"), "<u4")
        k, r = kind[cp], random[cp]
        b = np.flatnonzero(np.diff(np.concatenate([[END], k, [END]]).astype(np.int8)))
        starts, ends = b[::2], b[1::2]
        if not len(starts):
            return
        doc = np.searchsorted(stops, starts).astype(np.int64)
        names_, docs = [named(r, starts, ends)], [doc]
        for n in STEMS:
            long = ends - starts > n
            names_.append(named(r, starts[long], starts[long] + n) ^ np.uint64(0x5851F42D4C957F2D))
            docs.append(doc[long])
        wide = unspaced[cp]
        if wide.any():
            for n in GRAMS:
                at = np.flatnonzero(np.logical_and.reduce([wide[i : len(wide) - n + 1 + i] for i in range(n)]))
                names_.append(named(r, at, at + n))
                docs.append(np.searchsorted(stops, at).astype(np.int64))
        f, d = np.concatenate(names_), np.concatenate(docs)
        order = np.argsort(f, kind="stable")
        f, d = f[order], d[order]
        order = np.argsort(d, kind="stable")
        f, d = f[order], d[order]
        first = np.concatenate([[True], (f[1:] != f[:-1]) | (d[1:] != d[:-1])])
        f, d = f[first], d[first]
        for i, x in zip(owners, np.split(f, np.searchsorted(d, np.arange(1, len(owners)))), strict=True):
            parts[i].append(x)

    block: list[str] = []
    owners: list[int] = []

    def flush() -> None:
        if block:
            run(" ".join(block) + " ", list(owners), np.cumsum([len(x) + 1 for x in block]) - 1)
            block.clear()
            owners.clear()

    size = 0
    for i, text in enumerate(texts):
        text, at = text or "", 0
        while at < len(text):
            end = min(len(text), at + BLOCK // 2)
            if end < len(text):
                gap = text.rfind(" ", at + 1, end)
                end = gap if gap > 0 else end
            if size + end - at >= BLOCK:
                flush()
                size = 0
            block.append(text[at:end])
            owners.append(i)
            size += end - at + 1
            at = end
    flush()
    for i, x in enumerate(parts):
        if x:
            one = x[0] if len(x) == 1 else np.unique(np.concatenate(x))
            found.append(one)
            counts[i] = len(one)
    return np.concatenate([np.zeros(0, np.uint64), *found]), counts


@dataclass(frozen=True)
class Scorer:
    """A weight for each known feature, in the order of their names."""

    known: np.ndarray
    weights: np.ndarray
    bias: float

    def logits(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(counts), self.bias)
        at = np.minimum(np.searchsorted(self.known, features), len(self.known) - 1)
        w = np.where(self.known[at] == features, self.weights[at], 0.0)
        total = np.concatenate([[0.0], np.cumsum(w)])
        end = np.cumsum(counts)
        return total[end] - total[end - counts] + self.bias


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _shares(seen: np.ndarray, positive: int, elsewhere: np.ndarray, unlabelled: int, prior: float) -> np.ndarray:
    """Of the texts that have a feature, the share that is toxic, by the prior and how many of two samples have it."""
    return prior * (seen / positive) / np.maximum(elsewhere / unlabelled, 1e-12)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = 150, rate: float = 0.1, decay: float = 1e-3, least: int = LEAST, screen: float = SCREEN) -> Scorer:
    """Minimises the non-negative risk, with the logistic loss, over weights of the features that `least` positive texts or
    more have and of whose texts a share of `screen` at least is toxic, as estimated from the prior and the two samples.

    The others are everyday words: with them the risk can be met by telling lengths and languages apart (README has figures)."""
    none = Scorer(np.zeros(0, np.uint64), np.zeros(0), -10.0 if prior < 0.5 else 10.0)
    if not positive or not unlabelled or not 0 < prior < 1:
        return none
    names_, seen = np.unique(np.concatenate(positive), return_counts=True)
    known, seen = names_[seen >= least], seen[seen >= least]
    everywhere = np.concatenate(unlabelled)
    at = np.searchsorted(known, everywhere)
    everywhere = at[known[np.minimum(at, len(known) - 1)] == everywhere] if len(known) else at[:0]
    known = known[_shares(seen, len(positive), np.bincount(everywhere, minlength=len(known)), len(unlabelled), prior) >= screen]
    if not len(known):
        return none
    np_, n = len(positive), len(positive) + len(unlabelled)
    size = np.array([len(f) for f in (*positive, *unlabelled)])
    row, name = np.repeat(np.arange(n), size), np.concatenate([*positive, *unlabelled])
    col = np.minimum(np.searchsorted(known, name), len(known) - 1)
    hit = known[col] == name
    row, col = row[hit], col[hit]
    w, bias = np.zeros(len(known)), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(known) + 1), np.zeros(len(known) + 1)
    for t in range(1, epochs + 1):
        g = np.bincount(row, w[col], n) + bias
        s = _sigmoid(g)
        clean = np.logaddexp(0, g[np_:]).mean() - prior * np.logaddexp(0, g[:np_]).mean()
        d = np.zeros(n)
        if clean >= 0:
            d[:np_] = prior * (s[:np_] - 1) / np_ - prior * s[:np_] / np_
            d[np_:] = s[np_:] / (n - np_)
        else:  # only undo the overfitted part
            d[:np_] = prior * s[:np_] / np_
            d[np_:] = -s[np_:] / (n - np_)
        grad = np.append(np.bincount(col, d[row], len(known)) + decay * w, d.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) / (1 + t / 100)
        w, bias = w - step[:-1], bias - step[-1]
    return Scorer(known, w, float(bias))


def learn(labels: DataFrame, texts: DataFrame, toxic_col: str = "toxic", text_col: str = "text", id_col: str = "doc_id", positives: int = 4_000, unlabelled: int = 12_000) -> Scorer:
    """labels: id and toxic (1: confirmed). texts: id and text, of any kind: unlabelled texts are taken from these too.

    The class prior is the share of confirmed texts among the labelled. About `positives` and `unlabelled` rows at most
    are used, chosen by a hash of the id; the chosen positives' ids are broadcast, so no text is shuffled. What reaches the
    driver is how many texts have each of KNOWN features at most, and which of those that pass the screen each chosen text has, not
    the texts. Null texts are empty, texts may be of any length, repeated rows count each, other columns are not read. Without a
    confirmed text (an empty table) every score is near 0."""
    importable(labels.sparkSession)
    share = labels.agg(F.count(F.when(F.col(toxic_col) == 1, 1)).alias("p"), F.count(toxic_col).alias("n")).collect()[0]
    prior = share["p"] / share["n"] if share["n"] else 0.0

    def chosen(df: DataFrame, there: int, most: int, seed: int) -> DataFrame:
        if there > most:
            df = df.where(F.xxhash64(F.col(id_col), F.lit(seed)) < share_below(F.lit(most), F.lit(there)))
        return df

    def of_known(texts: list[str | None], known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        f, n = _features(texts)
        own = known[np.minimum(np.searchsorted(known, f), len(known) - 1)] == f if len(known) else np.zeros(len(f), bool)
        return f, n, own

    def counted(df: DataFrame, known: np.ndarray | None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for k in range(0, whole.num_rows, _ROWS):
                    texts = whole.column("text").slice(k, _ROWS).to_pylist()
                    f, _, own = of_known(texts, known) if known is not None else (*_features(texts), slice(None))
                    f, n = np.unique(f[own], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(n, pa.int64())], names=["f", "n"])

        return df.mapInArrow(run, "f bigint, n bigint").groupBy("f").agg(F.sum("n").alias("n"))

    def arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        rows = df.toArrow()
        f, n = rows.column("f").to_numpy().view(np.uint64), rows.column("n").to_numpy()
        order = np.argsort(f)
        return f[order], n[order]

    def held(df: DataFrame, known: np.ndarray) -> list[np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for k in range(0, whole.num_rows, _ROWS):
                    f, n, own = of_known(whole.column("text").slice(k, _ROWS).to_pylist(), known)
                    end = np.cumsum(n)
                    yield pa.RecordBatch.from_arrays([pa.array([f[e - m : e][own[e - m : e]].astype("<u8").tobytes() for e, m in zip(end.tolist(), n.tolist(), strict=True)], pa.binary())], names=["f"])

        found = df.mapInArrow(run, "f binary").toArrow()
        return [np.frombuffer(f, "<u8") for f in sorted(found.column("f").to_pylist())]

    ids = chosen(labels.where(F.col(toxic_col) == 1).select(id_col), share["p"], positives, 11).distinct()
    texts = texts.select(id_col, F.col(text_col).alias("text"))
    confirmed = texts.join(F.broadcast(ids), id_col, "left_semi").select("text")
    rest = chosen(texts, texts.select(F.lit(1)).count(), unlabelled, 12).select("text")
    known, seen = arrays(counted(confirmed, None).where(F.col("n") >= LEAST).orderBy(F.col("n").desc(), "f").limit(KNOWN))
    there, n = arrays(counted(rest, known))
    elsewhere = np.zeros(len(known), np.int64)
    elsewhere[np.searchsorted(known, there)] = n
    sizes = [max(1, df.count()) for df in (confirmed, rest)]
    used = known[_shares(seen, sizes[0], elsewhere, sizes[1], prior) >= SCREEN]
    return fit(held(confirmed, used), held(rest, used), prior)


def score(df: DataFrame, scorer: Scorer, text_col: str = "text", id_col: str = "doc_id", more: dict[str, Column] | None = None) -> DataFrame:
    """The id, the columns `more`, score (0 to 1) and predicted (1 from 0.5 on) of each row, from its text alone. Null texts are empty and
    get the score of a text without features; texts may be of any length; repeated rows are scored each; other columns are not
    read, so none clashes; `more` may not name the id, score or predicted. An empty table gives an empty one."""
    importable(df.sparkSession)
    rows = df.select(F.col(id_col), *(v.alias(k) for k, v in (more or {}).items()), F.col(text_col).alias("text__"))
    cols = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, _ROWS) for whole in batches for k in range(0, whole.num_rows, _ROWS)):
            s = _sigmoid(scorer.logits(*_features(batch.column("text__").to_pylist())))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in cols), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*cols, "score", "predicted"])

    return rows.mapInArrow(run, rows.select(*cols).schema.add("score", "double").add("predicted", "integer"))
