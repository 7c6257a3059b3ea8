"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram's vector binds (multiplies) its letters' vectors, each rotated by
its distance from the end; a text's vector bundles (adds) those of its trigrams; a language's prototype bundles its
documents' vectors. A text's language is the prototype at the smallest angle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import holding, holds, importable, put_aside, share_below

DIM, SYMBOLS, UNDETERMINED = 1024, 64, "und"
#: Languages whose sampling limits may be broadcast.
LANGUAGES = 10_000
#: Texts and characters whose vectors are made together.
_TEXTS, _CHARS = 128, 1 << 19
#: Rows of an Arrow batch that are taken together.
_ROWS = 1024
_SCALE = 1 << 20


@lru_cache(1)
def _letters() -> np.ndarray:
    """The symbol of each character: 0 for what is no letter, 1-26 for a-z, and the rest shared by all other letters."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if chr(c).isalpha():
            out[c] = c - 96 if 97 <= c <= 122 else 27 + (c * 0x9E3779B1 >> 7) % (SYMBOLS - 27)
    return out


@lru_cache(1)
def _turned() -> list[np.ndarray]:
    v = (np.random.default_rng(7).integers(0, 2, (SYMBOLS, DIM), dtype=np.int8) * 2 - 1).astype(np.int8)
    return [np.roll(v, k, axis=1) for k in (2, 1, 0)]


def _grams(text: str) -> np.ndarray:
    """The text's trigrams over letters and single gaps, as numbers."""
    s = _letters()[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")]
    s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])].astype(np.int32)
    g = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
    return g[(s[:-2] > 0) | (s[1:-1] > 0) | (s[2:] > 0)]


def vectors(texts: list[str | None]) -> np.ndarray:
    """Unit vectors of the texts; zero where there is no letter."""
    out = np.zeros((len(texts), DIM), np.float32)
    a = 0
    while a < len(texts):
        grams, size, b = [], 0, a
        while b < len(texts) and b - a < _TEXTS and (b == a or size < _CHARS):
            text = texts[b] or ""
            grams.append(_grams(text))
            size += len(text)
            b += 1
        there = np.zeros(SYMBOLS**3, bool)
        for g in grams:
            there[g] = True
        which = np.flatnonzero(there)
        if len(which):
            place = np.cumsum(there, dtype=np.int32) - 1
            counts = np.stack([np.bincount(place[g], minlength=len(which)).astype(np.float32) for g in grams])
            u, v, w = _turned()
            for k in range(0, len(which), 8192):
                x = which[k : k + 8192]
                out[a:b] += counts[:, k : k + 8192] @ (u[x // SYMBOLS**2] * v[x // SYMBOLS % SYMBOLS] * w[x % SYMBOLS]).astype(np.float32)
        a = b
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


@dataclass(frozen=True)
class Profiles:
    languages: list[str]
    prototypes: np.ndarray  # one unit row for each language


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = 5_000, key: Column | None = None) -> Profiles:
    """Prototypes from the labelled rows of df, about `sample` of each language at most, chosen by a hash of key (by default the text).

    Rows with a null text or language, or without a letter, teach nothing; repeated rows count each; an empty table gives profiles
    of no language. Texts of any length. What reaches the driver is DIM numbers for each language."""
    importable(df.sparkSession)
    text, lang = df[f"`{text_col}`"], df[f"`{lang_col}`"].cast("string")
    rows = df.where(lang.isNotNull() & text.isNotNull()).select(text.alias("text"), lang.alias("lang"), F.xxhash64(key if key is not None else text).alias("by"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    some = sizes.where(F.col("n") > sample).select(F.col("lang").alias("of"), share_below(F.lit(sample), F.col("n")).alias("below"))
    some = F.broadcast(some) if some.count() <= LANGUAGES else some
    rows = rows.join(some, F.col("lang") == F.col("of"), "left").where("below IS NULL OR by < below")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding("language")
        total: dict[str, np.ndarray] = {}
        for batch in (whole.slice(k, _ROWS) for whole in batches for k in range(0, whole.num_rows, _ROWS)):
            v = np.rint(vectors(batch.column("text").to_pylist()) * _SCALE).astype(np.int64)
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in sorted(set(langs)):
                total[lang] = total.get(lang, 0) + v[langs == lang].sum(0)
        for lang, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIM), pa.array(np.arange(DIM), pa.int32()), pa.array(v, pa.int64())], names=["lang", "place", "v"])

    parts = rows.select("text", "lang").mapInArrow(run, "lang string, place int, v bigint")
    found: dict[str, np.ndarray] = {}
    for lang, place, v in parts.groupBy("lang", "place").agg(F.sum("v").alias("v")).collect():
        found.setdefault(lang, np.zeros(DIM))[place] = v
    langs = sorted(x for x, v in found.items() if v.any())
    return Profiles(langs, np.stack([found[x] / np.linalg.norm(found[x]) for x in langs]).astype(np.float32) if langs else np.zeros((0, DIM), np.float32))


def identify(df: DataFrame, profiles: Profiles, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of df (by default all but those named like a result) with lang_pred and score (cosine, 0 to 1).

    A null text or one without a letter gets `und` and 0, as does every text if no language is known. Of equal cosines
    the first language in alphabetical order wins. Every row is judged by its whole text alone, repeated ones too; no shuffle. Columns
    named like a result, in any case, are replaced; no other name clashes. An empty table gives an empty one."""
    importable(df.sparkSession)
    aside, back = put_aside(df, ("lang_pred", "score"), keep)
    rows = df.select(*aside, df[f"`{text_col}`"].alias("text__"))
    cols = rows.columns[:-1]
    names = np.array([*profiles.languages, UNDETERMINED], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding("language")
        for batch in (whole.slice(k, _ROWS) for whole in batches for k in range(0, whole.num_rows, _ROWS)):
            v = vectors(batch.column("text__").to_pylist())
            some = v.any(axis=1)
            cos = v @ profiles.prototypes.T if profiles.languages else np.zeros((len(v), 1), np.float32)
            best = np.where(some, cos.argmax(1), len(names) - 1)
            score = np.where(some, np.clip(cos.max(1, initial=-1), 0, 1), 0).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in cols), pa.array(names[best].tolist(), pa.string()), pa.array(score)], names=[*cols, "lang_pred", "score"])

    return rows.mapInArrow(run, rows.select(*cols).schema.add("lang_pred", "string").add("score", "double")).select(*back, "lang_pred", "score")


def _drop() -> None:
    _letters.cache_clear()
    _turned.cache_clear()


holds("language", _drop)
