"""Loudness text and levels, and cepstral features of audio."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TARGET, CEILING, MAX_GAIN, MIN_GAIN = -14.0, -1.0, 12.0, 0.5
#: Lowest edge of the cepstral filters in Hz, a fixed value.
LOWEST = 50.0


def parsed(logs: DataFrame, column: str = "raw") -> DataFrame:
    """logs with integrated, true_peak and range from the JSON block in their text; all null if there is none or a number is not finite."""
    block = f"regexp_extract({column}, '(?s)(\\\\{{[^{{}}]*\"input_i\"[^{{}}]*\\\\}})', 1)"
    rows = logs.selectExpr("*", f"from_json({block}, 'input_i string, input_tp string, input_lra string') AS j")
    rows = rows.selectExpr("* EXCEPT (j)", "try_cast(j.input_i AS double) AS a", "try_cast(j.input_tp AS double) AS b", "try_cast(j.input_lra AS double) AS c")
    fine = "a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND NOT isnan(a) AND NOT isnan(b) AND NOT isnan(c) AND abs(a) < double('inf') AND abs(b) < double('inf') AND abs(c) < double('inf')"
    return rows.selectExpr("* EXCEPT (a, b, c)", f"CASE WHEN {fine} THEN a END AS integrated", f"CASE WHEN {fine} THEN b END AS true_peak", f"CASE WHEN {fine} THEN c END AS range")


def levelled(rows: DataFrame) -> DataFrame:
    """parsed rows with gain (dB, clamped to 12 either way; 0 if not measured), filters (null: none), is_quiet and is_dynamic."""
    rows = rows.selectExpr("*", f"CASE WHEN integrated IS NULL THEN 0D ELSE greatest(-{MAX_GAIN}D, least({MAX_GAIN}D, {TARGET}D - integrated)) END AS gain")
    limit = f"{10 ** (CEILING / 20):.4f}"
    return rows.selectExpr(
        "*", f"nullif(concat_ws(',', CASE WHEN abs(gain) >= {MIN_GAIN}D THEN format_string('volume=%.2fdB', gain) END, CASE WHEN true_peak + gain > {CEILING}D THEN 'alimiter=limit={limit}:attack=5:release=50:level=disabled' END), '') AS filters",
        f"integrated < {TARGET - MIN_GAIN}D AS is_quiet", "range > 14D AS is_dynamic",
    )


def hz_to_mel(hz: np.ndarray | float) -> np.ndarray | float:
    return 2595.0 * np.log10(1.0 + np.asarray(hz) / 700.0)


def mel_to_hz(mel: np.ndarray | float) -> np.ndarray | float:
    return 700.0 * (10.0 ** (np.asarray(mel) / 2595.0) - 1.0)


def mel_filters(n: int, n_fft: int, rate: int) -> np.ndarray:
    """Triangular filters, evenly spaced in mel from LOWEST Hz on. A side without width gets one bin."""
    bins = np.floor((n_fft + 1) * mel_to_hz(np.linspace(hz_to_mel(LOWEST), hz_to_mel(rate / 2), n + 2)) / rate).astype(int)
    x = np.arange(n_fft // 2 + 1)
    out = np.zeros((n, len(x)))
    for m, (a, b, c) in enumerate(zip(bins, bins[1:], bins[2:], strict=False)):
        b += b == a
        c += c == b
        up, down = (x - a) / (b - a), (c - x) / max(c - b, 1)
        out[m] = np.where((x >= a) & (x < b), up, np.where((x >= b) & (x < c), down, 0.0))
    return out


def mfcc(signal: np.ndarray, rate: int = 16_000, coefficients: int = 13, frame: float = 0.025, hop: float = 0.01, filters: int = 26, n_fft: int = 512) -> np.ndarray:
    """Cepstral coefficients of 25 ms frames every 10 ms: pre-emphasis 0.97, Hamming, 26 mel filters, orthonormal DCT-II."""
    size, step = int(rate * frame), int(rate * hop)
    x = np.append(signal[:1], signal[1:] - 0.97 * signal[:-1]) if len(signal) else signal
    if len(x) < size:
        return np.zeros((0, coefficients))
    at = np.arange(0, len(x) - size + 1, step)[:, None] + np.arange(size)
    power = np.abs(np.fft.rfft(x[at] * np.hamming(size), n_fft)) ** 2 / n_fft
    energy = power @ mel_filters(filters, n_fft, rate).T
    energy = np.log(np.where(energy == 0, np.finfo(float).eps, energy))
    k, n = np.arange(coefficients)[:, None], np.arange(filters)
    dct = np.cos(np.pi * k * (2 * n + 1) / (2 * filters)) * np.where(k == 0, np.sqrt(1 / filters), np.sqrt(2 / filters))
    return energy @ dct.T


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def cepstra(signals: pd.Series) -> pd.Series:
    """mfcc of each signal."""
    return signals.map(lambda x: None if x is None else mfcc(np.asarray(x, float)).tolist())


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def embedding(signals: pd.Series) -> pd.Series:
    """Mean and deviation of each coefficient but the first over a segment's samples; null if it is shorter than 0.4 s."""

    def one(x: np.ndarray) -> list[float] | None:
        if x is None or len(x) < 6_400:
            return None
        c = mfcc(np.asarray(x, float))[:, 1:]
        return None if len(c) < 3 else np.concatenate([c.mean(0), c.std(0)]).tolist()

    return signals.map(one)


def described(rows: DataFrame) -> DataFrame:
    """levelled rows with a line for people."""
    move = f"CASE WHEN abs(gain) >= {MIN_GAIN}D THEN format_string('turned %s %.1f dB', CASE WHEN gain > 0 THEN 'up' ELSE 'down' END, abs(gain)) ELSE 'already on target' END"
    line = f"format_string('source measures %.1f LUFS, peak %.1f dBTP%s - %s', integrated, true_peak, CASE WHEN is_dynamic THEN ', wide dynamic range' ELSE '' END, {move})"
    return rows.selectExpr("*", f"CASE WHEN integrated IS NULL THEN 'audio level not measured, clips exported as-is' ELSE {line} END AS note")
