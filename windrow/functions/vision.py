"""Numbers from frames. A frame is a row of raw bytes (blue, green, red) with its height and width."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def image(data: bytes, height: int, width: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, 3)


def hsv_histogram(bgr: np.ndarray, bins: int = 32) -> np.ndarray:
    """Hue by saturation, bins of each, scaled to unit length."""
    b, g, r = (bgr[..., k].astype(np.float64) for k in range(3))
    top, low = np.maximum(np.maximum(b, g), r), np.minimum(np.minimum(b, g), r)
    span = top - low
    safe = np.where(span == 0, 1, span)
    hue = np.where(top == r, (g - b) / safe, np.where(top == g, 2 + (b - r) / safe, 4 + (r - g) / safe)) * 30 % 180
    sat = np.where(top == 0, 0, span / np.where(top == 0, 1, top)) * 255
    h, _, _ = np.histogram2d(np.where(span == 0, 0, hue).ravel(), sat.ravel(), bins=bins, range=((0, 180), (0, 256)))
    n = np.linalg.norm(h)
    return (h / n if n else h).ravel()


def skin_fraction(bgr: np.ndarray, x: int, y: int, w: int, h: int) -> float:
    """Share of a box whose chroma is that of skin."""
    p = bgr[max(0, y) : y + h, max(0, x) : x + w].astype(np.float64)
    if not p.size:
        return 0.0
    luma = 0.299 * p[..., 2] + 0.587 * p[..., 1] + 0.114 * p[..., 0]
    # The chroma range.
    cr, cb = np.rint((p[..., 2] - luma) * 0.713 + 128), np.rint((p[..., 0] - luma) * 0.564 + 128)
    return float(((cr >= 133) & (cr <= 173) & (cb >= 77) & (cb <= 127)).mean())


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def histogram(data: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else hsv_histogram(image(d, h, w)).tolist() for d, h, w in zip(data, height, width, strict=True)])


def mouth_activity(patches: DataFrame) -> DataFrame:
    """patches (episode_id, k, t, seat, pixels array<double>) -> energy: mean change against the seat's patch before, by brightness; 0 for
    the first and after a change of size."""
    rows = patches.selectExpr("*", "lag(pixels) OVER (PARTITION BY episode_id, seat ORDER BY k) AS before")
    change = "aggregate(zip_with(pixels, before, (a, b) -> abs(a - b)), 0D, (s, x) -> s + x) / size(pixels)"
    light = "aggregate(pixels, 0D, (s, x) -> s + x) / size(pixels) + 1e-6D"
    return rows.selectExpr("episode_id", "k", "t", "seat", f"CASE WHEN before IS NULL OR size(before) <> size(pixels) OR size(pixels) = 0 THEN 0D ELSE ({change}) / ({light}) END AS energy")
