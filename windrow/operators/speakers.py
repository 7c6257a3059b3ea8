"""Speakers from segment embeddings, and how well clusterings agree."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..sources.views import q


def _squares(x: np.ndarray, norms: np.ndarray, at: np.ndarray, norms_at: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of `at` to those of x; what rounding leaves of equal rows is 0."""
    scale = norms_at[:, None] + norms
    d = scale - 2 * (at @ x.T)
    return np.where(d > 1e-12 * scale, d, 0.0)


def _merges(x: np.ndarray) -> list[tuple[float, int, int]]:
    """All merges by Ward's criterion, the cheapest first, as (cost, cluster, cluster), a cluster being named by its least row.

    From any cluster the chain of nearest neighbours ends in two that are each other's; merging those is what the greedy order comes to,
    since no merge brings clusters nearer to others. So n-squared distances are met, but only one cluster's are held at a time."""
    n = len(x)
    center, size, name, cost = x.copy(), np.ones(n), np.arange(n), np.zeros(n)
    norms, live = (center**2).sum(1), np.ones(n, bool)
    out: list[tuple[float, int, int]] = []
    chain: list[int] = []
    steps: list[float] = []  # the cost of each link of the chain
    left = n
    while left > 1:
        if left * 2 < len(size):  # let go of what is merged
            keep = np.flatnonzero(live)
            place = np.cumsum(live) - 1
            center, size, name, cost, norms, live = center[keep], size[keep], name[keep], cost[keep], norms[keep], live[keep]
            chain = [int(place[c]) for c in chain]
        if not chain:
            chain.append(int(live.argmax()))
        a = chain[-1]
        d = size * (size[a] / (size + size[a])) * _squares(center, norms, center[a : a + 1], norms[a : a + 1])[0]
        d[~live] = np.inf
        d[chain] = np.inf
        b = int(d.argmin())
        if not steps or d[b] < steps[-1]:
            chain.append(b)
            steps.append(float(d[b]))
            continue
        b = chain[-2]
        a, b = (a, b) if name[a] < name[b] else (b, a)
        cost[a] = max(steps[-1], cost[a], cost[b])
        out.append((float(cost[a]), int(name[a]), int(name[b])))
        center[a] = (center[a] * size[a] + center[b] * size[b]) / (size[a] + size[b])
        size[a] += size[b]
        norms[a], live[b] = (center[a] ** 2).sum(), False
        del chain[-2:], steps[-2:]
        left -= 1
    return sorted(out, key=lambda m: m[0])


def ward(x: np.ndarray, ks: list[int]) -> list[np.ndarray]:
    """For each of ks, labels of so many clusters by Ward's criterion: the cheapest merge first."""
    merges = _merges(x)
    out = []
    for k in ks:
        root = np.arange(len(x))
        for _, a, b in merges[: len(x) - k]:
            while root[a] != a:
                root[a] = a = root[root[a]]
            while root[b] != b:
                root[b] = b = root[root[b]]
            root[max(a, b)] = min(a, b)
        while (root[root] != root).any():
            root = root[root]
        out.append(np.unique(root, return_inverse=True)[1])
    return out


def silhouettes(x: np.ndarray, labellings: list[np.ndarray], held: int = 1 << 21) -> list[float]:
    """The silhouette of each labelling. Distances are made once for all, `held` at a time, and only their sums by cluster are kept."""
    norms, n = (x**2).sum(1), len(x)
    sizes = [lab.max() + 1 for lab in labellings]
    member = np.concatenate([np.eye(k)[lab] for k, lab in zip(sizes, labellings, strict=True)], 1)
    sums, rows = np.empty((n, member.shape[1])), max(1, held // n)
    for r in range(0, n, rows):
        d = np.sqrt(_squares(x, norms, x[r : r + rows], norms[r : r + rows]))
        np.fill_diagonal(d[:, r:], 0)
        sums[r : r + rows] = d @ member
    out, at = [], 0
    for k, own in zip(sizes, labellings, strict=True):
        mean, count, every = sums[:, at : at + k], np.bincount(own, minlength=k), np.arange(n)
        at += k
        a = mean[every, own] / np.maximum(count[own] - 1, 1)
        other = mean / count
        other[every, own] = np.inf
        b = other.min(1)
        out.append(float(np.where(count[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-12), 0).mean()))
    return out


def diarized(segments: DataFrame, most: int = 4, speakers: int | None = None) -> DataFrame:
    """segments (episode_id, seg, start, end, embedding) -> turns with speaker: standardised embeddings, Ward clusters, as many as the best
    silhouette of 2 to `most` says; segments without an embedding take the speaker before. One grouped task an episode, whose time grows with
    the square of its segments and whose memory does not."""
    kind = segments.schema["episode_id"].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seg").reset_index(drop=True)
        has = rows["embedding"].notna().to_numpy()
        names = np.full(len(rows), "SPEAKER_0", object)
        if has.sum() > 1:
            x = np.stack(rows.loc[has, "embedding"].to_list())
            x = (x - x.mean(0)) / np.where(x.std(0) == 0, 1, x.std(0))
            options = [min(speakers, len(x))] if speakers else [*range(2, min(most, len(x) - 1) + 1)]
            if options:
                found = ward(x, options)
                best = max(zip(silhouettes(x, found), (-k for k in options), range(len(options)), strict=True))[2] if len(options) > 1 else 0
                names[has] = [f"SPEAKER_{k}" for k in found[best]]
        last = "SPEAKER_0"
        for i in range(len(rows)):
            last = names[i] = names[i] if has[i] else last
        return pd.DataFrame({"episode_id": rows["episode_id"], "turn": rows["seg"], "start": rows["start"], "end": rows["end"], "speaker": names})

    # by range, few episodes are a task each; by hash, some tasks would have several of them
    segments = segments.repartitionByRange(int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions")), "episode_id")
    return segments.groupBy("episode_id").applyInPandas(run, f"episode_id {kind}, turn int, start double, end double, speaker string")


def agreement(pairs: DataFrame) -> DataFrame:
    """pairs (episode_id, a, b): two labels of one thing -> share (of things in their cluster's commonest label) and the adjusted Rand index."""
    return q(
        pairs.sparkSession,
        """
        WITH cells AS (SELECT episode_id, a, b, cast(count(*) AS double) AS n FROM {pairs} GROUP BY episode_id, a, b),
        ra AS (SELECT episode_id, a, sum(n) AS n, max(n) AS most FROM cells GROUP BY episode_id, a), rb AS (SELECT episode_id, b, sum(n) AS n FROM cells GROUP BY episode_id, b),
        c AS (SELECT episode_id, sum(n * (n - 1) / 2) AS c, sum(n) AS n FROM cells GROUP BY episode_id),
        sa AS (SELECT episode_id, sum(n * (n - 1) / 2) AS a, sum(most) AS most FROM ra GROUP BY episode_id), sb AS (SELECT episode_id, sum(n * (n - 1) / 2) AS b FROM rb GROUP BY episode_id)
        SELECT episode_id, most / n AS share, CASE WHEN (a + b) / 2 = a * b / (n * (n - 1) / 2) THEN 1D ELSE (c - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2)) END AS ari
        FROM c JOIN sa USING (episode_id) JOIN sb USING (episode_id) WHERE n > 1
        """,
        pairs=pairs,
    )


def histogram_distances(cut: DataFrame) -> DataFrame:
    """Decoder diagnostics from histogram_cuts: frames, exact repeats, and the distance's median, 95th percentile and greatest."""
    return q(cut.sparkSession, "SELECT episode_id, count(*) AS frames, count_if(abs(distance) < 1e-9D) AS repeats, median(distance) AS median, percentile(distance, 0.95D) AS p95, max(distance) AS top FROM {cut} WHERE distance IS NOT NULL GROUP BY episode_id", cut=cut)
