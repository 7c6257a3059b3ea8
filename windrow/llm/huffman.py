"""Canonical length-limited Huffman codes over token ids, in numpy."""

from __future__ import annotations

import numpy as np

#: Tokens between two bit-offset checkpoints.
STRIDE = 256


def lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most limit bits (package-merge). counts are positive; two symbols at least."""
    n = len(counts)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need more than {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaf = counts[order].astype(np.int64)
    weights, from_leaf = [leaf], [np.ones(n, bool)]
    for _ in range(limit - 1):
        last = weights[-1]
        pairs = last[0 : len(last) // 2 * 2 : 2] + last[1 : len(last) // 2 * 2 : 2]
        both = np.concatenate([leaf, pairs])
        by = np.argsort(both, kind="stable")
        weights.append(both[by])
        from_leaf.append(by < n)
    out, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(from_leaf):
        k = int(is_leaf[:take].sum())
        out[:k] += 1
        take = 2 * (take - k)
    got = np.empty(n, np.int64)
    got[order] = out
    return got


class Code:
    """A canonical code: symbols in ascending (length, id) order get ascending codewords."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        order = np.lexsort((ids, bits))
        self.ids, self.bits = ids[order].astype(np.int64), bits[order].astype(np.int64)
        self.limit = int(self.bits.max(initial=1))
        words = np.zeros(len(ids), np.int64)
        if len(ids):
            step = np.left_shift(1, self.limit - self.bits)
            words = (np.cumsum(step) - step) >> (self.limit - self.bits)
        size = int(self.ids.max(initial=0)) + 1
        self.word, self.size = np.zeros(size, np.uint32), np.zeros(size, np.int64)
        self.word[self.ids], self.size[self.ids] = words, self.bits
        fill = np.left_shift(1, self.limit - self.bits)
        self.symbol = np.zeros(1 << self.limit, np.uint32)
        self.taken = np.ones(1 << self.limit, np.int64)
        self.symbol[: int(fill.sum())] = np.repeat(self.ids, fill)
        self.taken[: int(fill.sum())] = np.repeat(self.bits, fill)

    @staticmethod
    def of(ids: np.ndarray, counts: np.ndarray, limit: int = 16) -> Code:
        if len(ids) < 2:
            return Code(ids, np.ones(len(ids), np.int64))
        return Code(ids, lengths(counts, max(limit, (len(ids) - 1).bit_length())))

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """The bits, filled up to a byte, and a checkpoint for each further STRIDE: its distance in bits (uint16)."""
        size, word = self.size[ids], self.word[ids]
        cols = np.arange(self.limit)
        bit = (word[:, None] >> np.maximum(size[:, None] - 1 - cols, 0)) & 1
        payload = np.packbits(bit[cols < size[:, None]].astype(np.uint8)).tobytes()
        at = np.concatenate([[0], np.cumsum(size)])[::STRIDE]
        if len(ids) and len(ids) % STRIDE == 0:
            at = at[:-1]
        return payload, np.diff(at).astype("<u2").tobytes()

    def decode(self, payload: bytes, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Ids of all lanes one after another: lane i has counts[i] <= STRIDE ids from bit starts[i] on."""
        raw = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint32)
        window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        order = np.argsort(-counts, kind="stable")
        place = (np.cumsum(counts) - counts)[order]
        at, many = starts[order].astype(np.int64), counts[order]
        out = np.empty(int(counts.sum()), np.uint32)
        mask = np.uint32((1 << self.limit) - 1)
        live = np.searchsorted(-many, -np.arange(int(many[0]) if len(many) else 0), side="left")
        for step, k in enumerate(live.tolist()):
            p = at[:k]
            code = (window[p >> 3] >> (32 - self.limit - (p & 7)).astype(np.uint32)) & mask
            out[place[:k] + step] = self.symbol[code]
            at[:k] = p + self.taken[code]
        return out


def crc_join(first: int, second: int, n: int) -> int:
    """The crc32 of two byte strings one after another, from theirs and the second's length."""
    if n <= 0:
        return first

    def times(m: list[int], v: int) -> int:
        out = i = 0
        while v:
            if v & 1:
                out ^= m[i]
            v >>= 1
            i += 1
        return out

    m = [0xEDB88320] + [1 << i for i in range(31)]
    m = [times(m, x) for x in m]
    m = [times(m, x) for x in m]
    while n:
        m = [times(m, x) for x in m]
        if n & 1:
            first = times(m, first)
        n >>= 1
    return first ^ second
