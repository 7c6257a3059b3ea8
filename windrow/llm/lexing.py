"""Compiled tokenizers: deterministic finite-state transducers, run over whole batches of text at once.

A byte-pair tokenizer works in two steps. A regular pattern cuts a text into pretokens; then each
pretoken is encoded by itself. Both are compiled once from the tokenizer's file:

* The pattern becomes a DFA over character classes whose transitions say where pretokens start
  (`automaton`). A block is dealt into chunks; each chunk's state map (the state it ends in, for every
  state it may start in) is computed for all chunks together, the maps are composed by a parallel
  prefix scan, and then every chunk runs again from the one state it really starts in (`cuts`).
* The second transducer is a trie over pretokens. Its state is the prefix read since the last cut,
  named by a 64-bit polynomial hash, so reading a character is the affine map h -> h + R[c] * P**i on
  state names, and a cut is the constant map to the start state. Maps of neighbouring chunks compose
  associatively; `named` composes all of them in one prefix scan. The transition that leaves a
  pretoken is annotated with what it emits: ids, and so their count. Annotations are made from the
  merge table (`Merges`) when a pretoken is first met, and kept in a bounded table together with the pretoken's
  characters, which every later use is compared with: two pretokens of one name are found out and
  all states are named anew.

The library encodes nothing here. It normalises characters that a table of single characters can't, and says the class of
characters that Python's Unicode tables don't know.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import unicodedata
from functools import cached_property, lru_cache

import numpy as np

from .shared import holds

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Classes of characters. UNSURE: not in Python's Unicode tables, so the library is asked.
END, LETTER, NUMBER, OTHER, SPACE, BLANK, QUOTE, STMD, R, V, E, LL, UNSURE = range(13)
#: Characters taken at once, entries, and ids or characters that a table may hold before it is emptied, and characters of a chunk.
BLOCK, ENTRIES, IDS, CHUNK = 1 << 18, 1 << 20, 1 << 23, 256
#: Columns that all chunks run through from every state before those whose states have met go on from one.
MEET = 16
#: Symbols of a pretoken up to which it is merged together with others.
LONG = 256
_P = 0x9E3779B97F4A7C15 | 1
#: The patterns that are compiled, as the tokenizer files state them.
WORDS_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@lru_cache(1)
def classes() -> tuple[np.ndarray, np.ndarray]:
    """Class of each character, and lower case of those below U+0300 (itself where it has more than one character)."""
    kind, low = np.full(0x110000, UNSURE, np.uint8), np.arange(0x110000, dtype=np.uint32)
    kind[0xF0000:] = OTHER  # private use
    for c in (*range(0x40000), *range(0xE0000, 0xE1000)):
        name = unicodedata.category(chr(c))
        if name != "Cn":
            kind[c] = LETTER if name[0] == "L" else NUMBER if name[0] == "N" else BLANK if chr(c).isspace() and not 0x1C <= c <= 0x1F else OTHER
    for c in range(0x300):
        if len(chr(c).lower()) == 1:
            low[c] = ord(chr(c).lower())
    for group, those in ((SPACE, " "), (QUOTE, "'"), (STMD, "stmd"), (R, "r"), (V, "v"), (E, "e"), (LL, "l")):
        kind[[ord(x) for x in those]] = group
    return kind, low


@lru_cache(2)
def automaton(words: bool) -> tuple[np.ndarray, np.ndarray]:
    """The pattern's DFA: next state and marks by class * 16 + state. Marks: bit 0, a pretoken starts at this character;
    bit 1, one starts at the character before (the pattern looks one character ahead of what it has settled).

    words: contractions, letters, single numbers, others, each by itself. Otherwise a space goes with what follows it, and white
    space before something else leaves its last character to it."""
    start, letter, number, other, quote, qr, qv, ql, done, space, spaces, blank, blanks = range(13)
    nxt, mark = np.zeros((16, 16), np.uint8), np.zeros((16, 16), np.uint8)
    letters = (LETTER, STMD, R, V, E, LL)

    def fresh(c: int) -> int:
        if c in letters:
            return letter
        return {END: start, NUMBER: number, SPACE: space, BLANK: blank, QUOTE: quote}.get(c, other)

    def follow(state: int, c: int) -> tuple[int, int]:
        same = {letter: letters, number: () if words else (NUMBER,), other: (OTHER, QUOTE), quote: (OTHER, QUOTE)}
        if c in same.get(state, ()):
            return (other if state == quote else state), 0
        if state == quote and c in (STMD, R, V, LL):
            return {STMD: done, R: qr, V: qv, LL: ql}[c], 0
        if (state in (qr, qv) and c == E) or (state == ql and c == LL):
            return done, 0
        if state in (qr, qv, ql):  # no contraction: a quote, and a word that begins with its letter
            to, marks = follow(letter, c)
            return to, marks | 2
        if state in (space, spaces, blank, blanks):
            if c in (SPACE, BLANK):
                return (spaces if c == SPACE else blanks), 0
            if c != END and not words:
                many = 2 if state in (spaces, blanks) else 0
                if state in (space, spaces):  # the space begins it
                    return (other if c == QUOTE else fresh(c)), many
                return fresh(c), many | 1
        return fresh(c), 1

    for state in range(13):
        for c in range(UNSURE):
            nxt[c, state], mark[c, state] = follow(state, c)
    return nxt.ravel(), mark.ravel()


def cuts(kind: np.ndarray, words: bool) -> np.ndarray:
    """Whether a pretoken starts at each position. kind is END between texts and at the last place."""
    nxt, mark = automaton(words)
    n = len(kind)
    chunks = -(-n // CHUNK)
    lanes = np.zeros(chunks * CHUNK, np.uint8)
    lanes[:n] = kind
    lanes = np.ascontiguousarray(lanes.reshape(chunks, CHUNK).T) << 4  # a row: one column of all chunks
    # every chunk's state map
    states = np.broadcast_to(np.arange(16, dtype=np.uint8), (chunks, 16))
    for j in range(MEET):
        states = nxt[lanes[j][:, None] | states]
    states = np.where(np.arange(16) < 13, states, states[:, :1])
    apart = np.flatnonzero((states != states[:, :1]).any(axis=1))
    maps = np.empty((chunks, 16), np.uint8)
    one, some, rest = states[:, 0], states[apart], lanes[:, apart]
    for j in range(MEET, CHUNK):
        one = nxt[lanes[j] | one]
        if len(apart):
            some = nxt[rest[j][:, None] | some]
    maps[:] = one[:, None]
    maps[apart] = some
    # composed by a prefix scan: maps[i] becomes the map of everything up to chunk i
    step, own = 1, np.arange(chunks, dtype=np.int32)[:, None] * 16
    while step < chunks:
        maps[step:] = maps.ravel()[own[step:] + maps[:-step]]
        step *= 2
    state = np.zeros(chunks, np.uint8)
    state[1:] = maps[:-1, 0]
    marks = np.empty((CHUNK, chunks), np.uint8)
    for j in range(CHUNK):
        at = lanes[j] | state
        marks[j] = mark[at]
        state = nxt[at]
    flat = np.ascontiguousarray(marks.T).ravel()[:n]
    out = (flat & 1).astype(bool)
    out[:-1] |= flat[1:] > 1
    return out


@lru_cache(4)
def character_numbers(salt: int) -> np.ndarray:
    """A random odd number for each character; another salt names all states anew."""
    return np.random.default_rng((20240229, salt)).integers(1, 1 << 63, 0x110000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of P and of its inverse, 2 ** bits of them."""
    up, down = np.full(1 << bits, _P, np.uint64), np.full(1 << bits, pow(_P, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def named(r: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The state that each pretoken ends in: a prefix scan over the affine maps of its characters, given as their random numbers."""
    up, down = _powers(max(19, len(r).bit_length()))
    scan = np.zeros(len(r) + 1, np.uint64)
    np.cumsum(r * up[: len(r)], out=scan[1:])
    h = (scan[ends] - scan[starts]) * down[starts]
    h ^= (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return np.where(h == 0, np.uint64(1), h)


class Table:
    """Open addressing from a state's name to its number, for arrays of names."""

    def __init__(self, bits: int):
        self.bits, self.size = bits, 0
        self.keys, self.vals = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def _at(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers, -1 where there is none."""
        at, out, mask = self._at(h), np.full(len(h), -1, np.int32), (1 << self.bits) - 1
        k = self.keys[at]
        hit = k == h
        out[hit] = self.vals[at[hit]]
        left = np.flatnonzero(~hit & (k != 0))
        while len(left):
            at[left] = (at[left] + 1) & mask
            k = self.keys[at[left]]
            hit = k == h[left]
            out[left[hit]] = self.vals[at[left[hit]]]
            left = left[~hit & (k != 0)]
        return out

    def add(self, h: np.ndarray, v: np.ndarray) -> None:
        """Distinct new names."""
        at, left, mask = self._at(h), np.arange(len(h)), (1 << self.bits) - 1
        while len(left):
            free = left[self.keys[at[left]] == 0]
            self.keys[at[free]] = h[free]
            mine = self.keys[at[left]] == h[left]
            self.vals[at[left[mine]]] = v[left[mine]]
            left = left[~mine]
            at[left] = (at[left] + 1) & mask
        self.size += len(h)


def _byte_names() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it shows, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(0x100 + hidden.index(b)) for b in range(256)]


class Merges:
    """The merge table: of all neighbouring symbols the pair of the lowest rank, the leftmost of those, becomes one symbol, until
    no pair has a rank. Many strings are merged together, a step of each at a time."""

    def __init__(self, model: dict):
        vocab, names = model["vocab"], _byte_names()
        suffix = model.get("end_of_word_suffix") or ""
        self.first = np.array([vocab[x] for x in names], np.int64)
        self.last = np.array([vocab[x + suffix] for x in names], np.int64)
        self.none = len(model["merges"])
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        self.made = np.array([vocab[a + b] for a, b in pairs] + [0], np.int64)
        self.ranks = {(vocab[a], vocab[b]): i for i, (a, b) in reversed(list(enumerate(pairs)))}
        key = np.array([a << 32 | b for a, b in self.ranks], np.uint64)
        self.table = Table((len(key) * 4).bit_length())
        self.table.add(self._named(key), np.array(list(self.ranks.values()), np.int32))

    @staticmethod
    def _named(key: np.ndarray) -> np.ndarray:
        """One to one, and not 0: the key is not."""
        return (key + np.uint64(1)) * np.uint64(_P)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        got = self.table.find(self._named((a << 32 | b).view(np.uint64)))
        return np.where(got < 0, self.none, got).astype(np.int32)

    def _alone(self, sym: list[int]) -> list[int]:
        """One long string, by a heap of its pairs."""
        n, none = len(sym), self.none
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := self.ranks.get((sym[i], sym[i + 1]), none)) < none]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j] = int(self.made[r]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := self.ranks.get((sym[x], sym[y]), none)) < none:
                    heapq.heappush(heap, (r, x, sym[x], sym[y]))
        return [x for x in sym if x >= 0]

    def encode(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """data: the bytes of strings, none empty, one after another. Their ids likewise, and how many each has."""
        n = len(sizes)
        ends = np.cumsum(sizes)
        sym = self.first[data]
        sym[ends - 1] = self.last[data[ends - 1]]
        out: list[tuple[np.ndarray, np.ndarray]] = []  # owners and ids, in order within an owner
        owner = np.repeat(np.arange(n), sizes)
        for i in np.flatnonzero(sizes > LONG).tolist():
            ids = np.array(self._alone(sym[ends[i] - sizes[i] : ends[i]].tolist()), np.int64)
            out.append((np.full(len(ids), i), ids))
        if out:
            short = sizes[owner] <= LONG
            sym, owner = sym[short], owner[short]
        rank = np.full(len(sym), self.none, np.int32)  # of the pair that begins here
        if len(sym):
            rank[:-1] = np.where(owner[1:] == owner[:-1], self.rank(sym[:-1], sym[1:]), self.none)
        while len(sym):
            begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            size = np.diff(np.append(begin, len(owner)))
            least = np.minimum.reduceat(rank, begin)
            over = least == self.none
            if over.any():
                gone = np.repeat(over, size)
                out.append((owner[gone], sym[gone]))
                sym, owner, rank, least, size = sym[~gone], owner[~gone], rank[~gone], least[~over], size[~over]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(least, size))
            own = owner[at]
            at = at[np.concatenate([[True], own[1:] != own[:-1]])]
            sym[at] = self.made[least]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))
            sym, owner, rank = sym[keep], owner[keep], rank[keep]
            for i in (at[(at > 0)] - 1, at):  # the pairs that end and begin in a new symbol
                j = np.minimum(i + 1, len(sym) - 1)
                rank[i] = np.where((owner[i] == owner[j]) & (i != j), self.rank(sym[i], sym[j]), self.none)
        who, ids = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return ids[np.argsort(who, kind="stable")].astype(np.uint32), np.bincount(who, minlength=n)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of ranges, one after another."""
    end = np.cumsum(sizes, dtype=np.int64)
    total = int(end[-1]) if len(end) else 0
    kind = np.int32 if total < 1 << 30 else np.int64
    return np.repeat((starts - end + sizes).astype(kind), sizes) + np.arange(total, dtype=kind)


class Transducer:
    """The tokenizer in a tokenizers JSON file, compiled. Files that it was not made for are left to the library."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = {x["content"]: x for x in spec["added_tokens"]}
        self.special = {k: x["id"] for k, x in added.items()}
        self.splitter = re.compile("|".join(re.escape(x) for x in sorted(added, key=len, reverse=True)) or "(?!)")
        model, pre, norm = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        self.vocabulary = max([*model["vocab"].values(), *self.special.values()]) + 1
        bytewise = {"type": "ByteLevel", "add_prefix_space": False}
        plain = norm is None and bytewise.items() <= pre.items() and pre.get("use_regex") is True
        steps = pre.get("pretokenizers") or [{}]
        self.words = (
            [x["type"] for x in (norm or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and norm["normalizers"][1] == {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
            and len(steps) == 2
            and {"type": "Split", "pattern": {"Regex": WORDS_PATTERN}, "behavior": "Removed", "invert": True}.items() <= steps[0].items()
            and bytewise.items() <= steps[1].items()
            and steps[1].get("use_regex") is False
        )
        bare = not any(x[y] for x in added.values() for y in ("single_word", "lstrip", "rstrip", "normalized"))
        usual = model["type"] == "BPE" and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        self.compiled = bool((plain or self.words) and bare and usual)
        self.merges = Merges(model) if self.compiled else None
        self.salt = 0
        self._empty()

    @cached_property
    def library(self):  # noqa: ANN201
        """Loaded where it is asked for: few texts need it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _empty(self) -> None:
        self.table = Table((ENTRIES * 2 - 1).bit_length())
        self.offsets, self.ids, self.n_ids = np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint32), 0
        self.places, self.chars, self.n_chars = np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint32), 0

    @staticmethod
    def _grown(x: np.ndarray, n: int) -> np.ndarray:
        return np.concatenate([x, np.zeros(max(n - len(x), len(x)), x.dtype)]) if len(x) < n else x

    def _compile(self, h: np.ndarray, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Annotates the states of new pretokens."""
        sizes = ends - starts
        chars = cp[_ranges(starts, sizes)]
        if chars.max() < 128:
            data, lengths = chars, sizes
        else:
            wide = 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
            data = np.frombuffer(chars.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
            lengths = np.add.reduceat(wide, np.cumsum(sizes) - sizes)
        ids, counts = self.merges.encode(data, lengths)
        n, k = self.table.size, len(h)
        self.offsets, self.ids = self._grown(self.offsets, n + k + 1), self._grown(self.ids, self.n_ids + len(ids))
        self.places, self.chars = self._grown(self.places, n + k + 1), self._grown(self.chars, self.n_chars + len(chars))
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.chars[self.n_chars : self.n_chars + len(chars)] = chars
        self.offsets[n + 1 : n + 1 + k] = self.n_ids + np.cumsum(counts)
        self.places[n + 1 : n + 1 + k] = self.n_chars + np.cumsum(sizes)
        self.table.add(h, np.arange(n, n + k, dtype=np.int32))
        self.n_ids += len(ids)
        self.n_chars += len(chars)

    def _states(self, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of the state that each pretoken ends in, compiled where it is new."""
        sizes = ends - starts
        own = cp if int(sizes.sum()) == len(cp) else cp[_ranges(starts, sizes)]
        while True:
            h = named(character_numbers(self.salt)[cp], starts, ends)
            got = self.table.find(h)
            new = np.flatnonzero(got < 0)
            if len(new):
                distinct, first = np.unique(h[new], return_index=True)
                if self.table.size + len(distinct) > ENTRIES or self.n_ids > IDS or self.n_chars > IDS:
                    self._empty()
                    distinct, first = np.unique(h, return_index=True)
                    new = np.arange(len(h))
                pick = new[first]
                self._compile(distinct, cp, starts[pick], ends[pick])
                got[new] = self.table.find(h[new])
            at = self.places[got]
            if (self.places[got + 1] - at == sizes).all() and (self.chars[_ranges(at, sizes)] == own).all():
                return got
            self.salt += 1  # two pretokens of one name
            self._empty()

    def _block(self, texts: list[str], want_ids: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Counts of the texts' ids, and the ids."""
        kind, _ = classes()
        cp = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le"), "<u4")
        stops = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        k = kind[cp]
        k[stops] = END
        unsure = np.flatnonzero(k == UNSURE)
        if len(unsure):
            asked, which = np.unique(cp[unsure], return_inverse=True)
            k[unsure] = np.array([self._asked(int(c)) for c in asked], np.uint8)[which]
        starts = np.flatnonzero(cuts(k, self.words))
        ends = np.append(starts[1:], len(cp))
        first = k[starts]
        keep = (first != END) & (first != SPACE) & (first != BLANK) if self.words else first != END
        starts, ends = starts[keep], ends[keep]
        if not len(starts):
            return np.zeros(len(texts), np.int64), np.zeros(0, np.uint32) if want_ids else None
        state = self._states(cp, starts, ends)
        a = self.offsets[state]
        sizes = self.offsets[state + 1] - a
        total = np.concatenate([[0], np.cumsum(sizes)])
        counts = np.diff(total[np.searchsorted(starts, stops)], prepend=0)
        return counts, self.ids[_ranges(a, sizes)] if want_ids else None

    @lru_cache(1 << 16)  # noqa: B019
    def _asked(self, c: int) -> int:
        """The class of a character that Python doesn't know, by whether the library lets it go on with a letter or a number."""
        for probe, group in (("x", LETTER), ("1", NUMBER)):
            if any(b - a == 2 for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(f"{probe}{chr(c)}")):
                return group
        whole = self.library.pre_tokenizer.pre_tokenize_str(f"!{chr(c)}")
        return OTHER if any(b - a == 2 for _, (a, b) in whole) else NUMBER if self.words and len(whole) == 2 else BLANK

    def _normal(self, text: str) -> str:
        if not self.words:
            return text
        if text.isascii():
            return text.lower()
        cp = np.frombuffer(text.encode("utf-32-le"), "<u4")
        if cp.max() < 0x300 and not (cp == 0x130).any():  # no mark, and one character for one
            return classes()[1][cp].astype("<u4").tobytes().decode("utf-32-le")
        return self.library.normalizer.normalize_str(text)

    def _pieces(self, text: str) -> list[str]:
        """A long text, cut where a pretoken starts whatever stands around it: at a space between other characters."""
        out, at = [], 0
        while len(text) - at > BLOCK:
            i = at + BLOCK
            while i > at and not (text[i] == " " and not text[i - 1].isspace() and i + 1 < len(text) and not text[i + 1].isspace()):
                i -= 1
            if i == at:
                i = at + BLOCK
                while i < len(text) and not (text[i] == " " and not text[i - 1].isspace() and i + 1 < len(text) and not text[i + 1].isspace()):
                    i += 1
            out.append(text[at:i])
            at = i
        return [*out, text[at:]]

    def _run(self, texts: list[str], want_ids: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Counts by text, and all ids one after another."""
        if not self.compiled:
            got = [np.array(x.ids, np.uint32) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
            return np.fromiter(map(len, got), np.int64, len(got)), np.concatenate([np.zeros(0, np.uint32), *got])
        counts, found = np.zeros(len(texts), np.int64), []
        block: list[tuple[int, str]] = []

        def flush() -> None:
            if block:
                n, ids = self._block([x for _, x in block], want_ids)
                np.add.at(counts, [i for i, _ in block], n)
                found.append(ids)
                block.clear()

        size = 0
        for i, text in enumerate(texts):
            parts, at = [], 0
            for m in self.splitter.finditer(text) if any(x in text for x in self.special) else ():
                parts += [text[at : m.start()], self.special[m[0]]]
                at = m.end()
            for part in (*parts, text[at:]):
                if isinstance(part, int):
                    flush()
                    size = 0
                    counts[i] += 1
                    found.append(np.array([part], np.uint32))
                    continue
                part = self._normal(part)
                for piece in [part] if len(part) <= BLOCK else self._pieces(part):
                    if not piece:
                        continue
                    if size + len(piece) >= BLOCK:
                        flush()
                        size = 0
                    block.append((i, piece))
                    size += len(piece) + 1
        flush()
        return counts, np.concatenate([np.zeros(0, np.uint32), *found]) if want_ids else None

    def counts(self, texts: list[str]) -> np.ndarray:
        return self._run(texts, False)[0]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        n, ids = self._run(texts, True)
        return ids, n


@lru_cache(4)
def transducer(path: str) -> Transducer:
    """One for each file in a worker: its table serves all tasks that the worker runs."""
    return Transducer(path)


def _drop() -> None:
    for x in (transducer, character_numbers, _powers, classes):
        x.cache_clear()


holds("lexing", _drop)
