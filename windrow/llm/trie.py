"""Self-join of fingerprints on a binary trie, by traversing node pairs together, and components of what it links.

A node pair starts at the root with itself. A level down, four child pairs follow, those of unlike bits with one bit of the
budget spent; pairs over budget are pruned. Two keys that differ in at most `budget` bits differ in at most budget // 2 of one of their
halves, so the join runs once with each half put first, and allows only so many bits in the levels of that half:
on random keys a key then meets some log n nodes of the level at which the trie is a key wide, and not n.

The top levels are traversed while keys are dealt to tasks: each key goes to the node pairs that it is part of (`deal`), and a pair
with too many keys is dealt further down. The rest of a pair's traversal is one task's (`trie_join`).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_since, holding, importable, mark, partitions, written

#: Node pairs taken at once, links after which classes are made, keys of a task's share that are joined at once (cut between node
#: pairs), and keys that a dealt node pair may have.
PAIRS, LINKS, ROWS, MOST = 1 << 16, 1 << 16, 1 << 18, 1 << 21
#: Levels that a node pair with too many keys is dealt down at once.
DOWN = 4
_DEALT = "lane int, depth int, a bigint, b bigint, key bigint, vertex bigint"


class _Classes:
    """Components of links between numbered leaves, as each leaf's smallest reachable number."""

    def __init__(self, n: int, labels: np.ndarray | None = None):
        self.of = np.arange(n)
        if labels is not None:
            _, first, which = np.unique(labels, return_index=True, return_inverse=True)
            self.of = first[which]
        self._settle()

    def _settle(self) -> None:
        #: How often neighbouring leaves' classes differ, up to here.
        self.changes = np.concatenate([[0], np.cumsum(self.of[1:] != self.of[:-1])]) if len(self.of) else np.zeros(0, np.int64)

    def link(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Links a[i] and b[i]; which of the links were needed for the classes that result: fewer than there are leaves."""
        needed, there = [np.zeros(0, np.int64)], np.arange(len(a))
        while True:
            x, y = self.of[a[there]], self.of[b[there]]
            there, x, y = (z[x != y] for z in (there, x, y))
            if not len(there):
                break
            hi, lo = np.maximum(x, y), np.minimum(x, y)
            order = np.lexsort((lo, hi))
            pick = order[np.concatenate([[True], hi[order][1:] != hi[order][:-1]])]
            root = np.arange(len(self.of))
            root[hi[pick]] = lo[pick]
            needed.append(there[pick])
            while (root[root] != root).any():
                root = root[root]
            self.of = root[self.of]
        self._settle()
        return np.concatenate(needed)

    def one(self, lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> np.ndarray:
        """Whether two ranges of leaves are of one class already."""
        return (self.changes[hi - 1] == self.changes[lo]) & (self.changes[hi2 - 1] == self.changes[lo2]) & (self.of[lo] == self.of[lo2])


def trie_join(keys: np.ndarray, first: np.ndarray, mid: np.ndarray, last: np.ndarray, depth: np.ndarray, spent: np.ndarray, bits: int = 64, budget: int = 3, labels: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Links below node pairs: yields (x, y, left out), places of linked keys, and which keys lost links (see below).

    Pair g is of the nodes keys[first[g]:mid[g]] and keys[mid[g]:last[g]], each sorted, or of keys[first[g]:last[g]] with itself where
    mid[g] == last[g]; depth levels are settled already with `spent` differing bits. Pairs of nodes wait on a stack and
    are taken PAIRS at a time, which bounds memory.

    Pairs whose leaves are all of one class are pruned: what is asked for is components, and near copies have links without
    number. With labels, those are the classes, and every link between different labels is given. Without, classes grow
    from the links, of every LINKS links those are given that their classes need, and the keys of links that are not given or
    not looked at are left out: a caller that goes on to doubt links has to ask for those again, with labels.
    """
    n = len(keys)
    classes = _Classes(n, labels)
    missed = np.zeros(n + 1, np.int64)
    zeros: dict[int, np.ndarray] = {}
    same = mid == last
    stack = []
    for d in np.unique(depth).tolist():
        g = depth == d
        ends = (first[g], np.where(same, last, mid)[g], np.where(same, first, mid)[g], last[g])
        stack.append((bits - 1 - d, *(x.astype(np.int32) for x in ends), spent[g].astype(np.int8)))
    links: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def miss(a: np.ndarray, b: np.ndarray) -> None:
        np.add.at(missed, a, 1)
        np.add.at(missed, b, -1)

    def settled() -> tuple[np.ndarray, np.ndarray]:
        x, y = (np.concatenate(z) for z in zip(*links, strict=True))
        links.clear()
        if labels is None:
            needed = classes.link(x, y)
            out = np.ones(len(x), bool)
            out[needed] = False
            for z in (x[out], y[out]):
                miss(z, z + 1)
            x, y = x[needed], y[needed]
        return x, y

    nobody = np.zeros(0, np.int64)
    while stack:
        bit, a, b, c, d, cost = stack.pop()
        if len(a) > PAIRS:
            stack.append((bit, *(x[PAIRS:] for x in (a, b, c, d, cost))))
            a, b, c, d, cost = (x[:PAIRS] for x in (a, b, c, d, cost))
        lone = (a == c) & (b - a == 1)
        shut = classes.one(a, b, c, d)
        if labels is None and (shut & ~lone).any():
            for x, y in ((a, b), (c, d)):
                miss(x[shut & ~lone], y[shut & ~lone])
        a, b, c, d, cost = (x[~shut & ~lone] for x in (a, b, c, d, cost))
        if not len(a):
            continue
        leaf = (b - a == 1) & (d - c == 1)
        if bit < 0:  # equal keys
            wide = (b - a).astype(np.int64) * (d - c) > PAIRS
            if wide.any():
                half = [x[wide] for x in (a, b, c, d, cost)]
                m, o, own = (half[0] + half[1]) // 2, (half[2] + half[3]) // 2, half[0] == half[2]
                for q in ((half[0], m, half[2], o), (m, half[1], half[2], o), (half[0], m, o, half[3]), (m, half[1], o, half[3])):
                    go = (q[0] < q[1]) & (q[2] < q[3]) & ~(own & (q[0] > q[2]))
                    stack.append((bit, *(x[go] for x in q), half[4][go]))
            leaf = ~wide
        p, q, r, s = (x[leaf] for x in (a, b, c, d))
        if len(p):
            size = (q - p).astype(np.int64) * (s - r)
            which = np.repeat(np.arange(len(p)), size)
            k = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
            x, y = p[which] + k // (s - r)[which], r[which] + k % (s - r)[which]
            near = ((x < y) | (p != r)[which]) & (classes.of[x] != classes.of[y]) & (np.bitwise_count(keys[x] ^ keys[y]) <= budget)
            links.append((x[near], y[near]))
            held += int(near.sum())
            if held >= LINKS:
                yield (*settled(), nobody)
                held = 0
        if bit < 0:
            continue
        a, b, c, d, cost = (x[~leaf] for x in (a, b, c, d, cost))
        if not len(a):
            continue
        if bit not in zeros:
            zeros[bit] = np.concatenate([np.zeros(1, np.int32), np.cumsum((keys >> np.uint64(bit)) & np.uint64(1) == 0, dtype=np.int32)])
        z = zeros[bit]
        m, o = a + z[b] - z[a], c + z[d] - z[c]
        own = a == c
        limit = budget // 2 if bit >= bits - bits // 2 else budget
        more = cost < limit
        cost = cost.astype(np.int8)
        nxt = [np.concatenate(x) for x in zip((a, m, c, o, cost), (m, b, o, d, cost), (a[more], m[more], o[more], d[more], cost[more] + 1), *([(x[~own & more] for x in (m, b, c, o, cost + 1))]), strict=True)]
        live = (nxt[0] < nxt[1]) & (nxt[2] < nxt[3])
        stack.append((bit - 1, *(x[live] for x in nxt)))
    if links:
        if held < LINKS:  # few: all of them
            x, y = (np.concatenate(z) for z in zip(*links, strict=True))
        else:
            x, y = settled()
        yield x, y, nobody
    if labels is None:
        yield nobody, nobody, np.flatnonzero(np.cumsum(missed[:-1]) > 0)


def _pieces(keys: np.ndarray, bits: int, depth: int, down: int) -> np.ndarray:
    """The `down` bits below depth."""
    if not down:
        return np.zeros(len(keys), np.int64)
    return ((keys >> np.uint64(bits - depth - down)) & np.uint64((1 << down) - 1)).astype(np.int64)


def _dealt(lane: np.ndarray, depth: int, a: np.ndarray, b: np.ndarray, keys: np.ndarray, vertex: np.ndarray, bits: int, budget: int, down: int) -> pa.RecordBatch:
    """The rows of node pairs (a, b), `down` levels further down: each key once for every node pair that it becomes part of."""
    spent = np.bitwise_count((a ^ b).view(np.uint64)).astype(np.int64)
    own = a == b
    left = own | (_pieces(keys, bits, 0, depth) == a)  # which of the two nodes the key is in
    limit = budget // 2 if depth + down <= bits // 2 else budget
    piece = _pieces(keys, bits, depth, down)
    out = []
    for errors in range(min(limit, down) + 1):
        for flipped in combinations(range(down), errors):
            flip = sum(1 << x for x in flipped)
            go = spent + errors <= limit
            mine = np.where(left, a, b)[go] << down | piece[go]
            other = np.where(left, b, a)[go] << down | piece[go] ^ flip
            out.append((lane[go], np.minimum(mine, other), np.maximum(mine, other), keys[go], vertex[go]))
    lane, a, b, keys, vertex = (np.concatenate(x) for x in zip(*out, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(lane, pa.int32()), pa.array(np.full(len(lane), depth + down), pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(keys.view(np.int64)), pa.array(vertex)], names=["lane", "depth", "a", "b", "key", "vertex"])


def deal(rows: DataFrame, bits: int, budget: int, down: int, keys: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """rows: (lane, key, vertex), or what `keys` makes such batches of. (lane, depth, a, b, key, vertex): the key once, with either half put
    first (lanes 2 * lane and 2 * lane + 1), for each pair (a, b) of nodes `down` levels below the root that it is part of.

    keys runs in the same worker: a stage of two Python steps would start a second worker for each core, and all of them are
    used in turn by the stages after it, each with tables of its own."""
    importable(rows.sparkSession)
    half = bits // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding("simhash")
        for batch in batches if keys is None else (part for whole in batches for part in keys(whole)):
            lane, key, vertex = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("lane", "key", "vertex"))
            key = key.view(np.uint64)
            root = np.zeros(len(key), np.int64)
            mask = np.uint64((1 << bits) - 1)
            for turn, k in ((0, key), (1, (key << np.uint64(half) | key >> np.uint64(bits - half)) & mask)):
                yield _dealt(lane.astype(np.int64) * 2 + turn, 0, root, root, k, vertex, bits, budget, down)

    return (rows.select("lane", "key", "vertex") if keys is None else rows).mapInArrow(run, _DEALT)


def _further(rows: DataFrame, bits: int, budget: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding("simhash")
        for batch in batches:
            lane, depth, a, b, key, vertex = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("lane", "depth", "a", "b", "key", "vertex"))
            for d in np.unique(depth).tolist():
                g = depth == d
                yield _dealt(lane[g], d, a[g], b[g], key[g].view(np.uint64), vertex[g], bits, budget, min(DOWN, bits - d))

    return rows.mapInArrow(run, _DEALT)


def spread(rows: DataFrame, n: int, lanes: int, bits: int, budget: int, keys: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """deal, as far down as n keys on `lanes` lanes ask for: some node pairs for each task, none of more than MOST keys while
    there are levels left."""
    spark = rows.sparkSession
    tasks = partitions(spark)
    down = max(0, math.ceil(math.log2(max(n, 1) * 4 / MOST)), min(6, math.ceil(math.log2(max(1, tasks / lanes)))) if n > 1000 else 0)
    dealt = deal(rows, bits, budget, min(down, bits // 2 - 1), keys)
    if n <= MOST:
        return dealt
    pair = ["lane", "depth", "a", "b"]
    done = None
    while True:
        dealt = written(dealt, "dealt")
        big = written(dealt.groupBy(*pair).count().where((F.col("count") > MOST) & (F.col("depth") < bits)).select(*pair), "big")
        if not big.limit(1).count():
            return dealt if done is None else done.unionByName(dealt)
        small = dealt.join(big, pair, "left_anti").select(*dealt.columns)
        done = small if done is None else done.unionByName(small)
        dealt = _further(dealt.join(big, pair, "left_semi").select(*dealt.columns), bits, budget)


def join_dealt(dealt: DataFrame, bits: int, budget: int, labelled: bool = False) -> DataFrame:
    """(a, b): for each component of the links below a dealt node pair, its smallest vertex with each other one, and (vertex, null) for the
    vertices of components of three or more: pairs that are no links themselves may be among those. As the hub is the smallest
    vertex wherever a component is found, node pairs agree on it, and a group of near copies gives pairs in proportion to its
    size. labelled: dealt has a column `label`, and it is every link between different labels that is given."""
    importable(dealt.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding("simhash")
        held: list[pa.RecordBatch] = []
        rows, most = 0, ROWS

        def done(part: pa.Table) -> Iterator[pa.RecordBatch]:
            lane, depth, a, b, key, vertex = (part.column(c).to_numpy() for c in ("lane", "depth", "a", "b", "key", "vertex"))
            key = key.view(np.uint64)
            shift = np.uint64(bits) - depth.astype(np.uint64)
            side = np.where(depth > 0, key >> np.minimum(shift, np.uint64(63)), np.uint64(0)).astype(np.int64) != a
            order = np.lexsort((key, side, b, a, lane, depth))
            lane, depth, a, b, key, vertex, side = (x[order] for x in (lane, depth, a, b, key, vertex, side))
            new = np.concatenate([[True], np.logical_or.reduce([x[1:] != x[:-1] for x in (depth, lane, a, b)])])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(key))
            sides = np.concatenate([[0], np.cumsum(~side)])
            mid = first + sides[last] - sides[first]
            go = np.where(a[first] == b[first], mid == last, (mid > first) & (mid < last))  # both nodes have keys
            first, mid, last = (x[go] for x in (first, mid, last))
            labels = part.column("label").to_numpy()[order] if labelled else None
            spent = np.bitwise_count((a[first] ^ b[first]).view(np.uint64))
            links = trie_join(key, first, mid, last, depth[first], spent, bits, budget, labels)
            if labelled:
                for x, y, _ in links:
                    x, y = vertex[x], vertex[y]
                    x, y = np.minimum(x, y), np.maximum(x, y)
                    yield pa.RecordBatch.from_arrays([pa.array(x[x != y]), pa.array(y[x != y])], names=["a", "b"])
                return
            classes = _Classes(len(key))
            for x, y, _ in links:
                classes.link(x, y)
            size = np.bincount(classes.of, minlength=len(key))[classes.of]
            member = np.flatnonzero(size > 1)
            hub = np.full(len(key), np.iinfo(np.int64).max)
            np.minimum.at(hub, classes.of[member], vertex[member])
            a, b = hub[classes.of[member]], vertex[member]
            yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])
            many = np.unique(b[size[member] > 2])
            yield pa.RecordBatch.from_arrays([pa.array(many), pa.nulls(len(many), pa.int64())], names=["a", "b"])

        pair = ("lane", "depth", "a", "b")
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= most:
                whole = pa.Table.from_batches(held)
                apart = np.logical_or.reduce([whole.column(c).to_numpy() != whole.column(c)[-1].as_py() for c in pair])
                cut = int(apart.sum())  # rows of a pair come together
                if cut:
                    yield from done(whole.slice(0, cut))
                held = whole.slice(cut).combine_chunks().to_batches()
                rows -= cut
                most = max(ROWS, rows * 2)
        if held:
            yield from done(pa.Table.from_batches(held))

    dealt = dealt.repartition(partitions(dealt.sparkSession), "lane", "a", "b").sortWithinPartitions("lane", "depth", "a", "b")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def contracted(edges: DataFrame) -> DataFrame:
    """(label, to) for the vertices of edges (a, b): `to` is the same within a component and different between.

    Each round, a vertex moves to its smallest neighbour's smallest neighbour, and edges between the moved
    vertices remain. Labels should be scrambled: then paths to a local minimum are short and edges run out in a few rounds."""
    spark, since = edges.sparkSession, mark()
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    moved = None
    while edges.limit(1).count():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("to")), "step")
        jump = step.join(step.select(F.col("a").alias("to"), F.col("to").alias("next")), "to", "left").select("a", F.coalesce("next", "to").alias("to"))
        jump = written(jump, "jump")
        ends = edges.join(jump, "a").select(F.col("to").alias("x"), F.col("b").alias("a")).join(jump, "a").select("x", F.col("to").alias("y"))
        edges = written(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if moved is None:
            moved = jump.select(F.col("a").alias("label"), "to")
        else:
            moved = moved.join(jump.select(F.col("a").alias("to"), F.col("to").alias("next")), "to", "left").select("label", F.coalesce("next", "to").alias("to"))
        moved = written(moved, "moved")
        drop_since(spark, since, edges, moved)
    return moved if moved is not None else spark.createDataFrame([], "label bigint, to bigint")
