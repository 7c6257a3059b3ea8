"""Temperature mixing of sources, in DataFrame operations.

Weights are source token shares to a power: 1 keeps the shares, 0 makes sources equal. The power is bisected to the
flattest mixture that still meets an entropy target and a repetition limit. Weights become token budgets, and budgets
become whole passes over a source and a prefix of one more pass, in which blocks of documents are permuted.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import put_aside, written

#: Sources whose targets may be broadcast, and cells (blocks of sources).
SOURCES, CELLS = 100_000, 200_000
#: Tokens are estimated from words, which SQL can count: `[^\x20\x09-\x0D]+`.
_WORDS = r"size(filter(split(coalesce({0}, ''), '[\\x20\\x09-\\x0D]+'), w -> w <> ''))"


@dataclass(frozen=True)
class Mixture:
    power: float
    budget: int
    tokens: dict  # by source
    weights: dict

    def target(self, source: object) -> int:
        return int(round(self.weights[source] * self.budget))


def _weights(tokens: dict, power: float) -> dict:
    most = max(tokens.values())
    raw = {s: (n / most) ** power for s, n in tokens.items()}
    total = math.fsum(raw.values())
    return {s: x / total for s, x in raw.items()}


def _entropy(weights: dict) -> float:
    return -math.fsum(w * math.log(w) for w in weights.values() if w > 0)


def solve(tokens: dict, entropy: float, repeats: float, budget: int | None = None, steps: int = 60) -> Mixture:
    """The mixture of sources with tokens each (those of none are left out).

    entropy: share of the greatest possible, ln(number of sources), that the weights should reach. repeats: passes over a source
    at most. budget: tokens of the mixture; None: as many as give every source one whole pass at least, so nothing is lost.
    The power falls from 1 until the entropy is met, but not so far that a source would repeat more often."""
    tokens = {s: n for s, n in tokens.items() if n > 0}
    if not tokens:
        return Mixture(1.0, budget or 0, {}, {})

    def size(w: dict) -> float:
        return budget if budget is not None else max(n / w[s] for s, n in tokens.items())

    def fits(power: float) -> bool:
        w = _weights(tokens, power)
        return max(w[s] * size(w) / n for s, n in tokens.items()) <= max(repeats, size(_weights(tokens, 1.0)) / sum(tokens.values())) + 1e-9

    def even(power: float) -> bool:
        return _entropy(_weights(tokens, power)) >= entropy * math.log(len(tokens)) - 1e-12

    def greatest(ok, least: float = 0.0, most: float = 1.0) -> float:  # noqa: ANN001
        """ok holds up to some power; the greatest such."""
        if ok(most):
            return most
        for _ in range(steps):
            mid = (least + most) / 2
            least, most = (mid, most) if ok(mid) else (least, mid)
        return least

    power = greatest(even)
    if not fits(power):
        power = 1.0 - greatest(lambda x: fits(1.0 - x), 0.0, 1.0 - power)
    w = _weights(tokens, power)
    return Mixture(power, int(round(size(w))), tokens, w)


def mix(df: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", entropy: float = 0.97, repeats: float = 4.0, budget: int | None = None, blocks: int = 256, seed: int = 1, keep: list[str] | None = None) -> tuple[DataFrame, Mixture]:
    """df's rows with the columns `keep` (by default all), n_tokens, block, copies (how often the mixture has the row; 0: not at all),
    weight and order_key.

    A null source is a source of its own. Documents without a word have 0 tokens and one copy for each whole pass. Each source's
    documents are dealt to `blocks` by a hash of the id and its blocks permuted by seed. A budget of k whole passes and a
    rest gives each document k copies, and those before the rest's end in the permutation one more; the document that crosses
    the end is left out. Running sums go over block totals (blocks for each source) and, in the one block for each source that the
    end cuts, over its documents, so a source of any size is dealt over all tasks. Rows that are equal in id and size
    are told apart arbitrarily. Columns of df named like a result, in any case, are replaced; no other name clashes. Words are
    counted once, into a table with the columns to keep; texts of any length. What reaches the driver is one total
    for each source, and its target is broadcast up to SOURCES of them, its blocks up to CELLS; an empty table gives an empty one.

    order_key sorts the first pass: by a permutation of blocks over all sources, then within a block.
    """
    spark = df.sparkSession
    aside, back = put_aside(df, ("n_tokens", "block", "copies", "weight", "order_key"), keep)
    rows = df.select(*aside, df[f"`{source_col}`"].alias("s__"), df[f"`{id_col}`"].alias("id__"), df[f"`{text_col}`"].alias("text__"))
    rows = rows.withColumn("n_tokens", F.expr(_WORDS.format("text__")).cast("bigint")).drop("text__")
    rows = written(rows.withColumn("block", F.pmod(F.xxhash64("id__", F.lit(seed)), F.lit(blocks)).cast("int")), "mix")
    cells = rows.groupBy("s__", "block").agg(F.sum("n_tokens").alias("n"))
    totals = {r[0]: r[1] for r in cells.groupBy("s__").agg(F.sum("n")).collect()}
    mixture = solve(totals, entropy, repeats, budget)
    plan = []
    for s, n in mixture.tokens.items():
        passes, rest = divmod(mixture.target(s), n)
        plan.append((s, mixture.weights[s], int(passes), int(rest)))
    targets = spark.createDataFrame(plan, f"t__ {df.schema[source_col].dataType.simpleString()}, weight double, passes bigint, rest bigint")
    targets = F.broadcast(targets) if len(plan) <= SOURCES else targets
    turn = F.xxhash64(F.col("block"), F.col("s__").cast("string"), F.lit(seed + 1))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("s__").orderBy(turn, "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("before", before).join(targets, F.col("s__").eqNullSafe(F.col("t__")), "left")
    cells = cells.select("s__", "block", "n", "before", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("passes", F.lit(1)).alias("passes"), F.coalesce("rest", F.lit(0)).alias("rest"))
    cut = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("n") > F.col("rest"))
    cells = cells.withColumn("cut", cut).withColumn("whole", F.col("before") + F.col("n") <= F.col("rest"))
    cells = cells.drop("n").withColumnsRenamed({"s__": "of__", "block": "at__"})
    cells = F.broadcast(cells) if (len(totals) + 1) * blocks <= CELLS else cells
    told = rows.join(cells, F.col("s__").eqNullSafe(F.col("of__")) & (F.col("block") == F.col("at__")))
    told = told.withColumn("inner__", F.xxhash64(F.col("id__"), F.lit(seed + 2)))
    order = F.sum("n_tokens").over(Window.partitionBy("s__", "block").orderBy("inner__", "id__", "n_tokens").rowsBetween(Window.unboundedPreceding, 0))
    extra = F.when(F.col("whole"), F.col("n_tokens") > 0).when(F.col("cut"), F.col("before") + F.col("upto") <= F.col("rest")).otherwise(F.lit(False))
    part = told.where("cut").withColumn("upto", order)
    rest = told.where("NOT cut").withColumn("upto", F.lit(0).cast("bigint"))
    key = F.struct(F.xxhash64(F.col("block"), F.lit(seed + 3)).alias("block"), F.col("inner__").alias("place"))
    out = part.unionByName(rest).withColumn("copies", F.col("passes") + extra.cast("bigint"))
    return out.select(*back, "n_tokens", "block", "copies", "weight", key.alias("order_key")), mixture
