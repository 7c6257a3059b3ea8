"""Quality rules as a bitmask ledger, in DataFrame operations.

Every rule is evaluated once: the ledger stores its measurements and one failure bit for each rule. What is kept is then a
policy, a versioned mask over those bits; a new policy or an ablation reads the ledger, not the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exact_dedup import BLANKS, without

#: name -> SQL condition over the measurements under which a text fails; a rule's bit is its place here.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "shouting": "2 * n_upper > word_chars",
    "exclamations": "10 * n_bangs > 3 * n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
}
BASE = ("few_words", "repeated_windows")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs")


@dataclass(frozen=True)
class Policy:
    """The rules that a text must pass."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(x) for x in self.rules)


POLICIES = {(p.name, p.version): p for p in (Policy("base", 1, BASE), Policy("prose", 1, tuple(RULES)))}
_SYMBOLS, _UPPER = "#*$%&|<>", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _count(text: Column, chars: str) -> Column:
    """How many of the text's characters are among chars: replacing few by byte search is faster than a look-up of each character."""
    rest = without(text, chars) if len(chars) <= 8 else F.translate(text, chars, "")
    return F.char_length(text) - F.char_length(rest)


def _repeat_words(hashes: str) -> str:
    """Words covered by windows whose hash occurs twice or more, by sorting (hash, place) and comparing neighbours."""
    pairs = f"array_sort(transform({hashes}, (h, i) -> struct(h AS h, i AS i)))"
    return f"""
    CASE WHEN size({hashes}) = size(array_distinct({hashes})) THEN 0L ELSE
      aggregate(
        array({pairs}),
        0L,
        (zero, s) -> aggregate(
          array(sort_array(array_distinct(flatten(transform(
            filter(arrays_zip(slice(s, 1, size(s) - 1), slice(s, 2, size(s) - 1)), z -> z.`0`.h = z.`1`.h),
            z -> array(z.`0`.i, z.`1`.i)))))),
          0L,
          (none, p) -> 3L + aggregate(zip_with(slice(p, 1, size(p) - 1), slice(p, 2, size(p) - 1), (x, y) -> least(3, y - x)), 0L, (t, d) -> t + d)))
    END"""


def ledger(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each row of df: the id, MEASURES (bigint) and failed_bits (bigint, bit i: rule i of RULES fails).

    Words are `[^\\x20\\x09-\\x0D]+`; a null text has none. n_dup_lines: lines (split at \\n) with a word that equal an
    earlier line; n_repeat_words: words in windows of three words that occur twice or more, the first included (windows
    are compared by 64-bit hashes). All comparisons are whole numbers, so an empty text divides by nothing. Whole texts,
    one pass, no shuffle, no Python; a row's arrays grow with its text (about 60 bytes a word), so the longest text bounds
    a task's memory. Each row is measured by itself, repeated ones too; other columns are not read, so none clashes; an empty table
    gives an empty one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col), text.alias("_text"))
    rows = rows.select(id_col, "_text", F.expr(r"filter(split(_text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')").alias("_words"), F.expr(r"filter(split(_text, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')").alias("_lines"))
    window = "transform(arrays_zip(slice(_words, 1, size(_words) - 2), slice(_words, 2, size(_words) - 2), slice(_words, 3, size(_words) - 2)), x -> xxhash64(x.`0`, x.`1`, x.`2`))"
    rows = rows.select(
        id_col,
        F.size("_words").alias("n_words"),
        F.char_length(without(F.col("_text"), BLANKS)).alias("word_chars"),
        _count(F.col("_text"), _SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        F.expr(f"CASE WHEN size(_words) < 4 THEN cast(array() AS array<bigint>) ELSE {window} END").alias("_hashes"),
        F.size("_lines").alias("n_lines"),
        _count(F.col("_text"), _UPPER).alias("n_upper"),
        _count(F.col("_text"), "!").alias("n_bangs"),
    )
    rows = rows.withColumn("n_repeat_words", F.expr(_repeat_words("_hashes")))
    rows = rows.select(id_col, *(F.col(c).cast("bigint").alias(c) for c in MEASURES))
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())]
    return rows.withColumn("failed_bits", sum(bits[1:], bits[0]).cast("bigint"))


def apply_policy(entries: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with kept: no rule of the policy fails."""
    return entries.withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(policy.mask)) == 0)


def ablations(entries: DataFrame, policy: Policy) -> DataFrame:
    """A row for each rule of the policy: fails (texts that fail it), alone (texts that fail no other rule of it, so
    that dropping the rule would keep them), kept_without (what the policy would keep without it).

    Texts are first counted by their bits, of which there are 2 ** len(RULES) at most; rules are taken from those counts."""
    mask = policy.mask
    counts = entries.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << list(RULES).index(r)).cast("bigint").alias("bit")) for r in policy.rules))
    each = counts.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.*")
    of = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    without = F.col("bits").bitwiseAND(F.bitwise_not("bit"))
    return each.groupBy("rule", "bit").agg(of(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("fails"), of(F.col("bits") == F.col("bit")).alias("alone"), of(without == 0).alias("kept_without"))
