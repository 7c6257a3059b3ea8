"""Column expressions over text, as SQL strings. Each takes SQL expressions and returns one; packs are explicit."""

from __future__ import annotations

import re

from ..config import Pack


def lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def words(bank: list[str]) -> str:
    return f"array({', '.join(map(lit, bank))})" if bank else "cast(array() AS array<string>)"


def trimmed(t: str) -> str:
    return f"regexp_replace({t}, '^\\\\s+|\\\\s+$', '')"


def tokens(t: str) -> str:
    """ASCII words with apostrophes, lower case."""
    return f"regexp_extract_all(lower({t}), '[a-z\\']+', 0)"


def raw_tokens(t: str) -> str:
    return f"regexp_extract_all({t}, '[A-Za-z\\']+', 0)"


def content(tok: str, *banks: list[str]) -> str:
    """The tokens that carry a topic: four letters or more, in none of the banks."""
    banned = words(sorted({w for b in banks for w in b}))
    return f"filter({tok}, w -> length(w) >= 4 AND NOT array_contains({banned}, w))"


def hits(low: str, bank: list[str]) -> str:
    """How many markers of the bank occur, as substrings, each once."""
    return f"size(filter({words(bank)}, m -> contains({low}, m)))"


def phrase_pattern(phrases: list[str]) -> str:
    body = "|".join(r"\s+".join(re.escape(w) for w in p.split()) for p in phrases)
    return f"(?<![a-z])(?:{body})(?![a-z])"


def has_phrase(low: str, phrases: list[str]) -> str:
    """Whole-word match of any phrase."""
    return f"({low} rlike {lit(phrase_pattern(phrases))})" if phrases else "false"


def dangling(raw: str, pack: Pack) -> str:
    """The last verb that announces speech has no substance after it. raw: tokens in their case."""
    last = f"array_max(transform({raw}, (w, i) -> CASE WHEN array_contains({words(pack.bank('speech_act_verbs'))}, lower(w)) THEN i + 1 ELSE 0 END))"
    after = f"slice({raw}, {last} + 1, size({raw}))"
    empty = words(pack.bank("empty_after_verb"))
    return f"(coalesce({last}, 0) > 0 AND NOT exists({after}, w -> length(w) >= 3 AND NOT array_contains({empty}, lower(w)) AND NOT substr(w, 1, 1) rlike '[A-Z]'))"


def stripped(tok: str, bank: list[str]) -> str:
    """Tokens from the first one that is not in the bank on."""
    first = f"array_position(transform({tok}, w -> array_contains({words(bank)}, w)), false)"
    return f"CASE WHEN {first} = 0 THEN cast(array() AS array<string>) ELSE slice({tok}, cast({first} AS int), size({tok})) END"


def sentences(t: str) -> str:
    return f"filter(transform(split({trimmed(t)}, '(?<=[.!?])\\\\s+'), s -> {trimmed('s')}), s -> s <> '')"


def shortened(t: str, most: int) -> str:
    parts = f"split({trimmed(t)}, '\\\\s+')"
    return f"CASE WHEN size({parts}) <= {most} THEN {t} ELSE concat(regexp_replace(array_join(slice({parts}, 1, {most}), ' '), '[,;:]+$', ''), '...') END"


def names(t: str, pack: Pack) -> str:
    """Capitalised words that are not first in their sentence, lower case, each once."""
    found = f"flatten(transform(split({trimmed(t)}, '[.!?]\\\\s*'), s -> slice(regexp_extract_all(s, '[A-Za-z][A-Za-z\\']*', 0), 2, 100000)))"
    return f"array_sort(array_distinct(transform(filter({found}, w -> substr(w, 1, 1) rlike '[A-Z]' AND length(w) >= 4 AND NOT array_contains({words(pack.bank('not_names'))}, lower(w))), w -> lower(w))))"


def ass_time(s: str) -> str:
    """Seconds as h:mm:ss.cc; negative counts as 0."""
    s = f"greatest(0D, {s})"
    return f"format_string('%d:%02d:%05.2f', cast(floor({s} / 3600) AS int), cast(floor(({s} % 3600) / 60) AS int), {s} % 60)"


def ass_color(hex_rgb: str, alpha: int = 0) -> str:
    """#RRGGBB as &HAABBGGRR."""
    h = hex_rgb.lstrip("#")
    return f"&H{alpha:02X}{h[4:6]}{h[2:4]}{h[0:2]}".upper()
