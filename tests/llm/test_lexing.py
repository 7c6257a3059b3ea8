"""The compiled tokenizer against the library: contractions at every edge, random cuts of batches, all of Unicode, clashing names."""

import random

import numpy as np
import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

from windrow.llm import lexing

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TAILS = ["'s", "'t", "'m", "'d", "'re", "'ve", "'ll", "'r", "'v", "'l", "'", "''", "'S", "'sx", "'lle"]
PARTS = [*TAILS, "a", "l", "e", " ", "  ", "\n", "\t", " ", "　", "1", "22", "é", "ß", "Σ", "İ", "!", "...", "<|endoftext|>", "<|startoftext|>", "日", "\x1c", "ǅ", "²", "́", "᷺̑", "̬᷶", "word", "😀", "한국", "ไทย", "Ᲊ", "\U000105c0", "\U000f0000", "Ⅳ"]


def same(machine, lib, texts, sizes):
    want = [x.ids for x in lib.encode_batch_fast(texts, add_special_tokens=False)]
    at = 0
    while at < len(texts):
        part = texts[at : at + next(sizes)]
        ids, n = machine.encode(part)
        assert n.tolist() == machine.counts(part).tolist()
        for text, own, there in zip(part, np.split(ids, np.cumsum(n)[:-1]), want[at : at + len(part)], strict=True):
            assert own.tolist() == there, text[:80]
        at += len(part)


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_equals_library_in_any_order(path):
    rnd = random.Random(8)
    texts = ["".join(rnd.choices(PARTS, k=rnd.randint(0, 12))) for _ in range(6000)]
    texts += ["".join(chr(c) for c in (rnd.randrange(m) for _ in range(10)) if not 0xD800 <= c <= 0xDFFF) for m in (0x400, 0x3400, 0x110000) for _ in range(1500)]
    rnd.shuffle(texts)
    machine = lexing.Transducer(path)
    assert machine.compiled
    same(machine, Tokenizer.from_file(path), texts, iter(lambda: rnd.choice([1, 2, 7, 400]), None))


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_contractions_alone_and_last(path, monkeypatch):
    machine, lib = lexing.Transducer(path), Tokenizer.from_file(path)
    for tail in TAILS:
        for batch in ([tail], ["it" + tail], ["it" + tail, "x"], ["x", "it" + tail], ["x", tail, tail]):
            same(machine, lib, batch, iter(lambda: 9, None))
    monkeypatch.setattr(lexing, "BLOCK", 64)  # each piece of a long text ends in one
    for tail in TAILS:
        same(lexing.Transducer(path), lib, [f"it{tail} " * 300 + f"it{tail}", "z" * 500 + tail], iter(lambda: 9, None))


def test_cuts_are_the_patterns():
    patterns = {False: r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", True: lexing.WORDS_PATTERN}
    rnd = random.Random(9)
    kind, _ = lexing.classes()
    for words, pattern in patterns.items():
        for n in (0, 1, 2, 50, 1000, 5000):
            text = "".join(rnd.choices("stmdrevlx' \n1!", k=n))
            k = kind[np.array([*map(ord, text), 10])]
            k[-1] = lexing.END
            at = np.flatnonzero(lexing.cuts(k, words))
            got = [i for i in at.tolist() if i < n and not (words and text[i].isspace())]
            assert got == [m.start() for m in regex.finditer(pattern, text)]


def test_one_name_for_two_pretokens_is_found_out(monkeypatch):
    plain = lexing.named
    monkeypatch.setattr(lexing, "named", lambda r, a, b: plain(r, a, b) | np.uint64(~15 & (1 << 64) - 1))
    machine, lib = lexing.Transducer(BYTES), Tokenizer.from_file(BYTES)
    texts = [f"{a}{b}" for a in "abcdef" for b in "ghijkl"] * 2
    same(machine, lib, texts, iter(lambda: 1, None))
    assert machine.salt > 0


def test_merges_of_long_strings():
    lib = Tokenizer.from_file(BYTES)
    rnd = random.Random(4)
    machine = lexing.Transducer(BYTES)
    same(machine, lib, ["".join(rnd.choices("abn", k=n)) for n in (255, 256, 257, 3000)] + ["x" * 20_000], iter(lambda: 2, None))


def test_other_tokenizers_are_left_to_the_library(tmp_path):
    lib = Tokenizer.from_file(BYTES)
    text = lib.to_str().replace('"add_prefix_space":false', '"add_prefix_space":true', 1)
    (tmp_path / "t.json").write_text(text)
    machine = lexing.Transducer(str(tmp_path / "t.json"))
    assert not machine.compiled
    same(machine, Tokenizer.from_str(text), ["it's", "", "a b"], iter(lambda: 2, None))
