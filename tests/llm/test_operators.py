"""Each operator against brute force on small fixtures with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from windrow.llm import chat, exact_dedup, huffman, language, lexing, mixing, packing, quality, simhash, token_counts, token_store, toxicity, trie

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", "   \n", "a b", "a  b", "ab", "Éa b'll can't 'S <|endoftext|> x", "x" * 5000, "one two three four " * 40, "one two three four " * 40, "tab\tb\nb\nb\n\nc", "日本 ㍿ ǅ 12 3", "$ # a\n!\n!"]


def docs(spark, texts=TEXTS, extra=True):
    rows = [(i, t, ["s", "t", None][i % 3], i) for i, t in enumerate(texts)]
    rows += [(3, "a b", "s", 7), (3, "a b", "s", 7), (None, "a b", None, 1)] if extra else []
    # `kept`, `block` and others clash with names of results
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, kept int").selectExpr("*", "1 AS block", "'x' AS score", "0 AS length", "0 AS n_tokens", "0 AS fp", "0 AS copies")


def empty(spark):
    return docs(spark).limit(0)


@pytest.mark.parametrize("words", [None, 1])
def test_exact_dedup(spark, words):
    got = exact_dedup.exact_dedup(docs(spark), words=words).collect()
    src = docs(spark).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for r in src:
        groups.setdefault(norm(r.text), []).append(r)
    assert len(got) == len(src)
    for r in got:
        own = groups[norm(r.text)]
        best = min(own, key=lambda x: (-len(x.text or ""), x.doc_id is None, x.doc_id or 0))
        assert (r.keep_id, r.group_size, r.text_sha256) == (best.doc_id, len(own), hashlib.sha256(norm(r.text).encode()).hexdigest())
    kept = [norm(r.text) for r in got if r.kept]
    assert sorted(kept) == sorted(groups)  # one row of each group, of repeated rows too
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_exact_dedup_unique_rows_do_not_shuffle(spark):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(2000)], "doc_id bigint, text string")
    out = exact_dedup.exact_dedup(rows)
    assert out.count() == 2000 and out.where("kept AND group_size = 1").count() == 2000


def measures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(tri)
    hit = {i + k for i, t in enumerate(tri) if n[t] > 1 for k in range(3)}
    t = text or ""
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(lines), len(re.findall("[A-Z]", t)), t.count("!"))


def test_quality(spark):
    rnd = random.Random(3)
    texts = TEXTS + [" ".join(rnd.choices("abcde", k=rnd.randint(0, 90))) for _ in range(200)]
    entries = quality.ledger(docs(spark, texts, False)).collect()
    for r in entries:
        assert tuple(r[m] for m in quality.MEASURES) == measures(texts[r.doc_id]), texts[r.doc_id]
    df = quality.ledger(docs(spark, texts, False))
    policy = quality.POLICIES["prose", 1]
    told = {r.rule: r for r in quality.ablations(df, policy).collect()}
    bits = [r.failed_bits for r in entries]
    for i, rule in enumerate(quality.RULES):
        assert told[rule].fails == sum(b >> i & 1 for b in bits)
        assert told[rule].kept_without == sum(b & ~(1 << i) == 0 for b in bits)
    assert quality.apply_policy(df, policy).where("kept").count() == sum(b == 0 for b in bits)
    assert quality.ledger(empty(spark)).count() == 0


def fuzz(n, seed):
    rnd = random.Random(seed)
    parts = ["a", "s", "t", "re", "ve", "ll", "'", "'s", "'S", " ", "  ", "\n", "\t", "1", "22", "é", "ß", "Σ", "İ", "!", "...", "<|endoftext|>", "日", "\x1c", "ǅ", "²", "́", "word", " word"]
    return ["".join(rnd.choices(parts, k=rnd.randint(0, 14))) for _ in range(n)]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_transducer_equals_library(path):
    texts = [t or "" for t in TEXTS] + fuzz(4000, 1) + ["word " * 300_000, "y" * 50_000, "a\n" * 20_000]
    lib = Tokenizer.from_file(path)
    machine = lexing.Transducer(path)
    ids, counts = machine.encode(texts)
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == list(map(len, want)) == machine.counts(texts).tolist()
    assert ids.tolist() == [x for y in want for x in y]


def test_transducer_forgets(monkeypatch):
    monkeypatch.setattr(lexing, "ENTRIES", 64)
    machine, lib = lexing.Transducer(BYTES), Tokenizer.from_file(BYTES)
    texts = fuzz(300, 2)
    for i in range(0, 300, 4):
        assert machine.counts(texts[i : i + 4]).tolist() == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts[i : i + 4]]


def test_token_counts(spark):
    lib = Tokenizer.from_file(BYTES)
    rows = token_counts.count_tokens(docs(spark), BYTES, limit=100).collect()
    src = Counter((r.doc_id, len((r.text or "").encode()), n := len(lib.encode(r.text or "", add_special_tokens=False).ids), n > 100) for r in docs(spark).collect())
    assert Counter(map(tuple, rows)) == src
    assert token_counts.count_tokens(empty(spark), BYTES).count() == 0


def test_huffman():
    rnd = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 50, 3000):
        ids = np.sort(rnd.choice(50_000, n, replace=False)).astype(np.int64)
        counts = (rnd.pareto(0.6, n) * 10 + 1).astype(np.int64)
        code = huffman.Code.of(ids, counts, 12)
        assert n < 2 or (code.bits.max() <= max(12, (n - 1).bit_length()) and np.sum(2.0**-code.bits) == 1)
        for size in (0, 1, 255, 256, 257, 5000):
            x = rnd.choice(ids, size).astype(np.uint32) if n else np.zeros(0, np.uint32)
            payload, marks = code.encode(x) if n else (b"", b"")
            starts, lanes = token_store._lanes(np.array([len(x)]), np.array([len(payload)]), np.frombuffer(marks, "<u2").astype(np.int64), 0)
            assert code.decode(payload, starts, lanes).tolist() == x.tolist()
    # without a limit that binds, lengths are those of a Huffman tree
    assert sorted(huffman.lengths(np.array([1, 1, 2, 4, 8]), 16).tolist()) == [1, 2, 3, 4, 4]
    a, b = rnd.bytes(1000), rnd.bytes(77)
    assert huffman.crc_join(zlib.crc32(a), zlib.crc32(b), 77) == zlib.crc32(a + b)


def test_token_store(spark):
    lib = Tokenizer.from_file(BYTES)
    df = docs(spark, TEXTS + ["a b " * 70_000, "!"])
    path = token_store.write_tokens(df, BYTES)
    want = {}
    for r in df.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids + [0]
        want.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    rows = sorted(token_store.read_tokens(spark, path).collect(), key=lambda r: r.start)
    at = 0
    for r in rows:
        assert r.start == at
        want[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        at += r.n_tokens
    assert not any(want.values())
    keys = [(-1 if r.doc_id is None else r.doc_id) for r in rows]
    assert keys == sorted(keys)
    ids = [i for r in sorted(token_store.read_tokens(spark, path, with_ids=True).collect(), key=lambda r: r.start) for i in r.ids]
    assert len(ids) == at
    assert token_store.read_tokens(spark, token_store.write_tokens(empty(spark), BYTES)).count() == 0


def test_patterns():
    rnd = np.random.default_rng(1)
    for _ in range(30):
        cap = int(rnd.integers(5, 60))
        counts = np.bincount(rnd.integers(1, cap + 1, 200), minlength=cap + 1)
        found = packing.patterns(counts, cap)
        used = np.zeros(cap + 1, int)
        for times, bin_ in found:
            assert times > 0 and sum(bin_) <= cap
            for n in bin_:
                used[n] += times
        assert (used == counts).all()
    # greedy 6 + 3 leaves 1 free in 10; 6 + 2 + 2 is full
    assert sorted(packing.patterns(np.bincount([6, 3, 2, 2], minlength=11), 10)[0][1]) == [2, 2, 6]


def test_packing(spark):
    df = docs(spark, TEXTS + ["some words here " * n for n in range(1, 300)])
    lib = Tokenizer.from_file(WORDS)
    rows = packing.pack_documents(df, WORDS, 256).collect()
    want = Counter()
    for r in df.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids + [0]
        want.update((r.doc_id, j, a, len(x := ids[a : a + 256]), zlib.crc32(np.array(x, "<u4").tobytes())) for j, a in enumerate(range(0, len(ids), 256)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= 1.02 * sum(r.length for r in rows) / 256 + 1
    assert packing.pack_documents(empty(spark), WORDS, 256).count() == 0


def plain_simhash(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def components(points, near):
    root = list(range(len(points)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(points)):
        for j in range(i):
            if near(points[i], points[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(points))]


def clustered(n, seed):
    rnd = random.Random(seed)
    out = set()
    while len(out) < n:
        x = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 1, 3, 40])):
            out.add(x)
            for _ in range(rnd.choice([1, 2, 3, 4])):
                x ^= 1 << rnd.randrange(64)
    return sorted(out)[:n]


def joined(x, bits=64, budget=3, labels=None):
    """The pairs that the trie gives with either half put first, and the keys it left out."""
    keys, zero, half = np.array(x, np.uint64), np.zeros(1, np.int64), bits // 2
    pairs, out = set(), set()
    for turned in (keys, (keys << np.uint64(half) | keys >> np.uint64(bits - half)) & np.uint64((1 << bits) - 1)):
        order = np.argsort(turned, kind="stable")
        end = np.array([len(keys)])
        for a, b, missed in trie.trie_join(turned[order], zero, end, end, zero, zero, bits, budget, None if labels is None else labels[order]):
            pairs |= {(min(i, j), max(i, j)) for i, j in zip(order[a].tolist(), order[b].tolist(), strict=True)}
            out |= set(order[missed].tolist())
    return pairs, out


def linked_pairs(x, budget=3):
    return {(j, i) for i in range(len(x)) for j in range(i) if (x[i] ^ x[j]).bit_count() <= budget}


def test_trie_join():
    for seed in range(3):
        x = clustered(400, seed)
        assert joined(x) == (linked_pairs(x), set())
        labels = np.array([i % 5 for i in range(len(x))])
        assert joined(x, labels=labels)[0] == {(a, b) for a, b in linked_pairs(x) if labels[a] != labels[b]}
    rnd = random.Random(2)
    short = [rnd.getrandbits(12) for _ in range(300)] + [7] * 40  # equal keys too
    for budget in (0, 1, 2, 3):
        assert joined(short, 12, budget)[0] == linked_pairs(short, budget)


def test_trie_join_in_small_bites(monkeypatch):
    monkeypatch.setattr(trie, "PAIRS", 64)
    monkeypatch.setattr(trie, "LINKS", 16)
    for x, bits in ((clustered(300, 9), 64), ([random.Random(3).getrandbits(20)] * 50 + [1, 2, 3], 20)):
        pairs, out = joined(x, bits)
        all_ = linked_pairs(x)
        assert pairs <= all_ and all({a, b} <= out for a, b in all_ - pairs)  # what is not given is left out, and said to be
        near = lambda i, j, p=pairs: (min(i, j), max(i, j)) in p
        assert components(range(len(x)), near) == components(x, lambda a, b: (a ^ b).bit_count() <= 3)
        labels = np.array([i % 3 for i in range(len(x))])
        assert joined(x, bits, labels=labels)[0] == {(a, b) for a, b in all_ if labels[a] != labels[b]}


def test_node_pairs_of_many_keys_are_dealt_further(spark, monkeypatch):
    monkeypatch.setattr(trie, "MOST", 60)
    x = clustered(900, 12)
    rows = spark.createDataFrame([(0, int(np.uint64(v).view(np.int64)), i) for i, v in enumerate(x)], "lane int, key bigint, vertex bigint")
    dealt = trie.spread(rows, len(x), 1, 64, 3)
    assert max(r["count"] for r in dealt.groupBy("lane", "depth", "a", "b").count().collect()) <= 60
    rows = trie.join_dealt(dealt, 64, 3).collect()
    got = {(r.a, r.b) for r in rows if r.b is not None}
    want = components(x, lambda a, b: (a ^ b).bit_count() <= 3)
    assert components(range(len(x)), lambda i, j: (min(i, j), max(i, j)) in got) == want
    assert all({a, b} <= {r.a for r in rows if r.b is None} for a, b in linked_pairs(x) - got)
    labelled = dealt.withColumn("label", dealt.vertex % 4)
    assert {(r.a, r.b) for r in trie.join_dealt(labelled, 64, 3, labelled=True).collect()} == {(a, b) for a, b in linked_pairs(x) if a % 4 != b % 4}


def test_linked(spark):
    x = clustered(1500, 11)
    want = components(x, lambda a, b: (a ^ b).bit_count() <= 3)
    df = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in x], "fp bigint")
    got = {r.fp: r.label for r in simhash.linked(df).collect()}
    size = Counter(want)
    classes = {}
    for v, c in zip(x, want, strict=True):
        fp = int(np.uint64(v).view(np.int64))
        assert (fp in got) == (size[c] > 1)
        if fp in got:
            classes.setdefault(c, set()).add(got[fp])
    assert all(len(s) == 1 for s in classes.values()) and len({min(s) for s in classes.values()}) == len(classes)


def test_near_duplicates(spark):
    rnd = random.Random(4)
    base = [[f"w{rnd.randrange(500)}" for _ in range(120)] for _ in range(15)]
    texts = list(TEXTS)
    for b in base:
        for _ in range(6):
            t = list(b)
            for _ in range(rnd.randint(0, 3)):
                t[rnd.randrange(len(t))] = "changed"
            texts.append(" ".join(t))
    df = docs(spark, texts)
    src = df.collect()
    fps = [plain_simhash(r.text) for r in src]
    comp = components(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for r, c in zip(src, comp, strict=True):
        if r.doc_id is not None:
            least[c] = min(least.get(c, r.doc_id), r.doc_id)
    want = Counter((r.doc_id, f"{f:016x}", least[c]) for r, f, c in zip(src, fps, comp, strict=True))
    assert Counter(map(tuple, simhash.near_duplicates(df).collect())) == want
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_language(spark):
    train = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    profiles = language.learn(train.where("doc_id % 3 <> 1"))
    assert profiles.languages == ["de", "en", "es", "fr"]
    rows = language.identify(train.where("doc_id % 3 = 1"), profiles, keep=["doc_id", "lang"]).collect()
    assert sum(r.lang == r.lang_pred for r in rows) > 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
    odd = {r.doc_id: r for r in language.identify(docs(spark, [None, "", "12 !"], False), profiles).collect()}
    assert all((r.lang_pred, r.score) == ("und", 0) for r in odd.values())
    none = language.learn(train.limit(0))
    assert {r.lang_pred for r in language.identify(train.limit(5), none).collect()} == {"und"}
    assert language.identify(empty(spark), profiles).count() == 0


def test_language_vectors_whole_text():
    assert np.allclose(language.vectors(["the cat " * 9])[0], language.vectors(["the cat " * 9, "x"])[0])
    text = "some long words " * 200_000
    assert np.allclose(language.vectors([text])[0], language.vectors([text[: len(text) // 2]])[0], atol=1e-3)


def test_mixture():
    tokens = {"a": 1000, "b": 100, "c": 10, None: 5, "z": 0}
    m = mixing.solve(tokens, 0.9, 4.0)
    assert "z" not in m.tokens and abs(sum(m.weights.values()) - 1) < 1e-9
    passes = {s: m.weights[s] * m.budget / n for s, n in m.tokens.items()}
    assert max(passes.values()) <= 4.01 and min(passes.values()) > 0.999
    free = mixing.solve(tokens, 0.9, 1e9)
    assert abs(mixing._entropy(free.weights) - 0.9 * np.log(4)) < 1e-6
    assert mixing.solve({}, 0.9, 4).budget == 0 and mixing.solve({"a": 3}, 0.9, 4).weights == {"a": 1.0}
    assert mixing.solve({"a": 5, "b": 5}, 1.0, 4).power == 1.0


@pytest.mark.parametrize("budget", [None, 3000, 900])
def test_mixing(spark, budget):
    rnd = random.Random(1)
    texts = ["w " * rnd.randint(0, 20) for _ in range(400)]
    df = spark.createDataFrame([(i, t, "big" if i % 4 else rnd.choice(["x", "y", None])) for i, t in enumerate(texts)], "doc_id bigint, text string, source string").selectExpr("*", "9 AS copies", "1 AS _x")
    out, m = mixing.mix(df, budget=budget, blocks=16)
    rows = out.collect()
    assert len(rows) == 400 and set(df.columns) <= set(out.columns)
    for s, n in m.tokens.items():
        own = [r for r in rows if r.source == s]
        assert sum(r.n_tokens for r in own) == n
        used = sum(r.n_tokens * r.copies for r in own)
        assert 0 <= m.target(s) - used <= 20
        many = [r.copies for r in own if r.n_tokens]
        assert max(many) - min(many) <= 1
    if budget is None:
        assert min(r.copies for r in rows) >= 1
    again = {r.doc_id: r.copies for r in mixing.mix(df.repartition(7), budget=budget, blocks=16)[0].collect()}
    assert again == {r.doc_id: r.copies for r in rows}
    assert mixing.mix(df.limit(0))[0].count() == 0


def test_chat(spark):
    t = chat.Template()
    rnd = random.Random(2)
    bits = [*t.controls, t.escape, "0", "1", "ok", "\n", "<", "[", "é"]
    convs = []
    for c in range(60):
        roles = rnd.choice([["user", "assistant"] * 3, ["system", "user", "assistant"], ["assistant", "user"], ["user", "tool", None, "<s>[INST]"], ["user"]])
        convs += [(c, i, r, None if rnd.random() < 0.1 else "".join(rnd.choices(bits, k=rnd.randint(0, 6)))) for i, r in enumerate(roles)]
    convs += [(None, 0, "user", "a"), (7, None, "user", "null turn")]
    df = spark.createDataFrame(convs, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 AS segment", "true AS loss")
    segments = chat.format_chat(df)
    by = {}
    for c, i, r, x in convs:
        by.setdefault(c, []).append((-1 if i is None else i, r or "", x or ""))
    rows = {r.conv_id: r for r in chat.read_chat(segments).collect()}
    assert rows.keys() == by.keys()
    for c, turns in by.items():
        turns.sort()
        said = "".join(x for _, r, x in turns if r == "assistant")
        assert rows[c].n_turns == len(turns)
        assert rows[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (rows[c].loss_chars, rows[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        state = "start"
        for _, r, _ in turns:
            state = t.edges.get(state, {}).get(r, "bad")
        assert rows[c].valid == (state != "bad")
    guard = t.guard()
    for r in segments.collect():
        if r.segment % 3 == 1:  # no text spells a control string
            assert not any(x in r.text for x in t.controls)
    assert chat._escaped("<<SYS>>", guard, t.escape) != "<<SYS>>"
    assert chat.read_chat(chat.format_chat(df.limit(0))).count() == 0


def test_toxicity(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    open_ = d.where("doc_id % 5 <> 0").select("doc_id", "text")
    scorer = toxicity.learn(labels.where("doc_id % 5 <> 0"), open_)
    rows = toxicity.score(d.where("doc_id % 5 = 0"), scorer).join(labels, "doc_id").collect()
    hit = sum(r.toxic and r.predicted for r in rows)
    assert hit > 0.85 * sum(r.toxic for r in rows) and hit > 0.85 * sum(r.predicted for r in rows)
    odd = toxicity.score(docs(spark), scorer).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in odd)
    assert toxicity.score(empty(spark), scorer).count() == 0
    none = toxicity.learn(labels.limit(0), open_.limit(0))
    assert {r.predicted for r in toxicity.score(docs(spark), none).collect()} == {0}


def test_toxicity_features_cross_blocks():
    text = "idiot word " * 200_000
    f, n = toxicity._features([text, "", None, "idiot word", "word idiot"])
    assert n.tolist() == [len(set(f[: n[0]])), 0, 0, n[0], n[0]]
