"""Phrase mining, BPE by transducer and tokenizer alignment against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ledgerlens.llm import bpe_transducer as B
from ledgerlens.llm import collocations as C
from ledgerlens.llm import token_alignment as T

WORD, BYTE, PIECE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, words string, unit long, n long"     # clashing names too


def docs(spark, texts, langs=None):
    rows = [(i if i % 7 else None, t, (langs or ["en"] * len(texts))[i], "x", 1, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


# ------------------------------------------------------------------ op11

def brute_phrases(texts, langs, depth, least, share, top):
    f, total = Counter(), Counter()
    for t, lang in zip(texts, langs):
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if c.isascii() else c for c in t or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for m in range(1, depth + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i:i + m])] += 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = []
    for lang in {k[0] for k in cand}:
        rows = []
        for (g, w), a in cand.items():
            if g != lang or any(h == g and len(v) > len(w) and 100 * b >= share * a and
                                any(v[i:i + len(w)] == w for i in range(len(v))) for (h, v), b in cand.items()):
                continue
            score, _, l, r = min((2000000 * a // (f[g, w[:k]] + f[g, w[k:]]), k, f[g, w[:k]], f[g, w[k:]])
                                 for k in range(1, len(w)))
            rows.append((-score, -a, " ".join(w).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


@pytest.mark.parametrize("budget", [50, 1 << 21])
def test_collocations_equal_brute_force(spark, budget):
    """A budget of 50 suffixes splits hot prefixes down to single leaves."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice("the of A b é cc d. the, x;y !z".split()) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    texts += ["New York city  hall"] * 40 + [None, "", " \t", "...", "a\x0bb", "the of the of " * 2000]
    langs = [rng.choice(["en", "fr", None, "und"]) for _ in texts]
    got = C.collocations(docs(spark, texts, langs), least=8, top=25, budget=budget)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_phrases(texts, langs, 4, 8, 80, 25)


def test_collocations_of_nothing(spark):
    assert C.collocations(docs(spark, []).limit(0)).count() == 0
    assert C.collocations(docs(spark, [None, "", "one"])).count() == 0


def test_a_unit_is_one_block_a_group():
    """The leaves of all languages and prefix lengths of a unit travel together, whatever their number."""
    r = random.Random(3)
    langs = [r.choice(["en", "fr", None]) for _ in range(300)]
    texts = [" ".join(r.choice("a é the of ß. xx,y zz".split()) for _ in range(r.randint(0, 40))) for _ in langs]
    batch = pa.RecordBatch.from_arrays([pa.array(langs), pa.array(texts)], names=["lang", "text"])
    frequent, groups, slots, blocks = np.full(1 << 13, 255, np.uint8), 5, 1 << 10, {}
    group_of = np.sort(np.arange(slots) % groups)
    for part in (batch.slice(0, 200), batch.slice(200)):
        u = C._unit([part])
        b = C._blocks(u, frequent, [np.unique(u.key)[::3]], group_of, slots, 3)
        assert len(set(b.column(0).to_pylist())) == b.num_rows <= groups
        for g, *block in zip(*[c.to_pylist() for c in b.columns]):
            blocks.setdefault(g, []).append(block)
    got = Counter()
    for held in blocks.values():
        for b in C._subtrees(held, 3, 1):
            for lang, phrase, m, f, _ in zip(*[c.to_pylist() for c in b.columns]):
                got[lang, tuple(phrase.split(" "))] += f
                assert m == len(phrase.split(" "))
    want = Counter()
    for lang, text in zip(langs, texts):
        for piece in re.split(r"[.,]", text):
            w = piece.split()
            want.update((lang or "und", tuple(w[i:i + m])) for m in (1, 2, 3) for i in range(len(w) - m + 1))
    assert got == want


def test_leaves_sort_alike_however_many_columns_a_key_holds():
    r = np.random.default_rng(2)
    for most in (3, 1 << 20, 1 << 31):
        cols = [r.integers(0, most, 500) * r.integers(0, 2, 500) for _ in range(5)]
        order, first, n = C._sorted(cols[0], cols[1:], np.ones(500, np.int64))
        rows = sorted(zip(*[c.tolist() for c in cols]))
        assert list(zip(*[c[order].tolist() for c in cols])) == rows
        assert {rows[i]: k for i, k in zip(first.tolist(), n.tolist())} == Counter(rows)


# ------------------------------------------------------------------ op12

def test_transducer_is_exact_and_shares_suffixes(tmp_path):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7))).encode() for _ in range(3000)})
    path = tmp_path / "lex.bin"
    path.write_bytes(B.compile_lexicon(words, [[i, i + 1][: 1 + i % 2] for i in range(len(words))]))
    lex = B.Lexicon(str(path))
    ask = words + [b"zz", b"", b"a" * 100, words[0] + b"q"]
    place = lex.find(pa.array([w.decode() for w in ask]))
    assert place.tolist()[:len(words)] == list(range(len(words))) and set(place[len(words):]) == {-1}
    assert lex.ids[lex.first[3]:lex.first[4]].tolist() == [3, 4]
    trie = {w[:i] for w in words for i in range(len(w) + 1)}
    assert len(lex.final) < len(trie) / 3
    empty = tmp_path / "none.bin"
    empty.write_bytes(B.compile_lexicon([], []))
    assert B.Lexicon(str(empty)).find(pa.array(["a"])).tolist() == [-1]


def token_texts():
    rng = random.Random(1)
    letters = "aaabbst'' \n\tretvemlld19.,!ÉÄßΣσςñİ́<|startoftext|>\U0001f600　\xa0\x85\x1c中\x00"
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    return out + [None, "", "  ", "<|startoftext|>It's<|endoftext|> we'll", "a" * 5000, "ab" * 700, "the " * 9000, "the cat " * 3]


@pytest.mark.parametrize("lexicon", [0, 300, 1 << 16])
def test_bpe_equals_the_library(spark, lexicon):
    """With an empty, a small and a large lexicon; null ids, repeated rows, special tokens and very long words."""
    texts = token_texts() * (2 if lexicon == 300 else 1)
    tok = Tokenizer.from_file(WORD)
    want = Counter()
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        back = tok.decode(ids, skip_special_tokens=False)
        want[i if i % 7 else None, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
             hashlib.sha256(back.encode()).hexdigest(), tuple(ids), back] += 1
    got = B.encode(docs(spark, texts), WORD, lexicon)
    have = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids), r.decoded) for r in got.collect())
    assert have == want


def test_classes_equal_the_library():
    v = B.Vocabulary(WORD)
    known = B._classes()
    texts = [f"a{chr(c)}a{chr(c)}{chr(c)}'s" for c in range(1, 1 << 16) if known[c] != B.UNSURE]
    words, of, special = v.split(texts)
    off, ids = v.merge(words)
    edge = off[np.searchsorted(of, np.arange(len(texts) + 1))]
    for i, e in enumerate(v.library.encode_batch(texts, add_special_tokens=False)):
        assert ids[edge[i]:edge[i + 1]].tolist() == e.ids, texts[i]


def test_bpe_of_nothing(spark):
    assert B.encode(docs(spark, []).limit(0), WORD).count() == 0


# ------------------------------------------------------------------ op13

def brute_alignment(texts):
    tok = Tokenizer.from_file(BYTE)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    raw_a, raw_b = T._byte_level(BYTE).raw, T._pieces(PIECE).raw
    count, rows = Counter(), []
    for t in texts:
        a, b = (tok.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)) if t else ([], [])
        ta, tb = [raw_a[i].as_py() for i in a], [raw_b[i].as_py() for i in b]
        if not t or not b"".join(ta) == (" " + t).encode() == b"".join(tb):
            rows.append((0, 0, [], []))
            continue
        ea, eb = np.cumsum([len(x) for x in ta]), np.cumsum([len(x) for x in tb])
        sa, sb = ea - [len(x) for x in ta], eb - [len(x) for x in tb]
        links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if sa[i] < eb[j] and sb[j] < ea[i]]
        groups, lo = [], 0
        for hi in sorted(set(ea.tolist()) & set(eb.tolist())):
            groups.append(",".join(str(x) for x, e in zip(a, ea) if lo < e <= hi) + "|"
                          + ",".join(str(x) for x, e in zip(b, eb) if lo < e <= hi))
            lo = hi
        count.update(links)
        rows.append((len(a), len(b), groups, links))
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return [(na, nb, len(g), len(k), sum(count[x] == top[x[1]] for x in k), sum(count[x] for x in k),
             hashlib.sha256(";".join(g).encode()).hexdigest() if na else "", ";".join(g)) for na, nb, g, k in rows]


def test_encoders_equal_the_libraries():
    """Every code point of sure class, spaces and line ends of all lengths, contractions, texts side by side."""
    rng = random.Random(4)
    known = B._classes()
    texts = [f"a{chr(c)}a{chr(c)}{chr(c)}'s {chr(c)}" for c in range(1, 1 << 16) if known[c] != B.UNSURE]
    signs = ["'", "'s", "'re", "'ll", " ", "  ", "\n", "\t", " \n", "a", "É", "12", "٣", "..", "中", "\xa0", "\U0001f600", "<s>", "<|endoftext|>", "\x00", "St", "re"]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(1, 25))) for _ in range(20000)]
    texts += [" ", "   ", "\n", "'s", "x" * 3000, " " * 3000, "a" + " " * 70 + "b", "'", "''s", "'l"]
    tok = Tokenizer.from_file(BYTE)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    spaced = [" " + t for t in texts]
    for (ids, edge), want in ((T._byte_level(BYTE).encode(spaced), [e.ids for e in tok.encode_batch(spaced, add_special_tokens=False)]),
                              (T._pieces(PIECE).encode(spaced), sp.encode(texts, num_threads=1))):
        for i, x in enumerate(want):
            assert ids[edge[i]:edge[i + 1]].tolist() == x, texts[i]


@pytest.mark.parametrize("unit", [3000, 4 << 20])
def test_alignment_equals_brute_force(spark, unit, monkeypatch):
    """Units of 3000 bytes and of everything; bytes lost by U+2581, null ids, repeated rows, special strings, long texts."""
    rng = random.Random(3)
    letters = "abc thé inß  \n\t<s>\x00😀é漢1.9'"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += [None, "", " ", "hello world", "hello world", "<|endoftext|> x", "<0x41>", "</s> a", "a▁b", "the quick brown fox " * 60, "é" * 300]
    monkeypatch.setattr(T, "UNIT", unit)
    got = T.align(docs(spark, texts), BYTE, PIECE)
    have = Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256, r.groups) for r in got.collect())
    want = Counter((i if i % 7 else None, *row) for i, row in enumerate(brute_alignment(texts)))
    assert have == want


def test_run_skipping_meets_every_group():
    rng = random.Random(8)
    for _ in range(300):
        n = rng.randint(1, 120)
        ea = sorted({*rng.sample(range(1, n + 1), rng.randint(0, n)), n})
        eb = sorted({*(ea if rng.random() < .5 else []), *rng.sample(range(1, n + 1), rng.randint(0, n)), n})
        runs, links, ends = T.align_ends(ea, eb)
        met = {(i + k, j + k) for i, j, m in runs for k in range(m)}
        assert {ea[i] for i, _ in met} | {ea[i - 1] for i, _ in ends} == set(ea) & set(eb)
        assert len(met) + len(links) == len(set(ea) | set(eb))


def test_alignment_of_nothing(spark):
    assert T.align(docs(spark, []).limit(0), BYTE, PIECE).count() == 0
    got = T.align(docs(spark, [None, ""]), BYTE, PIECE).collect()
    assert [(r.n_a, r.n_links, r.groups_sha256) for r in got] == [(0, 0, "")] * 2
