"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

The frequent words of the corpus (counted over all documents) are merged once
and compiled into a minimal acyclic automaton: equal suffixes are one state,
and the numbers on the arcs of a word's path add up to its place among the
sorted words, which points at its token ids.  The automaton is written to the
shared folder, handed to the executors by Spark's file distribution and
memory-mapped by the tasks, so all workers of a machine share its pages.  A
task walks all distinct words of a batch through it at once; words that it
doesn't hold are merged exactly (lowest rank first, leftmost first).

Splitting into words follows the vocabulary file: special tokens are cut out of
the raw text, then NFC, white space, lower case, then the split pattern.  A
table of code points whose class is the same in Unicode 3.2 and today does this
for whole batches; a text with any other code point is normalised and split by
the tokenizer file's own normaliser and splitter.

Bounds: at most ``lexicon`` words of at most ``LONGEST`` bytes reach the driver
and the file (documented parameters; they decide the speed, not the result).
The counts cover every word of every document.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words as W
from .registry import map_batches, query, stored, table
from ledgerlens.session import scratch_path

LEXICON = 1 << 16        # words of the lexicon at most
LONGEST = 64             # bytes of a word of the lexicon, and of words merged together
END = "</w>"
CHUNK = 1 << 20          # bytes of text worked on at a time

#: Unicode White_Space (fixed values)
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPACE, LETTER, NUMBER, OTHER, UNSURE = 0, 1, 2, 3, 4


@functools.cache
def _classes() -> np.ndarray:
    """Class of each code point of the basic plane; UNSURE where Unicode versions may differ."""
    out = np.full(1 << 16, UNSURE, np.uint8)
    old = unicodedata.ucd_3_2_0
    kinds = {"L": LETTER, "N": NUMBER}
    for c in range(1 << 16):
        cat = unicodedata.category(chr(c))
        if cat not in ("Cn", "Cs") and old.category(chr(c)) == cat:
            out[c] = kinds.get(cat[0], OTHER)
    out[WHITE] = np.where(out[WHITE] == UNSURE, UNSURE, SPACE)
    return out


def _normal(s: str) -> str:
    if s.isascii():
        return s.lower()
    if not unicodedata.is_normalized("NFC", s):
        s = unicodedata.normalize("NFC", s)
    return s.replace("Σ", "σ").lower()     # lower case is by character: no final sigma


class Vocabulary:
    """Merges, token strings and special tokens of a byte-level BPE file whose words end in ``end``."""

    end = END

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        if (spec["model"].get("end_of_word_suffix") or "") != self.end:
            raise ValueError(f"{path}: words don't end in {self.end!r}")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        size = max(names) + 1
        self.names = [names.get(i, "") for i in range(size)]
        self.spaced = pa.array([s + " " for s in self.names], pa.large_string())
        byte = _byte_letters()
        self.inner = np.array([vocab[c] for c in byte], np.int64)
        self.last = np.array([vocab[c + self.end] for c in byte], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = left << 32 | right
        _, first = np.unique(key[::-1], return_index=True)      # a repeated pair has its last rank
        rank = len(key) - 1 - first
        self.key, self.rank, self.made = key[rank], rank, made[rank]
        self.path = path
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer
        return Tokenizer.from_file(self.path)

    @functools.cached_property
    def ranked(self) -> dict:
        return {k: (r, m) for k, r, m in zip(self.key.tolist(), self.rank.tolist(), self.made.tolist())}

    def merge_long(self, word: bytes) -> np.ndarray:
        """Token ids of one word of any length: a heap of (rank, place) over a linked list."""
        sym = self.inner[list(word)].tolist()
        sym[-1] = int(self.last[word[-1]])
        n = len(sym)
        after, before, heap, ranked = list(range(1, n + 1)), list(range(-1, n - 1)), [], self.ranked

        def offer(i):
            j = after[i]
            if j < n:
                got = ranked.get(sym[i] << 32 | sym[j])
                if got:
                    heapq.heappush(heap, (got[0], i, sym[i], sym[j], got[1]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j] = made, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return np.array([s for s in sym if s >= 0], np.int64)

    def merge(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of the tokens of each word: all short words go through the merges together."""
        off, data = W.text_buffers(words)
        size = np.diff(off)
        n = len(size)
        count, out = np.zeros(n, np.int64), {}
        for i in np.flatnonzero(size > LONGEST).tolist():
            out[i] = self.merge_long(data[off[i]:off[i + 1]].tobytes())
            count[i] = len(out[i])
        which = np.flatnonzero((size > 0) & (size <= LONGEST))
        lens = size[which]
        stop = np.cumsum(lens)
        at = np.arange(stop[-1] if len(stop) else 0) - np.repeat(stop - lens, lens) + np.repeat(off[which], lens)
        sym = self.inner[data[at]]
        if len(stop):
            sym[stop - 1] = self.last[data[at[stop - 1]]]
        word = np.repeat(which, lens)
        done_word, done_sym = [], []
        far = np.int64(1 << 40)
        while len(sym):
            pair = sym[:-1] << 32 | sym[1:]
            pos = np.searchsorted(self.key, pair)
            pos[pos == len(self.key)] = 0
            same = (self.key[pos] == pair) & (word[1:] == word[:-1])
            rank = np.full(len(sym), far)
            rank[:-1][same] = self.rank[pos[same]]
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            low = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(sym))))
            over = low == far                       # words without a pair to merge are finished
            if over.any():
                done_word.append(word[over])
                done_sym.append(sym[over])
            hit = (rank == low) & ~over
            i = np.flatnonzero(hit)
            if not len(i):
                break
            # x x x: of overlapping places every second one merges, from the left
            run = np.concatenate([[True], np.diff(i) != 1])
            begin = np.maximum.accumulate(np.where(run, np.arange(len(i)), 0))
            i = i[(np.arange(len(i)) - begin) % 2 == 0]
            sym[i] = self.made[pos[i]]
            stay = ~over
            stay[i + 1] = False
            sym, word = sym[stay], word[stay]
        if done_word:
            word, sym = np.concatenate(done_word), np.concatenate(done_sym)
            order = np.argsort(word, kind="stable")
            word, sym = word[order], sym[order]
            count += np.bincount(word, minlength=n)
        offsets = np.concatenate([[0], np.cumsum(count)])
        ids = np.zeros(offsets[-1], np.int64)
        if done_word:
            nth = np.arange(len(word)) - np.searchsorted(word, word)
            ids[offsets[word] + nth] = sym
        for i, x in out.items():
            ids[offsets[i]:offsets[i + 1]] = x
        return offsets, ids

    def split(self, texts: list[str | None]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Words of all texts, the text of each, and its special token's id (-1: none)."""
        plain, rest = [], []
        for i, t in enumerate(texts):
            if t:
                (rest if any(s in t for s in self.special) else plain).append(i)
        words, of, unsure = self._split_plain([_normal(texts[i]) for i in plain], np.array(plain, np.int64))
        special = np.full(len(words), -1, np.int64)
        rest += unsure
        if rest:
            more, where, ids = [], [], []
            for i in rest:
                for part in self.cut.split(texts[i]):
                    if part in self.special:
                        got, token = [""], self.special[part]
                    else:
                        norm = self.library.normalizer.normalize_str(part)
                        got = [_from_letters(w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(norm)] if norm else []
                        token = -1
                    more += got
                    where += [i] * len(got)
                    ids += [token] * len(got)
            words = pa.concat_arrays([words, pa.array(more, pa.string())])
            of, special = np.concatenate([of, np.array(where, np.int64)]), np.concatenate([special, np.array(ids, np.int64)])
            order = np.argsort(of, kind="stable")
            words, of, special = words.take(pa.array(order)), of[order], special[order]
        return words, of, special

    @staticmethod
    def _split_plain(texts: list[str], place: np.ndarray):
        """Words of normalised texts by code point classes; texts with a code point of unsure class are left out."""
        none = pa.array([], pa.string()), np.zeros(0, np.int64), []
        if not texts:
            return none
        joined = "\n".join(texts) + "\n"
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts])
        kind = np.where(cp < 1 << 16, _classes()[np.minimum(cp, (1 << 16) - 1)], UNSURE)
        unsure = np.unique(np.searchsorted(ends, np.flatnonzero(kind == UNSURE), side="right"))
        if len(unsure):
            bad = set(unsure.tolist())
            keep = [i for i in range(len(texts)) if i not in bad]
            words, of, _ = Vocabulary._split_plain([texts[i] for i in keep], place[keep])
            return words, of, place[unsure].tolist()
        solid = kind != SPACE
        begin = solid.copy()
        begin[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        # 's 't 'm 'd 're 've 'll: a lone apostrophe takes one or two letters along
        i = np.flatnonzero((cp[:-1] == 39) & begin[:-1] & (kind[1:] == LETTER))
        x, y = cp[i + 1], cp[np.minimum(i + 2, len(cp) - 1)]
        two = np.isin(x, [115, 116, 109, 100])
        three = ((x == 114) & (y == 101)) | ((x == 118) & (y == 101)) | ((x == 108) & (y == 108))
        begin[i[two | three] + 1] = False
        j = np.concatenate([i[two] + 2, i[three] + 3])
        begin[j] |= kind[j] == LETTER
        width = (1 + (cp >= 0x80) + (cp >= 0x800)).astype(np.int64)
        data = np.frombuffer(joined.encode(), np.uint8)
        data = data[np.repeat(solid, width)] if len(data) != len(cp) else data[solid]
        size = np.cumsum(np.where(solid, width, 0))
        start = np.flatnonzero(begin)
        offsets = np.append(size[start] - width[start], size[-1]).astype(np.int32)
        words = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))
        return words, place[np.searchsorted(ends, start, side="right")], []


@functools.cache
def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    letter = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other)}
    return [letter[b] for b in range(256)]


@functools.cache
def _letter_bytes() -> dict[int, int]:
    return {ord(c): b for b, c in enumerate(_byte_letters())}


def _from_letters(word: str) -> str:
    return bytes(map(_letter_bytes().__getitem__, map(ord, word))).decode()


# ---------------------------------------------------------------- transducer

def compile_lexicon(words: list[bytes], ids: list[list[int]]) -> bytes:
    """The minimal acyclic transducer of distinct, sorted, non-empty words, as one flat file.

    Built bottom-up over the sorted words; states with equal arcs and finality are
    one.  A state's arcs carry how many words come before theirs, so a path's
    sum is the word's place.
    """
    register: dict[tuple, int] = {}
    states: list[tuple] = []
    below: list[int] = []                            # words from each state on

    def build(lo: int, hi: int, depth: int) -> int:
        final = lo < hi and len(words[lo]) == depth
        at = lo + final
        arcs = []
        while at < hi:
            b, to = words[at][depth], at + 1
            while to < hi and words[to][depth] == b:
                to += 1
            arcs.append((b, build(at, to, depth + 1)))
            at = to
        made = (final, *arcs)
        got = register.get(made)
        if got is None:
            got = register[made] = len(states)
            states.append(made)
            below.append(final + sum(below[s] for _, s in arcs))
        return got

    root = build(0, len(words), 0)
    key, to, add = [], [], []
    for s, (final, *arcs) in enumerate(states):
        n = int(final)
        for b, t in arcs:
            key.append(s << 8 | b)
            to.append(t)
            add.append(n)
            n += below[t]
    finals = np.array([s[0] for s in states], np.int64)
    first = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    flat = np.array([i for x in ids for i in x], np.int64)
    head = np.array([root, len(key), len(states), len(words), len(flat)], np.int64)
    return b"".join(np.asarray(x, np.int64).tobytes() for x in (head, key, to, add, finals, first, flat))


class Lexicon:
    """A compiled lexicon, read through a memory map."""

    def __init__(self, path: str):
        flat = np.memmap(path, np.int64, mode="r")
        self.root, arcs, states, self.size, ids = flat[:5].tolist()
        cuts = np.cumsum([5, arcs, arcs, arcs, states, self.size + 1, ids])
        self.key, self.to, self.add, self.final, self.first, self.ids = (flat[a:b] for a, b in zip(cuts, cuts[1:]))

    def find(self, words: pa.Array) -> np.ndarray:
        """Place of each word in the lexicon, or -1; all words take each step together."""
        off, data = W.text_buffers(words)
        size = np.diff(off)
        place = np.full(len(size), -1, np.int64)
        if not len(self.key):
            return place
        at = np.flatnonzero((size > 0) & (size <= LONGEST))
        state, total = np.full(len(at), self.root), np.zeros(len(at), np.int64)
        step = 0
        while len(at):
            want = state << 8 | data[off[at] + step]
            pos = np.searchsorted(self.key, want)
            pos[pos == len(self.key)] = 0
            ok = self.key[pos] == want
            at, pos, total = at[ok], pos[ok], total[ok]
            state, total = self.to[pos], total + self.add[pos]
            step += 1
            end = size[at] == step
            good = end & (self.final[state] != 0)
            place[at[good]] = total[good]
            at, state, total = at[~end], state[~end], total[~end]
        return place


def _ragged(offsets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the lists ``at`` and the places of all their elements."""
    size = offsets[at + 1] - offsets[at]
    stop = np.cumsum(size)
    return size, np.arange(stop[-1] if len(stop) else 0) - np.repeat(stop - size, size) + np.repeat(offsets[at], size)


_held: dict = {}


def _vocabulary(path: str) -> Vocabulary:
    if path not in _held:
        _held[path] = Vocabulary(path)
    return _held[path]


def _lexicon(name: str) -> Lexicon:
    if name not in _held:
        for old in [k for k, v in _held.items() if isinstance(v, Lexicon)]:
            del _held[old]
        _held[name] = Lexicon(SparkFiles.get(name))
    return _held[name]


def _publish(spark: SparkSession, data: bytes) -> str:
    """Writes a file to the shared folder and has Spark hand it to every executor; its name there."""
    path = scratch_path(spark, "bpe-lexicon") + ".bin"
    jvm = spark.sparkContext._jvm
    to = jvm.org.apache.hadoop.fs.Path(path)
    out = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(to)
    out.write(data)
    out.close()
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def _texts(b: pa.RecordBatch, i: int):
    """Slices of a batch of about ``CHUNK`` bytes of text."""
    off, _ = W.text_buffers(b.column(i))
    for s in W.row_slices(off, CHUNK):
        yield s, b.column(i).slice(s.start, s.stop - s.start).to_pylist()


def frequent_words(docs: DataFrame, path: str, size: int, text_col: str = "text") -> list[tuple[bytes, list[int]]]:
    """The most frequent words, sorted by bytes, with their token ids: all words above the smallest count
    bin that leaves at most ``size`` words."""
    def count(b: pa.RecordBatch):
        v = _vocabulary(path)
        for _, texts in _texts(b, 0):
            words, _, special = v.split(texts)
            words = words.filter(pa.array(special < 0)).dictionary_encode()
            n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
            short = pc.less_equal(pc.binary_length(words.dictionary), LONGEST)
            yield {"word": words.dictionary.filter(short), "n": pa.array(n.astype(np.int64)).filter(short)}

    counts = stored(map_batches(docs.select(F.col(text_col).alias("text")), count, "word string, n long")
                    .groupBy("word").agg(F.sum("n").alias("n")), "bpe-words")
    level = F.floor(F.log2("n") * 64).cast("int")
    bins = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("c")).collect()
    least, room = 1 << 30, size
    for r in sorted(bins, key=lambda r: -r["level"]):
        room -= r["c"]
        if room < 0:
            break
        least = r["level"]

    def merge(b: pa.RecordBatch):
        off, ids = _vocabulary(path).merge(b.column(0))
        yield {"word": b.column(0), "ids": pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids))}

    top = map_batches(counts.where(level >= least).select("word"), merge, "word string, ids array<long>").toArrow()
    return sorted(zip((w.encode() for w in top.column(0).to_pylist()), top.column(1).to_pylist()))


def encode(docs: DataFrame, path: str, lexicon: int = LEXICON, id_col: str = "doc_id", text_col: str = "text",
           whole: bool = True) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, with ``whole``,
    ``ids array<int>`` and ``decoded`` (the token strings joined by one space).

    Null, empty and blank texts have no tokens and decode to ''.  Null and
    repeated ids stay rows of their own; an empty table gives an empty table;
    other columns of ``docs`` are ignored.  A word of any length is merged
    exactly; ties between equal ranks go to the left.
    """
    spark = docs.sparkSession
    known = frequent_words(docs, path, lexicon, text_col)
    name = _publish(spark, compile_lexicon([w for w, _ in known], [i for _, i in known]))

    def run(b: pa.RecordBatch):
        v, lex = _vocabulary(path), _lexicon(name)
        for s, texts in _texts(b, 1):
            words, of, special = v.split(texts)
            coded = words.dictionary_encode()
            kinds = coded.dictionary
            place = lex.find(kinds)
            new = np.flatnonzero(place < 0)
            off, ids = v.merge(kinds.take(pa.array(new)))
            # ids of known words, of new words and of special tokens in one pool
            extra = np.arange(len(v.names))
            pool = np.concatenate([lex.ids, ids, extra])
            offsets = np.concatenate([lex.first, len(lex.ids) + off[1:], len(lex.ids) + len(ids) + extra + 1])
            place[new] = lex.size + np.arange(len(new))
            at = place[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
            at = np.where(special < 0, at, lex.size + len(new) + special)
            size, take = _ragged(offsets, at)
            tokens = pool[take]
            n = np.bincount(of, weights=size, minlength=len(texts)).astype(np.int64)
            edge = np.concatenate([[0], np.cumsum(n)])
            raw = tokens.astype("<u4").tobytes()
            text = v.spaced.take(pa.array(tokens))
            toff, tdata = W.text_buffers(text)
            tdata = tdata.tobytes() if len(tokens) else b""
            back = [tdata[toff[a]:toff[z] - 1] if z > a else b"" for a, z in zip(edge[:-1], edge[1:])]
            row = {"doc_id": b.column(0).slice(s.start, len(texts)), "n_tokens": n,
                   "ids_sha256": [hashlib.sha256(raw[4 * a:4 * z]).hexdigest() for a, z in zip(edge[:-1], edge[1:])],
                   "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in back]}
            if whole:
                row["ids"] = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(tokens.astype(np.int32)))
                row["decoded"] = pa.array(back, pa.binary()).cast(pa.string())
            yield row

    columns = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(src, run, columns + (", ids array<int>, decoded string" if whole else ""))


@query("op12_transducer_bpe")
def op12(spark, sf_dir):
    """Digests of the token ids of every document and of the text that they decode to."""
    import public_tokenizers
    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), whole=False)
