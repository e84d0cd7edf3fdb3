"""Cross-tokenizer alignment by diagonal run skipping.

Two tokenizers cut the same bytes.  Their tokens' end offsets are two rising
arrays; while both cut alike, entry i of one equals entry i + shift of the
other, so exponential probing compares ever longer slices at the current shift
and jumps over the whole one-to-one stretch.  Where it ends, the next common
end is found token by token, which yields the irregular group, its links, and
the new shift.

A link's count is corpus-wide, so texts are encoded once and stored as links by
document; counts are aggregated from each unit's (some MB of text) distinct
pairs, and every unit's distinct pairs, not every link, meet the counts again.

Scale: a unit holds about ``UNIT`` bytes of text (one text at least), a pair
occurs once per unit at most, so the hottest pair has as many rows as there are
units.  Nothing reaches the driver.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from .bpe_transducer import LETTER, SPACE, UNSURE, Vocabulary, _classes, _letter_bytes, _ragged
from .registry import arrow_map, query, stored, table

UNIT = 1 << 20
_LINKS = ("unit long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, "
          "at array<int>, times array<int>, pos int, pair long, n long")
_ROW = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class ByteLevel(Vocabulary):
    """Byte-level BPE without word ends: a text is split into words, and distinct words are merged once."""

    end = ""

    def __init__(self, path: str):
        super().__init__(path)
        byte = _letter_bytes()
        raw = [bytes(byte.get(ord(c), 63) for c in s) for s in self.names]
        self.raw = pa.array(raw, pa.large_binary())
        self.size = np.array([len(x) for x in raw], np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and where each text's begin; texts are not empty."""
        words, edge, unsure = self._cut(texts)
        ids, edge = _by_word(words, edge, self.merge)
        if not unsure:
            return ids, edge
        lib = self.library
        lib.no_truncation()
        lib.no_padding()
        lib.encode_special_tokens = True                 # their strings in a text are text
        parts = [ids[a:b] for a, b in zip(edge[:-1], edge[1:])]
        for i in unsure:
            parts[i] = np.array(lib.encode(texts[i], add_special_tokens=False).ids, np.int64)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])

    @staticmethod
    def _cut(texts: list[str]):
        """Words of all texts, where each text's begin, and the texts with a code point of unsure class (no words).

        The split pattern: 's 't 're 've 'm 'll 'd; letters, numbers or other signs, each with a space before;
        white space, whose last character is left to what follows."""
        joined = "".join(texts)
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        n, ends = len(cp), np.cumsum([len(t) for t in texts])
        kind = np.where(cp < 1 << 16, _classes()[np.minimum(cp, (1 << 16) - 1)], UNSURE)
        unsure = np.unique(np.searchsorted(ends, np.flatnonzero(kind == UNSURE), side="right")).tolist()
        if unsure:
            bad = set(unsure)
            words, edge, _ = ByteLevel._cut(["" if i in bad else t for i, t in enumerate(texts)])
            return words, edge, unsure
        if not n:
            return pa.array([], pa.large_binary()), np.zeros(len(texts) + 1, np.int64), []
        begin = np.ones(n, bool)
        begin[1:] = kind[1:] != kind[:-1]
        begin[(ends - [len(t) for t in texts])[np.diff(ends, prepend=0) > 0]] = True
        first = np.zeros(n + 1, bool)
        first[ends] = True                               # a text begins here, or all end
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:n])
        begin[last] = True
        begin[last[cp[last] == 32] + 1] = False          # the space goes with the word
        i = np.flatnonzero((cp[:-1] == 39) & begin[:-1] & (kind[1:] == LETTER) & ~first[1:n])
        x, y = cp[i + 1], np.where(first[np.minimum(i + 2, n)], 0, cp[np.minimum(i + 2, n - 1)])
        two = np.isin(x, [115, 116, 109, 100])
        three = ((x == 114) & (y == 101)) | ((x == 118) & (y == 101)) | ((x == 108) & (y == 108))
        begin[i[two | three] + 1] = False
        j = np.concatenate([i[two] + 2, i[three] + 3])
        j = j[j < n]
        begin[j] |= kind[j] == LETTER
        width = 1 + (cp >= 0x80) + (cp >= 0x800)
        start = np.flatnonzero(begin)
        offsets = np.concatenate([[0], np.cumsum(width)]).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [
            None, pa.py_buffer(offsets[np.append(start, n)]), pa.py_buffer(joined.encode())])
        return words, np.searchsorted(start, np.concatenate([[0], ends])), []


class Pieces:
    """SentencePiece BPE with a space in front.  Its pieces hold spaces at their beginning only, so no merge crosses
    from a word into the spaces after it: distinct words (with the spaces before them) are encoded once."""

    def __init__(self, path: str):
        import sentencepiece
        self.p = sentencepiece.SentencePieceProcessor(model_file=path)
        raw, self.local = [], True
        for i in range(self.p.get_piece_size()):
            s = self.p.id_to_piece(i)
            byte = re.fullmatch(r"<0x([0-9A-F]{2})>", s)
            raw.append(bytes([int(byte[1], 16)]) if byte else s.replace("▁", " ").encode())
            self.local &= "▁" not in s.lstrip("▁")
        self.space = self.p.piece_to_id("▁")
        self.raw = pa.array(raw, pa.large_binary())
        self.size = np.array([len(x) for x in raw], np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with its space in front, and where each text's begin."""
        data = "".join(texts).encode()
        ends = np.cumsum([len(t.encode()) for t in texts])
        first = ends - np.diff(ends, prepend=0)
        space = np.frombuffer(data, np.uint8) == 32
        begin = np.zeros(len(space), bool)
        if self.local:
            begin[1:] = space[1:] & ~space[:-1]
        begin[first] = True
        start = np.flatnonzero(begin)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [
            None, pa.py_buffer(np.append(start, len(data)).astype(np.int64)), pa.py_buffer(data)])

        def merge(words: pa.Array):
            # the processor puts the first space in front itself
            ids, edge = _flat(self.p.encode([w.decode()[1:] or "." for w in words.to_pylist()], num_threads=1))
            alone = pc.equal(pc.binary_length(words), 1).to_numpy(zero_copy_only=False)
            if alone.any():                              # a lone space is one piece
                parts = [np.array([self.space]) if x else ids[a:b] for x, a, b in zip(alone, edge[:-1], edge[1:])]
                ids, edge = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
            return edge, ids

        return _by_word(words, np.searchsorted(start, np.append(first, len(data))), merge)


def _by_word(words: pa.Array, edge: np.ndarray, merge) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts that are runs ``edge`` of words, and where each text's begin; ``merge`` sees distinct words."""
    coded = words.dictionary_encode()
    offsets, ids = merge(coded.dictionary)
    size, take = _ragged(offsets, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64))
    return ids[take], np.concatenate([[0], np.cumsum(size)])[edge]


@functools.cache
def _byte_level(path: str) -> ByteLevel:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"       # Spark runs the tasks side by side
    return ByteLevel(path)


@functools.cache
def _pieces(path: str) -> Pieces:
    return Pieces(path)


@functools.cache
def _numbered(na: int, nb: int) -> pa.Array:
    """Decimal ids with the sign that follows: A's inside and at the end of its side of a group, then B's."""
    return pa.array([f"{i}{c}" for n, c in ((na, ","), (na, "|"), (nb, ","), (nb, ";")) for i in range(n)], pa.large_string())


def align_ends(ea: list[int], eb: list[int]):
    """One-to-one stretches ``(i, j, n)``, links ``(i, j)`` inside irregular groups, and those groups' ends.

    Both lists rise strictly and end with the same offset."""
    runs, links, ends = [], [], []
    i = j = 0
    na = len(ea)
    while i < na:
        if ea[i] == eb[j]:
            n, w = 1, 1
            while ea[i + n:i + n + w] == eb[j + n:j + n + w] and i + n + w <= na:    # probe twice as far
                n += w
                w *= 2
            while w > 1:                                                             # then home in
                w //= 2
                if i + n + w <= na and ea[i + n:i + n + w] == eb[j + n:j + n + w]:
                    n += w
            runs.append((i, j, n))
            i += n
            j += n
            continue
        x, y = ea[i], eb[j]
        while x != y:
            links.append((i, j))
            if x < y:
                i += 1
                x = ea[i]
            else:
                j += 1
                y = eb[j]
        links.append((i, j))
        i += 1
        j += 1
        ends.append((i, j))
    return runs, links, ends


def _columns(pairs, k: int) -> list[np.ndarray]:
    a = np.array(pairs, np.int64).reshape(-1, k)
    return [a[:, i] for i in range(k)]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    edge = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    out = np.empty(edge[-1], np.int64)
    for x, a, b in zip(lists, edge[:-1].tolist(), edge[1:].tolist()):
        out[a:b] = x
    return out, edge


def _same(ids: np.ndarray, edge: np.ndarray, raw: pa.Array, want: list[bytes]) -> np.ndarray:
    """Whether each text's tokens join to its bytes."""
    off, data = _buffers(raw.take(pa.array(ids)))
    return np.array([data[off[a]:off[b]] == w for a, b, w in zip(edge[:-1], edge[1:], want)], bool)


def _buffers(x: pa.Array) -> tuple[np.ndarray, memoryview]:
    off = np.frombuffer(x.buffers()[1], np.int64)[x.offset:x.offset + len(x) + 1]
    return off, memoryview(x.buffers()[2]).cast("B") if x.buffers()[2] is not None else memoryview(b"")


def _unit(unit: int, doc_ids: pa.Array, texts: list[str | None], a_path: str, b_path: str, whole: bool):
    """Rows of one unit: its documents with their links, then its distinct pairs."""
    ta, tb = _byte_level(a_path), _pieces(b_path)
    len_a, len_b = ta.size, tb.size
    some = [i for i, t in enumerate(texts) if t]
    want = [" " + texts[i] for i in some]
    none = np.zeros(0, np.int64), np.zeros(1, np.int64)
    (a, ae), (b, be) = (ta.encode(want), tb.encode(want)) if some else (none, none)
    want = [t.encode() for t in want]
    good = _same(a, ae, ta.raw, want) & _same(b, be, tb.raw, want) if some else np.zeros(0, bool)
    if not good.all():
        a, b = a[np.repeat(good, np.diff(ae))], b[np.repeat(good, np.diff(be))]
        ae = np.concatenate([[0], np.cumsum(np.diff(ae)[good])])
        be = np.concatenate([[0], np.cumsum(np.diff(be)[good])])
    of = np.array(some, np.int64)[good] if some else np.zeros(0, np.int64)

    runs, links, ends = align_ends(np.cumsum(len_a[a]).tolist(), np.cumsum(len_b[b]).tolist())
    ri, rj, rn = _columns(runs, 3)
    step = np.arange(rn.sum()) - np.repeat(np.cumsum(rn) - rn, rn)
    ri, rj = np.repeat(ri, rn) + step, np.repeat(rj, rn) + step
    li, lj = _columns(links, 2)
    gi, gj = _columns(ends, 2)
    li, lj = np.concatenate([ri, li]), np.concatenate([rj, lj])
    ga, gb = np.sort(np.concatenate([ri + 1, gi])), np.sort(np.concatenate([rj + 1, gj]))   # both rise together

    n_docs = len(texts)
    n_a, n_b, n_groups, n_links = (np.zeros(n_docs, np.int64) for _ in range(4))
    n_a[of], n_b[of] = np.diff(ae), np.diff(be)
    n_groups[of] = np.diff(np.searchsorted(ga, ae, side="right"))
    doc = of[np.searchsorted(ae, li, side="right") - 1]
    n_links[:] = np.bincount(doc, minlength=n_docs)

    # the groups as text: ids in the order A side, B side, next group
    na, nb = len(len_a), len(len_b)
    ka, kb = np.diff(ga, prepend=0), np.diff(gb, prepend=0)
    order = np.empty(len(a) + len(b), np.int64)
    last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    last_a[ga - 1], last_b[gb - 1] = na, nb
    order[np.arange(len(a)) + np.repeat(gb - kb, ka)] = a + last_a
    order[np.arange(len(b)) + np.repeat(ga, kb)] = 2 * na + b + last_b
    off, data = _buffers(_numbered(na, nb).take(pa.array(order)))
    text, sha = [""] * n_docs, [""] * n_docs
    for d, x, y in zip(of.tolist(), (ae + be)[:-1].tolist(), (ae + be)[1:].tolist()):
        got = data[off[x]:off[y] - 1]
        sha[d] = hashlib.sha256(got).hexdigest()
        if whole:
            text[d] = bytes(got).decode()

    pair, back, n = np.unique(a[li] << 32 | b[lj], return_inverse=True, return_counts=True)
    code, times = np.unique(doc * max(1, len(pair)) + back, return_counts=True)
    first = np.searchsorted(code, np.arange(n_docs + 1) * max(1, len(pair))).astype(np.int32)
    at = (code % max(1, len(pair))).astype(np.int32)
    names = ["unit", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "at", "times", "pos", "pair", "n"]
    ints, longs, strs, lists = pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int32())
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(n_docs, unit)), doc_ids, *(pa.array(x) for x in (n_a, n_b, n_groups, n_links)), pa.array(sha, strs),
         pa.array(text if whole else [None] * n_docs, strs), pa.ListArray.from_arrays(pa.array(first), pa.array(at)),
         pa.ListArray.from_arrays(pa.array(first), pa.array(times.astype(np.int32))),
         pa.nulls(n_docs, ints), pa.nulls(n_docs, longs), pa.nulls(n_docs, longs)], names=names)
    k = len(pair)
    if k:
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(k, unit)), *(pa.nulls(k, longs) for _ in range(5)), pa.nulls(k, strs), pa.nulls(k, strs),
             pa.nulls(k, lists), pa.nulls(k, lists), pa.array(np.arange(k, dtype=np.int32)), pa.array(pair), pa.array(n.astype(np.int64))],
            names=names)


def _scored(docs: pa.Table, pairs: pa.Table, whole: bool) -> pa.Table:
    """Documents of one unit with their sums over links, from the counts of its pairs."""
    pos = pairs["pos"].to_numpy()
    count, best = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
    count[pos], best[pos] = pairs["count"].to_numpy(), pairs["best"].to_numpy()
    docs = docs.combine_chunks()
    n = docs.num_rows
    size = docs["at"].combine_chunks().value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    at = docs["at"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    times = docs["times"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    stop = np.cumsum(size)
    sums = []
    for x in (best, count):
        run = np.concatenate([[0], np.cumsum(times * x[at])]).astype(np.int64)
        sums.append(pa.array(run[stop] - run[stop - size] if n else np.zeros(0, np.int64)))
    cols = {k: docs[k] for k in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    cols |= {"n_best": sums[0], "count_sum": sums[1], "groups_sha256": docs["groups_sha256"]}
    return pa.table(cols | ({"groups": docs["groups"]} if whole else {}))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
          whole: bool = True) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` and,
    with ``whole``, the ``groups`` themselves.

    Null and empty texts, and texts whose tokens don't join to their bytes, have
    no tokens: zeros and ''.  Null and repeated ids stay rows of their own, and
    their links count each time; pairs of equal count are all best.  An empty
    table gives an empty table; other columns are ignored; a text of any length
    is aligned whole, as a unit of its own if it is longer than one.
    """
    def encode(batches):
        unit, seq = TaskContext.get().partitionId() << 32, 0
        held, size = [], 0

        def flush():
            t = pa.Table.from_batches(held).combine_chunks()
            ids, text = (t.column(i).combine_chunks() for i in (0, 1))
            off, _ = W.text_buffers(text)
            for n, s in enumerate(W.row_slices(off, UNIT)):
                k = s.stop - s.start
                yield from _unit(unit + seq + n, ids.slice(s.start, k), text.slice(s.start, k).to_pylist(), a_path, b_path, whole)

        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.nbytes
            if size >= UNIT:
                yield from flush()
                seq += sum(x.num_rows for x in held)         # at most one unit a row
                held, size = [], 0
        if held:
            yield from flush()

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    linked = stored(arrow_map(src, encode, _LINKS), "align-links")
    pairs = linked.where("pair is not null").select(F.col("unit").alias("of"), "pos", "pair", "n")
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF))
    counts = stored(counts, "align-counts")
    top = counts.groupBy("b").agg(F.max("count").alias("top"))
    known = counts.join(top, "b").select("pair", "count", (F.col("count") == F.col("top")).cast("int").alias("best"))
    met = pairs.join(known, "pair").select("of", "pos", "count", "best")
    rows = linked.where("pair is null").drop("pos", "pair", "n")
    return (rows.groupBy("unit").cogroup(met.groupBy("of"))
            .applyInArrow(lambda x, y: _scored(x, y, whole), _ROW + (", groups string" if whole else "")))


@query("op13_run_skipping_alignment")
def op13(spark, sf_dir):
    """How two tokenizers' tokens of every document group and link, with corpus-wide link counts."""
    import public_tokenizers as P
    return align(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), whole=False)
