"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit distance.

A document leaks an item of m words when some stretch of it is within
k = floor(m * EDIT_PERCENT / 100) word edits (insert, delete, replace) of the
whole item.  Words are runs of letters, digits and non-ASCII bytes, A-Z
lower-cased.

1. Windows.  k edits leave at least one of an item's k + 1 pieces whole, so only
   item-sized windows aligned with such a piece are looked at (lossless).
2. CGK.  A random walk copies a word sequence into 3 m symbols: at each step the
   current word is written, and a random bit that depends on step and word says
   whether to advance.  Small edit distance becomes small Hamming distance,
   since walks over both sequences fall into step again after an edit.
3. LSH.  ``BANDS`` samples of ``DEPTH`` positions each from ``WALKS`` independent
   walks; a window is a candidate when a sample agrees with the item's.
4. Exact check.  Word edit distance of the item against the best stretch around
   each candidate.

Scale: one narrow pass over the documents, nothing is shuffled.  The benchmark
is the stated query set; it reaches the tasks in blocks of about ``BLOCK``
bytes, one pass per block, so what is broadcast is bounded.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from .registry import arrow_map, map_batches, query, table

EDIT_PERCENT = 20
WALKS, BANDS, DEPTH = 4, 12, 2
SHIFTS = (0, -1, 1)
BLOCK = 8 << 20


@dataclass
class Items:
    """One block of the benchmark, ready to be matched."""
    ids: list
    words: list                       # uint64 array per item
    edits: list
    pieces: dict = field(default_factory=dict)   # piece length -> (sorted hashes, item, offset, bitmap)
    bands: dict = field(default_factory=dict)    # item length -> (item numbers, band keys)


def _embed(s: np.ndarray, walk: int) -> np.ndarray:
    """CGK embedding (n, 3 m) of n sequences of m word hashes (0: no word)."""
    n, m = s.shape
    ends = np.concatenate([s, np.zeros((n, 1), W.U)], axis=1)
    at = np.zeros(n, np.int64)
    rows = np.arange(n)
    out = np.empty((n, 3 * m), W.U)
    for j in range(3 * m):
        now = ends[rows, at]
        out[:, j] = now
        seed = W.U((walk * 1_000_003 + j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        step = (W.splitmix(now ^ seed) >> W.U(63)).astype(np.int64)
        at = np.minimum(at + step, m)
    return out


def _band_keys(s: np.ndarray) -> np.ndarray:
    """Keys (n, WALKS * BANDS) of the bit samples of n sequences of one length."""
    n, m = s.shape
    keys = []
    for walk in range(WALKS):
        e = _embed(s, walk)
        pick = np.random.default_rng(7919 * m + walk).integers(0, 3 * m, size=(BANDS, DEPTH))
        for b in range(BANDS):
            key = np.zeros(n, W.U)
            for j in pick[b]:
                with np.errstate(over="ignore"):
                    key = W.splitmix(key * W.U(31) + e[:, j] + W.U(1))
            keys.append(key)
    return np.stack(keys, axis=1)


def prepare(rows: list[tuple], percent: int) -> Items:
    """Items of ``(item_id, text)`` rows; items without words are left out."""
    c = [x for x in W.chunks(pa.array([t for _, t in rows], pa.large_string()), W.LOWER, W.PUNCT, 1 << 62)]
    it = Items([], [], [])
    for i, (item, _) in enumerate(rows):
        h = c[0].h[c[0].first[i]:c[0].first[i + 1]]
        if len(h):
            it.ids.append(item)
            it.words.append(h)
            it.edits.append(len(h) * percent // 100)
    found: dict[int, list] = {}
    by_len: dict[int, list] = {}
    for n, (h, k) in enumerate(zip(it.words, it.edits)):
        m = len(h)
        q = m // (k + 1)
        by_len.setdefault(m, []).append(n)
        pre = W.prefix(h, W.BASE_WORD)
        for j in range(k + 1):
            o = np.array([j * q])
            found.setdefault(q, []).append((int(W.ranges(pre, o, o + q, W.BASE_WORD)[0]), n, j * q))
    for q, x in found.items():
        x.sort()
        h = np.array([y[0] for y in x], W.U)
        bits = max(16, (64 * len(h)).bit_length())
        m = np.zeros((1 << bits) // 8, np.uint8)
        p = (h >> W.U(64 - bits)).astype(np.int64)
        np.bitwise_or.at(m, p >> 3, (1 << (p & 7)).astype(np.uint8))
        it.pieces[q] = (h, np.array([y[1] for y in x]), np.array([y[2] for y in x]), m)
    for m, ns in by_len.items():
        it.bands[m] = dict(zip(ns, _band_keys(np.stack([it.words[n] for n in ns]))))
    return it


def edit_distance(item: list, text: list, most: int) -> tuple[int, int, int] | None:
    """``(distance, start, end)`` of the stretch of ``text`` nearest to the whole ``item``
    (first of the nearest ones; the shortest there), or None beyond ``most`` edits."""
    n = len(text)
    cost, frm = [0] * (n + 1), list(range(n + 1))
    for a in item:
        up_c, up_f = cost, frm
        cost, frm = [up_c[0] + 1], [up_f[0]]
        for j in range(1, n + 1):
            c, f = up_c[j - 1] + (a != text[j - 1]), up_f[j - 1]
            if up_c[j] + 1 < c:
                c, f = up_c[j] + 1, up_f[j]
            if cost[-1] + 1 < c:
                c, f = cost[-1] + 1, frm[-1]
            cost.append(c)
            frm.append(f)
        if min(cost) > most:
            return None
    best = min(range(n + 1), key=lambda j: (cost[j], frm[j], j))
    return (cost[best], frm[best], best) if cost[best] <= most else None


def leaks(c: W.Chunk, it: Items) -> dict[tuple[int, int], tuple[int, int, int]]:
    """``(row, item) -> (distance, start, end)`` (words of the row) for every leak of a chunk."""
    row, start, item = [], [], []
    for q, (h, item_of, offset, marks) in it.pieces.items():
        g = c.sequences(q)
        if not len(g):
            continue
        at = np.flatnonzero(W.in_bitmap(marks, g))
        at = at[c.row[at] == c.row[at + q - 1]]
        lo, hi = np.searchsorted(h, g[at], "left"), np.searchsorted(h, g[at], "right")
        size = hi - lo
        which = np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        at = np.repeat(at, size)
        row.append(c.row[at])
        item.append(item_of[which])
        start.append(at - offset[which] - c.first[c.row[at]])
    if not row:
        return {}
    found = np.unique(np.stack([np.concatenate(x) for x in (row, item, start)], axis=1), axis=0)
    out: dict[tuple[int, int], tuple[int, int, int]] = {}
    lengths = np.array([len(w) for w in it.words])
    for m in np.unique(lengths[found[:, 1]]):
        some = found[lengths[found[:, 1]] == m]
        for a in range(0, len(some), 4096):
            part = some[a:a + 4096]
            item_keys = np.stack([it.bands[int(m)][int(n)] for n in part[:, 1]])
            hit = np.zeros(len(part), bool)
            for shift in SHIFTS:
                todo = np.flatnonzero(~hit)
                if len(todo):
                    hit[todo] = (_band_keys(_windows(c, part[todo, 0], part[todo, 2] + shift, int(m)))
                                 == item_keys[todo]).any(axis=1)
            for r, n, s in part[hit].tolist():
                k = it.edits[n]
                base, size = int(c.first[r]), int(c.first[r + 1] - c.first[r])
                x, y = max(0, s - 2 * k), min(size, s + int(m) + 2 * k)
                if (r, n) in out and out[r, n][0] == 0:
                    continue
                got = edit_distance(it.words[n].tolist(), c.h[base + x:base + y].tolist(), k)
                if got:
                    got = (got[0], got[1] + x, got[2] + x)
                    if (r, n) not in out or got < out[r, n]:
                        out[r, n] = got
    return out


def _windows(c: W.Chunk, row: np.ndarray, start: np.ndarray, m: int) -> np.ndarray:
    """Word hashes (n, m) of windows; places outside the row are 0."""
    at = start[:, None] + np.arange(m)[None, :]
    size = (c.first[row + 1] - c.first[row])[:, None]
    inside = (at >= 0) & (at < size)
    return np.where(inside, c.h[np.where(inside, at + c.first[row][:, None], 0)], W.U(0))


def _blocks(benchmark: DataFrame, percent: int, item_col: str, text_col: str):
    """Prepared blocks of the benchmark, each of about ``BLOCK`` bytes."""
    b = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("t is not null")
    total = b.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = 1 + total // BLOCK
    for x in range(n):
        part = b.where(F.pmod(F.xxhash64("t"), F.lit(n)) == x) if n > 1 else b
        it = prepare([(r.i, r.t) for r in part.collect()] or [(None, "")], percent)
        if it.ids:
            yield it


def matches(docs: DataFrame, benchmark: DataFrame, percent: int = EDIT_PERCENT, id_col: str = "doc_id",
            text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, start, end, distance``: the best stretch (word positions) per leaking pair.

    Null and empty texts or items never match; repeated rows each yield their
    own rows; ids may be null and are passed on.  Other columns are ignored.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, item_id long, start long, end long, distance long"
    out = None
    for it in _blocks(benchmark, percent, item_col, item_text_col):
        def run(b: pa.RecordBatch, it=it):
            for c in W.chunks(b.column(1), W.LOWER, W.PUNCT):
                got = leaks(c, it)
                if got:
                    rows = pa.array([c.rows.start + r for r, _ in got])
                    yield {"doc_id": b.column(0).take(rows), "item_id": [it.ids[n] for _, n in got],
                           "start": [x[1] for x in got.values()], "end": [x[2] for x in got.values()],
                           "distance": [x[0] for x in got.values()]}
        part = map_batches(src, run, schema)
        out = part if out is None else out.unionAll(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, percent: int = EDIT_PERCENT, text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns) that leak no item; no shuffle."""
    for it in _blocks(benchmark, percent, item_col, item_text_col):
        def run(batches, it=it):
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for c in W.chunks(b.column(b.schema.names.index(text_col)), W.LOWER, W.PUNCT):
                    keep[[c.rows.start + r for r, _ in leaks(c, it)]] = False
                yield b.filter(pa.array(keep))
        docs = arrow_map(docs, run, docs.schema)
    return docs


@query("op9_cgk_decontamination")
def op9(spark, sf_dir):
    """Every (document, benchmark item) pair with a stretch within 20 % word edits of the item."""
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
