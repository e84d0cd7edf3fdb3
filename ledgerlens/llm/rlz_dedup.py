"""Substring dedup by relative Lempel-Ziv parsing.

Every text is cut into content-defined blocks: consecutive ``window``-word
windows whose smallest ``SEED``-word fingerprint (the block's anchor) is the
same.  The cut depends on content alone, so a passage is cut alike in every
document.  The distinct blocks are the reference index, each under its anchor
and with the smallest doc_id that holds it.  A document is parsed against all
of them: a block found in an earlier document is a factor as a whole, and runs
of such blocks are the long factors.  At factor boundaries, where a block
shares its anchor with other reference blocks but is itself new, the factor is
extended word by word: the block's windows are looked up among the windows of
every reference block with that anchor.

The result is exact (up to 128-bit fingerprints): a word goes iff it is
covered by a window that also starts in a document with a smaller doc_id.

Scale: ~1 block per 22 words is shuffled, not each window; windows are
shuffled for boundary blocks of one representative only.  Hot passages are
reduced by partial aggregation (min doc_id per block), the only joins that see
a row per occurrence are plain equi-joins that AQE can split, and bounded
bitmaps keep rows without a partner out of them.  Texts move once, and only
those that lose words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from .registry import map_batches, query, stored, table

WINDOW = 50
SEED = 8
BITS = 25          # 4 MB bitmaps


def _blocks(c: W.Chunk, window: int):
    """Start word, number of windows, anchor and content hash of each block of a chunk,
    with the anchor-window fingerprints' source."""
    n = len(c.h)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none.view(np.uint64), none.view(np.uint64)
    seeds = c.sequences(min(SEED, window))
    low = W.sliding_min(seeds, window - min(SEED, window) + 1)       # per window
    ok = c.row[: n - window + 1] == c.row[window - 1:]
    at = np.flatnonzero(ok)
    if not len(at):
        return none, none, none.view(np.uint64), none.view(np.uint64)
    m = low[at]
    new = np.ones(len(at), bool)
    new[1:] = (m[1:] != m[:-1]) | (np.diff(at) != 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    start = at[first]
    return start, count, m[first], W.ranges(c.pre, start, start + count + window - 1, W.BASE_WORD)


def _text_key(c: W.Chunk) -> np.ndarray:
    """Fingerprint of each whole word sequence, to tell rows of one doc_id apart."""
    return W.ranges(c.pre, c.first[:-1], c.first[1:], W.BASE_WORD)


def _joined(c: W.Chunk, i: int, keep: np.ndarray | None = None) -> bytes:
    """Words of row i (those of the mask) joined by one space."""
    a, b = c.first[i], c.first[i + 1]
    raw = c.text(i)
    o = int(c.offsets[i])
    words = zip(c.start[a:b].tolist(), c.end[a:b].tolist())
    if keep is None:
        return b" ".join(raw[s - o:e - o] for s, e in words)
    return b" ".join(raw[s - o:e - o] for (s, e), k in zip(words, keep.tolist()) if k)


def dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_removed, kept_sha256, kept_text,
    spans`` (removed word ranges ``[start, end)``).

    Null and empty texts have no words (sha256 of the empty string).  Rows with
    the same doc_id are not duplicates of one another.  A row with a null
    doc_id has no place in the order: it loses nothing and is no reference.
    Other columns of ``docs`` are ignored.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = src.where(F.col("doc_id").isNotNull())

    def index(b: pa.RecordBatch):
        ids = b.column(0)
        for c in W.chunks(b.column(1)):
            s, n, a, r = _blocks(c, window)
            if len(s):
                yield {"anchor": W.as_long(a), "block": W.as_long(r),
                       "doc_id": ids.slice(c.rows.start, len(c.offsets) - 1).take(pa.array(c.row[s]))}

    found = map_batches(known, index, "anchor long, block long, doc_id long")
    reference = stored(found.groupBy("anchor", "block")
                       .agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")), "rlz-blocks")
    # anchors whose blocks lie in more than one document
    anchors = (reference.groupBy("anchor")
               .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count(F.lit(1)).alias("n"))
               .where("lo < hi"))
    anchors = stored(anchors.select("anchor", (F.col("n") > 1).alias("edge")), "rlz-anchors")
    # reference blocks that matter: repeated in later documents, or at a boundary
    useful = stored(reference.join(anchors, "anchor").where("edge or lo < hi"), "rlz-useful")
    shared = W.bitmap(useful.select("anchor").distinct(), "anchor", BITS)
    edges = W.bitmap(anchors.where("edge").select("anchor"), "anchor", BITS)

    def factors(b: pa.RecordBatch):
        ids = b.column(0)
        for c in W.chunks(b.column(1)):
            s, n, a, r = _blocks(c, window)
            hit = W.in_bitmap(shared, a)
            s, n, a, r = s[hit], n[hit], a[hit], r[hit]
            if not len(s):
                continue
            wide = W.in_bitmap(edges, a)
            # fingerprints of the windows of boundary blocks, one list per block
            size = np.where(wide, n, 0)
            ends = np.cumsum(size)
            at = np.arange(ends[-1]) - np.repeat(ends - size, size) + np.repeat(s, size)
            prints = W.as_long(W.ranges(c.pre, at, at + window, W.BASE_WORD))
            offs = np.concatenate([[0], ends]).astype(np.int32)
            yield {"doc_id": ids.slice(c.rows.start, len(c.offsets) - 1).take(pa.array(c.row[s])),
                   "tkey": W.as_long(_text_key(c)[c.row[s]]),
                   "start": (s - c.first[c.row[s]]).astype(np.int64), "n": n.astype(np.int64),
                   "anchor": W.as_long(a), "block": W.as_long(r),
                   "prints": pa.ListArray.from_arrays(pa.array(offs), pa.array(prints))}

    blocks = map_batches(known, factors, "doc_id long, tkey long, start long, n long, anchor long, block long, "
                                         "prints array<long>")
    parsed = stored(blocks.join(useful, ["anchor", "block"])
                    .where("doc_id > lo or (edge and doc_id = lo)")
                    .select("doc_id", "tkey", "start", "n", "anchor", (F.col("doc_id") > F.col("lo")).alias("whole"),
                            F.when(F.col("doc_id") == F.col("lo"), F.col("prints")).alias("prints")), "rlz-factors")
    whole = parsed.where("whole").select("doc_id", "tkey", "start", "n")
    # boundaries: windows of the new blocks against the windows of all reference blocks of the anchor
    steps = (parsed.where("not whole")
             .select("doc_id", "tkey", "start", "anchor", F.posexplode("prints").alias("k", "print"))
             .select("doc_id", "tkey", (F.col("start") + F.col("k")).alias("start"), "anchor", "print"))
    firsts = stored(steps.groupBy("anchor", "print").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
                    .where("lo < hi").select("anchor", "print", "lo"), "rlz-windows")
    single = (steps.join(firsts, ["anchor", "print"]).where("doc_id > lo")
              .select("doc_id", "tkey", "start", F.lit(1).cast("long").alias("n")))
    covered = stored(whole.unionAll(single).groupBy("doc_id", "tkey")
                     .agg(F.collect_list(F.struct("start", "n")).alias("cover")), "rlz-cover")
    touched = W.bitmap(covered, "tkey", BITS)
    return _cut(src, covered, touched, window)


def _cut(src: DataFrame, covered: DataFrame, touched: np.ndarray, window: int) -> DataFrame:
    """Texts without covered words are finished where they are read; the others meet their cover by one join."""

    def plain(b: pa.RecordBatch):
        ids, texts = b.column(0), b.column(1)
        for c in W.chunks(texts):
            k = len(c.offsets) - 1
            key = _text_key(c)
            hit = W.in_bitmap(touched, key)
            yield {"doc_id": ids.slice(c.rows.start, k),
                   "text": texts.take(pa.array(np.arange(c.rows.start, c.rows.stop), mask=~hit)),
                   "tkey": W.as_long(key), "n_words": np.diff(c.first),
                   "sha": [hashlib.sha256(_joined(c, i)).hexdigest() for i in range(k)]}

    parts = map_batches(src, plain, "doc_id long, text string, tkey long, n_words long, sha string")
    both = parts.join(covered, ["doc_id", "tkey"], "left")

    def cut(b: pa.RecordBatch):
        names = b.schema.names
        col = {n: b.column(i) for i, n in enumerate(names)}
        sha, n_words, cover = col["sha"].to_pylist(), col["n_words"].to_pylist(), col["cover"].to_pylist()
        removed = [0] * b.num_rows
        spans = [[] for _ in range(b.num_rows)]
        for c in W.chunks(col["text"]):
            for i in range(len(c.offsets) - 1):
                j = c.rows.start + i
                if not cover[j]:
                    continue
                edge = np.zeros(n_words[j] + 1, np.int64)
                s = np.fromiter((x["start"] for x in cover[j]), np.int64)
                n = np.fromiter((x["n"] for x in cover[j]), np.int64)
                np.add.at(edge, s, 1)
                np.add.at(edge, s + n + window - 1, -1)
                gone = np.cumsum(edge)[:-1] > 0
                turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                spans[j] = [{"start": int(x), "end": int(y)} for x, y in turn.reshape(-1, 2)]
                removed[j] = int(gone.sum())
                sha[j] = hashlib.sha256(_joined(c, i, ~gone)).hexdigest()
        yield {"doc_id": col["doc_id"], "n_words": col["n_words"], "n_removed": removed, "kept_sha256": sha,
               "spans": spans}

    return map_batches(both, cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, "
                                  "spans array<struct<start: long, end: long>>")


SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
p AS (SELECT doc_id, ws, len(ws) AS n_words, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50),
k AS (SELECT doc_id, i, md5_number(array_to_string(ws[i:i + 49], ' ')) AS h FROM p),
f AS (SELECT h, min(doc_id) AS lo FROM k GROUP BY h),
c AS (SELECT DISTINCT k.doc_id, unnest(range(i, i + 50)) AS at FROM k JOIN f ON k.h = f.h WHERE k.doc_id > f.lo),
x AS (SELECT doc_id, ws[j] AS word, j FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS j FROM w)),
r AS (SELECT x.doc_id, count(c.at) AS n_removed,
      coalesce(string_agg(x.word, ' ' ORDER BY x.j) FILTER (WHERE c.at IS NULL), '') AS kept
      FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.at = x.j GROUP BY x.doc_id)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(r.n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(r.kept, '')) AS kept_sha256
FROM w LEFT JOIN r ON r.doc_id = w.doc_id
"""


@query("op3_rlz_substring_dedup", SQL)
def op3(spark, sf_dir):
    """Words left of every document after removal of passages of 50 words seen in earlier documents."""
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
