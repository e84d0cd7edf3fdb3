"""Approximate nearest neighbours by a hash-prefix forest.

Every tree gives each vector a string: a character is the axis (and its sign)
nearest to the vector after a random rotation, so near vectors agree with a good
chance and 2 d characters are told apart.  A string has as many characters as fit
63 bits (9 at 64 dimensions); equal strings stand in an order drawn per tree.  A
tree is the sorted array of its strings.  A query descends to the place of its own
string, where the longest common prefixes are, and takes the ``WINDOW`` nearest
places of each tree; all of them are scored.  Cosines are exact (double
precision, original vectors).

A neighbour that lies in a share p of the trees' windows is missed with chance
(1 - p)^TREES.  So a query is settled only if every one of its k best was met in
``SUPPORT`` trees (4 of 48: a chance of 1.5 %).  All other queries, such as those in
dense groups wider than the windows, are compared with every vector.

Nothing is fitted: rotations come from a seed.  Every row is indexed; on the
test tables recall against brute force is above 0.95 (tests/llm).

Scale: equal vectors are one entry (the ``k + 1`` smallest ids represent them,
which is all that a result can show), so a hot vector is one entry too.  Each
tree is range-partitioned by (tree, string), so a task holds a stretch of one
sorted array; per query there are at most TREES * (WINDOW + 1) candidate ids.  They
meet the vectors in blocks of about ``BLOCK`` rows, and only k + 2 scores per
query and block leave a block.  The comparison with every vector is a narrow scan
for each ``PASS`` bytes of unsettled queries; its cost is their number times the
rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _words as W
from .registry import arrow_map, map_batches, query, stored, table

TREES, WINDOW, SUPPORT = 48, 512, 4
BLOCK = 8192
PASS = 1 << 24
SEED = 17


def _bits(dim: int) -> int:
    return int(2 * dim - 1).bit_length()


def rotations(dim: int, tree: int, seed: int = SEED) -> list[np.ndarray]:
    r = np.random.default_rng([seed, tree, dim])
    return [np.linalg.qr(r.standard_normal((dim, dim)))[0] for _ in range(63 // _bits(dim))]


_few = lru_cache(TREES)(rotations)       # 14 MB at 64 dimensions


def strings(x: np.ndarray, tree: int) -> np.ndarray:
    """The hash strings of unit vectors as integers, first character highest."""
    dim = x.shape[1]
    key = np.zeros(len(x), np.int64)
    for q in _few(dim, tree) if dim <= 128 else rotations(dim, tree):
        y = x @ q
        axis = np.abs(y).argmax(axis=1)
        key = (key << _bits(dim)) | (2 * axis + (y[np.arange(len(x)), axis] < 0))
    return key


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def everywhere(asks: DataFrame, classes: DataFrame, dim: int, k: int) -> DataFrame:
    """``q, rep, score``: the k + 2 nearest classes of each of ``asks`` (rep, v) within each task's part of all classes."""
    spark = asks.sparkSession
    passes = -(-asks.count() * 8 * dim // PASS)
    out = spark.createDataFrame([], "q long, rep long, score double")
    for p in range(passes):
        some = asks.where(F.pmod(F.xxhash64("rep"), F.lit(passes)) == p).select("rep", "v").toArrow()
        if some.num_rows:
            out = out.unionAll(stored(_scan(classes, some["rep"].to_numpy(), _matrix(some["v"], dim), dim, k + 2), "forest-all"))
    return out


def _scan(classes: DataFrame, who: np.ndarray, y: np.ndarray, dim: int, most: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, r, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        floor = np.full(len(y), -np.inf)                # what the last place of each query's list holds
        for b in batches:
            if not b.num_rows:
                continue
            rep, x = b.column(0).to_numpy(), _matrix(b.column(1), dim)
            found = [(q, r, s)]
            for a in range(0, len(y), 1024):
                m = y[a:a + 1024] @ x.T
                bar = floor[a:a + 1024]
                if len(x) > most:
                    bar = np.maximum(bar, np.partition(m, -most, axis=1)[:, -most])
                i, j = np.nonzero(m >= bar[:, None] - 1e-12)
                found.append((a + i, rep[j], (x[j] * y[a + i]).sum(axis=1)))
            q, r, s = (np.concatenate(c) for c in zip(*found))
            order = np.lexsort((r, -s, q))
            q, r, s = q[order], r[order], s[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            floor[q[place == most - 1]] = s[place == most - 1]
            q, r, s = (c[place < most] for c in (q, r, s))
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(who[q]), pa.array(r), pa.array(s)], names=["q", "rep", "score"])

    return arrow_map(classes.select("rep", "v"), run, "q long, rep long, score double")


def search(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` for every row whose id is divisible by ``every``.

    Candidates are all rows with another id; ties go to the smaller id; a query
    with fewer candidates gets them all.  Null ids, null or zero vectors and
    vectors with null or non-finite components take no part, nor do vectors whose
    length isn't the table's most common one (the smaller at a tie).  An id on several
    rows keeps its smallest vector.  An empty table gives an empty result; other columns are ignored.
    """
    schema = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False))
                & F.exists("v", lambda x: x != 0))
    length = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if length is None:
        return spark.createDataFrame([], schema)
    dim = length.d
    v = stored(v.where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v")), "forest-rows")
    place = Window.partitionBy("v").orderBy("id")
    least = v.withColumn("i", F.row_number().over(place)).where(F.col("i") <= k + 1)
    classes = stored(least.groupBy("v").agg(F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("ids")), "forest-classes")
    total = classes.count()
    asks = v.where(F.col("id") % every == 0)
    # queries by class; equal queries search once
    asked = stored(asks.join(classes.select("v", "rep"), "v").select(F.col("id").alias("query_id"), "rep"), "forest-queries")
    wanted = asked.select("rep").distinct().withColumn("q", F.lit(1))
    entries = classes.join(wanted, "rep", "left").select("rep", "v", F.coalesce("q", F.lit(0)).alias("q"))

    def index(b: pa.RecordBatch):
        x = _matrix(b.column(1), dim)
        for t in range(TREES):
            draw = W.splitmix(b.column(0).to_numpy().view(W.U) ^ W.splitmix(np.array([t + 1], W.U))).view(np.int64)
            yield {"tree": np.full(b.num_rows, t, np.int32), "key": strings(x, t), "draw": draw, "rep": b.column(0), "q": b.column(2)}

    arrays = map_batches(entries, index, "tree int, key long, draw long, rep long, q int")
    tasks = max(TREES, TREES * total // 500_000)
    arrays = arrays.repartitionByRange(tasks, "tree", "key", "draw").sortWithinPartitions("tree", "key", "draw")

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        tree, rep, q = (t[c].to_numpy() for c in ("tree", "rep", "q"))
        for one in np.unique(tree):
            a, z = np.searchsorted(tree, one, "left"), np.searchsorted(tree, one, "right")
            r_ = rep[a:z]
            at = np.flatnonzero(q[a:z] == 1)
            width = min(WINDOW + 1, z - a)
            for s in range(0, len(at), 1024):
                p = at[s:s + 1024]
                lo = np.clip(p - WINDOW // 2, 0, z - a - width)
                pick = lo[:, None] + np.arange(width)
                n = len(p)
                offs = pa.array(np.arange(n + 1, dtype=np.int32) * width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r_[p]), pa.ListArray.from_arrays(offs, pa.array(r_[pick].ravel()))], names=["q", "found"])

    near = arrays.mapInArrow(neighbours, "q long, found array<long>")
    blocks = max(1, -(-total // BLOCK))

    def gather(key: tuple, t: pa.Table) -> pa.Table:
        """Candidates of one query over all trees, each with the number of trees that met it, split by block."""
        ids, met = np.unique(t["found"].combine_chunks().flatten().to_numpy(), return_counts=True)
        block = ids % blocks
        order = np.argsort(block, kind="stable")
        ids, met, block = ids[order], met[order], block[order]
        b, first = np.unique(block, return_index=True)
        offs = pa.array(np.append(first, len(ids)).astype(np.int32))
        return pa.table({"q": pa.array(np.full(len(b), key[0].as_py(), np.int64)), "block": pa.array(b),
                         "ids": pa.ListArray.from_arrays(offs, pa.array(ids)),
                         "met": pa.ListArray.from_arrays(offs, pa.array(met.astype(np.int8)))})

    todo = near.groupBy("q").applyInArrow(gather, "q long, block long, ids array<long>, met array<tinyint>")
    todo = todo.join(classes.select(F.col("rep").alias("q"), F.col("v").alias("qv")), "q")
    rows = classes.select(F.pmod("rep", F.lit(blocks)).alias("block"), "rep", "v")

    def exact(left: pa.Table, right: pa.Table) -> pa.Table:
        """The k + 2 nearest classes of each query within one block."""
        out_q, out_r, out_s, out_m = [], [], [], []
        if left.num_rows and right.num_rows:
            rep = right["rep"].to_numpy()
            order = np.argsort(rep)
            x, rep = _matrix(right["v"], dim)[order], rep[order]
            y = _matrix(left["qv"], dim)
            ids = left["ids"].combine_chunks()
            off, val = ids.offsets.to_numpy(), ids.values.to_numpy()
            met = left["met"].combine_chunks().flatten().to_numpy()
            for i, q in enumerate(left["q"].to_numpy()):
                at = np.searchsorted(rep, val[off[i]:off[i + 1]])
                s = (x[at] * y[i]).sum(axis=1)
                best = np.lexsort((rep[at], -s))[:k + 2]
                out_q.append(np.full(len(best), q))
                out_r.append(rep[at][best])
                out_s.append(s[best])
                out_m.append(met[off[i] - off[0]:off[i + 1] - off[0]][best])
        cat = (lambda z, t: np.concatenate(z) if z else np.zeros(0, t))
        return pa.table({"q": pa.array(cat(out_q, np.int64), pa.int64()), "rep": pa.array(cat(out_r, np.int64), pa.int64()),
                         "score": pa.array(cat(out_s, np.float64), pa.float64()), "met": pa.array(cat(out_m, np.int8), pa.int8())})

    scored = todo.groupBy("block").cogroup(rows.groupBy("block")).applyInArrow(exact, "q long, rep long, score double, met tinyint")
    scored = stored(scored, "forest-scores")
    nearest = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    settled = (scored.where("rep != q").withColumn("i", F.row_number().over(nearest)).where(F.col("i") <= k)
               .groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("met").alias("met"))
               .where((F.col("n") >= min(k, total - 1)) & (F.col("met") >= SUPPORT)).select("q"))
    settled = stored(settled, "forest-settled")
    open_ = wanted.join(settled, wanted["rep"] == settled["q"], "left_anti").select("rep")
    scored = scored.join(settled, "q").select("q", "rep", "score").unionAll(
        everywhere(stored(classes.join(open_, "rep").select("rep", "v"), "forest-open"), classes, dim, k))
    # k + 1 ids per query class, then each query without itself
    ids = scored.join(classes.select("rep", "ids"), "rep").select("q", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    best = ids.withColumn("i", F.row_number().over(order)).where(F.col("i") <= k + 1)
    lists = stored(best.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("i", "vec_id", "score"))).alias("best")), "forest-best")
    out = (asked.join(lists, asked["rep"] == lists["q"])
           .select("query_id", F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("best")))
    return (out.select("query_id", F.posexplode("best").alias("i", "b"))
            .select("query_id", (F.col("i") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score")))


@query("op6_hash_prefix_forest")
def op6(spark, sf_dir):
    """The five nearest neighbours of every fiftieth vector."""
    return search(table(spark, sf_dir, "embeddings"))
