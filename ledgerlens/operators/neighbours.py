"""Exact k nearest neighbours over numeric features, and AllKNN under-sampling.

Rows with equal features are one point that carries its ``k + 1`` smallest ids,
so a group of copies, however large, costs one point.  Points are cut into
cells of about ``CELL`` points by median splits fitted on a bounded sample (the
splits decide the cost only), and each cell has a bounding box.  A point is
first compared with its own cell, which bounds the distance of its
``k + 1``-th row, and then only with those cells whose boxes are within that
bound.  Pairs of points exist inside a task's numpy blocks only; what leaves a
task is at most ``k + 1`` candidates a point.  A cell that many points ask for
is copied to several tasks.

The driver holds the splits and the boxes: one row per ``CELL`` points.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELL = 2048          # points of a cell, about
SAMPLE = 1 << 16     # points that inform the splits, about
ASKING = 1 << 14     # points that one task compares with one cell
BLOCK = 256          # points compared at a time


def _splits(x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Column and value of each inner node of a median tree, in heap order; a node that can't be split sends all left."""
    col, val = np.zeros(1 << depth, np.int64), np.full(1 << depth, np.inf)
    parts = {1: x}
    for node in range(1, 1 << depth):
        p = parts.pop(node)
        if len(p) > 1 and (width := p.max(0) - p.min(0)).max() > 0:
            c = int(width.argmax())
            v = np.median(p[:, c])
            if not (p[:, c] < v).any():
                v = p[:, c][p[:, c] > v].min()
            col[node], val[node] = c, v
        left = p[:, col[node]] < val[node]
        parts[2 * node], parts[2 * node + 1] = p[left], p[~left]
    return col, val


def _cells(x: np.ndarray, col: np.ndarray, val: np.ndarray) -> np.ndarray:
    node = np.ones(len(x), np.int64)
    while len(x) and node[0] < len(col):
        node = 2 * node + (x[np.arange(len(x)), col[node]] >= val[node])
    return node - len(col)


def _matrix(column, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _best(queries: np.ndarray, points: pa.Table, k: int, dims: int):
    """For each query its ``k + 1`` nearest rows among ``points``: sizes, squared distances, ids and labels."""
    x, own = _matrix(points["x"], dims), points["own"].combine_chunks()
    first = own.offsets.to_numpy().astype(np.int64)
    ids, labels = (own.flatten().field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    first = first - first[0]
    sizes, out = [np.zeros(0, np.int64)], [(np.zeros(0), ids[:0], labels[:0])]
    for a in range(0, len(queries), BLOCK):
        q = queries[a:a + BLOCK]
        d = np.zeros((len(q), len(x)))
        for c in range(dims):
            d += (q[:, c, None] - x[None, :, c]) ** 2
        last = min(k, d.shape[1] - 1)
        at, p = np.nonzero(d <= np.partition(d, last, axis=1)[:, last, None])     # ties included: ids decide
        n = first[p + 1] - first[p]
        row = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[p], n)
        at, dist = np.repeat(at, n), np.repeat(d[at, p], n)
        order = np.lexsort((ids[row], dist, at))
        at, row, dist = at[order], row[order], dist[order]
        nth = np.arange(len(at)) - np.searchsorted(at, at)
        keep = nth <= k
        sizes.append(np.bincount(at[keep], minlength=len(q)))
        out.append((dist[keep], ids[row[keep]], labels[row[keep]]))
    return np.concatenate(sizes), *(np.concatenate(z) for z in zip(*out))


def _candidates(sizes, dist, ids, labels) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    rows = pa.StructArray.from_arrays([pa.array(dist), pa.array(ids.astype(np.int64)), pa.array(labels.astype(np.int32))], ["d2", "id", "label"])
    return pa.ListArray.from_arrays(pa.array(offsets), rows)


_NEAR = "near array<struct<d2: double, id: long, label: int>>"


def nearest(df: DataFrame, id_col: str, label_col: str, features: Sequence[str], k: int) -> DataFrame:
    """``id, label, near`` with the ``k`` nearest other rows of each row (squared Euclidean distance, ties to smaller
    ids): ``near array<struct<d2, id, label>>``, nearest first, shorter if there are fewer rows.

    Ids are unique integers.  Rows with a missing or non-finite feature take no part."""
    from ..session import shared_dir
    shared_dir(df.sparkSession)
    dims = len(features)
    x = F.array(*[F.col(f"`{c}`").cast("double") + F.lit(0.0) for c in features])
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"), x.alias("x")).where(~bad)
    # row_number <= k + 1: Spark cuts each group before the shuffle
    few = rows.withColumn("nth", F.row_number().over(Window.partitionBy("x").orderBy("id"))).where(F.col("nth") <= k + 1)
    points = (few.groupBy("x").agg(F.sort_array(F.collect_list(F.struct("id", "label"))).alias("own"))
              .checkpoint(eager=True))
    n = points.count()
    depth = max(0, int(np.ceil(np.log2(max(1, n / CELL)))))
    share = max(1, n // SAMPLE)
    some = points.where(F.pmod(F.xxhash64("x"), F.lit(share)) == 0).select("x").toArrow() if depth else None
    col, val = _splits(_matrix(some["x"], dims), depth) if depth else (np.zeros(1, np.int64), np.zeros(1))

    def place(batches):
        for b in batches:
            yield b.append_column("cell", pa.array(_cells(_matrix(b.column(0), dims), col, val)))

    own = "own array<struct<id: long, label: int>>"
    placed = points.mapInArrow(place, f"x array<double>, {own}, cell long").checkpoint(eager=True)
    boxes = (placed.groupBy("cell").agg(*[f(F.get("x", F.lit(c))).alias(f"{s}{c}") for s, f in (("lo", F.min), ("hi", F.max))
                                          for c in range(dims)]).toArrow())
    # boxes of the tree's nodes, in heap order: a leaf's box is its cell's (an empty cell is met by nothing)
    leaves = len(col)
    lo, hi = np.full((2 * leaves, dims), np.inf), np.full((2 * leaves, dims), -np.inf)
    at = leaves + boxes["cell"].to_numpy()
    for c in range(dims):
        lo[at, c], hi[at, c] = boxes[f"lo{c}"].to_numpy(), boxes[f"hi{c}"].to_numpy()
    for node in range(leaves - 1, 0, -1):
        lo[node], hi[node] = np.minimum(lo[2 * node], lo[2 * node + 1]), np.maximum(hi[2 * node], hi[2 * node + 1])

    def inside(t: pa.Table) -> pa.Table:
        q = _matrix(t["x"], dims)
        sizes, dist, ids, labels = _best(q, t, k, dims)
        last = np.where(sizes > k, dist[np.cumsum(sizes) - 1], np.inf)
        return pa.table({"x": t["x"], "cell": t["cell"], "bound": last, "near": _candidates(sizes, dist, ids, labels)})

    first = placed.groupBy("cell").applyInArrow(inside, f"x array<double>, cell long, bound double, {_NEAR}").checkpoint(eager=True)

    def ask(batches):
        for b in batches:
            q, home, bound = _matrix(b.column(0), dims), b.column(1).to_numpy(), b.column(2).to_numpy()
            for a in range(0, len(q), BLOCK):
                i, node = np.arange(a, min(a + BLOCK, len(q))), np.ones(min(BLOCK, len(q) - a), np.int64)
                for level in range(leaves.bit_length()):         # down the tree, without nodes beyond the bound
                    gap = np.maximum(np.maximum(lo[node] - q[i], q[i] - hi[node]), 0)
                    near = (gap ** 2).sum(1) <= bound[i]
                    i, node = i[near], node[near]
                    if level < leaves.bit_length() - 1:
                        i, node = np.repeat(i, 2), np.repeat(2 * node, 2) + np.tile([0, 1], len(node))
                other = node - leaves != home[i]
                yield pa.RecordBatch.from_arrays([pa.array(node[other] - leaves), b.column(0).take(pa.array(i[other]))], names=["asked", "x"])

    asked = first.select("x", "cell", "bound").mapInArrow(ask, "asked long, x array<double>").checkpoint(eager=True)
    copies = asked.groupBy("asked").agg(F.ceil(F.count(F.lit(1)) / ASKING).cast("int").alias("copies"))
    questions = asked.join(copies, "asked").select("asked", "x", F.pmod(F.xxhash64("x"), F.col("copies")).cast("int").alias("copy"))
    answers = (placed.join(copies, placed["cell"] == copies["asked"])
               .select(F.col("cell").alias("held"), "x", "own", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("part")))

    def across(q: pa.Table, t: pa.Table) -> pa.Table:
        if not q.num_rows or not t.num_rows:
            return pa.table({"x": q["x"].slice(0, 0), "near": _candidates(*(np.zeros(0, np.int64),) * 4)})
        return pa.table({"x": q["x"], "near": _candidates(*_best(_matrix(q["x"], dims), t, k, dims))})

    second = questions.groupBy("asked", "copy").cogroup(answers.groupBy("held", "part")).applyInArrow(across, f"x array<double>, {_NEAR}")
    met = (first.select("x", "near").unionAll(second).groupBy("x")
           .agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near")))
    return rows.join(met, "x").select("id", "label", F.slice(F.filter("near", lambda c: c["id"] != F.col("id")), 1, k).alias("near"))


def all_knn(df: DataFrame, id_col: str, label_col: str, features: Sequence[str], k: int = 3, majority: int = 0,
            vote: str = "all") -> DataFrame:
    """AllKNN under-sampling: for 1, 2, ... ``k`` neighbours in turn, majority rows whose neighbours among the rows
    still there disagree go.  ``vote``: ``all`` (one other label is enough) or ``mode`` (more than half).

    The search ends early once the majority has become the smaller class.  Other classes, and rows with a missing
    feature or label, stay."""
    if vote not in ("all", "mode"):
        raise ValueError(vote)
    kept = df
    for j in range(1, k + 1):
        near = nearest(kept.where(F.col(label_col).isNotNull()), id_col, label_col, features, j)
        other = F.size(F.filter("near", lambda c: c["label"] != F.col("label")))
        lost = other > 0 if vote == "all" else other * 2 > F.size("near")
        gone = near.where((F.col("label") == majority) & lost).select(F.col("id").alias("__gone"))
        kept = kept.join(gone, kept[id_col] == F.col("__gone"), "left_anti").checkpoint(eager=True)
        left = kept.where(F.col(label_col).isNotNull()).groupBy((F.col(label_col) == majority).alias("m")).count().collect()
        sizes = {r["m"]: r["count"] for r in left}
        if sizes.get(True, 0) < sizes.get(False, 0):
            break
    return kept
