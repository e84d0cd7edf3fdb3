"""Tree ensembles grown by one or two Spark aggregates per level.

A tree is a function of the feature columns, so a row's node is an expression
and no row is ever moved: each level groups the rows by (tree, node) with
map-side partial aggregation, and what reaches the driver is one row of
statistics per node, bounded by the model's own size.

* ``fit_extra_trees``: extremely randomised trees.  Every column of a node gets
  one threshold, drawn within the column's range in that node by a hash of
  (seed, tree, node, column); the best of these splits the node.
* ``fit_boosted``: gradient boosting for a binary label over quantile bins,
  with a learned direction for missing values, best-first leaves, and early
  stopping on held-out rows.  Gradients are summed as integers (units of
  2^-30), so a model doesn't depend on the order of partitions.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = 1 << 30           # gradients are summed in units of 1 / UNIT


def draw(seed: int, tree: int, node: int, column: int) -> float:
    """A number in [0, 1) that only depends on its place."""
    return int(hashlib.md5(f"{seed}:{tree}:{node}:{column}".encode()).hexdigest()[:8], 16) / 2 ** 32


# ------------------------------------------------------- extremely randomised trees

@dataclass
class ExtraTrees:
    features: list[str]
    splits: list[dict[int, tuple[int, float]]]       # per tree: node -> (column, threshold); right if above or missing
    values: list[dict[int, float]]                   # per tree: node -> share of positive rows

    def _side(self, column: int, threshold: float) -> Column:
        return F.col(f"`{self.features[column]}`").cast("double") <= F.lit(threshold)

    def node(self, tree: int) -> Column:
        """The leaf (heap number) of a row in a tree."""
        def walk(n: int) -> Column:
            if n not in self.splits[tree]:
                return F.lit(n)
            return F.when(self._side(*self.splits[tree][n]), walk(2 * n)).otherwise(walk(2 * n + 1))
        return walk(1)

    def score(self) -> Column:
        def walk(tree: int, n: int) -> Column:
            if n not in self.splits[tree]:
                return F.lit(self.values[tree][n])
            return F.when(self._side(*self.splits[tree][n]), walk(tree, 2 * n)).otherwise(walk(tree, 2 * n + 1))
        total = walk(0, 1)
        for t in range(1, len(self.splits)):
            total = total + walk(t, 1)
        return total / len(self.splits)


def fit_extra_trees(df: DataFrame, label: str, features: Sequence[str], n_trees: int = 10, depth: int = 4,
                    min_rows: int = 2, max_features: int | None = None, seed: int = 47) -> ExtraTrees:
    """Trees over the rows with a label (0 or 1).  Missing values go right; a node stays whole if it has fewer than
    ``min_rows`` rows or no drawn threshold raises purity; ties go to the earlier column."""
    features = list(features)
    if n_trees << depth > 1 << 16:
        raise ValueError("the model's statistics would have more than 65536 rows a level")
    model = ExtraTrees(features, [{} for _ in range(n_trees)], [{} for _ in range(n_trees)])
    rows = df.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("y"), *[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(c) for c in features])
    x = [F.col(f"`{c}`") for c in features]
    open_nodes = [{1} for _ in range(n_trees)]
    for level in range(depth + 1):
        places = F.array(*[F.struct(F.lit(t).alias("tree"), model.node(t).alias("node")) for t in range(n_trees)])
        seen = rows.select("y", *x, F.explode(places).alias("at")).select("y", *x, "at.tree", "at.node")
        ranges = [f(c).alias(f"{s}{i}") for i, c in enumerate(x) for s, f in (("lo", F.min), ("hi", F.max))] if level < depth else []
        stats = {(r["tree"], r["node"]): r for r in seen.groupBy("tree", "node").agg(F.count("y").alias("n"), F.sum("y").alias("s"), *ranges).collect()}
        drawn = []
        for (t, node), r in sorted(stats.items()):
            model.values[t][node] = r["s"] / r["n"]
            if node not in open_nodes[t] or level == depth or r["n"] < min_rows:
                continue
            use = sorted(range(len(x)), key=lambda i: (draw(seed + 1, t, node, i), i))[:max_features]
            cuts = [r[f"lo{i}"] + draw(seed, t, node, i) * (r[f"hi{i}"] - r[f"lo{i}"]) if i in use and r[f"lo{i}"] is not None else None
                    for i in range(len(x))]
            drawn.append((t, node, *cuts))
        if not drawn:
            break
        # at most 65536 rows of thresholds (checked above)
        cuts = F.broadcast(df.sparkSession.createDataFrame(
            drawn, "tree int, node int, " + ", ".join(f"t{i} double" for i in range(len(x)))))
        left = [e for i, c in enumerate(x) for e in (F.count(F.when(c <= F.col(f"t{i}"), 1)).alias(f"n{i}"),
                                                     F.sum(F.when(c <= F.col(f"t{i}"), F.col("y"))).alias(f"s{i}"))]
        found = seen.join(cuts, ["tree", "node"]).groupBy("tree", "node").agg(*left).collect()
        thresholds = {(d[0], d[1]): d[2:] for d in drawn}
        open_nodes = [set() for _ in range(n_trees)]
        for r in found:
            t, node = r["tree"], r["node"]
            n, s = stats[t, node]["n"], stats[t, node]["s"]
            best = (s * s / n, None)
            for i in range(len(x)):
                nl = r[f"n{i}"]
                if 0 < nl < n:
                    sl = r[f"s{i}"]
                    gain = sl * sl / nl + (s - sl) * (s - sl) / (n - nl)
                    if gain > best[0]:
                        best = (gain, i)
            if best[1] is not None:
                model.splits[t][node] = (best[1], thresholds[t, node][best[1]])
                open_nodes[t] |= {2 * node, 2 * node + 1}
    return model


# ------------------------------------------------------------------ boosting

@dataclass
class Boosted:
    features: list[str]
    edges: list[list[float]]                         # per column: rising bin edges; bin = number of edges below the value
    base: float
    rate: float
    trees: list[tuple[dict, dict]] = field(default_factory=list)   # node -> (column, bin, missing left); leaf -> value
    history: list[float] = field(default_factory=list)             # held-out loss after each round
    best: int = 0                                    # rounds kept

    def bins(self) -> Column:
        """Bin of every column; -1 is missing."""
        return F.array(*[F.when(F.col(f"`{c}`").isNull() | F.isnan(F.col(f"`{c}`").cast("double")), F.lit(-1)).otherwise(
            sum([(F.col(f"`{c}`").cast("double") > F.lit(v)).cast("int") for v in e], F.lit(0)))
            for c, e in zip(self.features, self.edges)])

    def margin(self, bins: str = "bins", rounds: int | None = None) -> Column:
        out = F.lit(self.base)
        for splits, values in self.trees[:self.best if rounds is None else rounds]:
            out = out + F.lit(self.rate) * _leaf(splits, values, bins)
        return out

    def transform(self, df: DataFrame, out: str = "score") -> DataFrame:
        margin = self.margin("__bins")
        return df.withColumn("__bins", self.bins()).withColumn(out, 1 / (1 + F.exp(-margin))).drop("__bins")


def _walk(splits: dict, bins: str, leaf) -> Column:
    def walk(n: int) -> Column:
        if n not in splits:
            return leaf(n)
        c, b, missing = splits[n]
        x = F.get(F.col(bins), F.lit(c))
        return F.when((x <= b) & ((x >= 0) if not missing else F.lit(True)), walk(2 * n)).otherwise(walk(2 * n + 1))
    return walk(1)


def _leaf(splits: dict, values: dict, bins: str) -> Column:
    return _walk(splits, bins, lambda n: F.lit(float(values[n])))


def fit_boosted(df: DataFrame, id_col: str, label: str, features: Sequence[str], held_out: Column | None = None,
                rounds: int = 50, leaves: int = 8, depth: int = 4, rate: float = 0.1, n_bins: int = 16, l2: float = 1.0,
                min_child: float = 1.0, min_gain: float = 0.0, patience: int = 5) -> Boosted:
    """Boosted trees for a 0/1 label over the labelled rows for which ``held_out`` isn't true; training stops
    ``patience`` rounds after the smallest held-out log-loss, and later trees are dropped.

    Missing values take the side that gains more (left at a tie).  Of the leaves that may split, those of largest
    gain split first, until the tree has ``leaves``.  Ties go to the earlier node, column, bin."""
    from ..session import shared_dir
    from .rank import multi_quantiles
    shared_dir(df.sparkSession)
    features = list(features)
    test = F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(False)
    rows = df.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("y"), test.alias("test"),
                                                     *[F.col(f"`{c}`").cast("double").alias(c) for c in features])
    train = rows.where(~F.col("test"))
    cuts = {r["column_name"]: r for r in multi_quantiles(train, features, [i / n_bins for i in range(1, n_bins)]).collect()}
    edges = [sorted({cuts[c][f"q{i}"] for i in range(n_bins - 1)}) if c in cuts else [] for c in features]
    share = train.agg(F.avg("y")).first()[0]
    if share is None or share in (0.0, 1.0):
        raise ValueError("training needs rows of both classes")
    model = Boosted(features, edges, math.log(share / (1 - share)), rate)
    state = rows.select("y", "test", model.bins().alias("bins")).withColumn("f", F.lit(model.base)).checkpoint(eager=True)
    for k in range(rounds):
        p = 1 / (1 + F.exp(-F.col("f")))
        grown = (state.where(~F.col("test"))
                 .select("bins", F.round((p - F.col("y")) * UNIT).cast("long").alias("g"), F.round(p * (1 - p) * UNIT).cast("long").alias("h")))
        splits, sums = _grow(grown, edges, leaves, depth, l2, min_child, min_gain)
        values = {n: -g / (h + l2) for n, (g, h) in sums.items() if n not in splits}
        model.trees.append((splits, values))
        state = state.withColumn("f", F.col("f") + F.lit(rate) * _leaf(splits, values, "bins"))
        if k % 5 == 4:                               # expressions stay short
            state = state.checkpoint(eager=True)
        if held_out is not None:
            p = 1 / (1 + F.exp(-F.col("f")))
            loss = state.where("test").agg(F.avg(-F.log(F.when(F.col("y") == 1, p).otherwise(1 - p)))).first()[0]
            if loss is None:
                raise ValueError("no held-out rows")
            model.history.append(loss)
            model.best = model.history.index(min(model.history)) + 1
            if k + 1 >= model.best + patience:
                break
        else:
            model.best = k + 1
    return model


def _grow(rows: DataFrame, edges: list[list[float]], leaves: int, depth: int, l2: float, min_child: float, min_gain: float):
    """Splits of one tree and every node's (gradient, hessian)."""
    splits: dict[int, tuple[int, int, bool]] = {}
    sums: dict[int, tuple[float, float]] = {}
    open_nodes, gains = {1}, {}
    while True:
        # one aggregate for all new leaves: a row of sums per (node, column, bin)
        node = _walk(splits, "bins", lambda n: F.lit(n))
        found = (rows.select(node.alias("node"), "bins", "g", "h").where(F.col("node").isin(sorted(open_nodes)))
                 .select("node", "g", "h", F.posexplode("bins").alias("c", "b"))
                 .groupBy("node", "c", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect())
        table: dict[tuple[int, int], dict[int, tuple[int, int]]] = {}
        for r in found:
            table.setdefault((r["node"], r["c"]), {})[r["b"]] = (r["g"], r["h"])
        for n in open_nodes:
            if (n, 0) in table:
                sums[n] = tuple(sum(v[i] for v in table[n, 0].values()) / UNIT for i in (0, 1))
                gains[n] = _best_split(n, table, edges, l2, min_child)
        able = sorted((-g, n) for n, (g, _) in gains.items() if g > min_gain and n < 1 << depth)
        take = able[:leaves - 1 - len(splits)]
        if not take:
            return splits, sums
        open_nodes = set()
        for _, n in take:
            splits[n] = gains.pop(n)[1]
            open_nodes |= {2 * n, 2 * n + 1}


def _best_split(node: int, table, edges, l2: float, min_child: float):
    best = (0.0, None)
    for c in range(len(edges)):
        bins = table.get((node, c), {})
        total = [sum(v[i] for v in bins.values()) for i in (0, 1)]
        lost = bins.get(-1, (0, 0))
        whole = (total[0] / UNIT) ** 2 / (total[1] / UNIT + l2)
        for missing in (True, False):
            g, h = lost if missing else (0, 0)
            for b in range(len(edges[c])):
                g, h = g + bins.get(b, (0, 0))[0], h + bins.get(b, (0, 0))[1]
                hl, hr = h / UNIT, (total[1] - h) / UNIT
                if hl >= min_child and hr >= min_child:
                    gain = (g / UNIT) ** 2 / (hl + l2) + ((total[0] - g) / UNIT) ** 2 / (hr + l2) - whole
                    if gain > best[0]:
                        best = (gain, (c, b, missing))
    return best
