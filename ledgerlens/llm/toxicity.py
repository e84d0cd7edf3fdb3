"""Toxicity by class-conditional Kneser-Ney models.

Units are UTF-8 bytes (A-Z lower-cased, one space before and after the text),
order ``ORDER``.  Each class has its own discounted counts of the highest
order; what a class has not seen backs off to continuation counts that both
classes share, so a rare expression is not held against either class.  The
log-likelihoods under both models are compared per byte: over the whole text,
and over its most toxic stretch of ``STRETCH`` n-grams.  A logistic calibration
turns both, with the log length, into a probability.

Counts come from all labelled training texts (a distributed aggregation that
grows with them); every text is scored whole.  The model is a table with the log
ratio of every counted n-gram and of every context, and it stays one: neither
the driver nor any task ever holds it.  Texts are packed into units of about
``UNIT`` bytes, the distinct n-grams and contexts of a unit are joined with the
table, and what was found goes back to its unit, where the texts are scored.  An
n-gram that isn't found backs off to its context.  The calibration is fitted on
at most about ``CALIBRATE`` labelled documents of one fold (by hash), against
models counted without them; the models that score then count these documents
too.

Scale: compressed texts are shuffled once to meet their ratios (both uses of the
units share the exchange), n-grams as often as a unit has them distinct.  Of the
training texts only labelled ones are shuffled, to meet their label; a bounded
bitmap keeps the others out.  A unit is named by its place and its content, and
one whose ratios belong to other content (a lost partition that came back in
another order) fails its task instead of scoring without them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _words as W
from .registry import apart, arrow_map, give_back, map_batches, query, stored, table

ORDER = 5
DISCOUNT = 0.75
STRETCH = 8
CALIBRATE = 20_000
UNIT = 32 << 20         # bytes of the batches that share one lookup
SEAL = -(1 << 62)       # a key that every unit asks for and every model holds
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 1
BITS = 24


def fold_of(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5 (null id: null)."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(FOLDS))


def _known(labels: DataFrame, label: str, id_col: str, folds: tuple) -> DataFrame:
    return (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
            .where("doc_id is not null and label is not null").withColumn("fold", fold_of(F.col("doc_id")))
            .where(F.col("fold").isin(list(folds)) & (F.col("fold") != HELD_OUT))
            .groupBy("doc_id", "fold").agg(F.max("label").alias("label")))


def labelled(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str,
             folds: tuple = tuple(range(1, FOLDS)), most: int | None = None) -> DataFrame:
    """``doc_id, fold, label, text`` of the documents of ``folds`` that may be learnt from,
    or of about ``most`` labels among them.

    One label per doc_id (the largest, should there be several); null ids and
    labels are left out, as is the held-out fold, before any text is read.
    """
    known = _known(labels, label, id_col, folds)
    if most is not None:
        known = sampled(known, most)
    known = stored(known.withColumn("at", F.xxhash64("doc_id")), "labels")
    marks = W.bitmap(known, "at", BITS)

    def wanted(b: pa.RecordBatch):
        hit = pa.array(W.in_bitmap(marks, b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)))
        yield {"doc_id": b.column(0).filter(hit), "text": b.column(1).filter(hit)}

    some = map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                                   F.xxhash64(F.col(id_col).cast("long"))).where("doc_id is not null"),
                       wanted, "doc_id long, text string")
    return some.join(apart(known.drop("at")), "doc_id")


def sampled(df: DataFrame, most: int) -> DataFrame:
    """About ``most`` rows of ``df`` (``doc_id``) by hash, or all if there are fewer."""
    return df.where(_drawn(df.count(), most))


def _drawn(rows: int, most: int) -> Column:
    """Whether ``doc_id`` is among about ``most`` of ``rows`` rows."""
    part = min(1.0, most / max(1, rows))
    return F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < int(part * (1 << 30))


def _padded(c_off: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with a space before and after every row, and each row's range."""
    n = len(c_off) - 1
    row = np.repeat(np.arange(n), np.diff(c_off))
    out = np.full(len(raw) + 2 * n, 32, np.uint8)
    out[np.arange(len(raw)) + 2 * row + 1] = raw
    start = c_off[:-1] + 2 * np.arange(n)
    return out, start, c_off[1:] + 2 * np.arange(n) + 2


def _texts(col: pa.Array, size: int = W.CHUNK):
    off, data = W.text_buffers(col)
    for s in W.row_slices(off, size):
        o = off[s.start:s.stop + 1]
        yield (s, *_padded(o - o[0], W.LOWER[data[o[0]:o[-1]]]))


def _grams(raw: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram from each byte on, and whether it lies within one row."""
    n = max(0, len(raw) - ORDER + 1)
    g = np.zeros(n, np.int64)
    for j in range(ORDER):
        g <<= 8
        g |= raw[j:j + n]
    ok = np.ones(n, bool)
    for j in range(1, ORDER):
        at = end - j
        ok[at[(at >= 0) & (at < n)]] = False
    return g, ok


def _counted(col: pa.Array, kind: np.ndarray):
    """The distinct n-grams of each chunk of texts and how often texts of each kind (0 to 3) hold them.
    Chunks are small: a worker keeps what its largest arrays took, for as long as Spark keeps the worker."""
    for s, raw, start, end in _texts(col):
        g, ok = _grams(raw, end)
        of = np.repeat(kind[s], end - start)[: len(g)]
        u, inv = np.unique(g[ok], return_inverse=True)
        yield u, np.bincount(4 * inv + of[ok], minlength=4 * len(u)).reshape(-1, 4)


def _distinct(cols: Iterable[pa.Array]) -> pa.Array:
    """The distinct n-grams of all texts; those of small chunks are merged once they outnumber the rest."""
    have, fresh, n = pa.array([], pa.int64()), [], 0
    for col in cols:
        for _, raw, _, end in _texts(col):
            g, ok = _grams(raw, end)
            fresh.append(pc.unique(pa.array(g[ok])))
            n += len(fresh[-1])
            if n > len(have):
                have, fresh, n = pc.unique(pa.concat_arrays([have, *fresh])), [], 0
    return pc.unique(pa.concat_arrays([have, *fresh]))


class Ratios:
    """A hash table from keys (from 0 on, each once) to values; linear probing, a third to two thirds of the places taken."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        keys = keys.astype(np.int64)
        self.size = 1 << max(4, (len(keys) * 3 // 2).bit_length())
        self.keys = np.full(self.size, -1, np.int64)
        self.values = np.full(self.size, np.nan, np.float32)
        todo, at = np.arange(len(keys)), self._place(keys)
        while len(todo):
            free = np.flatnonzero(self.keys[at] < 0)
            at_free, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[at_free], self.values[at_free] = keys[todo[won]], values[todo[won]]
            left = np.ones(len(todo), bool)
            left[won] = False
            todo, at = todo[left], (at[left] + 1) & (self.size - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (W.splitmix(keys.view(W.U)) >> W.U(65 - self.size.bit_length())).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, NaN for an unknown one."""
        at = self._place(keys)
        out = self.values[at]
        have = self.keys[at]
        todo = np.flatnonzero((have != keys) & (have >= 0))
        out[have != keys] = np.nan
        at = at[todo]
        while len(todo):
            at = (at + 1) & (self.size - 1)
            have = self.keys[at]
            hit = have == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            more = ~hit & (have >= 0)
            todo, at = todo[more], at[more]
        return out


def count(train: DataFrame) -> DataFrame:
    """``gram, t, o, ht, ho``: occurrences of each n-gram in toxic and ordinary texts, and in those of them that are ``held``."""
    def run(b: pa.RecordBatch):
        kind = ((b.column(1).to_numpy(zero_copy_only=False) == 1) + 2 * b.column(2).to_numpy(zero_copy_only=False).astype(np.int64))
        for u, n in _counted(b.column(0), kind):
            yield {"gram": u, "t": n[:, 1] + n[:, 3], "o": n[:, 0] + n[:, 2], "ht": n[:, 3], "ho": n[:, 2]}

    return (map_batches(train.select("text", "label", "held"), run, "gram long, t long, o long, ht long, ho long")
            .groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("t", "o", "ht", "ho")]))


def model(grams: DataFrame) -> DataFrame:
    """``key, llr``: log ratios (toxic over ordinary) of all counted n-grams (key: the n-gram), of their contexts
    (key: -1 - context), and ``SEAL``."""
    d = DISCOUNT
    g = grams.withColumn("ctx", F.shiftright("gram", 8)).withColumn("suffix", F.col("gram").bitwiseAND((1 << 8 * (ORDER - 1)) - 1))
    contexts = stored(g.groupBy("ctx").agg(
        F.sum("t").alias("ct"), F.sum("o").alias("co"), F.sum((F.col("t") > 0).cast("long")).alias("nt"),
        F.sum((F.col("o") > 0).cast("long")).alias("no")), "kn-contexts")
    suffix = g.groupBy("suffix").agg(F.count(F.lit(1)).alias("ns")).withColumn("low", F.shiftright("suffix", 8))
    low = suffix.groupBy("low").agg(F.sum("ns").alias("nl"), F.count(F.lit(1)).alias("kl"))
    byte = suffix.groupBy(F.col("suffix").bitwiseAND(255).alias("byte")).agg(F.sum("ns").alias("nb"))
    total = byte.agg(F.sum("nb").alias("all"))
    one = byte.crossJoin(F.broadcast(total)).select("byte", (F.col("nb") / F.col("all")).alias("pb"))     # 256 rows by one
    shared = (suffix.join(low, "low").join(F.broadcast(one), F.col("suffix").bitwiseAND(255) == F.col("byte"))
              .select("suffix", (F.greatest(F.col("ns") - d, F.lit(0.0)) / F.col("nl")
                                 + d * F.col("kl") / F.col("nl") * F.col("pb")).alias("ps")))
    lam = {c: F.when(F.col(f"c{c}") > 0, d * F.col(f"n{c}") / F.col(f"c{c}")).otherwise(F.lit(1.0)) for c in "to"}
    prob = {c: F.when(F.col(f"c{c}") > 0, F.greatest(F.col(c) - d, F.lit(0.0)) / F.col(f"c{c}")).otherwise(F.lit(0.0))
            + lam[c] * F.col("ps") for c in "to"}
    rated = (g.join(contexts, "ctx").join(shared, "suffix")
             .select(F.col("gram").alias("key"), F.log(prob["t"] / prob["o"]).cast("float").alias("llr")))

    back = contexts.select((F.lit(-1) - F.col("ctx")).alias("key"), F.log(lam["t"] / lam["o"]).cast("float").alias("llr"))
    seal = grams.sparkSession.range(1).select(F.lit(SEAL).alias("key"), F.lit(0.0).cast("float").alias("llr"))
    return rated.union(back).union(seal)


def tables(keys: np.ndarray, llr: np.ndarray) -> tuple[Ratios, Ratios]:
    """Rows of a model as hash tables of n-grams and of contexts."""
    context = (keys < 0) & (keys != SEAL)
    return Ratios(keys[keys >= 0], llr[keys >= 0]), Ratios(-1 - keys[context], llr[context])


def features(col: pa.Array, grams: Ratios, contexts: Ratios) -> np.ndarray:
    """Per text: log ratio per byte, log ratio of the most toxic stretch per byte, log of the length."""
    out = np.zeros((len(col), 3))
    for s, raw, start, end in _texts(col):
        g, ok = _grams(raw, end)
        v = grams[g]
        gone = np.isnan(v)
        v[gone] = np.nan_to_num(contexts[g[gone] >> 8])
        v = np.where(ok, v, 0).astype(np.float64)
        sums = np.concatenate([[0.0], np.cumsum(v)])
        stop = np.maximum(end - ORDER + 1, start)           # n-grams of row i: start..stop
        n = stop - start
        top = np.minimum(stop, len(v))
        first = np.minimum(start, len(v))
        mean = (sums[top] - sums[first]) / np.maximum(n, 1)
        best = mean * np.minimum(n, STRETCH) / STRETCH
        wide = n >= STRETCH
        if wide.any():
            run = sums[STRETCH:] - sums[:-STRETCH]
            whole = np.full(len(raw) + 1, -np.inf)
            inside = np.zeros(len(raw) + 2, np.int64)
            np.add.at(inside, start[wide], 1)
            np.add.at(inside, stop[wide] - STRETCH + 1, -1)
            at = np.flatnonzero(np.cumsum(inside)[: len(run)] > 0)
            whole[at] = run[at]
            best = np.where(wide, np.maximum.reduceat(whole, start) / STRETCH, best)
        out[s] = np.stack([mean, best, np.log1p(n)], axis=1)
    return out


def packed(src: DataFrame) -> DataFrame:
    """``unit, pack``: batches of ``src`` as compressed Arrow streams, those of about ``UNIT`` bytes in one unit."""
    def run(batches):
        place, held, size = [TaskContext.get().partitionId(), 0], [], 0

        def unit():
            name = hashlib.blake2b(repr(place).encode(), digest_size=8)
            for p in held:
                name.update(p)
            return pa.RecordBatch.from_arrays([pa.array([int.from_bytes(name.digest(), "little", signed=True)] * len(held), pa.int64()),
                                               pa.array(held, pa.binary())], names=["unit", "pack"])

        for b in batches:
            if b.num_rows:
                sink = pa.BufferOutputStream()
                codec = pa.Codec("zstd", compression_level=3)
                with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression=codec)) as w:
                    w.write_batch(b)
                held.append(sink.getvalue().to_pybytes())
                size += b.nbytes
                if size >= UNIT:
                    yield unit()
                    place[1], held, size = place[1] + 1, [], 0
        if held:
            yield unit()
        b = sink = None
        held.clear()
        give_back()

    return arrow_map(src, run, "unit long, pack binary")


def _unpacked(t: pa.Table):
    for p in t["pack"]:
        with pa.ipc.open_stream(p.as_buffer()) as r:
            yield from r


def lookup(src: DataFrame, text_col: str, ratios: DataFrame, fn: Callable[[pa.RecordBatch, np.ndarray], list], schema) -> DataFrame:
    """``fn(batch, features)`` (columns of ``schema``) over batches of ``src``, with the features of their texts under
    the model ``ratios``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)
    at = src.columns.index(text_col)

    def asked(t: pa.Table) -> pa.Table:
        have = _distinct(b.column(at) for b in _unpacked(t))
        back = pc.subtract(-1, pc.unique(pc.shift_right(have, 8)))
        keys = pa.concat_arrays([have, back, pa.array([SEAL], pa.int64())])
        give_back()
        return pa.table({"unit": pa.array(np.full(len(keys), t["unit"][0].as_py(), np.int64)), "key": keys})

    def found(t: pa.Table, hits: pa.Table) -> pa.Table:
        if not t.num_rows:
            return target.empty_table()
        give_back()                                     # the last unit's texts
        keys = hits["key"].to_numpy()
        if SEAL not in keys:
            raise RuntimeError("the rows of a unit changed between its two uses: store the documents first")
        model_ = tables(keys, hits["llr"].to_numpy())
        out = []
        for b in _unpacked(t):
            cols = fn(b, features(b.column(at), *model_))
            out.append(pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type)
                                                   for c, f in zip(cols, target)], schema=target))
        del model_, keys, b, cols
        give_back()
        return pa.Table.from_batches(out, target)

    packs = packed(src)
    hits = packs.groupBy("unit").applyInArrow(asked, "unit long, key long").join(ratios, "key").select("unit", "key", "llr")
    return packs.groupBy("unit").cogroup(hits.groupBy("unit")).applyInArrow(found, schema)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton fit of standardised features; (mean, scale, weights with the intercept last)."""
    mu, sd = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.concatenate([(x - mu) / sd, np.ones((len(x), 1))], axis=1)
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, z.T @ (y - p) - ridge * w)
    return mu, sd, w


def probability(x: np.ndarray, fit: tuple) -> np.ndarray:
    mu, sd, w = fit
    return 1 / (1 + np.exp(-np.clip((x - mu) / sd @ w[:-1] + w[-1], -30, 30)))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text"):
    """``(model, calibration)``, or None if a class has no labelled document."""
    rows = _known(labels, label, id_col, (CALIBRATION,)).count()
    held = (F.col("fold") == CALIBRATION) & _drawn(rows, CALIBRATE)
    every = labelled(docs, labels, label, id_col, text_col).withColumn("held", held)
    counts = stored(count(every), "kn-grams")
    seen = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("t", "o", "ht", "ho")]).first()
    if not seen[0] or not seen[1]:
        return None
    x, y = np.zeros((0, 3)), np.zeros(0)
    if seen[0] > seen[2] and seen[1] > seen[3]:
        without = model(counts.selectExpr("gram", "t - ht t", "o - ho o").where("t + o > 0"))

        some = labelled(docs, labels, label, id_col, text_col, (CALIBRATION,), CALIBRATE).select("text", "label")
        probed = lookup(some, "text", without, lambda b, x: [b.column(1), *x.T], "label int, a double, b double, c double").toArrow()
        x, y = np.stack([probed[k].to_numpy() for k in "abc"], axis=1), probed["label"].to_numpy().astype(float)
    if len(set(y.tolist())) < 2:        # too few labels to calibrate: the sign of the mean log ratio decides
        x, y = np.array([[-0.1, -1, 5], [0.1, 1, 5.0]]), np.array([0.0, 1.0])
    order = np.lexsort(x.T)
    return model(counts.select("gram", "t", "o")), logistic(x[order], y[order])


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted, llr_per_byte, llr_stretch``.

    Null texts score as empty ones.  Rows with a null id are scored, count as
    not held out and are never learnt from; without labels of both classes
    every score is 0.  Ties and repeated rows are scored alike; other columns
    are ignored.
    """
    fitted = train(docs, labels, id_col=id_col, text_col=text_col)
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(fold_of(F.col(id_col)) == HELD_OUT, F.lit(False)).alias("held_out"),
                      F.col(text_col).alias("text"))

    def run(b: pa.RecordBatch, x: np.ndarray):
        p = probability(x, fit)
        return [b.column(0), b.column(1), p, (p >= threshold).astype(np.int32), x[:, 0], x[:, 1]]

    kind = docs.schema[id_col].dataType.simpleString()
    if not fitted:
        nothing = F.lit(0.0)
        return src.select("doc_id", "held_out", nothing.alias("score"), F.lit(int(threshold <= 0)).alias("predicted"),
                          nothing.alias("llr_per_byte"), nothing.alias("llr_stretch"))
    ratios, fit = fitted
    return lookup(src, "text", ratios, run, f"doc_id {kind}, held_out boolean, score double, predicted int, llr_per_byte double, "
                                            "llr_stretch double")


def reject(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (all columns) that are not predicted toxic.

    Null and empty texts are scored as empty ones; rows with a null id are judged
    and never learnt from; repeated rows stay as often as they are there.
    Without labels of both classes nothing goes; an empty table stays empty.
    """
    fitted = train(docs, labels, id_col=id_col, text_col=text_col)
    if not fitted:
        return docs
    ratios, fit = fitted

    def run(b: pa.RecordBatch, x: np.ndarray):
        return b.filter(pa.array(probability(x, fit) < threshold)).columns

    return lookup(docs, text_col, ratios, run, docs.schema)


@query("op8_kneser_ney_toxicity")
def op8(spark, sf_dir):
    """Toxicity of every document."""
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
