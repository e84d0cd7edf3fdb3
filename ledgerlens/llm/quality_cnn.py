"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded (``DIM`` values each); ``FILTERS`` learned filters of
``WIDTH`` bytes slide over the whole text in steps of ``STEP``; chunks of
``2 * HOP`` bytes overlap by half and keep each filter's maximum; a small hidden
layer looks at each chunk, and the maximum and the mean over all chunks make
one probability.  All of it is trained by back-propagation (Adam) on a bounded
hash sample of at most about ``SAMPLE`` labelled documents of at most
``LONGEST`` bytes; scoring covers every byte of every text.

Scale: scoring is one narrow pass of matrix products over batches of whole
texts; the network is some 10 kB in the task closure.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from .registry import map_batches, query, table
from .toxicity import HELD_OUT, fold_of, labelled

DIM, WIDTH, STEP, FILTERS, HOP, HIDDEN = 8, 12, 4, 32, 256, 16
SAMPLE, LONGEST = 4000, 1 << 15
EPOCHS, BATCH, RATE, SEED = 6, 32, 0.004, 5
SEGMENTS = WIDTH // STEP
PER_HOP = HOP // STEP


def initial(seed: int = SEED) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)

    def normal(*shape, scale):
        return (r.standard_normal(shape) * scale).astype(np.float32)

    return {"embed": normal(256, DIM, scale=0.5), "conv": normal(SEGMENTS, STEP * DIM, FILTERS, scale=(WIDTH * DIM) ** -0.5),
            "bias": np.zeros(FILTERS, np.float32), "hidden": normal(FILTERS, HIDDEN, scale=FILTERS ** -0.5),
            "hidden_bias": np.zeros(HIDDEN, np.float32), "out": normal(2 * HIDDEN, scale=0.1), "out_bias": np.zeros(1, np.float32)}


def layout(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows padded with zero bytes to whole hops (one at least); bytes and each row's number of hops."""
    size = np.diff(off)
    hops = np.maximum(1, -(-size // HOP))
    start = np.concatenate([[0], np.cumsum(hops) * HOP])
    out = np.zeros(start[-1], np.uint8)
    row = np.repeat(np.arange(len(size)), size)
    out[np.arange(off[0], off[-1]) - off[row] + start[row]] = data[off[0]:off[-1]]
    return out, hops


def forward(net: dict, raw: np.ndarray, hops: np.ndarray) -> dict:
    """All layers for a batch of rows laid out in whole hops."""
    x = net["embed"][raw].reshape(-1, STEP * DIM)
    n = len(x)
    conv = x @ net["conv"][0]
    for s in range(1, SEGMENTS):                       # a window is SEGMENTS consecutive steps
        conv[: n - s] += x[s:] @ net["conv"][s]
    last = np.cumsum(hops) * PER_HOP
    for s in range(1, SEGMENTS):                       # windows that would run into the next row
        conv[last - s] = -1e9
    conv = conv.reshape(-1, PER_HOP, FILTERS)
    top = conv.max(axis=1)
    # chunk j of a row is its hops j and j + 1 (a row of one hop is one chunk)
    chunks = np.maximum(hops - 1, 1)
    first = np.concatenate([[0], np.cumsum(hops)[:-1]])
    doc = np.repeat(np.arange(len(hops)), chunks)
    j = np.arange(chunks.sum()) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    left = first[doc] + j
    right = np.minimum(left + 1, first[doc] + hops[doc] - 1)
    pooled = np.maximum(np.maximum(top[left], top[right]) + net["bias"], 0)
    hidden = np.maximum(pooled @ net["hidden"] + net["hidden_bias"], 0)
    at = np.cumsum(chunks) - chunks
    peak = np.maximum.reduceat(hidden, at, axis=0)
    mean = np.add.reduceat(hidden, at, axis=0) / chunks[:, None]
    z = np.concatenate([peak, mean], axis=1) @ net["out"] + net["out_bias"]
    return {"conv": conv, "top": top, "left": left, "right": right, "doc": doc, "chunks": chunks, "pooled": pooled,
            "hidden": hidden, "peak": peak, "mean": mean, "p": 1 / (1 + np.exp(-np.clip(z, -30, 30)))}


def gradients(net: dict, raw: np.ndarray, hops: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean log loss; a maximum passes its gradient to where it was taken."""
    f = forward(net, raw, hops)
    dz = ((f["p"] - y) / len(y)).astype(np.float32)
    feats = np.concatenate([f["peak"], f["mean"]], axis=1)
    g = {"out": feats.T @ dz, "out_bias": np.array([dz.sum()], np.float32)}
    dpeak, dmean = np.outer(dz, net["out"][:HIDDEN]), np.outer(dz, net["out"][HIDDEN:])
    at_peak = (f["hidden"] >= f["peak"][f["doc"]]).astype(np.float32)
    ties = np.add.reduceat(at_peak, np.cumsum(f["chunks"]) - f["chunks"], axis=0)      # equal chunks share it
    dh = at_peak * (dpeak / ties)[f["doc"]] + (dmean / f["chunks"][:, None])[f["doc"]]
    dh = (dh * (f["hidden"] > 0)).astype(np.float32)
    g["hidden"], g["hidden_bias"] = f["pooled"].T @ dh, dh.sum(axis=0)
    dp = dh @ net["hidden"].T * (f["pooled"] > 0)
    g["bias"] = dp.sum(axis=0)
    dtop = np.zeros_like(f["top"])
    from_left = f["top"][f["left"]] >= f["top"][f["right"]]
    np.add.at(dtop, f["left"], np.where(from_left, dp, 0))
    np.add.at(dtop, f["right"], np.where(from_left, 0, dp))
    hop = np.arange(len(dtop))[:, None]
    pos = hop * PER_HOP + f["conv"].argmax(axis=1)                     # (hops, filters) step of each maximum
    window = pos[:, :, None] * STEP + np.arange(WIDTH)
    bytes_ = raw[np.minimum(window, len(raw) - 1)]                     # (hops, filters, WIDTH)
    x = net["embed"][bytes_].reshape(len(dtop), FILTERS, WIDTH * DIM)
    g["conv"] = np.einsum("nf,nfk->kf", dtop, x, optimize=True).reshape(net["conv"].shape)
    dx = (dtop[:, :, None] * net["conv"].reshape(-1, FILTERS).T[None]).reshape(-1, DIM)
    flat = bytes_.reshape(-1)
    g["embed"] = np.stack([np.bincount(flat, dx[:, d], minlength=256) for d in range(DIM)], axis=1).astype(np.float32)
    return g


def fit(texts: pa.Array, y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Train on a bounded set of texts (0/1 labels) by Adam with a falling rate."""
    off, data = W.text_buffers(texts)
    net, rng = initial(seed), np.random.default_rng(seed + 1)
    rate = min(max(y.mean(), 0.02), 0.98)
    net["out_bias"][:] = np.log(rate / (1 - rate))
    m = {k: np.zeros_like(v) for k, v in net.items()}
    s = {k: np.zeros_like(v) for k, v in net.items()}
    step, steps = 0, epochs * -(-len(y) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(y), BATCH):
            pick = order[a:a + BATCH]
            parts = [data[off[i]:off[i + 1]] for i in pick]
            o = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
            raw, hops = layout(o, np.concatenate(parts))
            g = gradients(net, raw, hops, y[pick].astype(np.float32))
            step += 1
            lr = RATE * (1 - (step - 1) / steps)
            for k in net:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                s[k] = 0.99 * s[k] + 0.01 * g[k] ** 2
                net[k] -= (lr * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.99 ** step)) + 1e-7)).astype(np.float32)
    return net


def predict(net: dict, texts: pa.Array) -> np.ndarray:
    """Probability of each text (null: empty)."""
    off, data = W.text_buffers(texts)
    out = np.zeros(len(texts))
    for s in W.row_slices(off, 1 << 18):
        out[s] = forward(net, *layout(off[s.start:s.stop + 1], data))["p"]
    return out


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> dict | None:
    """The trained network, or None without labelled documents of both classes."""
    known = labelled(docs, labels, label, id_col, text_col, most=SAMPLE).where(F.octet_length("text") <= LONGEST)
    some = known.select("doc_id", "label", "text").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    y = some["label"].to_numpy()
    if len(set(y.tolist())) < 2:
        return None
    return fit(some["text"].combine_chunks(), y)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted``.

    Null texts score as empty ones.  Rows with a null id are scored, count as
    not held out and are never learnt from; without labels of both classes
    every score is 1.  Ties and repeated rows are scored alike; other columns
    are ignored.
    """
    net = train(docs, labels, id_col=id_col, text_col=text_col)
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(fold_of(F.col(id_col)) == HELD_OUT, F.lit(False)).alias("held_out"),
                      F.col(text_col).alias("text"))

    def run(b: pa.RecordBatch):
        p = predict(net, b.column(2)) if net else np.ones(b.num_rows)
        yield {"doc_id": b.column(0), "held_out": b.column(1), "score": p, "predicted": (p >= threshold).astype(np.int32)}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(src, run, f"doc_id {kind}, held_out boolean, score double, predicted int")


@query("op10_byte_cnn_quality")
def op10(spark, sf_dir):
    """Quality of every document."""
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
