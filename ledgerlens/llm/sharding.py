"""Sharding by balanced label propagation, in DataFrame functions only.

Equal texts are one node (weight: rows).  Nodes are linked through lines of at
least ``LINE`` bytes that they share; a shared line is a hub, so a line of k
documents is k links, never k^2 pairs.  One round of propagation: a line takes
the label that most of its documents have, and a document wants the label that
most of its lines have (a line counts 1 / its documents).  First clusters form:
each node is labelled with its rarest shared line and follows its neighbours
freely.  Clusters are then dealt to the shards, and nodes move towards their
neighbours' shards.  Moves from shard a to b are granted up to a quota: what
wants to go the other way plus a share of b's free capacity.  Who moves within
a quota is drawn by hash per cluster, so no round needs an order.

At last the rows are laid out by (shard, cluster, text) and cut into equal
parts: the law ``rows`` holds exactly (counts at most one apart), and linked
documents stand next to one another, also where the cut had to move a border.

Scale: texts are read twice and never shuffled, only hashes of texts and lines
are.  Positions come from per-bucket counts: a bucket holds about
``max(ROWS, rows / PARTS)`` rows, also within a large cluster or a group of equal
texts, so neither a hot group nor a shard is ever ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .registry import query, stored, table

SHARDS = 24
LINE = 40
CLUSTER_ROUNDS, ROUNDS = 2, 2
SLACK = 0.05         # capacity above an equal share while labels move
ROWS, PARTS = 200, 8000


def _node(text: Column) -> Column:
    """Equal texts are one node: 64 bits of sha256 (null is a text of its own)."""
    return F.conv(F.substring(F.sha2(F.concat(F.when(text.isNull(), "n").otherwise("t"), F.coalesce(text, F.lit(""))), 256),
                              1, 15), 16, 10).cast("long")


def _hash(*cols, mod: int | Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(mod) if isinstance(mod, int) else mod)


def links(docs: DataFrame, text_col: str) -> DataFrame:
    """``node, line, deg``: lines found in more than one distinct text, with the number of such texts."""
    line = F.explode(F.split(F.col(text_col), "\n"))
    every = stored(docs.where(F.octet_length(text_col) >= LINE).select(_node(F.col(text_col)).alias("node"), line.alias("l"))
                   .where(F.octet_length("l") >= LINE).select("node", F.xxhash64("l").alias("line")).distinct(), "shard-lines")
    shared = stored(every.groupBy("line").agg(F.count(F.lit(1)).alias("deg")).where("deg > 1"), "shard-degrees")
    return stored(every.join(shared, "line"), "shard-links")


def wishes(state: DataFrame, edges: DataFrame, label: str) -> DataFrame:
    """``node, want``: the label that a node's lines have most of (a line counts 1 / deg); ties go to the smaller."""
    votes = (edges.join(state, "node").groupBy("line", label).agg(F.sum("w").alias("n"))
             .groupBy("line").agg(F.min(F.struct((-F.col("n")).alias("n"), label)).alias("m")))
    votes = stored(votes.select("line", F.col(f"m.{label}").alias("vote")), "shard-votes")
    return (edges.join(votes, "line").groupBy("node", "vote").agg(F.round(F.sum(-1 / F.col("deg")), 9).alias("s"))
            .groupBy("node").agg(F.min(F.struct("s", "vote")).alias("m")).select("node", F.col("m.vote").alias("want")))


def propagate(nodes: DataFrame, edges: DataFrame, shards: int, rounds: int, total: int) -> DataFrame:
    """``node, w, key, label``: clusters by free, then shards by balanced label propagation."""
    start = edges.groupBy("node").agg(F.min(F.struct("deg", "line")).alias("r"))
    state = stored(nodes.join(start, "node", "left").select("node", "w", F.coalesce(F.col("r.line"), F.col("node")).alias("key")),
                   "shard-keys")
    for _ in range(CLUSTER_ROUNDS):
        state = stored(state.join(wishes(state, edges, "key"), "node", "left")
                       .select("node", "w", F.coalesce("want", "key").alias("key")), "shard-keys")
    state = state.withColumn("label", _hash("key", mod=shards).cast("int"))
    cap = total / shards * (1 + SLACK)
    for r in range(rounds):
        want = wishes(state, edges, "label")
        asked = stored(state.join(want, "node", "left").withColumn("want", F.coalesce("want", "label")), "shard-asks")
        flow = asked.where("want != label").groupBy(F.col("label").alias("a"), F.col("want").alias("b")).agg(F.sum("w").alias("m"))
        back = flow.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("m").alias("reverse"))
        load = asked.groupBy(F.col("label").alias("b")).agg(F.sum("w").alias("load"))
        into = flow.groupBy("b").agg(F.sum("m").alias("asked"))
        quota = (flow.join(back, ["a", "b"], "left").join(load, "b", "left").join(into, "b")
                 .select(F.col("a").alias("label"), F.col("b").alias("want"),
                         ((F.least("m", F.coalesce("reverse", F.lit(0)))
                           + F.greatest(F.lit(cap) - F.coalesce("load", F.lit(0)), F.lit(0.0)) * F.col("m") / F.col("asked"))
                          / F.col("m")).alias("part")))
        drawn = _hash("key", F.lit(r), mod=1 << 30) / float(1 << 30)
        state = stored(asked.join(F.broadcast(quota), ["label", "want"], "left")      # at most shards^2 rows
                       .select("node", "w", "key", F.when(drawn < F.coalesce("part", F.lit(0.0)), F.col("want"))
                               .otherwise(F.col("label")).alias("label")), "shard-labels")
    return state


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, text_crc32, law, shard, slot, grown_shard, label``.

    ``size`` is the text's UTF-8 bytes plus 8; the law is ``rows``; ``slot`` counts
    from 0 without gaps within the shard; ``grown_shard`` is null (it belongs to
    the law ``key``); ``label`` is the shard that propagation asked for.  A null text
    has no bytes and no lines.  Null ids, ties and repeated rows are rows like
    others; an empty table gives an empty result; other columns are ignored.
    """
    text = F.col(text_col)
    rows = stored(docs.select(F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
                              F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"), _node(text).alias("node")), "shard-rows")
    total = rows.count()
    nodes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("w"))
    state = propagate(nodes, links(docs, text_col), shards, rounds, total)

    # positions: (label, part, salt) buckets of about `size` rows each, laid end to end
    size = max(ROWS, -(-total // PARTS))
    parts = max(1, total // shards // size)
    weights = stored(state.groupBy("key").agg(F.ceil(F.sum("w") / size).alias("salts")), "shard-weights")
    spot = state.join(weights, "key").select("node", "w", "label", _hash("key", F.lit(7), mod=parts).alias("part"),
                                             F.xxhash64("key").alias("near"), "salts")
    spread = F.when(F.col("w") > size, F.xxhash64("doc_id")).otherwise(F.xxhash64("node"))
    placed = stored(rows.join(spot, "node").withColumn("salt", F.pmod(spread, "salts")).drop("salts", "w"), "shard-places")
    bucket = ["label", "part", "salt"]
    counts = placed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)      # some PARTS rows
    offset = stored(counts.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).drop("n"), "shard-offsets")
    within = Window.partitionBy(*bucket).orderBy("near", "node", "doc_id")
    at = (placed.withColumn("i", F.row_number().over(within) - 1).join(F.broadcast(offset), bucket)
          .withColumn("at", (F.col("before") + F.col("i")).cast("long")))
    number = F.expr(f"(at * {shards}L) div {max(total, 1)}L")
    return (at.withColumn("shard", number.cast("int"))
            .withColumn("slot", F.expr(f"at - ((shard * {total}L + {shards - 1}L) div {shards}L)"))
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard"), "label"))


@query("op2_balanced_label_sharding")
def op2(spark, sf_dir):
    """Shard and slot of every document."""
    return shard(table(spark, sf_dir, "documents"))
