"""Connected components by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` for every node of ``edges(u, v)`` (longs): comp is the smallest node reachable.

    A round gives each node the smallest label among its neighbours and itself,
    then the label of that label (a label is a node of the same component, so
    chains halve).  It ends when a round changes nothing.  A node's minimum is
    a partial aggregation, and labels are stored, so a hot node is met by plain
    equi-joins that AQE can split.
    """
    both = edges.where("u != v")
    both = stored(both.select("u", "v").unionAll(both.select("v", "u")).distinct(), "cc-edges")
    state = stored(both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("comp"))
                   .selectExpr("u node", "comp", "true moved"), "cc-labels")
    while state.where("moved").limit(1).count():
        label = state.select("node", "comp")
        near = (both.join(label.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("comp").alias("near")))
        low = (state.join(near, F.col("node") == F.col("u")).select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("low")))
        jump = label.select(F.col("node").alias("low"), F.col("comp").alias("next"))
        state = stored(low.join(jump, "low").select("node", F.least("low", "next").alias("comp"), "old")
                       .selectExpr("node", "comp", "comp < old moved"), "cc-labels")
    return state.select("node", "comp")
