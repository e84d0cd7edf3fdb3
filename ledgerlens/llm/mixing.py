"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Targets: the sources, in code point order (null last), weigh 3, 1, 2, repeating,
and share ``share`` times the words of all; no target exceeds ``cap`` times its
source's words, and what is cut off is reshared by weight (water filling).

Rates: among all document rates that meet the token constraint of every source,
the ones closest to 1 in relative entropy are ``min(cap, exp(theta * n))`` for a
document of n words: an exponential tilt, with one dual variable per source.
The dual is solved by distributed, bracketed Newton iterations over the
(source, size) histogram, a sufficient statistic of the corpus.

Copies: whole copies are ``floor(rate)``; the rest of each rate is the chance of
one more copy, drawn by sequential Poisson sampling (smallest ``u / chance``
first, u a hash of the row) until the next one, the document at the edge, would go
beyond the source's remaining words.  The gap it leaves is filled by the next
documents that are no longer than the gap, to the nearest whole one; where too few of them follow, the
document at the edge is taken if that comes nearer to the target.  All copies are
whole, and a source is missed by half a short document, or by half the one at the edge where what
follows it can't fill its gap.

Scale: texts are read, counted and never shuffled.  A hot source is a partial
aggregation and a join with one row per source; the edge of the draw is found
from per-bucket sums, and only the rows of the bucket at the edge are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .registry import query, stored, table

SHARE = 1.5
CAP = 2
WEIGHTS = (3, 1, 2)
BUCKETS = 1 << 16
ROUNDS = 60


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(hist: DataFrame, share: float, cap: int, weights: tuple) -> DataFrame:
    """``source, source_size, target, mean`` from the (source, n, rows) histogram; one row per source.

    Water filling in one pass: with sources ordered by size per weight, the
    capped ones are a prefix.  The windows run over the sources, not the rows.
    """
    every = Window.partitionBy(F.lit(0))
    per = (hist.groupBy("source").agg(F.sum(F.col("n") * F.col("rows")).alias("source_size"),
                                      F.sum("rows").alias("docs")))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last()))
    ranked = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                                   ((rank - 1) % len(weights) + 1).cast("int")))
    level = Window.partitionBy(F.lit(0)).orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    since = level.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(every) * F.lit(float(share))
    fill = (ranked.withColumn("level", (total - F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0)))
                              / F.sum("weight").over(since))
            .withColumn("open", F.col("source_size") * cap > F.col("level") * F.col("weight"))
            .withColumn("level", F.min(F.when(F.col("open"), F.struct(F.col("source_size") / F.col("weight"), "level")))
                        .over(every)["level"]))
    target = F.least((F.col("source_size") * cap).cast("double"),
                     F.coalesce(F.col("level") * F.col("weight"), (F.col("source_size") * cap).cast("double")))
    return fill.select("source", "source_size", target.alias("target"),
                       F.greatest(F.col("source_size") / F.col("docs"), F.lit(1e-9)).alias("mean"))


def _rate(theta: Column, n: Column, mean: Column, cap: int) -> Column:
    """Tilted rate, cut at the cap; the exponent is bounded so that exp stays finite."""
    return F.least(F.lit(float(cap)), F.exp(F.least(theta * n / mean, F.lit(50.0))))


def solve(hist: DataFrame, goal: DataFrame, cap: int, rounds: int = ROUNDS, tolerance: float = 1e-7) -> DataFrame:
    """``source, source_size, target, mean, theta``: Newton steps on the dual, kept within a shrinking bracket."""
    goal = stored(goal, "mix-goal")
    full = F.col("target") >= F.col("source_size") * cap * (1 - 1e-12)
    state = stored(goal.select("*", F.when(full, F.lit(1e18)).when(F.col("target") <= 0, F.lit(-1e18))
                               .otherwise(F.log(F.col("target") / F.col("source_size"))).alias("theta"),
                               F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"),
                               (~full & (F.col("target") > 0)).alias("todo")), "mix-theta")
    for _ in range(rounds):
        if not state.where("todo").limit(1).count():
            break
        rate = _rate(F.col("s.theta"), F.col("h.n"), F.col("s.mean"), cap)
        slope = F.when(rate < cap, rate * F.col("h.n") / F.col("s.mean")).otherwise(0.0)
        at = (hist.alias("h").join(state.where("todo").alias("s"), F.col("h.source").eqNullSafe(F.col("s.source")))
              .groupBy(F.col("h.source").alias("key"))
              .agg(F.sum(F.col("h.n") * F.col("h.rows") * rate).alias("f"),
                   F.sum(F.col("h.n") * F.col("h.rows") * slope).alias("df")))
        gap = F.col("f") - F.col("target")
        lo = F.when(gap < 0, F.col("theta")).otherwise(F.col("lo"))
        hi = F.when(gap > 0, F.col("theta")).otherwise(F.col("hi"))
        step = F.col("theta") - F.try_divide(gap, F.col("df"))
        inside = step.isNotNull() & (lo.isNull() | (step > lo)) & (hi.isNull() | (step < hi))
        other = (F.when(lo.isNotNull() & hi.isNotNull(), (lo + hi) / 2)
                 .when(lo.isNull(), hi - 2 * F.abs(hi) - 1).otherwise(lo + 2 * F.abs(lo) + 1))
        going = F.col("todo") & (F.abs(gap) > F.col("target") * tolerance)
        state = stored(state.join(at, F.col("source").eqNullSafe(F.col("key")), "left")
                       .select("source", "source_size", "target", "mean",
                               F.when(going, F.when(inside, step).otherwise(other)).otherwise(F.col("theta")).alias("theta"),
                               F.when(going, lo).otherwise(F.col("lo")).alias("lo"),
                               F.when(going, hi).otherwise(F.col("hi")).alias("hi"), going.alias("todo")), "mix-theta")
    return state.select("source", "source_size", "target", "mean", "theta")


def mix(docs: DataFrame, share: float = SHARE, cap: int = CAP, weights: tuple = WEIGHTS,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: ``row`` (a struct of all its columns, so none can clash), ``doc_id,
    size, source_size, target, rate, copies`` and ``taken`` (words taken in all, ``copies * size``).

    Null and empty texts have size 0 and take nothing; a null source is a source
    of its own, the last; repeated rows are rows like others, each drawn by
    itself; a very long text is taken whole or not at all; an empty table gives an empty result.
    """
    base = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                       word_count(F.col(text_col)).alias("n"))
    sized = stored(base.select("doc_id", "source", "n"), "mix-sizes")
    hist = stored(sized.groupBy("source", "n").agg(F.count(F.lit(1)).alias("rows")), "mix-hist")
    theta = solve(hist, targets(hist, share, cap, weights), cap)

    # whole copies, and the chance of one more
    u = (F.pmod(F.xxhash64("doc_id", "n"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    chance = F.col("rate") - F.floor("rate")

    def rated(rows: DataFrame) -> DataFrame:
        t = theta.withColumnRenamed("source", "of")
        r = rows.join(t, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
        r = r.withColumn("rate", F.when(F.col("n") > 0, _rate(F.col("theta"), F.col("n"), F.col("mean"), cap)).otherwise(0.0))
        r = r.withColumn("copies", F.floor("rate")).withColumn("turn", F.when(chance > 0, u / (u + chance)))
        return r.withColumn("bucket", F.floor(F.col("turn") * BUCKETS))

    # written once: five small aggregates and joins read it, each with a short plan of its own
    draws = stored(rated(sized).select("doc_id", "source", "n", "copies", "turn", "bucket"), "mix-draws")
    drawn = draws.where("bucket is not null")
    whole = draws.groupBy("source").agg(F.sum(F.col("n") * F.col("copies")).alias("whole"))
    rest = (whole.join(theta.select(F.col("source").alias("of"), "target"), F.col("source").eqNullSafe(F.col("of")))
            .select("source", F.greatest(F.round(F.col("target") - F.col("whole")).cast("long"), F.lit(0)).alias("rest")))
    edge = stored(_edge(drawn, rest, "rest").select("of", F.col("bucket").alias("edge"), "left"), "mix-edge")
    place = F.struct("turn", "doc_id", "n")
    order = Window.partitionBy("source", "bucket").orderBy("turn", "doc_id", "n").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum("n").over(order), F.lit(0))
    first = (drawn.join(edge, F.col("source").eqNullSafe(F.col("of"))).where("bucket = edge").withColumn("used", used)
             .where("used < left and used + n > left").groupBy("of")
             .agg(F.min(F.struct(place.alias("place"), (F.col("left") - F.col("used")).alias("gap"))).alias("f"))
             .select("of", "f.place", "f.gap"))
    first = stored(first, "mix-gap")
    # what follows the edge and is no longer than the gap fills it
    fits = (drawn.join(first, F.col("source").eqNullSafe(F.col("of"))).drop("of")
            .where((place > F.col("place")) & (F.col("n") <= F.col("gap"))))
    fits = stored(fits.groupBy("source", "bucket").agg(F.sum("n").alias("n")), "mix-fits")
    fill = _edge(fits, first.select(F.col("of").alias("source"), "gap"), "gap").select(
        F.col("of").alias("of2"), F.col("bucket").alias("edge2"), F.col("left").alias("left2"))
    words = fits.groupBy(F.col("source").alias("of3")).agg(F.sum("n").alias("follow"))
    known = (edge.join(first.withColumnRenamed("of", "of1"), F.col("of").eqNullSafe(F.col("of1")), "left")
             .join(fill, F.col("of").eqNullSafe(F.col("of2")), "left").join(words, F.col("of").eqNullSafe(F.col("of3")), "left")
             .withColumn("over", F.col("edge2").isNull() & (F.col("place.n") - F.col("gap")
                                                           <= F.col("gap") - F.coalesce("follow", F.lit(0)))))
    known = stored(known.select("of", "edge", "left", "place", "gap", "edge2", "left2", "over"), "mix-edges")

    placed = rated(base).join(known, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    later = F.coalesce((place > F.col("place")) & (F.col("n") <= F.col("gap")) & ~F.col("over"), F.lit(False))
    at_edge = F.coalesce((F.col("bucket") == F.col("edge")) | (later & (F.col("bucket") == F.col("edge2"))), F.lit(False))
    placed = placed.withColumn("later", later).withColumn("at_edge", at_edge)
    keep = ["row", "doc_id", "n", "source_size", "target", "rate", "copies"]
    sure = (F.col("bucket") < F.coalesce("edge", F.lit(BUCKETS))) | (F.col("later") & (F.col("bucket") < F.coalesce("edge2", F.lit(BUCKETS))))
    outer = placed.where("not at_edge").select(*keep, F.when(F.coalesce(sure, F.lit(False)), F.col("n")).otherwise(0).alias("extra"))
    used2 = F.coalesce(F.sum(F.when(F.col("later"), F.col("n"))).over(order), F.lit(0))
    before = (F.col("bucket") == F.col("edge")) & ((F.col("used") + F.col("n") <= F.col("left"))
                                                   | (F.col("over") & (place == F.col("place")) & (F.col("used") < F.col("left"))))
    after = F.col("later") & ((F.col("bucket") < F.coalesce("edge2", F.lit(BUCKETS)))
                              | (2 * (F.col("left2") - F.col("used2")) >= F.col("n")))
    inner = placed.where("at_edge").withColumn("used", used).withColumn("used2", used2).select(
        *keep, F.when(F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False)), F.col("n")).otherwise(0).alias("extra"))
    return outer.unionAll(inner).select(
        "row", "doc_id", F.col("n").alias("size"), "source_size", "target", "rate",
        (F.col("copies") + (F.col("extra") > 0).cast("long")).alias("copies"),
        (F.col("copies") * F.col("n") + F.col("extra")).cast("long").alias("taken"))


def _edge(rows: DataFrame, goal: DataFrame, words: str) -> DataFrame:
    """``of, bucket, left``: for each source of ``goal`` the bucket in which its rows, in order of buckets,
    reach ``words``, and what of them is left at its start; no row where they never do."""
    sums = (rows.groupBy("source", "bucket").agg(F.sum("n").alias("s"))
            .withColumn("upto", F.sum("s").over(Window.partitionBy("source").orderBy("bucket"))))
    return (sums.join(goal.select(F.col("source").alias("of"), F.col(words).alias("goal")), F.col("source").eqNullSafe(F.col("of")))
            .where("upto >= goal").groupBy("of")
            .agg(F.min(F.struct("bucket", F.expr("goal - (upto - s)").alias("left"))).alias("e")).select("of", "e.bucket", "e.left"))


def apply(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: every document as often as it is taken, always whole.

    Rows without words (null and empty texts among them) are taken never; repeated rows are
    copied each by itself; an empty table gives an empty result.
    """
    m = mix(docs, text_col=text_col, **options).where("copies > 0")
    out = m.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long"))).alias("copy"))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


@query("op5_entropy_balancing_mix")
def op5(spark, sf_dir):
    """Words that the mix takes of every document."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")
