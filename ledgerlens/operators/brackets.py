"""Exact percentiles of whole columns without sorting or unpivoting them.

1. One aggregate sketches every column (``percentile_approx``) and reads nested
   brackets off it: per percentile a narrow pair of values, wider ones and at last
   the extremes.
2. One aggregate counts the values below and up to each bracket's ends.  The counts
   prove which brackets hold the wanted ranks; the narrowest such one is taken, and
   the extremes always qualify, so a poor sketch costs work and never the result.
3. Only values inside the taken brackets (about ``4 / accuracy`` of a column) are
   collapsed to (bracket, value, count) and positioned by prefix sums.

A bracket whose ends are equal needs no third step.  The driver holds a few numbers
per column and percentile.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rank import prefix_sums

ACCURACY = 2000
WIDTHS = (2, 16)          # half widths of the nested brackets, in units of 1 / accuracy
LANDMARKS = 64            # evenly spaced percentiles that show how many values differ
INTEGERS = ("tinyint", "smallint", "int", "bigint")


@dataclass
class ColumnQuantiles:
    """Percentiles of one column (None without values) and what the passes show about its values."""

    values: list[float] | None
    n: int
    n_distinct_at_least: int
    has_repeats: bool     # True is proven, False is open


def _same(a: float, b: float) -> bool:
    return a == b or (math.isnan(a) and math.isnan(b))


def bracketed_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                        accuracy: int = ACCURACY) -> dict[str, ColumnQuantiles]:
    """Exact percentiles with linear interpolation, as ``rank.exact_quantiles`` gives them
    for a whole column: NULL is skipped, NaN is the greatest value, a column without values
    has ``values=None``."""
    columns, probs = list(columns), [float(p) for p in probs]
    types = dict(df.dtypes)
    x = {c: F.col(f"`{c}`").cast("double") for c in columns}
    if not columns:
        return {}

    ends = [(max(0.0, p - w / accuracy), min(1.0, p + w / accuracy)) for p in probs for w in WIDTHS]
    marks = [i / (LANDMARKS - 1) for i in range(LANDMARKS)]
    asked = F.array(*[F.lit(q) for pair in ends for q in pair], *[F.lit(q) for q in marks])
    sketch = df.agg(*[e for i, c in enumerate(columns) for e in (
        F.count(x[c]).alias(f"n{i}"), F.min(x[c]).alias(f"lo{i}"), F.max(x[c]).alias(f"hi{i}"),
        F.percentile_approx(x[c], asked, F.lit(accuracy)).alias(f"q{i}"))]).first()

    out = {c: ColumnQuantiles(None, 0, 0, False) for c in columns}
    nested: dict[tuple[int, int], list[tuple[float, float]]] = {}
    for i, c in enumerate(columns):
        n, q = sketch[f"n{i}"], sketch[f"q{i}"]
        if not n:
            continue
        found = {repr(v) for v in q}
        lo, hi = sketch[f"lo{i}"], sketch[f"hi{i}"]
        # more rows than whole numbers between the extremes: some value repeats
        crowded = types[c] in INTEGERS and max(abs(lo), abs(hi)) < 2 ** 53 and n > hi - lo + 1
        out[c] = ColumnQuantiles([0.0] * len(probs), n, len(found), crowded)
        for j in range(len(probs)):
            at = [2 * (j * len(WIDTHS) + w) for w in range(len(WIDTHS))]
            nested[i, j] = [(q[a], q[a + 1]) for a in at] + [(lo, hi)]
    if not nested:
        return out

    counted = df.agg(*[e for (i, j), pairs in nested.items() for w, (lo, hi) in enumerate(pairs[:-1]) for e in (
        F.count_if(x[columns[i]] < F.lit(lo)).alias(f"below{i}_{j}_{w}"),
        F.count_if(x[columns[i]] <= F.lit(hi)).alias(f"upto{i}_{j}_{w}"))]).first()

    taken, known = [], {}      # brackets to rank inside: (i, j, lo, hi, below)
    for (i, j), pairs in nested.items():
        o = out[columns[i]]
        pos = (o.n - 1) * probs[j]
        for w, (lo, hi) in enumerate(pairs):
            last = w == len(pairs) - 1
            below, upto = (0, o.n) if last else (counted[f"below{i}_{j}_{w}"], counted[f"upto{i}_{j}_{w}"])
            if below <= math.floor(pos) and math.ceil(pos) < upto:
                break
        if _same(lo, hi):
            o.values[j] = lo
            o.has_repeats |= upto - below > 1
        else:
            taken.append((i, j, lo, hi, below))
            known[len(taken) - 1] = (i, j, pos)
    if not taken:
        return out

    def inside(t) -> Column:
        i, _, lo, hi, _ = t
        return (x[columns[i]] >= F.lit(lo)) & (x[columns[i]] <= F.lit(hi))

    some = inside(taken[0])
    for t in taken[1:]:
        some = some | inside(t)
    entries = F.array_compact(F.array(*[F.when(inside(t), F.struct(F.lit(b).alias("bracket"), x[columns[t[0]]].alias("v")))
                                        for b, t in enumerate(taken)]))
    counts = (df.where(some).select(F.explode(entries).alias("e")).select("e.bracket", "e.v")
              .groupBy("bracket", "v").agg(F.count(F.lit(1)).alias("cnt")))
    ps = prefix_sums(counts, ["v"], ["cnt"], ["bracket"])
    wanted = F.create_map(*[F.lit(y) for b, t in enumerate(taken) for y in (b, float(known[b][2] - t[4]))])
    at = wanted[F.col("bracket")]      # rank wanted, from the bracket's first value on

    def value_at(i: Column) -> Column:
        return F.max(F.when((F.col("cnt_before") <= i) & (i < F.col("cnt_before") + F.col("cnt")), F.col("v")))

    for r in ps.groupBy("bracket").agg(value_at(F.floor(at)).alias("lv"), value_at(F.ceil(at)).alias("hv"),
                                       F.max("cnt").alias("most")).collect():   # one row per bracket
        i, j, pos = known[r["bracket"]]
        o, lv, hv = out[columns[i]], r["lv"], r["hv"]
        whole = math.floor(pos) == math.ceil(pos) or _same(lv, hv)
        o.values[j] = lv if whole else (math.ceil(pos) - pos) * lv + (pos - math.floor(pos)) * hv
        o.has_repeats |= r["most"] > 1
    return out


def distinct_and_repeats(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[int, bool]]:
    """``(distinct values, some value repeats)`` of each column, exactly: (column, value)
    counts with map-side combine, for the columns that the passes above leave open."""
    if not columns:
        return {}
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("double").alias("v"))
                                         for c in columns])).alias("s")).select("s.c", "s.v").where("v is not null")
    per = long.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")).groupBy("c").agg(
        F.count(F.lit(1)).alias("d"), (F.max("n") > 1).alias("repeats"))
    return {c: (0, False) for c in columns} | {r["c"]: (r["d"], r["repeats"]) for r in per.collect()}  # one row per column
