"""Automatic feature synthesis over a declared table tree.

An entity set names each table's key, and relationships say which child
column points at which parent key.  ``synthesize`` walks the tree bottom-up
from the target: every child is reduced to one row per parent key with the
aggregation primitives (one ``groupBy`` per edge, with map-side partial
aggregation), then left-joined onto the parent.  At depth 2 the child's own
aggregates of its children are aggregated again, giving stacked features
named ``FUNC(child.FUNC2(grandchild.col))``.  An entity also gets the features
of its parents (their columns and the aggregates of their other children) by
an equi-join on the parent's key, named ``parent.feature``; the walk never
comes back to an entity of its own path, so it ends on any set of
relationships.

Primitives: SUM, STD, MAX, SKEW, MIN, MEAN, COUNT (numeric) and NUM_UNIQUE,
MODE (categorical).  SKEW is the bias-corrected sample skewness (0 for a
constant group); STD is the sample standard deviation.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, NumericType, StringType

NUMERIC_PRIMITIVES = ("SUM", "STD", "MAX", "SKEW", "MIN", "MEAN")
CATEGORICAL_PRIMITIVES = ("NUM_UNIQUE", "MODE")


@dataclass
class Entity:
    name: str
    df: DataFrame
    key: str | None  # None: no key of its own (never needed to aggregate)


@dataclass
class Relationship:
    parent: str
    parent_key: str
    child: str
    child_key: str


@dataclass
class EntitySet:
    entities: dict[str, Entity] = field(default_factory=dict)
    relationships: list[Relationship] = field(default_factory=list)

    def add(self, name: str, df: DataFrame, key: str | None) -> "EntitySet":
        self.entities[name] = Entity(name, df, key)
        return self

    def relate(self, parent: str, parent_key: str, child: str, child_key: str) -> "EntitySet":
        self.relationships.append(Relationship(parent, parent_key, child, child_key))
        return self

    def parents(self, child: str) -> list[Relationship]:
        return [r for r in self.relationships if r.child == child]

    def children(self, parent: str) -> list[Relationship]:
        return [r for r in self.relationships if r.parent == parent]

    def foreign_keys(self, name: str) -> set[str]:
        return {r.child_key for r in self.relationships if r.child == name}


def _skew(x: Column) -> Column:
    n = F.count(x).cast("double")
    g1 = F.skewness(x)
    return (F.when(n < 3, F.lit(None))
            .when(F.var_pop(x) == 0, F.lit(0.0))
            .otherwise(g1 * F.sqrt(n * (n - 1)) / (n - 2)))


def _numeric(x: Column, prim: str, decimal: bool) -> Column:
    d = x.cast("double")
    if prim == "SUM":
        return F.coalesce(F.sum(x), F.lit(0)) if decimal else F.coalesce(F.sum(d), F.lit(0.0))
    if prim == "MEAN":
        return F.try_divide(F.sum(x).cast("double"), F.count(x).cast("double")) if decimal else F.avg(d)
    if prim == "MAX":
        return F.max(x)
    if prim == "MIN":
        return F.min(x)
    if prim == "STD":
        return F.stddev_samp(d)
    if prim == "SKEW":
        return _skew(d)
    raise ValueError(prim)


def _aggregate_child(child_df: DataFrame, child: str, child_key: str, skip: set[str],
                     numeric_prims: Sequence[str], cat_prims: Sequence[str]) -> DataFrame:
    exprs = [F.count(F.lit(1)).alias(f"COUNT({child})")]
    modes = []
    fields = child_df.schema.fields
    for f in fields:
        if f.name in skip:
            continue
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, NumericType):
            dec = isinstance(f.dataType, DecimalType)
            for p in numeric_prims:
                exprs.append(_numeric(c, p, dec).alias(f"{p}({child}.{f.name})"))
        elif isinstance(f.dataType, StringType):
            if cat_prims:
                modes.append(f.name)
    out = child_df.groupBy(F.col(child_key).alias("__fk")).agg(*exprs)
    filled = {}
    for m in modes:
        # NUM_UNIQUE and MODE from one (key, value, count) side plan: no
        # Expand of the wide aggregate, no group gathered in one task
        counts = (child_df.where(F.col(f"`{m}`").isNotNull())
                  .groupBy(F.col(child_key).alias("__fk"), F.col(f"`{m}`").alias("__m"))
                  .agg(F.count(F.lit(1)).alias("__n")))
        side = []
        if "NUM_UNIQUE" in cat_prims:
            side.append(F.count(F.lit(1)).alias(f"NUM_UNIQUE({child}.{m})"))
            filled[f"NUM_UNIQUE({child}.{m})"] = 0
        if "MODE" in cat_prims:
            side.append(F.min_by(F.col("__m"), F.struct(-F.col("__n"), F.col("__m"))).alias(f"MODE({child}.{m})"))
        out = out.join(counts.groupBy("__fk").agg(*side), "__fk", "left")
    # one final projection: declared primitive order, zero-filled distinct counts
    have = out.columns  # one schema resolution, not one per name
    have_set = set(have)
    ordered = ["__fk", f"COUNT({child})"]
    for f in fields:
        for p in (*numeric_prims, *cat_prims):
            n = f"{p}({child}.{f.name})"
            if n in have_set and n not in ordered:
                ordered.append(n)
    ordered += [c for c in have if c not in ordered]
    return out.select(*[F.coalesce(F.col(f"`{n}`"), F.lit(filled[n])).alias(n) if n in filled
                        else F.col(f"`{n}`") for n in ordered])


def synthesize(es: EntitySet, target: str, max_depth: int = 2,
               numeric_prims: Sequence[str] = NUMERIC_PRIMITIVES,
               cat_prims: Sequence[str] = CATEGORICAL_PRIMITIVES) -> DataFrame:
    """Feature table with one row per row of ``target``.

    A row without a parent (or with a null key) has NULL in the parent's
    features; parent keys must be unique."""

    def build(name: str, depth: int, path: tuple[str, ...]) -> DataFrame:
        ent = es.entities[name]
        out = ent.df
        if depth <= 0:
            return out
        path = (*path, name)
        for rel in es.children(name):
            if rel.child in path:
                continue
            child = build(rel.child, depth - 1, path)
            if depth - 1 >= 1 and es.children(rel.child):
                # a derived feature table read by the main aggregate and by
                # the categorical side plans: materialise it once (reliable
                # checkpoint) instead of re-aggregating its children per reader
                from ..session import shared_dir
                shared_dir(child.sparkSession)
                child = child.checkpoint(eager=True)
            skip = {es.entities[rel.child].key, rel.child_key} | es.foreign_keys(rel.child)
            skip.discard(None)
            agg = _aggregate_child(child, rel.child, rel.child_key, skip, numeric_prims, cat_prims)
            out = out.join(agg, out[rel.parent_key] == agg["__fk"], "left").drop("__fk")
        for rel in es.parents(name):
            if rel.parent in path:
                continue
            above = build(rel.parent, depth - 1, path)
            hidden = {es.entities[rel.parent].key, rel.parent_key} | es.foreign_keys(rel.parent)
            direct = above.select(F.col(f"`{rel.parent_key}`").alias("__pk"), *[F.col(f"`{c}`").alias(f"{rel.parent}.{c}")
                                                                               for c in above.columns if c not in hidden])
            out = out.join(direct, out[f"`{rel.child_key}`"] == direct["__pk"], "left").drop("__pk")
        return out

    result = build(target, max_depth, ())
    # decimal sums/min/max come out as double at the end
    return result.select(*[F.col(f"`{f.name}`").cast("double").alias(f.name)
                           if isinstance(f.dataType, DecimalType) else F.col(f"`{f.name}`")
                           for f in result.schema.fields])
