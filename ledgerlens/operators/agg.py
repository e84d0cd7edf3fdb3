"""Group-by aggregation built from declarative specs.

A spec is an ordered list of ``(column, [func, ...])``; each pair becomes one
aliased aggregate named ``PREFIX + column + '_' + FUNC.upper()``.  Everything
for one table and one key is computed in a single ``groupBy().agg()`` — one
shuffle, with map-side partial aggregation, so a hot key costs one partial
row per partition rather than a skewed task.

NULL rules (pandas semantics): every function skips missing values; ``sum``
of a group with no value is 0; ``size`` counts rows.  A subset aggregate
(``cond``) over a group with no subset row is NULL, as after the left join
of a filtered aggregate.

Decimal inputs give exact, order-independent sums: ``mean`` is then
``double(sum) / count``, identical whatever the partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from typing import Union

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, BinaryType, DecimalType, DoubleType, FloatType


Spec = Union[Sequence[tuple[str, Sequence[str]]], Mapping[str, Sequence[str]]]

SUPPORTED = ("min", "max", "mean", "sum", "var", "std", "median", "size", "count",
             "nunique", "mode", "first_quartile", "third_quartile")
MASK_BITS = 63     # levels of a column whose distinct values are kept as a mask


def spec_items(spec: Spec) -> list[tuple[str, list[str]]]:
    items = spec.items() if isinstance(spec, Mapping) else spec
    return [(c, list(fs)) for c, fs in items]


def spec_for(columns: Iterable[str], funcs: Sequence[str]) -> list[tuple[str, list[str]]]:
    """Same function list for every column (the ``agg(['max', 'mean'])`` form)."""
    return [(c, list(funcs)) for c in columns]


def merge_specs(*specs: Spec) -> list[tuple[str, list[str]]]:
    """Merge like a Python dict update: a repeated column keeps the last list."""
    merged: dict[str, list[str]] = {}
    for s in specs:
        for c, fs in spec_items(s):
            merged[c] = list(fs)
    return list(merged.items())


FAST_PRECISION = 12
SCALE_KEY = "unscaled_scale"  # column metadata: value = long * 10**-scale


def fast_decimal_scale(dt) -> int | None:
    """Scale of a decimal whose integer units leave a long a million-fold room
    for sums (the exact fast path), else None (Spark's wide-decimal path)."""
    if isinstance(dt, DecimalType) and dt.precision <= FAST_PRECISION and dt.scale <= 6:
        return dt.scale
    return None


def unscaled(x: Column, scale: int) -> Column:
    """Exact integer units of a long-sized decimal (e.g. cents): Spark sums
    longs far faster than the 28-digit decimals of a decimal ``sum``."""
    return (x * F.lit(10 ** scale)).cast("long")  # decimal arithmetic throughout


def _from_units(total: Column, scale: int) -> Column:
    return total.cast("double") / F.lit(float(10 ** scale))


def agg_column(func: str, x: Column, *, decimal: bool = False, exact: bool = True,
               accuracy: int = 10000, scale: int | None = None, keep_units: bool = False) -> Column:
    """One aggregate over an (already conditioned) input column.

    ``scale`` selects the exact fast path for long-sized decimals: sums run
    over integer units and are converted once; ``keep_units`` returns the
    unit sum itself (tagged in the column metadata) for a second level."""
    if scale is not None and func in ("sum", "mean"):
        units = F.sum(unscaled(x, scale))
        if func == "mean":
            return F.try_divide(_from_units(units, scale), F.count(x).cast("double"))
        if keep_units:
            return F.coalesce(units, F.lit(0).cast("long"))
        return F.coalesce(_from_units(units, scale), F.lit(0.0))
    if func == "min":
        return F.min(x)
    if func == "max":
        return F.max(x)
    if func == "mean":
        if decimal:
            return F.try_divide(F.sum(x).cast("double"), F.count(x).cast("double"))
        return F.avg(x.cast("double"))
    if func == "sum":
        s = F.sum(x)
        if decimal:
            return F.coalesce(s, F.lit(0))
        return F.coalesce(s.cast("double"), F.lit(0.0))
    if func == "var":
        return F.var_samp(x.cast("double"))
    if func == "std":
        return F.stddev_samp(x.cast("double"))
    if func in ("median", "first_quartile", "third_quartile"):
        p = {"median": 0.5, "first_quartile": 0.25, "third_quartile": 0.75}[func]
        if exact:  # single-buffer form, only for callers that bound the group
            return F.percentile(x.cast("double"), F.lit(p))
        return F.percentile_approx(x.cast("double"), F.lit(p), F.lit(accuracy)).cast("double")
    if func == "count":
        return F.count(x)
    if func == "nunique":
        return F.countDistinct(x) if exact else F.approx_count_distinct(x)
    if func == "mode":  # single-buffer form, only for callers that bound the group
        return F.mode(x, deterministic=True)
    raise ValueError(f"unsupported aggregate {func!r}")


def agg_exprs(spec: Spec, prefix: str = "", cond: Column | None = None, *,
              df: DataFrame | None = None, exact: bool = True, keep_decimal: bool = False,
              name: Callable[[str, str, str], str] | None = None) -> list[Column]:
    """Aliased aggregate expressions for one spec, optionally over a subset.

    Decimal results (sum/min/max/median of a decimal column) are returned as
    double unless ``keep_decimal`` (used between the levels of a two-level
    aggregate so that weighted sums stay exact)."""
    name = name or (lambda p, c, f: f"{p}{c}_{f.upper()}")
    out = []
    present = F.count_if(cond) if cond is not None else None
    fields = {f.name: f.dataType for f in df.schema.fields} if df is not None else {}
    decimals = {n for n, t in fields.items() if isinstance(t, DecimalType)}  # one schema resolution
    scales = {n: fast_decimal_scale(t) for n, t in fields.items()}
    for c, funcs in spec_items(spec):
        base = F.col(c)
        x = F.when(cond, base) if cond is not None else base
        for f in funcs:
            if f == "size":
                e = present if cond is not None else F.count(F.lit(1))
            elif f == "mode" or (exact and f in QUANTILES):
                raise ValueError(f"{f!r} is holistic: use agg_by/conditional_agg, which compute it "
                                 "without gathering a group in one task")
            else:
                dec = c in decimals
                sc = scales.get(c)
                e = agg_column(f, x, decimal=dec, exact=exact, scale=sc,
                               keep_units=keep_decimal and f == "sum")
                if dec and f in ("sum", "min", "max") and not keep_decimal:
                    e = e.cast("double")
            if cond is not None:
                e = F.when(present > 0, e)
            if keep_decimal and f == "sum" and scales.get(c) is not None:
                out.append(e.alias(name(prefix, c, f), metadata={SCALE_KEY: scales[c]}))
            else:
                out.append(e.alias(name(prefix, c, f)))
    return out


QUANTILES = {"median": 0.5, "first_quartile": 0.25, "third_quartile": 0.75}


def agg_by(df: DataFrame, keys: str | Sequence[str], spec: Spec, prefix: str = "",
           exact: bool = True, extra: Sequence[Column] = (), keep_decimal: bool = False) -> DataFrame:
    """One ``groupBy`` for the algebraic functions.  Exact quantiles and the
    mode are holistic (they need every value of a group), so they come from
    distributed side plans — value counts per (key, value) and prefix sums —
    joined back on the key; no group is ever gathered in one task."""
    from .rank import distributed_mode, exact_quantiles
    keys = [keys] if isinstance(keys, str) else list(keys)
    items = spec_items(spec)
    names = [f"{prefix}{c}_{f.upper()}" for c, fs in items for f in fs]
    holistic = {"mode"} | (set(QUANTILES) if exact else set())
    simple = [(c, [f for f in fs if f not in holistic]) for c, fs in items]
    simple = [(c, fs) for c, fs in simple if fs]
    exprs = [*agg_exprs(simple, prefix, df=df, exact=exact, keep_decimal=keep_decimal), *extra]
    out = df.groupBy(*keys).agg(*(exprs or [F.count(F.lit(1)).alias("__rows")]))
    wanted = [(c, f) for c, fs in items for f in fs if f in QUANTILES and exact]
    if wanted:
        # every exact quantile of the spec in one pass, pivoted back per key
        from .rank import multi_quantiles
        probs = sorted({QUANTILES[f] for _, f in wanted})
        cols = list(dict.fromkeys(c for c, _ in wanted))
        q = multi_quantiles(df, cols, probs, keys).drop("n_distinct", "n")
        back = q.groupBy(*keys).agg(*[
            F.max(F.when(F.col("column_name") == c, F.col(f"q{probs.index(QUANTILES[f])}")))
            .alias(f"{prefix}{c}_{f.upper()}") for c, f in wanted])
        out = out.join(back, keys, "left")
    for c, fs in items:
        if "mode" in fs:
            out = out.join(distributed_mode(df, keys, c, f"{prefix}{c}_MODE"), keys, "left")
    extra_names = [c for c in out.columns if c not in keys and c not in names and c != "__rows"]
    return out.select(*keys, *[F.col(f"`{n}`") for n in names], *extra_names)


def agg_all_columns(df: DataFrame, keys: str | Sequence[str], funcs: Sequence[str],
                    prefix: str = "", exclude: Sequence[str] = ()) -> DataFrame:
    """The same function list over every non-key column."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    cols = [c for c in df.columns if c not in keys and c not in exclude]
    return agg_by(df, keys, spec_for(cols, funcs), prefix)


def conditional_agg(df: DataFrame, keys: str | Sequence[str], spec: Spec, prefix: str,
                    subsets: Mapping[str, Column], subset_spec: Spec | None = None,
                    exact: bool = True) -> DataFrame:
    """All-rows aggregate plus the same (or ``subset_spec``) aggregate per
    subset, in one pass: replaces filter + aggregate + left join per subset."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    holistic = {"mode"} | (set(QUANTILES) if exact else set())

    def split(sp):
        items = spec_items(sp)
        simple = [(c, [f for f in fs if f not in holistic]) for c, fs in items]
        hol = [(c, [f for f in fs if f in holistic]) for c, fs in items]
        return [(c, fs) for c, fs in simple if fs], [(c, fs) for c, fs in hol if fs]

    names = []
    parts = [(prefix, None, spec)] + [(p, c, subset_spec if subset_spec is not None else spec)
                                      for p, c in subsets.items()]
    exprs, side, quantile_requests = [], [], []
    for p, cond, sp in parts:
        names += [f"{p}{c}_{f.upper()}" for c, fs in spec_items(sp) for f in fs]
        simple, hol = split(sp)
        exprs += agg_exprs(simple, p, cond, df=df, exact=exact)
        for c, fs in hol:
            quantile_requests += [(p, cond, c, f) for f in fs if f in QUANTILES]
            if "mode" in fs:  # (key, value) counts of the (sub)set + min_by
                from .rank import distributed_mode
                src = df if cond is None else df.where(cond)
                side.append(distributed_mode(src, keys, c, f"{p}{c}_MODE"))
    out = df.groupBy(*keys).agg(*exprs)
    if quantile_requests:
        side.append(_subset_quantiles(df, keys, quantile_requests))
    for t in side:
        out = out.join(t, keys, "left")
    return out.select(*keys, *[F.col(f"`{n}`") for n in names]) if side else out


def _subset_quantiles(df: DataFrame, keys: list[str], requests) -> DataFrame:
    """Every exact quantile of every (subset, column) in one distributed
    pass: rows are unpivoted to (key, subset, column, value) — a row lands
    in each subset whose condition it meets — and (subset, column) joins the
    group of the prefix-sum positioning."""
    from .rank import exact_quantiles
    probs = sorted({QUANTILES[f] for *_, f in requests})
    pairs = list(dict.fromkeys((p, c) for p, _, c, _ in requests))
    conds = {p: cond for p, cond, _, _ in requests}
    items = []
    for p, c in pairs:
        v = F.col(f"`{c}`").cast("double")
        if conds[p] is not None:
            v = F.when(conds[p], v)
        items.append(F.struct(F.lit(p).alias("__subset"), F.lit(c).alias("column_name"), v.alias("__x")))
    long = df.select(*keys, F.explode(F.array(*items)).alias("__s")) \
        .select(*keys, "__s.__subset", "__s.column_name", "__s.__x")
    q = exact_quantiles(long, "__x", probs, [*keys, "__subset", "column_name"])
    return q.groupBy(*keys).agg(*[
        F.max(F.when((F.col("__subset") == p) & (F.col("column_name") == c), F.col(f"q{probs.index(QUANTILES[f])}")))
        .alias(f"{p}{c}_{f.upper()}") for p, _, c, f in requests])


def _second_level_value(v: Column, field):
    """A level-1 value as it enters level 2 (integer units where it has them),
    and the way back to a double."""
    sc = (field.metadata or {}).get(SCALE_KEY)
    if sc is None and isinstance(field.dataType, DecimalType):
        sc = fast_decimal_scale(field.dataType)
        if sc is not None:
            v = unscaled(v, sc)
    elif sc is None:
        v = v.cast("double")

    def back(t: Column) -> Column:
        return _from_units(t, sc) if sc is not None else t.cast("double")
    return v, back


def _weighted(func: str, v: Column, n: Column, back) -> Column:
    """Level-2 aggregate of ``v`` where every mid row stands for ``n`` detail rows."""
    if func == "mean":
        return F.try_divide(back(F.sum(v * n)), F.sum(F.when(v.isNotNull(), n)).cast("double"))
    if func == "max":
        return back(F.max(v))
    if func == "min":
        return back(F.min(v))
    if func == "sum":
        return F.coalesce(back(F.sum(v * n)), F.lit(0.0))
    raise ValueError(f"weighted second level supports mean/max/min/sum, not {func}")


def two_level_weighted_agg(df: DataFrame, root_key: str, mid_key: str, spec: Spec,
                           funcs2: Sequence[str], prefix: str,
                           count_name: str | None = None, exact: bool = True,
                           drop: Sequence[str] = (), mid_parent: DataFrame | None = None) -> DataFrame:
    """Aggregate detail rows per mid key, then per root with every mid
    weighted by its number of detail rows.

    This equals merging the mid-level aggregate back onto every detail row
    and aggregating that per root, without materialising the fan-out:
    mean = sum(n*v)/sum(n over non-null v); max/min ignore the weight;
    sum = sum(n*v); size = sum(n).

    When the detail rows do not carry the root key, ``mid_parent`` (a
    ``(mid_key, root_key)`` table) is joined *after* the first level, so the
    join sees one partially aggregated row per mid key instead of every
    detail row."""
    if mid_parent is None:
        lvl1 = agg_by(df, [mid_key, root_key], spec, prefix, exact=exact,
                      extra=[F.count(F.lit(1)).alias("__n")], keep_decimal=True)
    else:
        lvl1 = agg_by(df, [mid_key], spec, prefix, exact=exact,
                      extra=[F.count(F.lit(1)).alias("__n")], keep_decimal=True)
        lvl1 = lvl1.join(mid_parent.select(mid_key, root_key), mid_key)
    fields = {f.name: f for f in lvl1.schema.fields}  # resolved once
    feats = [c for c in fields if c not in (mid_key, root_key, "__n") and c not in drop]
    n = F.col("__n")
    exprs = []
    for c in feats:
        v, back = _second_level_value(F.col(f"`{c}`"), fields[c])
        exprs += [_weighted(f, v, n, back).alias(f"{prefix}{c}_{f.upper()}") for f in funcs2]
    if count_name:
        exprs.append(F.sum(n).alias(count_name))
    return lvl1.groupBy(root_key).agg(*exprs)


def two_level_agg(child: DataFrame, grandchild: DataFrame, child_key: str, root_key: str,
                  spec1: Spec, spec2_of: Callable[[list[str]], Spec], prefix1: str = "",
                  prefix2: str = "", child_cols: Sequence[str] = (),
                  exact: bool = True) -> DataFrame:
    """grandchild -> per child key -> left join onto child -> per root key.

    ``spec2_of`` receives the level-1 feature names and returns the level-2
    spec (so level-1 outputs and plain child columns can both be used)."""
    lvl1 = agg_by(grandchild, child_key, spec1, prefix1, exact=exact)
    joined = child.select(child_key, root_key, *child_cols).join(lvl1, child_key, "left")
    lvl1_feats = [c for c in lvl1.columns if c != child_key]
    return agg_by(joined, root_key, spec2_of(lvl1_feats), prefix2, exact=exact)


def agg_through_parent(df: DataFrame, mid_key: str, parent: DataFrame, root_key: str,
                       aggs: Mapping[str, tuple]) -> DataFrame:
    """Per-root aggregates of detail rows that carry only a mid-level key
    (e.g. loan lines -> applicant): algebraic partial aggregates per mid key
    first, then the ``(mid_key, root_key)`` parent join on those few rows,
    then the combine — the detail rows are never joined or shuffled whole.

    ``aggs``: name -> (func, expr[, expr2]) with func in sum | count | min |
    max | mean | ratio (``sum(expr) / sum(expr2)``)."""
    partial = []
    for name, (func, *es) in aggs.items():
        e = es[0]
        if func in ("sum", "mean"):
            partial.append(F.sum(e.cast("double")).alias(f"{name}__s"))
        if func in ("count", "mean"):
            partial.append(F.count(e).alias(f"{name}__c"))
        if func in ("min", "max"):
            partial.append((F.min(e) if func == "min" else F.max(e)).alias(f"{name}__m"))
        if func == "ratio":
            partial += [F.sum(e.cast("double")).alias(f"{name}__s"), F.sum(es[1].cast("double")).alias(f"{name}__d")]
    lvl1 = df.groupBy(mid_key).agg(*partial).join(parent.select(mid_key, root_key), mid_key)
    final = []
    for name, (func, *_) in aggs.items():
        s, c = F.sum(f"`{name}__s`"), F.sum(f"`{name}__c`")
        if func == "sum":
            final.append(F.coalesce(s, F.lit(0.0)).alias(name))
        elif func == "count":
            final.append(c.alias(name))
        elif func == "mean":
            final.append(F.try_divide(s, c.cast("double")).alias(name))
        elif func == "min":
            final.append(F.min(f"`{name}__m`").alias(name))
        elif func == "max":
            final.append(F.max(f"`{name}__m`").alias(name))
        elif func == "ratio":
            final.append(F.try_divide(s, F.sum(f"`{name}__d`")).alias(name))
        else:
            raise ValueError(func)
    return lvl1.groupBy(root_key).agg(*final)


DECOMPOSABLE = {"min", "max", "sum", "mean", "count", "size", "var", "std"}


class MidPass:
    """Several feature blocks over the same detail rows in one pass: algebraic
    partial aggregates per mid key (one shuffle of the detail table), joined
    to the ``(mid_key, root_key, ...)`` parent and combined per root.

    ``direct`` blocks equal an aggregate over the detail rows, ``weighted``
    blocks equal a mid-level aggregate merged back onto every detail row (see
    ``two_level_weighted_agg``), and parent columns can be aggregated beside
    them, each parent row counting once."""

    def __init__(self, df: DataFrame, mid_key: str, wide: bool = False):
        """``wide``: the states of all blocks together are wider than the rows they come from.  Then
        no state is shuffled: ``df`` comes partitioned by the mid key, and one row per mid key goes
        to its root, where it is reduced as it streams by."""
        self.df, self.mid_key, self.wide = df, mid_key, wide
        self.types = {f.name: f.dataType for f in df.schema.fields}
        self.partial: list[Column] = [F.count(F.lit(1)).alias("__rows")]
        self.final: list[tuple[str, Column]] = []
        self.means: list[Column] = []
        self.names: list[str] = []
        self.states: dict[str, int] = {}            # column -> number of its partial states
        self.centred: set[str] = set()              # columns with squares about the mean
        self.sets: list[tuple[str, str]] = []      # (column, output) whose distinct values go through the parent
        self._i = 0

    def direct(self, spec: Spec, prefix: str = "") -> MidPass:
        items = spec_items(spec)
        bad = {f for _, fs in items for f in fs} - DECOMPOSABLE
        if bad:
            raise ValueError(f"not decomposable through the parent: {sorted(bad)}")
        for c, fs in items:
            x, sc = F.col(f"`{c}`"), fast_decimal_scale(self.types[c])
            d = x.cast("double")
            i = self.states.get(c)
            if i is None:                           # blocks over the same column share its states
                i, self._i = self._i, self._i + 1
                self.states[c] = i
                self.partial += [F.count(x).alias(f"__n{i}"),
                                 F.sum(unscaled(x, sc) if sc is not None else d).alias(f"__s{i}"),
                                 F.min(x).alias(f"__lo{i}"), F.max(x).alias(f"__hi{i}")]
            n = F.sum(f"__n{i}").cast("double")
            total = F.sum(f"__s{i}")
            total = _from_units(total, sc) if sc is not None else total.cast("double")
            if {"var", "std"} & set(fs) and c not in self.centred:
                self.centred.add(c)
                # squares are taken about the mean at both levels: within each
                # mid key here, between mid keys about the root's mean later
                self.partial += [F.avg(d).alias(f"__mu{i}"), (F.var_pop(d) * F.count(x)).alias(f"__m2{i}")]
                self.means.append(F.try_divide(total, n).alias(f"__mean{i}"))
            for f in fs:
                if f == "sum":
                    e = F.coalesce(total, F.lit(0.0))
                elif f == "mean":
                    e = F.try_divide(total, n)
                elif f in ("min", "max"):
                    e = F.min(f"__lo{i}") if f == "min" else F.max(f"__hi{i}")
                    if isinstance(self.types[c], DecimalType):
                        e = e.cast("double")
                elif f == "count":
                    e = F.sum(f"__n{i}")
                elif f == "size":
                    e = F.sum("__rows")
                else:
                    gap = F.col(f"__mu{i}") - F.col(f"__mean{i}")
                    m2 = F.sum(F.col(f"__m2{i}") + F.col(f"__n{i}") * gap * gap)
                    var = F.when(n > 1, m2 / (n - 1))
                    e = var if f == "var" else F.sqrt(var)
                self.final.append((f"{prefix}{c}_{f.upper()}", e))
        return self

    def weighted(self, spec: Spec, funcs2: Sequence[str], prefix: str, count_name: str | None = None) -> MidPass:
        first = agg_exprs(spec, prefix, df=self.df, keep_decimal=True)
        self.partial += first
        schema = self.df.groupBy(self.mid_key).agg(*first).schema.fields
        for field in schema[1:]:
            v = F.col(f"`{field.name}`")
            v, back = _second_level_value(v, field)
            for f in funcs2:
                self.final.append((f"{prefix}{field.name}_{f.upper()}", _weighted(f, v, F.col("__rows"), back)))
        if count_name:
            self.final.append((count_name, F.sum("__rows")))
        return self

    def distinct(self, columns: Sequence[str], prefix: str = "",
                 levels: Mapping[str, Sequence] | None = None) -> MidPass:
        """Distinct non-null values of each column per root (``{prefix}{c}_NUNIQUE``).

        A column with ``levels`` (its at most 63 possible values; another one raises) has a
        64-bit mask as its state, joined by OR at both levels inside the same pass.  The others
        move as (mid key, column, value) rows without repeats, then as (root, column, value)
        rows without repeats, so that neither a hot root nor a hot value is one task's work."""
        for c in columns:
            name, known = f"{prefix}{c}_NUNIQUE", (levels or {}).get(c)
            if known is None:
                if not isinstance(self.types[c], AtomicType):
                    raise ValueError(f"distinct values of {c}: {self.types[c].simpleString()}")
                self.sets.append((c, name))
                continue
            if len(known) > MASK_BITS:
                raise ValueError(f"more than {MASK_BITS} levels of {c}")
            i, self._i = self._i, self._i + 1
            x = F.col(f"`{c}`")
            bit = F.array_position(F.array(*[F.lit(v).cast(self.types[c]) for v in known]), x) - 1
            bit = F.when(bit >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))).when(
                x.isNotNull(), F.raise_error(F.concat(F.lit(f"no level of {c}: "), x.cast("string"))).cast("long"))
            self.partial.append(F.bit_or(bit).alias(f"__mask{i}"))
            self.final.append((name, F.coalesce(F.bit_count(F.bit_or(f"__mask{i}")), F.lit(0)).cast("long")))
        return self

    def _distinct_per_root(self, parent: DataFrame, root_key: str) -> DataFrame:
        """``__root`` and one count for each of ``sets``."""
        def text(c: str) -> Column:
            x = F.col(f"`{c}`")
            if isinstance(self.types[c], (DoubleType, FloatType)):
                return (x + F.lit(0.0).cast(self.types[c])).cast("string")       # -0.0 is 0.0
            return F.hex(x) if isinstance(self.types[c], BinaryType) else x.cast("string")

        entries = F.array_compact(F.array(*[F.when(F.col(f"`{c}`").isNotNull(), F.struct(F.lit(i).alias("i"), text(c).alias("v")))
                                            for i, (c, _) in enumerate(self.sets)]))
        per_mid = self.df.select(self.mid_key, F.explode(entries).alias("__e")).select(
            self.mid_key, F.col("__e.i").alias("__i"), F.col("__e.v").alias("__v")).distinct()
        owner = parent.select(self.mid_key, F.col(root_key).alias("__root"))
        return (per_mid.join(owner, self.mid_key).select("__root", "__i", "__v").distinct()
                .groupBy("__root").agg(*[F.count_if(F.col("__i") == i).alias(f"__set{i}") for i in range(len(self.sets))]))

    def per_mid(self) -> DataFrame:
        """One row per mid key with every block's partial aggregates."""
        # like states side by side (the counts of all columns, say): equal neighbours compress to nothing
        return self.df.groupBy(self.mid_key).agg(*sorted(self.partial, key=str))

    def run(self, parent: DataFrame, root_key: str, extra: Sequence[Column] = (), how: str = "inner") -> DataFrame:
        """Per root: every block, then ``extra`` aggregates over parent rows.
        With ``how="left"`` parent rows without detail rows count for ``extra``
        and a root without any detail row has NULL in the blocks."""
        rows = parent.join(self.per_mid(), self.mid_key, how)
        if self.wide:
            rows = rows.repartition(root_key)
        if self.means:  # a second aggregate over the same few rows, with the root's means at hand
            rows = rows.join(rows.groupBy(root_key).agg(*self.means), root_key)
        some = F.sum("__rows").isNotNull()
        final = [(e if how == "inner" else F.when(some, e)).alias(n) for n, e in self.final]
        if not self.sets:
            return rows.groupBy(root_key).agg(*final, *extra)
        names = {f"__set{i}": n for i, (_, n) in enumerate(self.sets)}
        out = rows.groupBy(root_key).agg(*final, *extra, some.alias("__some"))
        counts = self._distinct_per_root(parent, root_key)
        return out.join(counts, F.col(root_key).eqNullSafe(F.col("__root")), "left").select(
            *[c for c in out.columns if c != "__some"],
            *[F.when(F.col("__some"), F.coalesce(s, F.lit(0))).alias(n) for s, n in names.items()])


def agg_spec_through_parent(df: DataFrame, mid_key: str, parent: DataFrame, root_key: str,
                            spec: Spec, prefix: str = "") -> DataFrame:
    """``agg_by(detail ⋈ parent, root_key, spec)`` for algebraic specs,
    computed as partial aggregates per mid key joined to the parent: count,
    sum (exact integer units for long-sized decimals), centred squares and
    extremes per mid key, combined per root.  Distinct counts go through the
    parent by ``MidPass.distinct``; median and mode need the detail rows: use
    ``agg_by`` after the join."""
    return MidPass(df, mid_key).direct(spec, prefix).run(parent.select(mid_key, root_key), root_key)
