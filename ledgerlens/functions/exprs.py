"""Scalar column expressions (ratios, clips, buckets, flags, maps, math).

Every function returns a ``Column`` built from built-in Spark functions, so
it stays inside whole-stage codegen.  NULL rules follow the pandas
behaviour the feature definitions were written against:

* division by zero (any sign) and 0/0 give NULL (``try_divide``);
* comparisons against a missing value give 0 when the flag is "hard"
  (``coalesce(cond, 0)``) and NULL when it is "soft" (plain cast);
* clamps of the ``x if x > 0 else 0`` form map a missing value to 0.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- ratios ---

def safe_ratio(a: ColumnOrName, b: ColumnOrName) -> Column:
    """a / b with every division by zero mapped to NULL."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def shifted_ratio(a: ColumnOrName, b: ColumnOrName) -> Column:
    """a / (1 + b)."""
    return safe_ratio(a, F.lit(1) + col(b))


def recency_scaled(x: ColumnOrName, days: ColumnOrName) -> Column:
    """x / sqrt(-days); defined only for strictly negative day offsets."""
    d = col(days)
    return F.when(d < 0, safe_ratio(x, F.sqrt(-d.cast("double"))))


def recency_weight(months: ColumnOrName, power: float = 0.5) -> Column:
    """(-1 / m) ** power, NULL for m >= 0 (the reference divides by zero)."""
    m = col(months).cast("double")
    w = F.try_divide(F.lit(-1.0), m)
    if power == 1:
        return F.when(m < 0, w)
    if power == 0.5:
        return F.when(m < 0, F.sqrt(w))
    return F.when(m < 0, F.pow(w, F.lit(power)))


# --------------------------------------------------------- clamps, clips ---

def clamp_zero(x: ColumnOrName) -> Column:
    """``x if x > 0 else 0``: negatives and missing values become 0."""
    c = col(x)
    return F.when(c > 0, c).otherwise(F.lit(0))


def clip(x: ColumnOrName, lo: float | None = None, hi: float | None = None,
         hi_inclusive: bool = True, lo_inclusive: bool = True) -> Column:
    """One- or two-sided clip; NULL stays NULL."""
    c = col(x)
    out = F.when(c.isNull(), F.lit(None))
    if hi is not None:
        out = out.when(c >= hi if hi_inclusive else c > hi, F.lit(hi))
    if lo is not None:
        out = out.when(c <= lo if lo_inclusive else c < lo, F.lit(lo))
    return out.otherwise(c)


def cap_else(x: ColumnOrName, keep_upto: float, cap_value: float) -> Column:
    """``x if x <= keep_upto else cap_value``; NULL kept."""
    c = col(x)
    return F.when(c.isNull(), F.lit(None)).when(c <= keep_upto, c).otherwise(F.lit(cap_value))


def fixed_width_bucket(x: ColumnOrName, start: float, width: float, k: int,
                       null_label: str | None = None) -> Column:
    """First ``i < k`` with ``x < start + width*i`` else ``k``, as a string.

    Edges are half-open ``[s+w(i-1), s+w*i)``.  ``null_label`` is what a
    missing value maps to (the income variant maps it to ``str(k)``)."""
    c = col(x).cast("double")
    idx = F.floor((c - F.lit(float(start))) / F.lit(float(width))) + F.lit(1)
    idx = F.when(c.isNotNull(), F.least(F.greatest(idx, F.lit(0)), F.lit(k)))  # least/greatest skip NULL
    label = idx.cast("bigint").cast("string")
    if null_label is None:
        return label
    return F.coalesce(label, F.lit(null_label))


def tri_bucket(x: ColumnOrName, t1: float, t2: float,
               labels: Sequence[Any] = ("0", "1", "2")) -> Column:
    """``labels[0] if x < t1 else labels[1] if x < t2 else labels[2]``, NULL kept."""
    c = col(x)
    return (F.when(c.isNull(), F.lit(None)).when(c < t1, F.lit(labels[0]))
            .when(c < t2, F.lit(labels[1])).otherwise(F.lit(labels[2])))


def open_interval_flag(x: ColumnOrName, lo: float, hi: float) -> Column:
    """1 if lo < x < hi else 0, NULL kept."""
    c = col(x)
    return F.when(c.isNull(), F.lit(None).cast("int")) \
        .when((c > lo) & (c < hi), F.lit(1)).otherwise(F.lit(0))


# ------------------------------------------------------------------ flags ---

_OPS = {
    ">": lambda c, t: c > t,
    ">=": lambda c, t: c >= t,
    "<": lambda c, t: c < t,
    "<=": lambda c, t: c <= t,
    "==": lambda c, t: c == t,
    "!=": lambda c, t: c != t,
}


def threshold_dummy(x: ColumnOrName, op: str, t: Any) -> Column:
    """1/0 by a comparison, NULL when x is NULL."""
    return _OPS[op](col(x), F.lit(t)).cast("int")


def hard_flag(cond: Column) -> Column:
    """1/0 flag where a missing comparison counts as false."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def equal_flag(a: ColumnOrName, b: ColumnOrName) -> Column:
    return hard_flag(col(a) == col(b))


def isin_flag(x: ColumnOrName, values: Iterable[Any]) -> Column:
    return hard_flag(col(x).isin(list(values)))


def any_flag(*cols: ColumnOrName) -> Column:
    """logical OR of numeric flags (non-zero = true), as int; NULL counts false."""
    return hard_flag(F.greatest(*[F.coalesce(col(c) != 0, F.lit(False)) for c in cols]))


def both_equal_flag(a: ColumnOrName, b: ColumnOrName, value: Any) -> Column:
    """1 if a == value and b == value else 0."""
    return hard_flag((col(a) == value) & (col(b) == value))


def diff_one_flag(a: ColumnOrName, b: ColumnOrName) -> Column:
    """1 if a - b == 1 and a != 1 else 0 (the 'one adult' rule)."""
    return hard_flag(((col(a) - col(b)) == 1) & (col(a) != 1))


def zero_flag(x: ColumnOrName) -> Column:
    """'0' for zero, '1' for any other value, NULL kept."""
    c = col(x)
    return F.when(c == 0, F.lit("0")).when(c.isNotNull(), F.lit("1"))


def binary_recode(x: ColumnOrName, value: Any) -> Column:
    """1 if x == value else 0, NULL kept."""
    c = col(x)
    return F.when(c.isNull(), F.lit(None).cast("int")).when(c == value, F.lit(1)).otherwise(F.lit(0))


def sentinel_to_null(x: ColumnOrName, sentinel: Any) -> Column:
    return F.nullif(col(x), F.lit(sentinel))


def sentinel_flag(x: ColumnOrName, sentinel: Any) -> Column:
    """1 if x == sentinel, 0 otherwise, NULL kept."""
    return (col(x) == F.lit(sentinel)).cast("int")


def outlier_to_null(x: ColumnOrName, above: float | None = None, below: float | None = None,
                    keep_strictly_below: float | None = None) -> Column:
    """Null out x > above, x < below; or keep only x < keep_strictly_below."""
    c = col(x)
    bad = F.lit(False)
    if above is not None:
        bad = bad | (c > above)
    if below is not None:
        bad = bad | (c < below)
    if keep_strictly_below is not None:
        bad = bad | ~(c < keep_strictly_below)
    return F.when(~F.coalesce(bad, F.lit(False)), c)


def infinite_to_null(x: ColumnOrName) -> Column:
    """±inf and NaN -> NULL."""
    c = col(x)
    return F.when(~(F.isnan(c) | (F.abs(c) == float("inf"))), c)


# ----------------------------------------------------------- dictionaries ---

def dict_map(x: ColumnOrName, mapping: Mapping[Any, Any], fallback: str = "null") -> Column:
    """Look up x in a literal dictionary.

    fallback: ``"null"`` (unmatched -> NULL), ``"identity"`` (unmatched ->
    x itself, the category-collapse form) or ``"error"`` (unmatched non-NULL
    raises, the strict form)."""
    c = col(x)
    if not mapping:
        looked = F.lit(None)
    else:
        kv = []
        for k, v in mapping.items():
            kv += [F.lit(k), F.lit(v)]
        looked = F.try_element_at(F.create_map(*kv), c)
    if fallback == "identity":
        return F.coalesce(looked, c)
    if fallback == "error":
        return F.when(c.isNull(), F.lit(None)).when(looked.isNull(), F.raise_error(
            F.concat(F.lit("unmapped value: "), c.cast("string")))).otherwise(looked)
    return looked


def collapse_categories(x: ColumnOrName, keep: Iterable[Any], other: str = "others") -> Column:
    """Map every category outside ``keep`` to ``other``; NULL kept."""
    c = col(x)
    return F.when(c.isNull() | c.isin(list(keep)), c).otherwise(F.lit(other))


# -------------------------------------------------------------------- math ---

def safe_ln(x: ColumnOrName) -> Column:
    c = col(x).cast("double")
    return F.when(c > 0, F.ln(c))


def safe_sqrt(x: ColumnOrName) -> Column:
    c = col(x).cast("double")
    return F.when(c >= 0, F.sqrt(c))


def square(x: ColumnOrName) -> Column:
    c = col(x).cast("double")
    return c * c


def pairwise_features(cols: Sequence[str], ratio: bool = True, product: bool = True,
                      sep_mul: str = "_mul_", sep_div: str = "_div_") -> list[Column]:
    """All ordered pairs (i != j): products and safe ratios, named by rule."""
    out = []
    for a in cols:
        for b in cols:
            if a == b:
                continue
            if product:
                out.append((col(a).cast("double") * col(b).cast("double")).alias(f"{a}{sep_mul}{b}"))
            if ratio:
                out.append(safe_ratio(a, b).alias(f"{a}{sep_div}{b}"))
    return out
