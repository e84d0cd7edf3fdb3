"""N-gram Jaccard join as a T-occurrence search (DivideSkip).

Two documents with sets a and b have Jaccard >= t iff they share at least
T = t / (1 + t) * (|a| + |b|) shingles, hence t |a| and t |b| at least.  The
inverted lists are divided into short and long ones: in one global order
(frequent shingles last) a document's first |a| - ceil(t |a|) + l shingles are
its short lists, and the first |a| - ceil(t |a|) + 1 of them its leads.  Partners
meet in a lead, so leads yield every candidate; they meet in l short lists, and
more precisely in T less the long lists of either one.  So the short lists of a
candidate pair are merged and the occurrences counted; the long lists are never
merged.  For pairs that pass, the smaller set is probed in the larger one by
binary search, and the probing stops once T can't be reached.

The order only decides the cost: shingles found in several documents of a
1/16 hash sample of all documents count as frequent.  Any order gives the same
links.

Scale: equal sets are one class from the start.  A shingle matters only if the
short lists of two classes or more have it, and a document only if enough of
its short lists matter; the others drop out before any set moves.  That is
decided exactly: the short lists are dealt out by the first bits of their
shingles, packed (16 bytes a shingle), and what two classes share comes back by
class, so the share of sets that move stays the same however large the input
is.  The shuffle files of a step go once its table is written.  No list
emits all its pairs: each list's members are compared with one centre (the
member with the least rare shingles) first, and afterwards only pairs from *different* components of the same list
are left, which are enumerated component against component under a condition
that nearly all unlinked pairs fail: parity sketches of two sets differ in no
more bits than the sets in shingles, so linked sets always pass it.  Pairs are
counted on their short lists before whole sets move.  Hot lists are met by
partial aggregation (batch by batch where short lists are dealt out) and by plain equi-joins that AQE can split.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._graph import components
from .registry import apart, arrow_map, map_batches, query, stored, swept, table

SHINGLE = 5
PERCENT = 80
LEAST = 20           # l: this part of a set (per cent, plus one) must meet in short lists
SAMPLE = 16          # one document in SAMPLE informs the order of the shingles
FREQUENT = 3         # ... in which a frequent shingle occurs this often
BITS = 26            # 8 MB bitmaps
GROUPS = 12          # short lists are dealt out by this many first bits of their shingles
PACKED = 1 << 18     # ... once a task has this many shingles, or at the end of a batch
SKETCH = 4           # parity sketch of a set: this many longs
_S = [f"s{i}" for i in range(SKETCH)]


def _sets(c: W.Chunk, size: int):
    """Sorted distinct shingles of each row of a chunk."""
    seq = c.sequences(size)
    whole = W.ranges(c.pre, c.first[:-1], c.first[1:], W.BASE_WORD)
    for i in range(len(c.offsets) - 1):
        a, b = c.first[i], c.first[i + 1]
        if a == b:
            yield seq[:0]
        elif b - a < size:
            yield whole[i:i + 1]
        else:
            yield np.unique(seq[a:b - size + 1])


def _key(s: np.ndarray) -> int:
    """64-bit fingerprint of a set; classes are told apart by it and the size."""
    with np.errstate(over="ignore"):
        return int(W.splitmix(np.array([W.splitmix(s).sum() + np.uint64(len(s))], dtype=W.U)).view(np.int64)[0])


def _sketch(s: np.ndarray) -> list[int]:
    """Parity of the set's shingles by bit.  Sketches of two sets differ in no more bits than the sets in shingles."""
    odd = np.bincount((s & W.U(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).tolist()


def _near(a: str, b: str, percent: int) -> str:
    """Condition that sets ``a`` and ``b`` (prefixes of n and sketch columns) may link: neither sizes nor sketches rule it out."""
    n = f"({a}n + {b}n)"
    bits = " + ".join(f"bit_count({a}{x} ^ {b}{x})" for x in _S)
    return (f"100 * least({a}n, {b}n) >= {percent} * greatest({a}n, {b}n) and "
            f"{bits} <= {n} - 2 * (({percent} * {n} + {99 + percent}) div {100 + percent})")


def _met(n, least: int = LEAST):
    """Short lists in which partners of sets of n shingles must meet."""
    return 1 + n * least // 100


def _size(n, percent: int, least: int = LEAST):
    """Number of short lists of a set of n shingles."""
    return min(n, n - -(-percent * n // 100) + _met(n, least))


def _short(s: np.ndarray, percent: int, frequent: np.ndarray) -> np.ndarray:
    """The short lists of a set: its first |s| - ceil(t |s|) + l shingles in the global order."""
    m = _size(len(s), percent)
    hot = W.in_bitmap(frequent, s)
    cool = s[~hot]
    return cool[:m] if len(cool) >= m else np.concatenate([cool, s[hot][:m - len(cool)]])


def _counts(lists: Iterable[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of some short lists and how many of the lists have each: a hot one is one row a batch."""
    return np.unique(np.concatenate([np.zeros(0, W.U), *lists]), return_counts=True)


def _binary(x: np.ndarray, at: np.ndarray) -> pa.Array:
    """The bytes of ``x`` as one binary value for each stretch from an index in ``at`` (ascending, from 0) to the next."""
    off = (np.append(at, len(x)) * x.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(x))])


def _unpacked(col: pa.ChunkedArray, kind) -> np.ndarray:
    """What ``_binary`` packed, in one array."""
    out = [np.zeros(0, kind)]
    for x in col.chunks:
        x = x.cast(pa.large_binary())
        off = np.frombuffer(x.buffers()[1], np.int64)[x.offset:x.offset + len(x) + 1]
        if off[-1] > off[0]:
            out.append(np.frombuffer(x.buffers()[2], np.uint8)[off[0]:off[-1]].view(kind))
    return np.concatenate(out)


_LEAD, _REST = W.U(1 << 64 - GROUPS), W.U((1 << 64 - GROUPS) - 1)


def _dealt(lists: list[tuple[int, np.ndarray, int]]) -> dict:
    """The short lists of some sets (key, shingles, how many of them lead), as a row for each group of shingles: the sets' keys,
    and words with the shingles' bits behind those of the group and the mark of a lead in front of them."""
    h = np.concatenate([p for _, p, _ in lists])
    k = np.repeat(np.array([key for key, _, _ in lists], np.int64), [len(p) for _, p, _ in lists])
    lead = np.concatenate([np.arange(len(p)) < leads for _, p, leads in lists])
    order = np.argsort(h)
    h, k, lead = h[order], k[order], lead[order]
    g = (h >> W.U(64 - GROUPS)).astype(np.int32)
    at = np.flatnonzero(np.diff(g, prepend=np.int32(-1)))
    return {"g": g[at], "w": _binary((h & _REST) | lead * _LEAD, at), "k": _binary(k, at)}


def _shared(t: pa.Table) -> pa.Table:
    """The rows ``k, h, lead`` of a group of shingles that are in the short lists of two classes or more, each once."""
    w, k = _unpacked(t.column("w"), W.U), _unpacked(t.column("k"), np.int64)
    some, c = _counts([w & _REST])
    some = np.append(some[c > 1], W.U(2**64 - 1))    # no word without its mark is that large
    at = np.searchsorted(some, w & _REST)
    hit = some[at] == w & _REST
    at, w, k = at[hit], w[hit], k[hit]
    order = np.lexsort((k, at))
    at, w, k = at[order], w[order], k[order]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (at[1:] != at[:-1]) | (k[1:] != k[:-1])
    at, w, k = at[fresh], w[fresh], k[fresh]
    two = (np.bincount(at, minlength=1) > 1)[at]
    w, k = w[two], k[two]
    h = (w & _REST) | W.U(t.column("g")[0].as_py()) << W.U(64 - GROUPS)
    return pa.table({"k": k, "h": W.as_long(h), "lead": w & _LEAD != 0})


def _common(p: np.ndarray, q: np.ndarray, need: int) -> bool:
    """Whether two sorted sets share ``need`` elements: the smaller is probed in the larger by binary search,
    and the search ends as soon as the answer is known."""
    if len(p) > len(q):
        p, q = q, p
    got, at = 0, 0
    while at < len(p) and got + len(p) - at >= need > got:
        part = p[at:at + 512]
        pos = np.searchsorted(q, part)
        pos[pos == len(q)] = len(q) - 1
        got += int((q[pos] == part).sum())
        at += 512
    return got >= need


def _pairs(need):
    """Batch function: the pairs whose two arrays share ``need(|a|, |b|)`` elements."""
    def run(b: pa.RecordBatch):
        a, b_, an, bn, x, y = (b.column(i) for i in range(6))
        off = [z.offsets.to_numpy(zero_copy_only=False) for z in (x, y)]
        val = [z.values.to_numpy(zero_copy_only=False) for z in (x, y)]
        an_, bn_ = an.to_pylist(), bn.to_pylist()
        keep = pa.array([_common(val[0][off[0][i]:off[0][i + 1]], val[1][off[1][i]:off[1][i + 1]], need(an_[i], bn_[i]))
                         for i in range(b.num_rows)])
        yield {"a": a.filter(keep), "b": b_.filter(keep), "an": an.filter(keep), "bn": bn.filter(keep)}
    return run


def classes(docs: DataFrame, percent: int, size: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows ``doc_id, n, k`` and classes ``k, size, component_id, winner`` (the class of the component's first row)."""
    with swept(docs.sparkSession):
        return _classes(docs, percent, size, id_col, text_col)


def _classes(docs: DataFrame, percent: int, size: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = src.select("text")

    def sets(b: pa.RecordBatch):
        ids = b.column(0)
        for c in W.chunks(b.column(1), fold=W.LOWER):
            n, key, some = [], [], []
            for s in _sets(c, size):
                n.append(len(s))
                key.append(_key(s) if len(s) else None)
                sampled = len(s) and (key[-1] & (SAMPLE - 1)) == 0
                some.append(W.as_long(s) if sampled else None)
            yield {"doc_id": ids.slice(c.rows.start, len(n)), "n": n, "k": key, "sample": some}

    members = stored(map_batches(src, sets, "doc_id long, n long, k long, sample array<long>"), "join-members")
    frequent = W.bitmap(members.where("sample is not null").dropDuplicates(["k"])
                        .select(F.explode("sample").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c"))
                        .where(F.col("c") >= FREQUENT), "h", BITS - 1)

    def distinct(b: pa.RecordBatch):
        """The sets of each chunk of a batch with their keys, equal ones once a batch."""
        seen = set()
        for c in W.chunks(b.column(0), fold=W.LOWER):
            sets = []
            for s in _sets(c, size):
                if len(s) and (key := _key(s)) not in seen:
                    seen.add(key)
                    sets.append((key, s))
            if sets:
                yield sets

    def short_lists(b: pa.RecordBatch):
        lists, held = [], 0
        for sets in distinct(b):
            for key, s in sets:
                lists.append((key, _short(s, percent, frequent), _size(len(s), percent, 0)))
                held += len(lists[-1][1])
            if held >= PACKED:
                yield _dealt(lists)
                lists, held = [], 0
        if lists:
            yield _dealt(lists)

    # shingles are nearly all different: a table of those of a task would hold as much as its rows, and save little
    lists = map_batches(texts, short_lists, "g int, w binary, k binary").groupBy("g").applyInArrow(_shared, "k long, h long, lead boolean")
    hits = stored(lists.repartition("k").groupBy("k").agg(
        F.sort_array(F.collect_list("h")).alias("hits"), F.collect_list(F.when(F.col("lead"), F.col("h"))).alias("leads"))
        .where("size(leads) > 0").withColumn("c", F.size("hits")), "join-hits")
    enough = f"c >= 1 + (({percent} * n + 99) div 100) * {LEAST} div 100"    # _met() of the fewest shingles that a partner shares
    passing = W.bitmap(hits.select("k", "c").join(members.select("k", "n"), "k").where(enough).select("k"), "k", BITS)

    def candidates(b: pa.RecordBatch):
        for sets in distinct(b):
            hit = W.in_bitmap(passing, np.array([key for key, _ in sets], np.int64))
            sets = [x for x, y in zip(sets, hit) if y]
            if sets:
                marks = [_sketch(s) for _, s in sets]
                yield {"k": [key for key, _ in sets], "n": [len(s) for _, s in sets],
                       "elements": [np.sort(W.as_long(s)) for _, s in sets],
                       "rare": [1000 * int((~W.in_bitmap(frequent, s)).sum()) // len(s) for _, s in sets]} | dict(zip(_S, map(list, zip(*marks))))

    found = stored(map_batches(texts, candidates, "k long, n long, elements array<long>, rare int, " + ", ".join(f"{x} long" for x in _S))
                   .dropDuplicates(["k"]).join(hits, "k").where(enough).drop("c"), "join-sets")
    posting = found.select("k", "n", "rare", *_S, F.explode("leads").alias("h"))
    # a list's centre has the least of its own: among near copies, the text they all come from
    centre = stored(posting.groupBy("h").agg(F.min(F.struct("rare", "k", "n", *_S)).alias("c"), F.min("k").alias("lo"), F.max("k").alias("hi"))
                    .where("lo < hi").select("h", "c.k", "c.n", *[f"c.{x}" for x in _S]), "join-centres")
    first = stored(posting.alias("a").join(centre.alias("b"), F.expr(f"a.h = b.h and a.k != b.k and {_near('a.', 'b.', percent)}"))
                   .selectExpr("a.k a", "b.k b", "a.n an", "b.n bn").distinct(), "join-pairs")
    comp = components(_linked(first, found, percent))

    # what is left: pairs of different components within one list; sizes and sketches are part of the join conditions,
    # so texts that share a frequent passage and little else are never put out as pairs
    owner = stored(posting.join(comp, posting["k"] == comp["node"], "left")
                   .select("h", "k", "n", *_S, F.coalesce("comp", "k").alias("comp")), "join-owners")
    parts = owner.groupBy("h", "comp").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), (F.count(F.lit(1)) == 1).alias("lone"),
                                           F.min(F.struct("k", "n", *_S)).alias("one")).select("h", "comp", "lo", "hi", "lone", "one.*")
    sides = (parts.alias("p").join(parts.alias("q"), F.expr(
        f"p.h = q.h and p.comp < q.comp and 100 * p.hi >= {percent} * q.lo and 100 * q.hi >= {percent} * p.lo "
        f"and (not p.lone or not q.lone or ({_near('p.', 'q.', percent)}))"))
             .selectExpr("p.h", "p.comp ca", "q.comp cb", "q.lone", "q.n", *[f"q.{x}" for x in _S]))
    pairs = (sides.alias("x").join(owner.alias("a"), F.expr(f"x.h = a.h and x.ca = a.comp and (not x.lone or ({_near('x.', 'a.', percent)}))"))
             .selectExpr("x.h", "cb", "a.k", "a.n", *[f"a.{x}" for x in _S]).alias("a")
             .join(owner.alias("b"), F.expr(f"a.h = b.h and a.cb = b.comp and {_near('a.', 'b.', percent)}"))
             .selectExpr("greatest(a.k, b.k) a", "least(a.k, b.k) b", "if(a.k > b.k, a.n, b.n) an", "if(a.k > b.k, b.n, a.n) bn")
             .groupBy("a", "b", "an", "bn").agg(F.count(F.lit(1)).alias("merged"))
             # partners meet in T leads less what either has behind its leads
             .where(f"merged >= ({percent} * (an + bn) + {99 + percent}) div {100 + percent} "
                    f"- greatest(({percent} * an + 99) div 100, ({percent} * bn + 99) div 100) + 1").drop("merged"))
    known = first.selectExpr("greatest(a, b) a", "least(a, b) b").distinct()
    second = stored(pairs.join(known, ["a", "b"], "left_anti"), "join-pairs")
    more = _linked(second, found, percent)
    # links between components; what a component holds already is one node
    of = comp.selectExpr("node", "comp")
    merged = (more.join(of.selectExpr("node u", "comp cu"), "u", "left").join(of.selectExpr("node v", "comp cv"), "v", "left")
              .selectExpr("coalesce(cu, u) u", "coalesce(cv, v) v"))
    joined = components(merged)
    comp = (comp.join(joined.selectExpr("node comp", "comp top"), "comp", "left").selectExpr("node", "coalesce(top, comp) comp")
            .unionAll(joined.selectExpr("node", "comp").join(comp.select("node"), "node", "left_anti")))

    sized = members.where("k is not null").groupBy("k").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k")).alias("lo"), F.count(F.lit(1)).alias("size"))
    placed = sized.join(comp, F.col("k") == F.col("node"), "left").select("k", "lo", "size", F.coalesce("comp", "k").alias("comp"))
    named = stored(placed.join(placed.groupBy("comp").agg(F.min("lo").alias("w")), "comp")
                   .select("k", "size", F.col("w.doc_id").alias("component_id"), F.col("w.k").alias("winner")), "join-named")
    return members, named


def join(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, class_size``.

    Null, empty and blank texts have an empty set, link with nothing and keep
    their own id as component.  Rows with a null id are rows like others and
    stand behind every known id (component null only if all members are null).
    Other columns of ``docs`` are ignored; class_size counts rows with the same set.
    """
    members, named = classes(docs, percent, size, id_col, text_col)
    return (members.select("doc_id", "n", "k").join(named, "k", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
                    F.coalesce("size", F.lit(1).cast("long")).alias("class_size")))


def representatives(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns) without near duplicates: the first row of each component stays.

    Rows without words stay.  Texts are shuffled only for rows that aren't
    alone in their component (and the few that a bounded bitmap can't tell from
    them); the others are passed on where they are read.
    """
    members, named = classes(docs, percent, size, id_col, text_col)
    alone = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("k") == F.col("winner"))
    risky = stored(members.select("doc_id", "k").join(named, "k").where(~alone | (F.col("size") > 1))
                   .select("doc_id", "k", alone.alias("first")).distinct(), "join-risky")
    marks = W.bitmap(risky.select(F.xxhash64("doc_id").alias("h")), "h", BITS)
    names = docs.columns
    taken = set(names)
    key = next(x for x in ("k" + "_" * i for i in range(len(names) + 1)) if x not in taken)
    hashed = docs.select("*", F.xxhash64(F.col(id_col).cast("long")).alias(key))

    def passed(batches):
        for b in batches:
            hit = W.in_bitmap(marks, b.column(len(names)).to_numpy(zero_copy_only=False).astype(np.int64))
            yield pa.RecordBatch.from_arrays(b.columns[:-1], names=names).filter(pa.array(~hit))

    def held(batches):
        for b in batches:
            b = b.filter(pa.array(W.in_bitmap(marks, b.column(len(names)).to_numpy(zero_copy_only=False).astype(np.int64))))
            keys = [_key(s) if len(s) else None for c in W.chunks(b.column(names.index(text_col)), fold=W.LOWER)
                    for s in _sets(c, size)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(keys, pa.int64())], names=[*names, key])

    clear = arrow_map(hashed, passed, docs.schema)
    rest = arrow_map(hashed, held, hashed.schema).alias("d").join(
        risky.alias("r"), F.col(f"d.`{id_col}`").eqNullSafe(F.col("r.doc_id")) & (F.col(f"d.`{key}`") == F.col("r.k")), "left")
    whole = [F.col(f"d.`{n}`").alias(n) for n in names]
    unknown = rest.where("r.k is null").select(*whole)
    first = rest.where("r.first").select(F.struct(*whole).alias("row"), F.col("r.doc_id"), F.col("r.k")).dropDuplicates(["doc_id", "k"])
    return clear.unionAll(unknown).unionAll(first.select(*[F.col(f"row.`{n}`").alias(n) for n in names]))


def _linked(pairs: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Links among candidate pairs (a, b, an, bn): first the short lists of both are counted, then whole sets probed."""
    def whole(m, n):
        return -(-percent * (m + n) // (100 + percent))

    def short(m, n):
        return max(1, whole(m, n) - max(m - _size(m, percent), n - _size(n, percent)))

    near = stored(_meet(pairs, found, "hits", short), "join-near")
    return _meet(near, found, "elements", whole, bounded=True).selectExpr("a u", "b v")


def _meet(pairs: DataFrame, found: DataFrame, column: str, need, bounded: bool = False) -> DataFrame:
    """Pairs whose arrays share enough elements; with ``bounded`` a bitmap keeps arrays without a pair out of the shuffle."""
    some = found.select("k", F.col(column).alias("x"))
    sides = [some.selectExpr("k a", "x"), some.selectExpr("k b", "x y")]
    if bounded:
        used = W.bitmap(pairs.selectExpr("a k").unionAll(pairs.select("b")), "k", BITS - 3)

        def wanted(b: pa.RecordBatch):
            hit = W.in_bitmap(used, b.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            if hit.any():
                yield {"k": b.column(0).filter(pa.array(hit)), "x": b.column(1).filter(pa.array(hit))}

        some = map_batches(some, wanted, "k long, x array<long>")
        sides = [apart(some.selectExpr("k a", "x")), apart(some.selectExpr("k b", "x y"))]
    both = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "an", "bn", "x", "y")
    return map_batches(both, _pairs(need), "a long, b long, an long, bn long")


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(
  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
p AS (SELECT DISTINCT doc_id, md5_number(array_to_string(ws[i:i + 4], ' ')) AS h
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM p a JOIN p b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) m USING (doc_id)
"""


@query("op4_divideskip_jaccard_join", SQL)
def op4(spark, sf_dir):
    """Set size and component of every document under 5-word shingles with Jaccard 0.8."""
    return join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
