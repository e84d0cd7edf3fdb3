"""Phrase collocation mining over vertically partitioned suffix subtrees (ERA).

The suffixes of all pieces, cut after ``DEPTH`` words, form one tree per
language; a phrase's count is the total of the leaves below its node.  The
tree is never built as a whole.  Its suffixes are divided by prefix: a prefix
with more suffixes than a quarter of the memory budget is replaced by its
children (one more word), until every prefix fits; prefixes are then packed
into groups of at most the budget, and each group's subtrees are built on
their own by one task, which sorts the group's leaves and reads every node's
count from the totals of its leaves.  Nodes above a split prefix have leaves in
several groups; their partial totals are added afterwards.

Lossless pruning: a word that occurs fewer than ``least`` times in its language
ends a suffix, since no phrase with it can reach ``least`` (a bitmap of the
others, at most 32 MB; a collision costs work, never a result).

Exactness: hashes only prune and balance.  Leaves travel as blocks with the
words themselves (one block per unit of texts and group: a small word list and
indices into it, compressed), so every count is a count of equal strings.

Scale: what reaches the driver is the prefixes heavier than a quarter of the
budget and the loads of the slots that are packed, both in proportion to the
number of groups.  A hot word is split by its followers, equal leaves of a
batch are one leaf with a count, and a group holds at most about ``budget``
leaves whatever the input.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _words as W
from .registry import arrow_map, query, stored, table

DEPTH = 4                # words of the longest phrase
LEAST = 30               # occurrences of a candidate
SHARE = 80               # per cent of a phrase's occurrences that lie in one longer candidate: it goes
TOP = 2000               # phrases of each language in the report
BUDGET = 1 << 20         # suffixes of one group
UNIT = 4 << 20           # bytes of text that a task counts at a time
MOST_BITS = 28           # bitmap of words: 32 MB at most

BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?\n\x0b\x0c\r"]] = True
SPACE = BREAK.copy()
SPACE[[32, 9]] = True


@dataclass
class _Unit:
    langs: list[str]
    lang: np.ndarray      # language of each word
    key: np.ndarray       # 64-bit hash of language and word
    joined: np.ndarray    # the next word follows in the same piece
    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def words(self, at: np.ndarray) -> pa.Array:
        """The words at these places, as strings."""
        size = (self.end - self.start)[at]
        stop = np.cumsum(size)
        take = np.arange(stop[-1] if len(stop) else 0) - np.repeat(stop - size, size) + np.repeat(self.start[at], size)
        offsets = np.concatenate([[0], stop]).astype(np.int32)
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(self.raw[take]))


def _unit(batches: list[pa.RecordBatch]) -> _Unit:
    t = pa.Table.from_batches(batches).combine_chunks()
    lang = pc.fill_null(t.column(0), "und").combine_chunks().dictionary_encode()
    langs = lang.dictionary.to_pylist()
    code = lang.indices.to_numpy(zero_copy_only=False)
    mix = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs], dtype=W.U)
    parts, at = [], 0
    for text in t.column(1).chunks:
        for c in W.chunks(text, fold=W.LOWER, space=SPACE):
            piece = np.cumsum(BREAK[c.raw], dtype=np.int32)[c.start]
            joined = np.zeros(len(c.h), bool)
            joined[:-1] = (c.row[1:] == c.row[:-1]) & (piece[1:] == piece[:-1])
            of = code[c.rows.start + c.row]
            parts.append((of, W.splitmix(c.h ^ mix[of]), joined, c.raw, c.start + at, c.end + at))
            at += len(c.raw)
    cols = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, d) for d in (int, W.U, bool, np.uint8, int, int)]
    return _Unit(langs, *cols)


def _units(batches, size: int = UNIT):
    """Units of about ``size`` bytes of consecutive batches ``(lang, text)``."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.nbytes
        if n >= size:
            yield _unit(held)
            held, n = [], 0
    if held:
        yield _unit(held)


def _prefixes(u: _Unit, frequent: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Words of the truncated suffix from each place (0: a rare word), and the hashes of its first 1, 2, ... words."""
    ok = W.in_bitmap(frequent, u.key) if len(u.key) else np.zeros(0, bool)
    go = np.zeros(len(ok), bool)
    go[:-1] = u.joined[:-1] & ok[:-1] & ok[1:]
    length = ok.astype(np.int8)
    for _ in range(depth - 1):                       # one more word per step
        length[:-1] = np.where(go[:-1], np.minimum(length[1:] + 1, depth), ok[:-1])
    keys = [u.key]
    for d in range(1, depth):
        k = keys[-1].copy()
        with np.errstate(over="ignore"):
            k[:len(k) - d] = W.splitmix(k[:len(k) - d] * W.U(0x9E3779B97F4A7C15) + u.key[d:])
        keys.append(k)
    return length, keys


def _split(length: np.ndarray, keys: list[np.ndarray], heavy: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Words in the prefix that places each suffix, and that prefix's hash."""
    deep = np.ones(len(length), np.int8)
    out = keys[0].copy()
    for d, known in enumerate(heavy, start=1):       # prefixes of d words that are split
        more = (deep == d) & _among(keys[d - 1], known)
        deep[more] = d + 1
        longer = more & (length > d)
        out[longer] = keys[d][longer]
    return deep, out


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    at = np.searchsorted(known, x)
    at[at == len(known)] = 0
    return known[at] == x


def _slot(keys, slots: int):
    return (keys >> W.U(65 - slots.bit_length())).astype(np.int64)


_VOCAB = "lang string, word long, n long"
_BLOCK = "grp int, lang array<string>, deep array<int>, leaves array<int>, words int, size int, body binary"
_NODE = "lang string, phrase string, m int, f long, partial boolean"


def _blocks(u: _Unit, frequent, heavy, group_of, slots: int, depth: int):
    """Leaves of a unit by group, one row each: the runs of one language and prefix length, and their leaves."""
    length, keys = _prefixes(u, frequent, depth)
    at = np.flatnonzero(length)
    if not len(at):
        return None
    deep, prefix = _split(length[at], [k[at] for k in keys], heavy)
    words = u.words(at).dictionary_encode()
    ids = np.zeros(len(length) + depth, np.int32)
    ids[at] = words.indices.to_numpy(zero_copy_only=False) + 1
    cols = [np.where(length[at] > d, ids[at + d], 0) for d in range(depth)]
    kinds = len(u.langs) * (depth + 1)
    top = group_of[_slot(prefix, slots)].astype(np.int64) * kinds + u.lang[at] * (depth + 1) + deep
    order, first, n = _sorted(top, cols, np.ones(len(at), np.int64))
    order = order[first]
    top, leaf = top[order], np.stack([c[order] for c in cols])
    run = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]]))
    grp, kind = np.divmod(top[run], kinds)
    edge, size = [*run.tolist(), len(top)], np.diff(run, append=len(top))
    block = np.flatnonzero(np.concatenate([[True], grp[1:] != grp[:-1]])).tolist()
    rows = {k: [] for k in ("grp", "lang", "deep", "leaves", "words", "size", "body")}
    place = np.zeros(len(words.dictionary) + 1, np.int32)
    for i, j in zip(block, [*block[1:], len(run)]):
        part = leaf[:, edge[i]:edge[j]]
        seen = np.zeros(len(place), bool)
        seen[part] = True
        seen[0] = False                              # 0 ends a suffix in every block
        used = np.flatnonzero(seen)
        place[used] = np.arange(1, len(used) + 1)
        body = _packed(words.dictionary.take(pa.array(used - 1)), place[part], n[edge[i]:edge[j]])
        rows["grp"].append(int(grp[i]))
        rows["lang"].append([u.langs[x] for x in (kind[i:j] // (depth + 1)).tolist()])
        rows["deep"].append(kind[i:j] % (depth + 1))
        rows["leaves"].append(size[i:j])
        rows["words"].append(len(used))
        rows["size"].append(len(body))
        rows["body"].append(pa.compress(body, "zstd", asbytes=True))
    types = {"lang": pa.list_(pa.string()), "deep": pa.list_(pa.int32()), "leaves": pa.list_(pa.int32()), "body": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(v, types.get(k, pa.int32())) for k, v in rows.items()], names=list(rows))


def _packed(words: pa.Array, local: np.ndarray, n: np.ndarray) -> bytes:
    """A block: indices, counts, the words' sizes (all by byte planes, which compress better) and the words."""
    wide = np.uint16 if len(words) + 1 < 1 << 16 else np.uint32
    off, data = W.text_buffers(words)
    planes = [np.ascontiguousarray(x.reshape(-1).view(np.uint8).reshape(x.size, -1).T).tobytes()
              for x in (local.astype(wide), n.astype(np.uint32), np.diff(off).astype(np.uint32))]
    return b"".join([*planes, data[off[0]:off[-1]].tobytes()])


def _unpacked(body: bytes, leaves: int, words: int, depth: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    wide, raw, at = np.dtype(np.uint16 if words + 1 < 1 << 16 else np.uint32), np.frombuffer(body, np.uint8), 0
    cols = []
    for kind, size in ((wide, leaves * depth), (np.dtype(np.uint32), leaves), (np.dtype(np.uint32), words)):
        planes = raw[at:at + size * kind.itemsize].reshape(kind.itemsize, -1)
        cols.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += size * kind.itemsize
    offsets = np.concatenate([[0], np.cumsum(cols[2], dtype=np.int64)]).astype(np.int32)
    own = pa.StringArray.from_buffers(words, pa.py_buffer(offsets), pa.py_buffer(body).slice(at))
    return own, cols[0].reshape(depth, leaves), cols[1]


def _sorted(top: np.ndarray, cols: list[np.ndarray], n: np.ndarray):
    """Order of the leaves, the first of each run of equal leaves, and the runs' totals."""
    keys, room = [], 0
    for c in (top, *cols):                           # as many columns to a key as fit
        size = int(c.max(initial=0)) + 1
        if keys and room * size < 1 << 63:
            keys[-1] = keys[-1] * size + c
            room *= size
        else:
            keys.append(c.astype(np.int64))
            room = size
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    return order, first, np.add.reduceat(n[order], first)


def _subtrees(blocks: list[tuple], depth: int, least: int):
    """Nodes of one group's subtrees, from its sorted leaves."""
    names = sorted({x for lang, *_ in blocks for x in lang})
    code = {x: i for i, x in enumerate(names)}
    tops, owns, leaves, ns = [], [], [], []
    for lang, deep, size, kinds, raw, body in blocks:
        own, leaf, n = _unpacked(pa.decompress(body, raw, "zstd", asbytes=True), sum(size), kinds, depth)
        tops.append(np.repeat([code[x] * (depth + 1) + d for x, d in zip(lang, deep)], size).astype(np.int32))
        owns.append(own)
        leaves.append(leaf)
        ns.append(n)
    known = pa.chunked_array(owns).dictionary_encode()          # one dictionary for all blocks
    words = known.chunk(0).dictionary
    cols = [[] for _ in range(depth)]
    for own, leaf in zip(known.chunks, leaves):
        local = np.concatenate([[0], own.indices.to_numpy(zero_copy_only=False) + 1]).astype(np.int32)
        for d in range(depth):
            cols[d].append(local[leaf[d]])
    leaves = owns = None
    top, cols, n = np.concatenate(tops), [np.concatenate(c) for c in cols], np.concatenate(ns).astype(np.int64)
    tops, ns = [], []
    order, first, n = _sorted(top, cols, n)
    top, cols = top[order][first], [c[order][first] for c in cols]
    new = np.concatenate([[True], top[1:] != top[:-1]])
    for d in range(1, depth + 1):
        c = cols[d - 1]
        new[1:] |= c[1:] != c[:-1]
        node = np.flatnonzero(new)
        total = np.add.reduceat(n, node)
        partial = top[node] % (depth + 1) > d
        keep = (c[node] != 0) & (partial | (total >= least))
        node, total, partial = node[keep], total[keep], partial[keep]
        if len(node):
            parts = [words.take(pa.array(x[node] - 1)) for x in cols[:d]]
            phrase = pc.binary_join_element_wise(*parts, " ") if d > 1 else parts[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names).take(pa.array(top[node] // (depth + 1))), phrase, pa.array(np.full(len(node), d, np.int32)),
                 pa.array(total), pa.array(partial)], names=["lang", "phrase", "m", "f", "partial"])


def _counted(batches, schema, fn):
    """One batch ``schema`` of (language, hash, count) for each unit."""
    for u in _units(batches):
        key, lang = fn(u)
        k, at, n = np.unique(key, return_index=True, return_counts=True)
        if len(k):
            yield pa.RecordBatch.from_arrays([pa.array(u.langs).take(pa.array(lang[at])), pa.array(W.as_long(k)),
                                              pa.array(n.astype(np.int64))], names=schema)


def phrase_counts(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, budget: int = BUDGET,
                  lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, m, f`` of every phrase of 1 to ``depth`` words that occurs ``least`` times in its
    language, and ``lang, n`` with the number of all words of each language that has words.

    A null language is ``und``; null, empty and blank texts have no words.
    Repeated rows count each time; other columns of ``docs`` are ignored; an
    empty table gives two empty tables.  Texts are read whole, however long.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    names = ["lang", "word", "n"]
    vocab = stored(arrow_map(src, lambda it: _counted(it, names, lambda u: (u.key, u.lang)), _VOCAB)
                   .groupBy("lang", "word").agg(F.sum("n").alias("n")), "phrase-words")
    totals = vocab.groupBy("lang").agg(F.sum("n").alias("n"))
    often = vocab.where(F.col("n") >= least)
    kinds, load = often.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequent = W.bitmap(often.select("word"), "word", min(MOST_BITS, max(16, (8 * kinds).bit_length())))

    # vertical partitioning: prefixes too heavy for a group are replaced by their children
    budget = max(1, min(budget, -(-load // max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))))
    limit = max(least, budget // 4)
    slots = 1 << max(10, (16 * (load // budget + 1)).bit_length())
    loads = np.zeros(slots, np.int64)
    heavy: list[np.ndarray] = []
    level = often.select("word", "n")
    while True:
        big = np.array([r[0] for r in level.where(F.col("n") > limit).select("word").collect()], np.int64).view(W.U)
        slot = F.shiftrightunsigned("word", 65 - slots.bit_length())
        for r in level.where(F.col("n") <= limit).groupBy(slot.alias("s")).agg(F.sum("n").alias("n")).collect():
            loads[r["s"]] += r["n"]
        if not len(big) or len(heavy) == depth - 1:
            for s in _slot(big, slots):              # prefixes of full depth are single leaves
                loads[s] += 1
            break
        heavy.append(np.sort(big))

        def children(u: _Unit, known=list(heavy)):
            length, keys = _prefixes(u, frequent, depth)
            deep, prefix = _split(length, keys, known)
            at = np.flatnonzero((deep == len(known) + 1) & (length > len(known)))
            return prefix[at], u.lang[at]

        level = stored(arrow_map(src, lambda it, fn=children: _counted(it, names, fn), _VOCAB)
                       .groupBy("word").agg(F.sum("n").alias("n")), "phrase-prefixes")
    before = np.cumsum(loads) - loads
    group_of = (before // budget).astype(np.int32)
    _, group_of = np.unique(group_of, return_inverse=True)
    groups = int(group_of.max()) + 1

    def leaves(batches):
        for u in _units(batches):
            b = _blocks(u, frequent, heavy, group_of, slots, depth)
            if b is not None:
                yield b

    def trees(batches):
        held: dict[int, list] = {}
        for b in batches:
            grp, *rest = (c.to_pylist() for c in b.columns)
            for g, *block in zip(grp, *rest):
                held.setdefault(g, []).append(block)
        for g in sorted(held):
            yield from _subtrees(held.pop(g), depth, least)

    blocks = arrow_map(src, leaves, _BLOCK).repartitionById(groups, F.col("grp"))
    nodes = stored(arrow_map(blocks, trees, _NODE), "phrase-nodes")
    whole = nodes.where("not partial").select("lang", "phrase", "m", "f")
    above = nodes.where("partial").groupBy("lang", "phrase", "m").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return whole.unionAll(above), totals


def collocations(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, share: int = SHARE, top: int = TOP,
                 budget: int = BUDGET, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Each language's first ``top`` phrases of 2 to ``depth`` words: ``lang, rank, phrase, a, l, r, n, score``.

    a, l and r count the phrase and the parts of its worst cut, n all words of
    the language, score is floor(2 000 000 a / (l + r)) (decimals of 38 digits,
    so no product overflows).  A phrase inside a longer candidate that has
    ``share`` per cent of its occurrences goes.  Ties: score, a, phrase by bytes.
    Null, empty, repeated and other rows: as in ``phrase_counts``.
    """
    counts, totals = phrase_counts(docs, depth, least, budget, lang_col, text_col)
    counts = stored(counts, "phrase-counts")
    some = counts.where("m > 1").select("lang", "phrase", "m", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))

    def text(start, size):
        return F.array_join(F.slice("w", start, size), " ")

    part = counts.select("lang", "phrase", "f")
    cuts = (some.select("lang", "phrase", "m", "a", "w", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
            .select("lang", "phrase", "a", "k", text(F.lit(1), F.col("k")).alias("p1"),
                    text(F.col("k") + 1, F.col("m") - F.col("k")).alias("p2"))
            .join(part.select("lang", F.col("phrase").alias("p1"), F.col("f").alias("l")), ["lang", "p1"])
            .join(part.select("lang", F.col("phrase").alias("p2"), F.col("f").alias("r")), ["lang", "p2"]))
    score = F.expr("cast((cast(2000000 as decimal(18,0)) * cast(a as decimal(20,0))) "
                   "div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as bigint)")
    worst = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))

    # phrases inside a longer candidate: the largest count among those around each
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("m") - 1), lambda s: F.transform(
        F.sequence(F.lit(1), F.col("m") - s + 1), lambda i: F.array_join(F.slice("w", i, s), " "))))
    around = (some.where("m > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a")
              .groupBy("lang", "phrase").agg(F.max("a").alias("outer")))
    left = (worst.join(around, ["lang", "phrase"], "left")
            .where(f"outer is null or cast(outer as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * {share}")
            .select("lang", "phrase", "a", "c.l", "c.r", "c.score"))
    by = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    first = (salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*by)))
             .where(F.col("rank") <= top).drop("salt", "rank"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by))).where(F.col("rank") <= top)
    return (ranked.join(totals, "lang")
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?\x0A-\x0D]+')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM t),
p AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT lang, i, ws, unnest([1, 2, 3, 4]) AS m FROM p),
f AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, m, count(*) AS f FROM g WHERE i + m - 1 <= len(ws) GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND f >= 30),
k AS (SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS p1, array_to_string(ws[k + 1:m], ' ') AS p2
      FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
s AS (SELECT k.lang, k.phrase, k.a, k.k, x.f AS l, y.f AS r, (CAST(2000000 AS HUGEINT) * k.a) // (x.f + y.f) AS score
      FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.p1 JOIN f y ON y.lang = k.lang AND y.phrase = k.p2),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, a, ws, m, z, unnest(range(1, m - z + 2)) AS j FROM (SELECT *, unnest(range(2, m)) AS z FROM c)),
o AS (SELECT lang, array_to_string(ws[j:j + z - 1], ' ') AS phrase, max(a) AS outer_a FROM i GROUP BY ALL),
q AS (SELECT b.* FROM b LEFT JOIN o USING (lang, phrase) WHERE outer_a IS NULL OR 100 * outer_a < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM q JOIN n USING (lang) QUALIFY rank <= 2000
"""


@query("op11_era_collocations", SQL)
def op11(spark, sf_dir):
    """The 2000 strongest phrases of every language, counted in suffix subtrees."""
    return collocations(table(spark, sf_dir, "documents"))
