"""Vectorised word and word-sequence fingerprints of whole texts.

A record batch is cut into chunks of about ``CHUNK`` bytes (a longer text is a
chunk of its own) and every word of a chunk is hashed at once: byte values go
through a fixed random table, a polynomial prefix sum modulo 2^64 gives the
hash of any byte range in O(1), and the same trick over word hashes gives the
hash of any word sequence.  Equal sequences have equal hashes wherever they
stand, in every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
U = np.uint64


def splitmix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser: a bijective mix of 64-bit values."""
    with np.errstate(over="ignore"):
        x = x.astype(U, copy=True)
        x ^= x >> U(30)
        x *= U(0xBF58476D1CE4E5B9)
        x ^= x >> U(27)
        x *= U(0x94D049BB133111EB)
        x ^= x >> U(31)
    return x


BYTE_VALUE = splitmix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
BASE_BYTE, BASE_WORD = 0xD1342543DE82EF95, 0xAF251AF3B0F025B5
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n (at least)."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK + 1)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=U)
            p[0] = 1
            with np.errstate(over="ignore"):
                both.append(np.multiply.accumulate(p))
        have = _powers[base] = (both[0], both[1])
    return have


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values[i] * base^i, with a leading zero."""
    out = np.zeros(len(values) + 1, dtype=U)
    with np.errstate(over="ignore"):
        np.cumsum(values * powers(base, len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def ranges(pre: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hash of each range [start, end), the same wherever the range stands."""
    with np.errstate(over="ignore"):
        return splitmix((pre[end] - pre[start]) * powers(base, len(pre))[1][start] + (end - start).astype(U))


SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
IDENTITY = np.arange(256, dtype=np.uint8)
LOWER = IDENTITY.copy()
LOWER[65:91] += 32
#: letters, digits and non-ASCII bytes are word bytes; everything else separates
PUNCT = np.ones(256, dtype=bool)
PUNCT[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


@dataclass
class Chunk:
    rows: slice              # rows of the batch
    raw: np.ndarray          # bytes (after folding) of the chunk's texts
    offsets: np.ndarray      # byte offset of each row in raw, and the end
    start: np.ndarray        # byte range of each word
    end: np.ndarray
    row: np.ndarray          # row of each word, from 0 within the chunk
    first: np.ndarray        # index of each row's first word, and the end
    h: np.ndarray            # 64-bit hash of each word
    pre: np.ndarray          # prefix sums over h

    def sequences(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on (rows are not respected)."""
        n = len(self.h) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=U)
        i = np.arange(n)
        return ranges(self.pre, i, i + k, BASE_WORD)

    def text(self, i: int) -> bytes:
        return self.raw[self.offsets[i]:self.offsets[i + 1]].tobytes()


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string column; null counts as empty."""
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    if not wide and not pa.types.is_string(col.type):
        col, wide = col.cast(pa.large_string()), True
    off = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)
    off = off[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    return off, np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)


def row_slices(off: np.ndarray, size: int = CHUNK) -> Iterator[slice]:
    """Cuts rows into slices of about ``size`` bytes, one row at least."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + size, side="right")) - 1)
        yield slice(a, min(b, n))
        a = min(b, n)


def chunks(col: pa.Array, fold: np.ndarray = IDENTITY, space: np.ndarray = SPACE,
           size: int = CHUNK) -> Iterator[Chunk]:
    """Chunks of a text column with the hashes of all their words."""
    off, data = text_buffers(col)
    for s in row_slices(off, size):
        o = off[s.start:s.stop + 1]
        raw = fold[data[o[0]:o[-1]]]
        o = o - o[0]
        sp = space[raw]
        begin = ~sp
        stop = np.zeros(len(raw) + 1, dtype=bool)
        stop[1:] = begin
        edge = o[1:-1]
        edge = edge[edge < len(raw)]
        follows = np.empty(len(raw), dtype=bool)    # a word byte right after one of the same row
        if len(raw):
            follows[0] = False
            follows[1:] = begin[:-1]
            follows[edge] = False
        start = np.flatnonzero(begin & ~follows)
        # a word ends at the next space, row edge or the end of the chunk
        last = np.ones(len(raw), dtype=bool)
        if len(raw):
            last[:-1] = sp[1:]
            last[edge[edge > 0] - 1] = True
        end = np.flatnonzero(begin & last) + 1
        first = np.searchsorted(start, o, side="left")
        row = np.repeat(np.arange(len(o) - 1), np.diff(first))
        h = ranges(prefix(BYTE_VALUE[raw], BASE_BYTE), start, end, BASE_BYTE)
        yield Chunk(s, raw, o, start, end, row, first, h, prefix(h, BASE_WORD))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    if len(x) < w:
        return x[:0]
    have, m = 1, x
    while have * 2 <= w:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    rest = w - have
    return np.minimum(m[:len(m) - rest], m[rest:]) if rest else m


def as_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


# ------------------------------------------------------------------ bitmaps

def bitmap(df, key, bits: int) -> np.ndarray:
    """Packed bitmap of 2^bits positions over the long column ``key``.

    Built by a distributed aggregation; what reaches the driver is 2^bits / 8
    bytes at most, whatever the input.  It only spares work: a set bit may be
    a collision, and exact joins decide.
    """
    from pyspark.sql import functions as F

    pos = F.shiftrightunsigned(F.col(key), 64 - bits)
    rows = (df.select(pos.alias("p"))
            .groupBy(F.bitmap_bucket_number(F.col("p") + 1).alias("b"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("p") + 1)).alias("m")).collect())
    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for r in rows:
        part = np.frombuffer(bytes(r["m"]), dtype=np.uint8)
        at = (r["b"] - 1) * 4096
        out[at:at + 4096] = part[: len(out) - at]
    return out


def in_bitmap(bitmap_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bits = (len(bitmap_) * 8).bit_length() - 1
    p = (keys.view(U) >> U(64 - bits)).astype(np.int64)
    return (bitmap_[p >> 3] >> (p & 7).astype(np.uint8)) & 1 != 0
