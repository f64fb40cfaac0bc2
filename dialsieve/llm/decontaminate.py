"""Benchmark decontamination by the q-gram lemma.

Texts are folded (lower case per character, white space runs as one space).  A
benchmark item of m characters leaks into a document where some stretch of the
document is within k = floor(``rate`` * m) edits of the whole item.  Such a
stretch shares at least m - q + 1 - k*q of the item's q-grams (q is at most m / (k + 1),
so this is never below 1: short items have shorter q-grams), all inside one of
the overlapping diagonal bands (diagonal = document position - item position;
bands are wider than k and overlap by k, so one band holds the whole alignment).
Shared q-grams are counted per (document, item, band); bands that reach the bound
are verified by banded alignment, which also gives the stretch and its edits.

The documents are only scanned (no shuffle); a benchmark larger than
``block_bytes`` is taken in blocks, so a task's index stays bounded.

Defined cases: null or empty texts never leak; items with a null text or no character
but white space are left out, all others are searched, however short (below 10
characters the budget is 0: exact copies, wherever they stand); repeated items and repeated documents are each reported; an empty benchmark finds
nothing.  Only the id and text columns are read; ``drop_leaks`` passes all columns on.
"""

from __future__ import annotations

import functools
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import common as C

EDIT_RATE = 0.1
#: Longest q-grams.
Q = 8
#: Benchmark text that one pass over the documents searches for.
BLOCK_BYTES = 4 << 20
#: Document text that one numpy step scans, and q-gram hits that it expands at once.
SCAN_BYTES, HITS = 4 << 20, 1 << 21
#: Characters whose q-grams are computed at a time (the arrays stay in the CPU cache).
BLOCK_CHARS = 1 << 17

_NONE = np.uint32(0xFFFFFFFF)


@functools.cache
def _fold_table() -> np.ndarray:
    """Lower case, and 0x20 for white space, of code points below 0x10000."""
    out = np.arange(0x10000, dtype=np.uint32)
    for c in range(0x10000):
        x = chr(c).lower()
        if chr(c).isspace():
            out[c] = 0x20
        elif len(x) == 1 and ord(x) < 0x10000:
            out[c] = ord(x)
    return out


def fold(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(folded code points, their offsets per text, their original place in the flat text,
    original offsets per text) of UTF-8 texts.  Points above 0xFFFF fold to themselves."""
    table = _fold_table()
    points = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    first = offsets if len(points) == len(buf) else np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[offsets]
    if len(points) and points.max() > 0xFFFF:
        points = np.where(points < 0x10000, table[np.minimum(points, 0xFFFF)], points)
    else:
        points = table[points]
    space = points == 0x20
    drop = np.zeros(len(points), bool)
    drop[1:] = space[1:] & space[:-1]
    drop[first[:-1][first[:-1] < len(points)]] = False
    place = np.flatnonzero(~drop)
    return (points if len(place) == len(points) else points[place]), np.searchsorted(place, first), place, first


_ODD = [np.uint64(C.mix(np.array([i], np.uint64), 21)[0] | np.uint64(1)) for i in range(64)]


def char_grams(points: np.ndarray, q: int) -> np.ndarray:
    """64-bit value of every q consecutive code points, built by doubling."""
    x, size, out, have = points.astype(np.uint64), 1, None, 0
    while True:
        if q & size:                       # append this power-of-two piece
            if out is None:
                out, have = x, size
            else:
                n = len(points) - have - size + 1
                out, have = out[:n] * _ODD[32 + have % 32] + x[have:have + n], have + size
        if have == q or len(points) < q:
            return out[:max(0, len(points) - q + 1)] if out is not None else np.zeros(0, np.uint64)
        x = x[:max(0, len(x) - size)] * _ODD[size.bit_length()] + x[size:]
        size *= 2


def _slot(values: np.ndarray) -> np.ndarray:
    return ((values * _ODD[63]) >> np.uint64(42)).astype(np.int64)


class Grams:
    """Postings of the q-grams of one length."""

    def __init__(self, texts: list[np.ndarray], which: np.ndarray, q: int):
        self.q = q
        found = [char_grams(texts[x], q) for x in which]
        values = np.concatenate(found)
        order = np.argsort(values, kind="stable")
        self.item = np.repeat(which, [len(x) for x in found])[order]
        self.at = np.concatenate([np.arange(len(x)) for x in found])[order]
        self.values, self.first, self.count = np.unique(values[order], return_index=True, return_counts=True)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[_slot(self.values)] = True

    def hits(self, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, row, index of the value) of the text's q-grams that are the benchmark's."""
        p, g = self._shared(points)
        if not len(p):
            return p, p, p
        j = np.minimum(np.searchsorted(self.values, g), len(self.values) - 1)
        row = np.searchsorted(offsets, p, "right") - 1
        good = (self.values[j] == g) & (p + self.q <= offsets[row + 1])
        return p[good], row[good], j[good]

    def _shared(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, gram) of the text's q-grams that are probably the benchmark's."""
        at, values = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for a in range(0, max(0, len(points) - self.q + 1), BLOCK_CHARS):
            g = char_grams(points[a:a + BLOCK_CHARS + self.q - 1], self.q)
            p = np.flatnonzero(self.bits[_slot(g)])
            at.append(p + a)
            values.append(g[p])
        return np.concatenate(at), np.concatenate(values)


class Items:
    """Index of a block of benchmark items: q-gram postings, budgets, bands."""

    def __init__(self, items: list[tuple[object, str]], rate: float, q: int):
        if not 0 <= rate < 1:
            raise ValueError("rate must be at least 0 and below 1")
        self.ids, self.texts = [], []
        for key, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            points = fold(raw, np.array([0, len(raw)]))[0]
            points = points[1:] if len(points) and points[0] == 0x20 else points
            points = points[:-1] if len(points) and points[-1] == 0x20 else points
            if len(points):
                self.ids.append(key)
                self.texts.append(points)
        self.m = np.array([len(x) for x in self.texts], np.int64)
        self.k = (self.m * rate).astype(np.int64)
        self.q = np.minimum(q, self.m // (self.k + 1))
        self.least = self.m - self.q + 1 - self.k * self.q
        # a band of a short item has no room for two stretches that do not overlap
        self.step = np.maximum(self.k + 1, np.minimum(2 * self.k + 16, self.m - 3 * self.k - 1))
        self.longest = int(self.m.max(initial=0))
        self.grams = [Grams(self.texts, np.flatnonzero(self.q == n), int(n)) for n in np.unique(self.q)]

    def bands(self, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, first diagonal) of the bands that reach the lemma's bound."""
        empty = np.zeros(0, np.int64)
        hits = [(g, *found, np.cumsum(g.count[found[2]])) for g in self.grams if len((found := g.hits(points, offsets))[0])]
        if not hits:
            return empty, empty, empty
        rows = len(offsets) - 1
        begin = np.concatenate([[0], np.cumsum(offsets[-1] + rows * (self.m + 2))])   # of each item's band keys

        def postings() -> Iterator[tuple]:
            """(band key, item position, bound) of every hit; a hit in an overlap belongs to two bands."""
            for g, p, row, j, many in hits:
                a = 0
                while a < len(p):
                    b = max(a + 1, int(np.searchsorted(many, (many[a - 1] if a else 0) + HITS, "right")))
                    n = g.count[j[a:b]]
                    post = np.repeat(g.first[j[a:b]] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                    item, at, r = g.item[post], g.at[post], np.repeat(row[a:b], n)
                    diagonal = np.repeat(p[a:b], n) - offsets[r] - at + self.m[item]
                    band = diagonal // self.step[item]
                    key = begin[item] + offsets[r] + r * (self.m[item] + 2) + band
                    twin = np.flatnonzero((diagonal - band * self.step[item] < self.k[item]) & (band > 0))
                    yield (np.concatenate([key, key[twin] - 1]), np.concatenate([at, at[twin]]),
                           np.concatenate([self.least[item], self.least[item[twin]]]))
                    a = b

        slots = 1 << 20
        slot = lambda key: ((key.view(np.uint64) * _ODD[62]) >> np.uint64(44)).astype(np.int64)
        one = list(postings()) if sum(h[-1][-1] for h in hits) <= HITS else None
        seen = np.zeros(slots, np.int64)         # hashed counts never fall below the true ones
        for key, _, _ in one or postings():
            seen += np.bincount(slot(key), minlength=slots)
        keys = []
        for key, at, least in one or postings():
            full = np.flatnonzero(seen[slot(key)] >= least)
            keys.append(np.unique(key[full] * self.longest + at[full]))   # an item's q-gram counts once in a band
        u, total = np.unique(np.unique(np.concatenate(keys)) // self.longest, return_counts=True)
        item = np.searchsorted(begin, u, "right") - 1
        hit = total >= self.least[item]
        u, item = u[hit] - begin[item[hit]], item[hit]
        row, above = np.zeros(len(u), np.int64), np.full(len(u), rows)        # the last row that begins at u or before
        while (above - row > 1).any():
            mid = (row + above) // 2
            low = offsets[mid] + mid * (self.m[item] + 2) <= u
            row, above = np.where(low, mid, row), np.where(low, above, mid)
        band = u - offsets[row] - row * (self.m[item] + 2)
        return row, item, band * self.step[item] - self.m[item]

    def align(self, points: np.ndarray, offsets: np.ndarray, row, item, diagonal) -> Iterator[tuple]:
        """(row, item, begin, end, edits) of bands within budget, in flat folded positions."""
        for a in range(0, len(row), 256):
            yield from self._align(points, offsets, row[a:a + 256], item[a:a + 256], diagonal[a:a + 256])

    def _align(self, points, offsets, row, item, diagonal):
        """Edit distance of whole items to any stretch of their band, all bands at once.

        cost[d]: least edits for the item's first i characters ending at text
        position origin + i + d; begin[d] is where that alignment starts."""
        m, own = self.m[item], self.step[item] + 2 * self.k[item] + 1
        wide = int(own.max())
        origin = offsets[row] + diagonal - self.k[item] // 2
        lo, hi = offsets[row][:, None], offsets[row + 1][:, None]
        pattern = np.full((len(row), int(m.max())), _NONE - np.uint32(1))
        for i, x in enumerate(item):
            pattern[i, :m[i]] = self.texts[x]
        d = np.arange(wide)
        beyond = d >= own[:, None]               # of another, wider band
        cost = np.where(beyond, 1 << 20, 0).astype(np.int32)
        begin = origin[:, None] + d
        best, end, start = np.full(len(row), 1 << 20), np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        for i in range(int(m.max())):
            at = origin[:, None] + i + d
            same = (points[np.clip(at, 0, len(points) - 1)] == pattern[:, i, None]) & (at >= lo) & (at < hi)
            here = cost + ~same
            skip = np.concatenate([cost[:, 1:] + 1, np.full((len(row), 1), 1 << 20, np.int32)], 1)
            from_skip = skip < here
            here = np.where(from_skip, skip, here)
            origin_of = np.where(from_skip, np.concatenate([begin[:, 1:], begin[:, -1:]], 1), begin)
            slope = here - d
            low = np.minimum.accumulate(slope, 1)
            src = np.maximum.accumulate(np.where(slope == low, d, 0), 1)
            cost, begin = (low + d).astype(np.int32), np.take_along_axis(origin_of, src, 1)
            done = np.flatnonzero(m == i + 1)
            if len(done):
                x = np.where(beyond[done], 1 << 20, cost[done]).argmin(1)
                best[done] = cost[done, x]
                start[done], end[done] = begin[done, x], origin[done] + i + 1 + x
        for i in np.flatnonzero(best <= self.k[item]):
            yield int(row[i]), int(item[i]), max(int(start[i]), int(offsets[row[i]])), min(int(end[i]), int(offsets[row[i] + 1])), int(best[i])

    def leaks(self, texts: pa.Array) -> list[tuple]:
        """(row, item index, start, end, edits) in code points of each text, without repeats."""
        points, offsets, place, first = fold(*C.flat_bytes(texts))
        row, item, diagonal = self.bands(points, offsets)
        found = {}
        for r, x, a, b, e in self.align(points, offsets, row, item, diagonal):
            if b > a:
                at = (r, x, int(place[a] - first[r]), int(place[b - 1] + 1 - first[r]))
                found[at] = min(e, found.get(at, e))
        best: list[tuple] = []
        taken: dict[tuple, list[tuple]] = {}       # spans of each (row, item), apart and in order
        for (r, x, a, b), e in sorted(found.items(), key=lambda f: (f[0][:2], f[1], f[0][2:])):
            spans = taken.setdefault((r, x), [])
            i = bisect_left(spans, (a, b))
            if (not i or spans[i - 1][1] <= a) and (i == len(spans) or b <= spans[i][0]):   # a better overlapping one stays
                spans.insert(i, (a, b))
                best.append((r, x, a, b, e))
        return sorted(best)


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> Iterator[list]:
    """The benchmark in blocks of about ``block_bytes`` of text, one at a time on the driver."""
    items = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    n = max(1, -(-C.size_of(items)[1] // block_bytes))
    for b in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == b)
        yield [(r["id"], r["text"]) for r in part.toLocalIterator()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text: str = "text", rate: float = EDIT_RATE, q: int = Q,
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per leak: id, item id, start, end (code points, end exclusive), edits."""
    C.prepare(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    schema = T.StructType([T.StructField(id_col, kinds[0]), T.StructField(item_col, kinds[1]),
                           T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                           T.StructField("edits", T.IntegerType())])
    item_kind = to_arrow_type(kinds[1])
    out = None
    for block in item_blocks(benchmark, item_col, item_text, block_bytes):
        def run(batches, block=block):
            index = Items(block, rate, q)
            for b in batches:
                for s in C.text_slices(b, "text", SCAN_BYTES):
                    found = index.leaks(s.column(1))
                    if found:
                        r, x, a, e, n = zip(*found, strict=True)
                        yield pa.record_batch([s.column(0).take(pa.array(r)), pa.array([index.ids[i] for i in x], item_kind),
                                               pa.array(a, pa.int64()), pa.array(e, pa.int64()), pa.array(n, pa.int32())],
                                              [id_col, item_col, "start", "end", "edits"])
        part = src.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
               item_text: str = "text", rate: float = EDIT_RATE, q: int = Q, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents (all columns) without those that hold a benchmark item."""
    C.prepare(docs.sparkSession)
    at = docs.columns.index(text_col)
    for block in item_blocks(benchmark, item_col, item_text, block_bytes):
        def run(batches, block=block):
            index = Items(block, rate, q)
            for b in batches:
                for s in C.text_slices(b, text_col, SCAN_BYTES):
                    keep = np.ones(s.num_rows, bool)
                    keep[[f[0] for f in index.leaks(s.column(at))]] = False
                    yield s if keep.all() else s.filter(pa.array(keep))
        docs = docs.mapInArrow(run, docs.schema)
    return docs
