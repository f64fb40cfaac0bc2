"""Substring dedup by repeated-phrase automata.

A *window* is ``window`` consecutive words of one document.  Every word covered
by a window whose word sequence also starts anywhere else (same document
included) is removed; windows are judged on the input.

1. ``pack``: documents become compressed shards of a few MB (no shuffle).
2. Confirm: each shard picks content-defined *anchor* phrases (the ``anchor``
   consecutive words with the smallest value inside a window), so equal windows
   pick equal anchors.  Anchor values that occur twice anywhere mark candidate
   windows; 96-bit values of the candidates are counted the same way and give
   the recurring windows.  Counting is an exchange of packed value lists by value
   range; the answer to a shard is one bit per value, so a passage that a third
   of all documents share costs one value per shard, never a pair of documents.
3. Locate: each shard compiles a pyahocorasick automaton over word ids from the
   anchor phrases of its recurring windows, streams all its documents through it,
   and around each hit takes the windows that were confirmed.

Defined cases: null or blank text has no words and is kept as the empty text; a
document shorter than ``window`` is kept whole; rows with a null or repeated
doc_id are separate documents; an empty table gives an empty result; only the id
and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

WINDOW = 35
ANCHOR = 12
#: Text bytes of a shard: bounds a task's memory and an automaton's size.
SHARD_BYTES = 8 << 20
#: Text bytes for each value range of the counting exchange.
RANGE_BYTES = 32 << 20


# --- shards ------------------------------------------------------------------

def pack(docs: DataFrame, id_col: str, text_col: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(g, blob): shards of whole documents, checkpointed so that g is fixed."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        pid, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            opts = pa.ipc.IpcWriteOptions(compression="zstd")
            with pa.ipc.new_stream(sink, held[0].schema, options=opts) as w:
                for x in held:
                    w.write_batch(x)
            return pa.record_batch([pa.array([(pid << 32) | n], pa.int64()),
                                    pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["g", "blob"])

        for b in batches:
            for s in C.text_slices(b, "text", shard_bytes // 4):
                held.append(s)
                size += s.get_total_buffer_size() if s.num_rows == 1 else s.nbytes
                if size >= shard_bytes:
                    yield flush()
                    n, held, size = n + 1, [], 0
        if held:
            yield flush()

    return C.save(src.mapInArrow(run, "g long, blob binary"))


class Shard:
    """Words, anchors and windows of one shard."""

    def __init__(self, blob: bytes, window: int, anchor: int):
        table = pa.ipc.open_stream(pa.py_buffer(blob)).read_all().combine_chunks()
        self.ids = table.column("id")
        texts = table.column("text").chunk(0) if table.num_rows else pa.array([], pa.string())
        self.buf, self.offsets = C.flat_bytes(texts)
        self.starts, self.ends, self.rows = C.words(self.buf, self.offsets)
        self.values = C.spans_hash(self.buf, self.starts, self.ends)
        self.n, self.window, self.anchor = table.num_rows, window, anchor
        n = len(self.values)
        if n < window:
            self.whole = np.zeros(0, bool)
            return
        self.whole = self.rows[window - 1:] == self.rows[:n - window + 1]   # window starts inside one document
        self.span = window - anchor + 1
        self.phrases = C.grams(self.values, anchor, 3)
        self.least = _sliding(self.phrases, self.span, np.minimum)          # per window start

    def anchors(self) -> np.ndarray:
        """Word positions whose phrase is the least of some window."""
        if not self.whole.any():
            return np.zeros(0, np.int64)
        pad = np.zeros(self.span - 1, np.uint64)
        top = _sliding(np.concatenate([pad, np.where(self.whole, self.least, np.uint64(0)), pad]), self.span, np.maximum)
        return np.flatnonzero(top == self.phrases)

    def anchor_values(self, parts: int):
        return Values(self.phrases[self.anchors()] if self.whole.any() else np.zeros(0, np.uint64), None, parts)

    def candidates(self, repeated: np.ndarray) -> np.ndarray:
        """Starts of the windows whose anchor value recurs (``repeated``: sorted values)."""
        if not self.whole.any() or not len(repeated):
            return np.zeros(0, np.int64)
        starts = np.flatnonzero(self.whole)
        return starts[_among(self.least[starts], repeated)]

    def window_values(self, starts: np.ndarray, parts: int):
        if not len(starts):
            return Values(np.zeros(0, np.uint64), np.zeros(0, np.uint32), parts)
        low = (C.grams(self.values, self.window, 5)[starts] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return Values(C.grams(self.values, self.window, 4)[starts], low, parts)


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return known[at] == x


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best over x[i : i + width], by doubling spans."""
    out, span = x, 1
    while span < width:
        step = min(span, width - span)
        out = best(out[:len(out) - step], out[step:])
        span += step
    return out


# --- counting exchange -------------------------------------------------------

class Values:
    """A shard's distinct values by range, with a flag for those it has twice."""

    def __init__(self, high: np.ndarray, low: np.ndarray | None, parts: int):
        part = (high % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((high, part) if low is None else (low, high, part))
        h, w = high[order], None if low is None else low[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) if w is None else (h[1:] != h[:-1]) | (w[1:] != w[:-1])
        at = np.cumsum(new) - 1
        self.inverse = np.empty(len(h), np.int64)                    # of each input: its distinct value
        self.inverse[order] = at
        self.high, self.low = h[new], None if w is None else w[new]
        self.twice = np.bincount(at, minlength=int(new.sum())) > 1
        self.bounds = np.searchsorted(part[order][new], np.arange(parts + 1))

    def blobs(self) -> Iterator[tuple[int, int, bytes]]:
        for p in np.flatnonzero(np.diff(self.bounds)):
            a, b = self.bounds[p], self.bounds[p + 1]
            low = b"" if self.low is None else self.low[a:b].tobytes()
            yield int(p), int(b - a), self.high[a:b].tobytes() + low + np.packbits(self.twice[a:b]).tobytes()

    def answers(self, replies: list) -> np.ndarray:
        """One flag per distinct value from the exchange's (part, bits) rows."""
        out = np.zeros(len(self.high), bool)
        for r in replies:
            a, b = self.bounds[r["part"]], self.bounds[r["part"] + 1]
            out[a:b] = np.unpackbits(np.frombuffer(r["bits"], np.uint8))[:b - a].astype(bool)
        return out


def recurring(lists: DataFrame, wide: bool) -> DataFrame:
    """(g, part, n, blob) -> (g, part, bits): which values occur twice over all shards.

    A range holds about RANGE_BYTES of text at every corpus size (the number of
    ranges follows the corpus), and each shard sends a value at most once."""

    def count(pdf):
        import pandas as pd
        sizes = pdf["n"].to_numpy()
        high, low, twice = [], [], []
        for n, b in zip(sizes, pdf["blob"], strict=True):
            high.append(np.frombuffer(b, np.uint64, n))
            low.append(np.frombuffer(b, np.uint32, n, 8 * n) if wide else np.zeros(0, np.uint32))
            twice.append(np.unpackbits(np.frombuffer(b, np.uint8, -1, (12 if wide else 8) * n))[:n])
        h, tw = np.concatenate(high), np.concatenate(twice).astype(bool)
        w = np.concatenate(low) if wide else np.zeros(len(h), np.uint32)
        order = np.lexsort((w, h)) if wide else np.argsort(h, kind="stable")
        same = (h[order][1:] == h[order][:-1]) & (w[order][1:] == w[order][:-1])
        again = np.zeros(len(h), bool)
        again[1:] |= same
        again[:-1] |= same
        out = tw.copy()
        out[order] |= again
        cuts = np.cumsum(sizes)[:-1]
        bits = [np.packbits(x).tobytes() for x in np.split(out, cuts)]
        return pd.DataFrame({"g": pdf["g"], "part": pdf["part"], "bits": bits})

    return lists.groupBy("part").applyInPandas(count, "g long, part int, bits binary")


def _replies(answers: DataFrame, name: str) -> DataFrame:
    return answers.groupBy("g").agg(F.collect_list(F.struct("part", "bits")).alias(name))


# --- the operator ------------------------------------------------------------

def _locate(shard: Shard, starts: np.ndarray, confirmed: np.ndarray) -> np.ndarray:
    """Word mask of the shard: covered by a confirmed window.

    An automaton over word ids is compiled from the anchor phrases of the
    confirmed windows; every document is streamed through it, and the confirmed
    windows around each located phrase are taken."""
    covered = np.zeros(len(shard.values) + 1, np.int64)
    good = np.zeros(len(shard.whole), bool)
    good[starts[confirmed]] = True
    if not good.any():
        return covered[:-1].astype(bool)
    import ahocorasick
    k = shard.anchor
    wanted = np.unique(shard.least[good])
    at = shard.anchors()
    at = at[_among(shard.phrases[at], wanted)]
    _, first = np.unique(shard.phrases[at], return_index=True)
    ids = np.unique(shard.values, return_inverse=True)[1].tolist()
    auto = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for j, p in enumerate(at[first].tolist()):
        auto.add_word(tuple(ids[p:p + k]), j + 1)
    auto.make_automaton()
    bounds = np.searchsorted(shard.rows, np.arange(shard.n + 1)).tolist()
    hits: list[int] = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b - a >= shard.window:
            hits += [a + end - k + 1 for end, _ in auto.iter(tuple(ids[a:b]))]
    near = np.zeros(len(good) + shard.window, np.int64)               # window starts that hold a located phrase
    h = np.asarray(hits, np.int64)
    np.add.at(near, np.maximum(h - shard.span + 1, 0), 1)
    np.add.at(near, np.minimum(h + 1, len(near) - 1), -1)
    found = np.flatnonzero(good & (np.cumsum(near)[:len(good)] > 0))
    np.add.at(covered, found, 1)
    np.add.at(covered, found + shard.window, -1)
    return np.cumsum(covered)[:-1] > 0


def _kept_texts(shard: Shard, removed: np.ndarray) -> Iterator[bytes]:
    """Each document's kept words, joined by one space."""
    keep = ~removed
    lens = shard.ends[keep] - shard.starts[keep] + 1
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total) - np.repeat(ends - lens, lens) + np.repeat(shard.starts[keep], lens)
    out = np.concatenate([shard.buf, np.zeros(1, np.uint8)])[at] if total else np.zeros(0, np.uint8)
    if total:
        out[ends - 1] = 0x20
    per = np.searchsorted(shard.rows[keep], np.arange(shard.n + 1))
    edges = np.concatenate([[0], ends])[per].tolist()
    raw = out.tobytes()
    for a, b in zip(edges, edges[1:], strict=False):
        yield raw[a:max(a, b - 1)]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   anchor: int = ANCHOR, texts: bool = True) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 and, with ``texts``, kept_text per document."""
    spark = C.prepare(docs.sparkSession)
    if not 1 <= anchor <= window:
        raise ValueError("anchor must be from 1 to window words")
    parts = max(1, -(-C.size_of(docs, text_col)[1] // RANGE_BYTES))
    shards = pack(docs, id_col, text_col)
    lists = "g long, part int, n int, blob binary"
    kind = docs.schema[id_col].dataType

    def listed(rows: list) -> pa.RecordBatch:
        g, p, n, b = zip(*rows, strict=True) if rows else ([], [], [], [])
        return pa.record_batch([pa.array(g, pa.int64()), pa.array(p, pa.int32()), pa.array(n, pa.int32()),
                                pa.array(b, pa.binary())], ["g", "part", "n", "blob"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for i in range(b.num_rows):
                yield {c: b.column(j)[i].as_py() for j, c in enumerate(b.schema.names)}

    def anchors(batches):
        for r in each(batches):
            v = Shard(r["blob"], window, anchor).anchor_values(parts)
            yield listed([(r["g"], *x) for x in v.blobs()])

    def repeated_of(shard: Shard, replies) -> np.ndarray:
        v = shard.anchor_values(parts)
        return np.sort(v.high[v.answers(replies or [])])

    def windows(batches):
        for r in each(batches):
            shard = Shard(r["blob"], window, anchor)
            v = shard.window_values(shard.candidates(repeated_of(shard, r["a"])), parts)
            yield listed([(r["g"], *x) for x in v.blobs()])

    def locate(batches):
        for r in each(batches):
            shard = Shard(r["blob"], window, anchor)
            starts = shard.candidates(repeated_of(shard, r["a"]))
            v = shard.window_values(starts, parts)
            removed = _locate(shard, starts, v.answers(r["w"] or [])[v.inverse])
            n_words = C.counts_by_row(shard.rows, shard.n)
            n_removed = C.counts_by_row(shard.rows[removed], shard.n)
            kept = list(_kept_texts(shard, removed))
            cols = [shard.ids.combine_chunks() if isinstance(shard.ids, pa.ChunkedArray) else shard.ids,
                    pa.array(n_words), pa.array(n_removed), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
            if texts:
                cols.append(pa.array([x.decode() for x in kept], pa.string()))
            yield pa.record_batch(cols, ["id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * texts)

    first = C.save(recurring(shards.mapInArrow(anchors, lists), wide=False))
    by_anchor = _replies(first, "a")
    second = C.save(recurring(shards.join(by_anchor, "g", "left").mapInArrow(windows, lists), wide=True))
    out = T.StructType([T.StructField("id", kind), T.StructField("n_words", T.LongType()),
                        T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
                       + [T.StructField("kept_text", T.StringType())] * texts)
    done = (shards.join(by_anchor, "g", "left").join(_replies(second, "w"), "g", "left").mapInArrow(locate, out))
    return done.withColumnRenamed("id", id_col) if id_col != "id" else done


def oracle(window: int = WINDOW) -> str:
    """DuckDB SQL of the query over ``documents``: all windows, grouped by their words."""
    return f"""
with d as (select row_number() over () as k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
v as (select k, unnest(range(len(w) - {window - 1})) as i, w from d where len(w) >= {window}),
t as (select k, i, array_to_string(w[i + 1:i + {window}], ' ') as t from v),
r as (select k, i from (select k, i, count(*) over (partition by t) as n from t) where n > 1),
x as (select k, unnest(range(len(w))) as i, unnest(w) as word from d),
y as (select x.k, x.i, x.word, max((r.i is not null)::int) over (partition by x.k order by x.i rows between {window - 1} preceding and current row) as gone
      from x left join r on r.k = x.k and r.i = x.i),
z as (select k, sum(gone)::bigint as n, string_agg(word, ' ' order by i) filter (gone = 0) as kept from y group by k)
select doc_id, len(w)::bigint as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join z using (k)
"""
