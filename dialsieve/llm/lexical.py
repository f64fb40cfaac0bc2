"""Ranked lexical search: the best documents of every item, by presence masks.

A term is a maximal run of letters, digits and characters beyond ASCII, A-Z lower-cased.
Two scans over the documents: the first counts N, all terms and the document frequency of
the items' terms; the second ranks.  The items (distinct texts) are the query set and go
with the tasks in blocks of ``ITEM_BYTES`` of text, each block its own pair of scans, so
neither the driver nor a task holds more of them.

The second scan works on blocks of documents.  Per block it keeps the items' terms as
bitmaps over the documents.  For an item, the terms whose largest scores in the block
cannot add up to the item's tenth best score so far are left out of the choice of documents
(OR of the other terms' bitmaps); the chosen documents are grouped by the mask of the
item's terms that they hold; a mask's bound is the sum of its terms' largest scores; masks
are evaluated by falling bound, exactly and in whole numbers, until the bound of the next
is below the tenth best score.  A document with an equal bound is still evaluated, since its id may be
smaller.  A task passes on ten rows an item at most; a window that is cut per task before
the shuffle ranks them.

Terms are found by a 64-bit value and then compared byte by byte, so no clash changes a score.

Defined results: documents with null text or without terms are not ranked and not counted;
items with null text or without terms have no rows; rows that are equal in id and text
are documents of their own, and items equal in id and text are one item; equal scores
go by ascending id, null last; an empty table on either side gives an empty result.
Only the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

TOP = 10
#: Text of the items that one pair of scans answers.
ITEM_BYTES = 4 << 20
#: Documents, and (document, term) pairs, of one block of the second scan.
BLOCK_DOCS, BLOCK_PAIRS = 8192, 1 << 20
#: The ranking formula's whole numbers.
BASE, SHARE = 25, 75
UNIT, TERM, LENGTH = 1_000_000_000, 1000, 8
#: Copies of an item's rows that its ids are joined to (an item's text may have very many ids).
SALTS = 16

_IN_TERM = np.zeros(256, bool)
_IN_TERM[48:58] = _IN_TERM[65:91] = _IN_TERM[97:123] = _IN_TERM[128:] = True


def terms_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte after the last, row) of every term, in order."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = _IN_TERM[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


@dataclass
class Items:
    """A block of item texts: its terms, and per item the terms it holds and how often."""
    keys: np.ndarray                      # 64-bit values of the terms, ascending
    texts: np.ndarray                     # their bytes, one after the other
    starts: np.ndarray                    # where each term's bytes start; one more at the end
    items: list[tuple[np.ndarray, np.ndarray]]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    total_docs: int = 0
    total_terms: int = 0

    @staticmethod
    def of(texts: list[str]) -> "Items":
        buf, offsets = C.flat_bytes(pa.array(texts, pa.large_string()))
        low = C.LOWER[buf]
        s, e, row = terms_of(low, offsets)
        values = C.spans_hash(low, s, e)
        keys, first, which = np.unique(values, return_index=True, return_inverse=True)
        spelled = [low[a:b].tobytes() for a, b in zip(s[first], e[first])]
        for a, b, w in zip(s, e, which):
            if low[a:b].tobytes() != spelled[w]:
                raise ValueError("two terms of the items share a 64-bit value")
        items = []
        for i in range(len(texts)):
            own, times = np.unique(which[np.searchsorted(row, i):np.searchsorted(row, i + 1)], return_counts=True)
            items.append((own.astype(np.int64), times.astype(np.int64)))
        sizes = np.array([len(x) for x in spelled], np.int64)
        return Items(keys, np.frombuffer(b"".join(spelled), np.uint8), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), items)

    def find(self, low: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions among the spans, term) of the spans that are terms of the items."""
        if not len(self.keys) or not len(s):
            z = np.zeros(0, np.int64)
            return z, z
        values = C.spans_hash(low, s, e)
        at = np.minimum(np.searchsorted(self.keys, values), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == values)
        term = at[hit]
        sizes = (e - s)[hit]
        same = sizes == (self.starts[term + 1] - self.starts[term])
        hit, term, sizes = hit[same], term[same], sizes[same]
        good = np.ones(len(hit), bool)
        for size in np.unique(sizes):                   # bytes compared, all spans of a length at once
            rows = np.flatnonzero(sizes == size)
            step = max(1, C.SLICE_BYTES // int(size))
            for k in range(0, len(rows), step):
                r = rows[k:k + step]
                span = np.arange(size)
                good[r] = (low[s[hit[r]][:, None] + span] == self.texts[self.starts[term[r]][:, None] + span]).all(axis=1)
        return hit[good], term[good]


def _scan(batch: pa.RecordBatch, items: Items) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice of a batch: (slice, terms of every row, then row, term, count of every pair)."""
    for part in C.text_slices(batch):
        buf, offsets = C.flat_bytes(part.column(part.schema.get_field_index("text")))
        low = C.LOWER[buf]
        s, e, row = terms_of(low, offsets)
        hit, term = items.find(low, s, e)
        q = max(1, len(items.keys))
        pairs, counts = np.unique(row[hit] * q + term, return_counts=True)
        yield part, C.counts_by_row(row, part.num_rows), pairs // q, pairs % q, counts


def count_terms(docs: DataFrame, items: Items) -> Items:
    """The block with its terms' weights and the corpus' figures."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        df = np.zeros(len(items.keys), np.int64)
        for b in batches:
            for _, lengths, _, term, _ in _scan(b, items):
                n += int(np.count_nonzero(lengths))
                total += int(lengths.sum())
                df += np.bincount(term, minlength=len(df))
        held = np.flatnonzero(df)
        yield pa.record_batch({"term": pa.array([-2, -1, *held.tolist()], pa.int64()), "n": pa.array([n, total, *df[held].tolist()], pa.int64())})
    rows = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r["term"]: r["n"] for r in rows}          # as many as the block has terms, and two
    n = found.get(-2, 0)
    items.weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * found.get(t, 0) + 1))) for t in range(len(items.keys))], np.int64)
    items.total_docs, items.total_terms = n, found.get(-1, 0)
    return items


class _Block:
    """Documents with terms of the items, evaluated together."""

    def __init__(self, items: Items, ids: pa.Array, lengths: np.ndarray, doc: np.ndarray, term: np.ndarray, count: np.ndarray):
        self.items, self.ids = items, ids
        order = np.lexsort((term, doc))
        self.doc, self.term, count = doc[order], term[order], count[order]
        longest = int(lengths.max(initial=0))
        if SHARE * longest * items.total_docs < 1 << 62:
            m = BASE + (SHARE * lengths * items.total_docs) // items.total_terms
        else:
            m = np.array([BASE + SHARE * int(x) * items.total_docs // items.total_terms for x in lengths], np.int64)
        self.score = items.weights[self.term] * ((UNIT * count) // (TERM * count + LENGTH * m[self.doc]))
        self.first = np.searchsorted(self.doc, np.arange(len(ids) + 1))        # a document's pairs
        self.most = np.zeros(len(items.keys), np.int64)
        np.maximum.at(self.most, self.term, self.score)
        # bitmaps over the documents, for the terms that the block holds
        self.held, at = np.unique(self.term, return_inverse=True)
        self.bits = np.zeros((len(self.held), -(-len(ids) // 8)), np.uint8)
        np.bitwise_or.at(self.bits, (at, self.doc >> 3), (128 >> (self.doc & 7)).astype(np.uint8))
        self.row = np.full(len(items.keys), -1, np.int64)
        self.row[self.held] = np.arange(len(self.held))
        # null ids sort last
        self.rank = np.empty(len(ids), np.int64)
        self.rank[np.asarray(pc.sort_indices(ids), dtype=np.int64)] = np.arange(len(ids))
        self.times = np.zeros(len(items.keys), np.int64)

    def best(self, own: np.ndarray, times: np.ndarray, bar: int, top: int) -> list[tuple[int, int]]:
        """(score, document) of the best documents that reach ``bar``, ``top`` at most."""
        here = self.row[own] >= 0
        own, times = own[here], times[here]
        most = times * self.most[own]
        bar = max(bar, 1)
        if not len(own) or int(most.sum()) < bar:
            return []
        order = np.argsort(most, kind="stable")
        own, times, most = own[order], times[order], most[order]
        weak = int(np.searchsorted(np.cumsum(most), bar, "left"))              # together below the bar
        bits = self.bits[self.row[own]]
        chosen = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(bits[weak:], axis=0), count=len(self.ids)))
        present = (bits[:, chosen >> 3] >> (7 - (chosen & 7)).astype(np.uint8)) & 1
        bound = most @ present.astype(np.int64)
        near = bound >= bar                       # the same for all documents of a mask
        chosen, present, bound = chosen[near], present[:, near], bound[near]
        if not len(chosen):
            return []
        packed = np.ascontiguousarray(np.packbits(present, axis=0).T)
        _, lead, mask = np.unique(packed.view(f"V{packed.shape[1]}").ravel(), return_index=True, return_inverse=True)
        by_bound = np.argsort(-bound[lead], kind="stable")
        place = np.empty(len(by_bound), np.int64)
        place[by_bound] = np.arange(len(by_bound))
        docs = chosen[np.argsort(place[mask], kind="stable")]                  # masks by falling bound
        bounds = np.sort(bound)[::-1]
        self.times[own] = times
        scores, found, at, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 4 * top
        while at < len(docs) and bounds[at] >= bar:
            # whole masks: as far as the bound at the end of the step goes
            end = int(np.searchsorted(-bounds, -bounds[min(at + step, len(docs)) - 1], "right"))
            scores, found = np.concatenate([scores, self.evaluate(docs[at:end])]), np.concatenate([found, docs[at:end]])
            keep = np.lexsort((self.rank[found], -scores))[:top]
            scores, found = scores[keep], found[keep]
            if len(scores) == top:
                bar = max(bar, int(scores[-1]))
            at, step = end, 4 * step
        self.times[own] = 0
        return [(s, d) for s, d in zip(scores.tolist(), found.tolist()) if s >= 1]

    def evaluate(self, docs: np.ndarray) -> np.ndarray:
        """Exact scores of the documents for the item whose term counts are in ``times``."""
        first, sizes = self.first[docs], self.first[docs + 1] - self.first[docs]
        ends = np.cumsum(sizes)
        pairs = np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1])
        return np.add.reduceat(self.times[self.term[pairs]] * self.score[pairs], ends - sizes)


def _rank_key(row: tuple[int, object]) -> tuple:
    return (-row[0], row[1] is None, row[1] if row[1] is not None else 0)


def rank_block(docs: DataFrame, items: Items, top: int) -> DataFrame:
    """(item, id, score): the best documents per item, ``top`` of every task."""
    kind = docs.schema["id"].dataType
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("id", kind), T.StructField("score", T.LongType())])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, object]]] = [[] for _ in items.items]
        ids, lengths, doc, term, count, n, pairs, id_type = [], [], [], [], [], 0, 0, None

        def evaluate() -> None:
            nonlocal ids, lengths, doc, term, count, n, pairs
            if pairs:
                block = _Block(items, pa.chunked_array(ids).combine_chunks(), np.concatenate(lengths), np.concatenate(doc),
                               np.concatenate(term), np.concatenate(count))
                for i, (own, times) in enumerate(items.items):
                    bar = best[i][-1][0] if len(best[i]) == top else 0
                    got = block.best(own, times, bar, top)
                    if got:
                        named = [(s, block.ids[d].as_py()) for s, d in got]
                        best[i] = sorted(best[i] + named, key=_rank_key)[:top]
            ids, lengths, doc, term, count, n, pairs = [], [], [], [], [], 0, 0

        for b in batches:
            id_type = b.schema.field("id").type
            for part, size, row, which, times in _scan(b, items):
                ids.append(part.column(part.schema.get_field_index("id")))
                lengths.append(size)
                doc.append(row + n)
                term.append(which)
                count.append(times)
                n, pairs = n + part.num_rows, pairs + len(row)
                if n >= BLOCK_DOCS or pairs >= BLOCK_PAIRS:
                    evaluate()
        evaluate()
        rows = [(i, d, s) for i, own in enumerate(best) for s, d in own]
        if rows:
            yield pa.record_batch({"item": pa.array([r[0] for r in rows], pa.int32()), "id": pa.array([r[1] for r in rows], id_type),
                                   "score": pa.array([r[2] for r in rows], pa.int64())})

    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return (docs.mapInArrow(rank, schema).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of every item."""
    spark = C.prepare(docs.sparkSession)
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("item_text")).where("item_text IS NOT NULL").distinct()
    texts = C.save(asked.select("item_text").distinct())
    size = C.size_of(texts, "item_text")[1]
    blocks = max(1, -(-size // ITEM_BYTES))
    dealt = texts.withColumn("block", F.pmod(F.xxhash64("item_text"), F.lit(blocks)))
    done = []
    for b in range(blocks):
        own = [r["item_text"] for r in dealt.where(F.col("block") == b).collect()]
        if not own:
            continue
        block = count_terms(rows, Items.of(own))
        if not block.total_docs:
            continue
        named = spark.createDataFrame(list(enumerate(own)), "item int, item_text string")
        done.append(C.save(rank_block(rows, block, top).join(F.broadcast(named), "item")
                           .select(F.sha2("item_text", 256).alias("key"), "rank", "id", "score")))
    kind = docs.schema[id].dataType
    if not done:
        return asked.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(None).cast(kind).alias("doc_id"), F.lit(0).cast("long").alias("score"))
    ranked = done[0]
    for more in done[1:]:
        ranked = ranked.unionByName(more)
    ranked = ranked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = asked.select("item_id", F.sha2("item_text", 256).alias("key"), F.pmod(F.hash("item_id"), F.lit(SALTS)).alias("salt"))
    return (named.join(ranked, ["key", "salt"]).select("item_id", "rank", F.col("id").alias("doc_id"), "score"))


def oracle() -> str:
    """DuckDB SQL: every document scored for every item."""
    term = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"
    return f"""
WITH d AS (SELECT doc_id, text, row_number() OVER () AS r FROM documents WHERE text IS NOT NULL),
w AS (SELECT r, {term} FROM d),
tf AS (SELECT r, term, count(*) AS tf FROM w GROUP BY r, term),
len AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM len),
m AS (SELECT r, {BASE} + ({SHARE} * n * docs) // terms AS m FROM len, corpus),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT item_id, key, term, count(*) AS times FROM (
        SELECT item_id, text AS key, {term} FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY item_id, key, term),
weighed AS (SELECT item_id, key, term, times * floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM q JOIN df USING (term), corpus),
scored AS (SELECT item_id, key, r, sum(w * (({UNIT} * tf) // ({TERM} * tf + {LENGTH} * m)))::BIGINT AS score
           FROM weighed JOIN tf USING (term) JOIN m USING (r) GROUP BY item_id, key, r),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id, key ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank
           FROM scored JOIN d USING (r) WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= {TOP}"""
