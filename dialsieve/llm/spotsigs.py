"""SpotSigs document fingerprints.

A text is lower-cased and cut into runs of letters and digits.  Every common word
(``ANCHORS``) that is followed by content words starts a chain: the anchor and up to
``CHAIN`` content words after it, ``DISTANCE`` apart.  Where common words are sparse, words
of the text itself are anchors too: of every ``WINDOW`` consecutive words without a common
word that has content at most ``WINDOW`` words after it, the word of smallest hash (the last
of equal ones) starts a chain of the words after it.  Such a choice depends on those words
alone, never on the rest of the text, so what two texts share has the same chains in both,
and every text has at least one chain for each ``WINDOW`` words (a shorter one has one).
The set of the chains' 32-bit values is the signature set; its sorted hexadecimal text is
the fingerprint.

* ``fingerprints``: the set of every document.
* ``near_pairs``: similarity join.  Equal sets collapse into classes; classes are
  partitioned by set length, so that sets which can reach the threshold meet in the same
  or the next partition, and are compared only if they share one of the rare signatures
  that a pair above the threshold must share (rarest first); the Jaccard value is then
  exact.
* ``edited_digest``: the fingerprint next to that of an edited text, in which the last
  half gives way to the beginning of the following document.

Defined cases: null and empty texts, and texts without letters or digits, have the empty
set, whose likeness is 1.0 to an empty set and 0.0 to any other; null ids come first; rows
with equal ids follow each other by text; the only document is its own next one; an empty
table gives no rows.  Only id and text are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: Common words of English, German, French and Spanish (parameter of every function).
ANCHORS = frozenset("""
a an and are as at be by for from in is it of on or that the this to was were with
das dem den der des die ein eine für ist mit und von zu
au avec dans de des du en est et la le les pas pour que qui sur un une
con de del el en es la las los no o para por que se un una y
""".split())
CHAIN, DISTANCE = 3, 2
#: Words without an anchor that give one of their own; as dense as common words are in ordinary text (2 in 7).
WINDOW = 6
THRESHOLD = 0.8

_WORD = re.compile(r"[^\W_]+").findall
_EMPTY = np.zeros(0, np.uint32)


def _own_anchors(words: list[str], covered: list[int], window: int) -> Iterator[int]:
    """Places of the smallest word hashes of all windows that hold no place of ``covered``."""
    from zlib import crc32
    before = -1
    for stop in (*covered, len(words)):
        first, size = before + 1, min(window, len(words))
        before = stop
        if stop - first < size:
            continue
        rank = [(crc32(w.encode("utf-8", "replace")), -i) for i, w in enumerate(words[first:stop], first)]
        last = None
        for i in range(len(rank) - size + 1):
            at = -min(rank[i:i + size])[1]
            if at != last:
                yield at
                last = at


def signature(text: str | None, anchors: frozenset = ANCHORS, chain: int = CHAIN, distance: int = DISTANCE,
              window: int = WINDOW) -> np.ndarray:
    """Sorted distinct values of a text's chains."""
    words = _WORD(text.lower()) if text else []
    if not words:
        return _EMPTY
    from zlib import crc32
    spots, content, covered, waiting = [], [], [], []
    for i, w in enumerate(words):
        if w in anchors:
            spots.append((w, len(content)))
            waiting.append(i)
        else:
            content.append(w)
            if waiting:
                covered += [x for x in waiting[-window:] if i - x <= window]
                waiting = []
    reach = chain * distance
    found = {f"{a} {' '.join(content[i:i + reach:distance])}" for a, i in spots if i < len(content)}
    found.update(" ".join(words[i:i + 1 + reach:distance]) for i in _own_anchors(words, covered, window))
    return np.unique(np.array([crc32(x.encode("utf-8", "replace")) for x in found], np.uint32))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def as_text(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, sigs (sorted longs) of every document; map-only."""
    C.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sigs = pa.array([signature(t).astype(np.int64) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))
            yield pa.record_batch([b.column(0), sigs], [id_col, "sigs"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("sigs", T.ArrayType(T.LongType()))])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def near_pairs(prints: DataFrame, id_col: str = "doc_id", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(pairs of class representatives a < b with their Jaccard value, id -> class).

    The class of equal sets is its smallest id; documents with an empty set are in no pair."""
    C.prepare(prints.sparkSession)
    sets = prints.where(f"`{id_col}` is not null").select(F.col(id_col).alias("id"), "sigs", F.xxhash64("sigs").alias("h"))
    reps = C.save(sets.groupBy("sigs").agg(F.min("id").alias("rep")))
    member = sets.join(reps, "sigs").select(F.col("id").alias(id_col), F.col("rep").alias("class_id"))
    rows = reps.where("size(sigs) > 0").select("rep", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    freq = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("f"))
    base = math.log(1 / threshold) if threshold < 1 else 1.0
    rare = (rows.join(freq, "sig").where("f > 1")                       # a signature of one class makes no pair
            .groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("f", "sig"))).alias("by_f"))
            # rarest first; the signatures of this class alone would come before all others
            .withColumn("keep", F.expr(f"n - cast(ceil({threshold} * n - 1e-9) as int) + 1 - (n - size(by_f))"))
            .where("keep > 0")
            .select("rep", "n", F.floor(F.log("n") / base).cast("int").alias("part"),
                    F.explode(F.expr("slice(by_f, 1, keep)")).alias("x"))
            .select("rep", "n", "part", F.col("x.sig").alias("sig")))
    rare = C.save(rare)
    other = (rare.select(F.col("rep").alias("rep2"), F.col("n").alias("n2"), "sig",
                         F.explode(F.array("part", F.col("part") + 1)).alias("part")))
    # a: the longer set (or, of equal lengths, the larger id)
    pairs = (rare.join(other, ["part", "sig"])
             .where(f"(n2 < n or (n2 = n and rep2 < rep)) and n2 >= {threshold} * n - 1e-9").select("rep", "rep2").distinct())
    one, two = reps.select("rep", F.col("sigs").alias("s1")), reps.select(F.col("rep").alias("rep2"), F.col("sigs").alias("s2"))
    both = F.size(F.array_intersect("s1", "s2"))
    found = (pairs.join(one, "rep").join(two, "rep2")
             .select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b"),
                     (both / (F.size("s1") + F.size("s2") - both)).alias("jaccard")).where(f"jaccard >= {threshold} - 1e-9"))
    return found, member


def edited_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = 32 << 20,
                  max_ranges: int = 4096) -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Texts travel once, compressed, to ranges of their id; the first documents of a range
    also go to the range before it (those of the first to the last), so that every document
    meets its next one.  Range bounds are ids that exist, at most ``max_ranges`` of them."""
    C.prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    lowest = -(1 << 63)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(lowest))
    n, size = C.size_of(docs, text_col)
    parts = int(min(max_ranges, max(1, -(-size // range_bytes))))
    stops = [i / parts for i in range(1, parts)]
    got = docs.agg(F.min(key).alias("low"), *([F.percentile_approx(key, stops, 100_000).alias("mid")] if stops else [])).first()
    bounds = np.array(sorted({got["low"], *(got["mid"] or [] if stops else [])} if n else {0}), np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        small = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            keys = np.asarray(b.column(0))
            part = np.searchsorted(bounds, keys, "right") - 1
            ahead = np.flatnonzero(bounds[part] == keys)
            at = np.concatenate([np.arange(len(keys)), ahead])
            packed = [small((t or "").encode("utf-8", "replace")) for t in b.column(2).to_pylist()]
            yield pa.record_batch([pa.array(np.concatenate([part, (part[ahead] - 1) % len(bounds)]), pa.int32()),
                                   pa.array(np.arange(len(at)) >= len(keys)), b.column(0).take(pa.array(at)),
                                   b.column(1).take(pa.array(at)), pa.array([packed[i] for i in at], pa.binary())],
                                  ["part", "ahead", "key", "h", "z"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        whole = zstandard.ZstdDecompressor().decompress
        before, out = None, []                      # (part, key, text, signature) not yet paired

        def pair(cur, text, sig) -> tuple:
            _, k, own, own_sig = cur
            half = len(own) // 2
            edited = own[:len(own) - half] + text[:half]
            edited_sig = signature(edited)
            return (None if k == lowest else k, len(own), hashlib.sha256(edited.encode()).hexdigest(), as_text(own_sig),
                    as_text(edited_sig), likeness(own_sig, edited_sig), likeness(own_sig, sig))

        def batch() -> pa.RecordBatch:
            c = list(zip(*out, strict=True))
            out.clear()
            return pa.record_batch([pa.array(c[0], pa.int64()).cast(id_type), pa.array(c[1], pa.int64()), *(pa.array(x, pa.string()) for x in c[2:5]),
                                    *(pa.array(x, pa.float64()) for x in c[5:])], schema.names)

        for b in batches:
            for part, ahead, k, z in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if ahead and (before is None or before[0] != part):
                    continue                        # of several first documents, the first is the next one
                text = whole(z).decode()
                sig = signature(text)
                if before is not None and before[0] == part:
                    out.append(pair(before, text, sig))
                before = None if ahead else (part, k, text, sig)
            if out:
                yield batch()

    id_type = {"int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}.get(kind.simpleString(), pa.int64())
    text_field = lambda c: T.StructField(c, T.StringType())
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("n_chars", T.LongType()), text_field("edited_sha256"),
                           text_field("fingerprint"), text_field("edited_fingerprint"),
                           T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])
    return (docs.select(key.alias("key"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("h"), F.col(text_col).alias("text"))
            .mapInArrow(deal, "part int, ahead boolean, key long, h long, z binary")
            .repartitionById(len(bounds), "part").sortWithinPartitions("part", "ahead", "key", "h")
            .mapInArrow(digest, schema))
