"""Near-duplicate groups by MinHash with tensored banding.

Words are runs without space and 0x09-0x0D, A-Z lower-cased; a document's set holds its
distinct ``shingle``-word sequences (the whole sequence where it has fewer words).

* Two collections of ``HALVES`` half keys are computed, each half key from ``ROWS``
  minhashes.  A table's key is a pair: one half of the first collection with one of the
  second, so HALVES**2 tables come from 2 * HALVES * ROWS minhashes.  A pair at
  likeness 0.8 misses all tables with probability 2 * (1 - 0.8**ROWS)**HALVES = 7e-5.
* Equal sets are one class, named by its smallest id, with one text: repeated rows and copies are
  compared once.  Half keys that no other class has are dropped before pairs are formed, so a
  document without near copies makes no key.
* Candidates are verified on the full sets, from the texts.  In a table's bucket, classes
  are first compared with the bucket's first class only, and links found join components.  A class
  that very many are compared with is dealt over tasks with its text (``PAIRS`` pairs each).
  What is left in different components of one bucket is settled exactly, block against
  block (``_settle``), so no candidate that could join two components is left out and no
  pairs of a group are ever rows.  A block is bounded by its shingles and by its sets, so
  neither long nor short texts make a large matrix.

Defined cases: texts without words have an empty set and are linked with nothing; a null id
has component null and is kept (it cannot be named); rows that share an id are one node
(their links are joined); an empty table gives no rows.  Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import stars as star_links

HALVES, ROWS = 10, 2
SHINGLE, PERCENT = 4, 80
#: Shingles of a block of sets that are compared with another block in one task.
BLOCK_SHINGLES = 1 << 18
#: Sets of such a block: two blocks' matrix of common counts has the square of it.
BLOCK_SETS = 1 << 10
#: Pairs with one class that a task verifies beside one copy of its text.
PAIRS = 512
#: Pairs that a task verifies.
TASK_PAIRS = 1 << 12
#: Tasks over which the members of one class are dealt when they get their class's name.
MEMBER_PARTS = 64


def _save(df: DataFrame) -> DataFrame:
    return C.stored(df, "near")


def shingle_rows(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets): each text's sorted distinct shingle values."""
    buf, offsets = C.flat_bytes(texts)
    buf = C.LOWER[buf]
    starts, ends, rows = C.words(buf, offsets)
    n = len(texts)
    value = C.spans_hash(buf, starts, ends)
    g = C.grams(value, k)
    inside = rows[k - 1:] == rows[:max(0, len(rows) - k + 1)] if len(rows) >= k else np.zeros(0, bool)
    per = np.bincount(rows, minlength=n)
    at = np.flatnonzero(np.isin(per, np.arange(1, k)))             # fewer words: the whole sequence
    first = np.searchsorted(rows, at)
    short = np.zeros(len(at), np.uint64)
    for size in range(1, k):
        here = per[at] == size
        if here.any():
            short[here] = C.grams(value, size, 100 + size)[first[here]]
    values, owner = np.concatenate([g[inside], short]), np.concatenate([rows[:len(g)][inside], at])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(n + 1))


def _signatures(docs: DataFrame, k: int, halves: int, rows: int) -> DataFrame:
    """id, h (the text's value), n (set size), s1 and s2 (the set's 128-bit value), a and b (half keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in C.text_slices(batch, "text"):
                v, off = shingle_rows(s.column(1), k)
                n = np.diff(off)
                full = np.flatnonzero(n)
                s1, s2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                half = np.zeros((2 * halves, len(n)), np.uint64)
                if len(full):
                    s1[full] = np.add.reduceat(C.mix(v, 1), off[full])
                    s2[full] = np.add.reduceat(C.mix(v, 2), off[full])
                    for h in range(2 * halves):
                        key = np.full(len(full), np.uint64(h))
                        for r in range(rows):
                            key = C.mix(key ^ np.minimum.reduceat(C.mix(v, 10 + h * rows + r), off[full]), 5)
                        half[h, full] = key
                keys = [pa.ListArray.from_arrays(pa.array(np.arange(0, (len(n) + 1) * halves, halves), pa.int32()),
                                                 pa.array(C.as_long(np.ascontiguousarray(x.T).reshape(-1)))) for x in (half[:halves], half[halves:])]
                yield pa.record_batch([s.column(0), s.column(2), pa.array(n.astype(np.int64)), pa.array(C.as_long(s1)), pa.array(C.as_long(s2)), *keys],
                                      ["id", "h", "n", "s1", "s2", "a", "b"])

    return docs.mapInArrow(run, "id long, h long, n long, s1 long, s2 long, a array<long>, b array<long>")


def _verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int, rows: int) -> DataFrame:
    """The (u, v) of ``pairs`` (stored, ``rows`` at most) whose full sets reach the likeness.

    u, the bucket's first class, may stand in very many pairs: they are dealt over tasks."""
    many = C.frequent(pairs, "u", PAIRS, rows)
    one = texts.select(F.col("c").alias("v"), F.col("text").alias("text_v"))
    two = C.to_slots(texts.select(F.col("c").alias("u"), F.col("text").alias("text_u")), many, "u")
    both = C.dealt(pairs, many, "u", "v").join(one, "v").join(two, ["u", "slot"]).select("u", "v", "text_u", "text_v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, v = b.column(0).to_numpy(), b.column(1).to_numpy()
            known, first, at = np.unique(u, return_index=True, return_inverse=True)
            x, xo = shingle_rows(b.column(2).take(pa.array(first)), k)
            y, yo = shingle_rows(b.column(3), k)
            good = np.zeros(len(u), bool)
            for i in range(len(u)):
                p, q = x[xo[at[i]]:xo[at[i] + 1]], y[yo[i]:yo[i + 1]]
                if len(p) and len(q) and 100 * min(len(p), len(q)) >= percent * max(len(p), len(q)):
                    both = int((p[np.minimum(np.searchsorted(p, q), len(p) - 1)] == q).sum())
                    good[i] = 100 * both >= percent * (len(p) + len(q) - both)
            yield pa.record_batch([pa.array(u[good]), pa.array(v[good])], ["u", "v"])

    return _save(C.narrowed(both, rows, TASK_PAIRS).mapInArrow(run, "u long, v long"))


def _placed(df: DataFrame, of: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the component (else the class itself) of ``column`` as ``name``."""
    here = of.select(F.col("node").alias(column), F.col("component").alias(name))
    return df.join(here, column, "left").withColumn(name, F.coalesce(name, column))


def _apart(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """The (u, v) pairs in different components."""
    return _placed(_placed(pairs, of, "u", "cu"), of, "v", "cv").where("cu <> cv").select("u", "v")


def _open(buckets: DataFrame, of: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """((bucket, rep, comp, u) of the buckets whose classes are in several components, u the smallest class; their number)."""
    m = _placed(buckets.select("bucket", "rep"), of, "rep", "comp")
    several = (m.groupBy("bucket").agg(F.min("comp").alias("a"), F.max("comp").alias("z"), F.min("rep").alias("u"))
               .where("a <> z").select("bucket", "u"))
    return C.counted(C.narrowed(m.join(several, "bucket"), rows), _save)


def _settle(of: DataFrame, buckets: DataFrame, rows: int, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links that still join components (``of``) inside one of the ``rows`` of ``buckets``, found exactly and without pair rows.

    Buckets that share a class make up a region.  A region's sets are dealt by hash into
    blocks of about BLOCK_SHINGLES shingles and BLOCK_SETS sets at most; every two blocks meet in one task, which counts
    the common shingles of all their pairs as a matrix product over the shingles that both
    have, and returns one link for two components at most."""
    now, rows = _open(buckets, of, rows)
    if not rows:
        return of.toDF("u", "v").limit(0)
    region = star_links(now.select("u", F.col("rep").alias("v")), rows)
    place = _save(C.narrowed(_placed(now.groupBy("rep").agg(F.min("comp").alias("comp")), region, "rep", "region"), rows))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in C.text_slices(batch, "text"):
                v, off = shingle_rows(s.column(3), k)
                yield pa.record_batch([*s.columns[:3], pa.array(np.diff(off)), pa.array([v[a:b].tobytes() for a, b in zip(off, off[1:], strict=False)], pa.binary())],
                                      ["rep", "comp", "region", "n", "sigs"])

    sets = _save(C.narrowed(texts.withColumnRenamed("c", "rep").join(place, "rep").select("rep", "comp", "region", "text"), rows, BLOCK_SETS)
                 .mapInArrow(spread, "rep long, comp long, region long, n long, sigs binary"))
    # stored: the join on it does not bring a region's blocks into one task
    sizes = _save(C.narrowed(sets.groupBy("region").agg(F.ceil(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count(F.lit(1)) / BLOCK_SETS)).cast("int").alias("blocks")), rows))
    dealt = (sets.join(sizes, "region").withColumn("block", F.expr("cast(pmod(xxhash64(rep), blocks) as int)"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("region", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "comp", "n", "sigs")
             .repartition("region", "i", "j"))

    def compare(part: pa.Table) -> pa.Table:
        part = part.sort_by([("rep", "ascending")])
        rep, comp, n, block = (part[c].to_numpy() for c in ("rep", "comp", "n", "block"))
        i, j = part["i"][0].as_py(), part["j"][0].as_py()
        found = [np.zeros((0, 2), np.int64)]
        if (comp != comp[0]).any():
            token, inv = np.unique(np.frombuffer(b"".join(part["sigs"].to_pylist()), np.uint64), return_inverse=True)
            owner = np.repeat(np.arange(len(n)), n)
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            side = np.zeros((2, len(n)), bool)
            side[0, left], side[1, right] = True, True
            has = [np.bincount(inv[side[x][owner]], minlength=len(token)) for x in (0, 1)]
            useful = np.flatnonzero((has[0] > 0) & (has[1] > 0) & ((has[0] + has[1]) > (2 if i == j else 1)))
            common = np.zeros((len(left), len(right)), np.float32)
            at = np.full(len(token), -1, np.int64)
            row = np.full(len(n), -1, np.int64)
            for a in range(0, len(useful), 2048):
                cols = useful[a:a + 2048]
                at[:] = -1
                at[cols] = np.arange(len(cols))
                inside = np.flatnonzero(at[inv] >= 0)
                both = []
                for own in (left, right):
                    row[:] = -1
                    row[own] = np.arange(len(own))
                    here = inside[row[owner[inside]] >= 0]
                    m = np.zeros((len(own), len(cols)), np.float32)
                    m[row[owner[here]], at[inv[here]]] = 1
                    both.append(m)
                common += both[0] @ both[1].T
            x, y = np.nonzero(100 * common >= percent * (n[left][:, None] + n[right][None, :] - common))
            x, y = left[x], right[y]
            apart = comp[x] != comp[y]
            x, y = x[apart], y[apart]
            lo, hi = np.minimum(comp[x], comp[y]), np.maximum(comp[x], comp[y])
            _, one = np.unique(np.stack([lo, hi], 1), axis=0, return_index=True)     # a link for two components
            found.append(np.stack([np.minimum(rep[x[one]], rep[y[one]]), np.maximum(rep[x[one]], rep[y[one]])], 1))
        links = np.concatenate(found)
        return pa.table([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["u", "v"])

    return _save(dealt.groupBy("region", "i", "j").applyInArrow(compare, "u long, v long"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                percent: int = PERCENT, halves: int = HALVES, rows: int = ROWS) -> DataFrame:
    """id, n_shingles, component_id, kept of every document."""
    C.prepare(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    signs, rows = C.counted(_signatures(src, shingle, halves, rows), _save)
    named = signs.where("id is not null and n > 0")
    # a class is a node of its own: two texts of one id may be in two classes
    classes = (named.groupBy("n", "s1", "s2").agg(F.min(F.struct("id", "h")).alias("own"), F.count(F.lit(1)).alias("members"),
                                                  F.first("a").alias("a"), F.first("b").alias("b")))
    classes, kinds = C.counted(C.narrowed(classes, rows * halves).withColumn("rep", F.monotonically_increasing_id()), _save)

    # tensored keys, from the half keys that two classes share
    one = classes.select("rep", F.posexplode(F.concat("a", "b")).alias("i", "h"))
    many = one.groupBy("i", "h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("i", "h")
    halved = C.narrowed(one.join(many, ["i", "h"]), kinds * halves).groupBy("rep").agg(F.collect_list(F.struct("i", "h")).alias("x"))
    tables = (halved.select("rep", F.explode(F.filter("x", lambda x: x.i < halves)).alias("x"), F.filter("x", lambda y: y.i >= halves).alias("y"))
              .select("rep", "x", F.explode("y").alias("y")).select(F.xxhash64("x.i", "x.h", "y.i", "y.h").alias("bucket"), "rep"))
    tables, rows = C.counted(C.narrowed(tables, kinds * halves), _save)
    centres = tables.groupBy("bucket").agg(F.min("rep").alias("centre"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    buckets, rows = C.counted(C.narrowed(tables.join(centres, "bucket"), rows), _save)

    stars, pairs = C.counted(C.narrowed(buckets.where("rep <> centre").select(F.col("centre").alias("u"), F.col("rep").alias("v")).distinct(), rows), _save)
    involved = buckets.select("rep").distinct()
    owners = _save(C.narrowed(classes.join(involved, "rep").select("own.id", "own.h", F.col("rep").alias("c")), kinds))
    # one text a class, whatever rows share its id and text; the same join at every size, so that figures of small tables carry on
    texts = _save(src.join(owners.hint("merge"), ["id", "h"]).groupBy("c").agg(F.first("text").alias("text")))

    # rows of one id are one node, whichever classes they are in; a class of very many members is dealt by them
    part = F.pmod(F.xxhash64("id"), F.lit(MEMBER_PARTS)).alias("part")
    groups = (classes.where("members > 1").select("n", "s1", "s2", F.col("own.id").alias("v"),
                                                  F.explode(F.sequence(F.lit(0), F.lit(MEMBER_PARTS - 1))).alias("part")))
    same = (named.select(F.col("id").alias("u"), "n", "s1", "s2", part)
            .join(groups.withColumn("part", F.col("part").cast("long")), ["n", "s1", "s2", "part"]).select("u", "v"))
    # the smallest centre of each class first, then the other centres that still join two components
    first = _save(C.narrowed(stars.groupBy("v").agg(F.min("u").alias("u")).select("u", "v"), pairs))
    of = star_links(_verify(first, texts, shingle, percent, pairs), pairs)
    more, pairs = C.counted(C.narrowed(_apart(stars.join(first, ["u", "v"], "left_anti"), of), pairs), _save)
    if pairs:
        of = star_links(of.toDF("u", "v").union(_verify(more, texts, shingle, percent, pairs)), pairs + kinds)
    linked = of.toDF("u", "v").union(_settle(of, buckets, rows, texts, shingle, percent))
    linked = (linked.join(owners.select(F.col("c").alias("u"), F.col("id").alias("x")), "u")
              .join(owners.select(F.col("c").alias("v"), F.col("id").alias("y")), "v").select("x", "y"))
    of = star_links(linked.toDF("u", "v").union(same))
    out = (signs.select("id", "n").join(of, F.col("id") == F.col("node"), "left")
           .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents (all columns) without those that are not their group's smallest id."""
    name = C.free_name(docs, "gone")
    gone = near_groups(docs, id_col, text_col, **how).where("not kept").select(F.col(id_col).alias(name)).distinct()
    return docs.join(_save(gone), F.col(id_col) == F.col(name), "left_anti")


def oracle(shingle: int = SHINGLE, percent: int = PERCENT) -> str:
    """DuckDB SQL of the query over ``documents`` (ids not null): all pairs that share a shingle."""
    return f"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') as w from documents),
v as (select doc_id, w, unnest(range(greatest(1, len(w) - {shingle - 1}))) as i from d where len(w) > 0),
s as (select distinct doc_id, array_to_string(w[i + 1:i + {shingle}], ' ') as g from v),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as x, b.doc_id as y, count(*) as common from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select x, y from c join n p on p.doc_id = x join n q on q.doc_id = y where 100 * common >= {percent} * (p.n + q.n - common)),
e as (select x, y from l union all select y, x from l),
reach as (select x as doc_id, x as other from e union select r.doc_id, e.y from reach r join e on e.x = r.other),
m as (select doc_id, min(other) as least from reach group by doc_id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(m.least, d.doc_id) as component_id, coalesce(m.least, d.doc_id) = d.doc_id as kept
from d left join n on n.doc_id = d.doc_id left join m on m.doc_id = d.doc_id
"""
