"""Mixing sources to target weights by entropy balancing.

Sources in code-point order (null last) weigh 1, 2, 3 and so on around, and share all
words; a target stops at ``MAX_RATE`` times its source's size and its excess is shared
out again by weight.  Among all rates 0..MAX_RATE for a source's documents, those nearest
to 1 in relative entropy whose words add up to the target are exponentially tilted:

    rate = min(MAX_RATE, exp(tilt * size / mean size of the source)).

The convex dual has one unknown per source.  Its gradient is an aggregate over the
(source, size, count) table, so each Newton iteration is one Spark aggregate followed by a
step on the per-source state; a bracket guards the step, and nothing per document or source
comes to the driver but one residual.  Rates become copies chunk by chunk: from the largest
document to the smallest, each takes its rate rounded down or up, whichever brings the
chunk's words nearer to what its rates ask for, so a chunk misses its share by a few words.
Chunks are numbered from hashes and hold about ``CHUNK`` documents, so no source is one group.

Defined cases: null texts and texts without words have size 0, rate 1 for their share of
copies and take 0 words; a null source is a source; rows with equal ids are separate
documents (equal rows are told apart by their order, which does not change the result);
an empty table gives no rows.  Only id, text and source are read; ``mix`` passes all
columns on.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

WEIGHTS = (1, 2, 3)
MAX_RATE = 3.0
#: Documents that one rounding chunk holds on average.
CHUNK = 20_000
TOLERANCE, MAX_STEPS = 1e-9, 60


def word_count(text_col: str) -> F.Column:
    """Number of runs without space and 0x09-0x0D (null: 0)."""
    space = "\\t\\n\\x0B\\f\\r "
    body = F.regexp_replace(F.col(text_col), f"[{space}]+", " ")
    return F.coalesce(F.length(F.trim(body)) - F.length(F.replace(F.trim(body), F.lit(" ")))
                      + F.when(F.trim(body) == "", 0).otherwise(1), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_rate: float = MAX_RATE) -> DataFrame:
    """(source, source_size, docs) -> the same with weight and target (words).

    min(max_rate * size, weight * level), where ``level`` shares out what sources that stop
    at their limit leave: sources in order of limit / weight, the first that does not stop
    fixes it.  One row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    rows = sizes.withColumn("weight", w).withColumn("limit", F.col("source_size") * F.lit(float(max_rate)))
    fill = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = F.coalesce(F.sum("limit").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.sum("source_size").over(whole) - before) / rest)
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))).over(whole)
    return (rows.withColumn("share", level)
            .withColumn("target", F.least("limit", F.coalesce(F.col("weight") * F.col("share"), F.col("limit"))))
            .drop("limit", "level", "share"))


def tilts(table: DataFrame, goal: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """(source, size, n) and the targets -> (source, tilt, mean): Newton on the dual.

    ``tilt`` is null where a source has no words or is to be taken max_rate times whole."""
    stats = table.where("size > 0").groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"),
                                                         F.min("size").alias("least"))
    down = F.log(F.col("target") / F.col("source_size")) * F.col("mean") / F.col("least")
    up = F.lit(math.log(max_rate)) * F.col("mean") / F.col("least")
    open_ = (F.col("target") < max_rate * F.col("source_size") * (1 - 1e-12)) & (F.col("target") > 0)
    state = C.save(goal.alias("g").join(stats.alias("s"), F.expr("g.source <=> s.source"))
                   .select("g.source", "source_size", "target", "mean",
                           F.when(open_, F.lit(0.0)).alias("tilt"), F.least(down, F.lit(0.0)).alias("lo"), up.alias("hi")))
    cells = table.where("size > 0")
    exact = lambda x: F.sum(x.cast("decimal(28,9)")).cast("double")  # noqa: E731  the same in any order of rows
    for _ in range(MAX_STEPS):
        z = F.col("size") / F.col("mean")
        e = F.exp(F.least(F.col("tilt") * z, F.lit(math.log(max_rate))))
        free = F.col("tilt") * z < math.log(max_rate)
        sums = (cells.alias("c").join(state.where("tilt is not null").select("source", "mean", "tilt").alias("t"), F.expr("c.source <=> t.source"))
                .groupBy("t.source").agg(exact(F.col("n") * F.col("size") * e).alias("f"),
                                         exact(F.when(free, F.col("n") * F.col("size") * z * e).otherwise(0.0)).alias("d")))
        gap = F.col("f") - F.col("target")
        lo = F.when(gap < 0, F.greatest("lo", "tilt")).otherwise(F.col("lo"))
        hi = F.when(gap > 0, F.least("hi", "tilt")).otherwise(F.col("hi"))
        step = F.col("tilt") - gap / F.col("d")
        inside = (F.col("d") > 0) & (step > lo) & (step < hi)
        settled = F.abs(gap) <= TOLERANCE * F.col("target")
        state = C.save(state.alias("s").join(sums.alias("f"), F.expr("s.source <=> f.source"), "left")
                       .select("s.source", "source_size", "target", "mean",
                               F.when(F.col("f").isNull() | settled, F.col("tilt")).when(inside, step).otherwise((lo + hi) / 2).alias("tilt"),
                               F.when(F.col("f").isNull(), F.col("lo")).otherwise(lo).alias("lo"),
                               F.when(F.col("f").isNull(), F.col("hi")).otherwise(hi).alias("hi"),
                               F.coalesce(F.abs(gap) / F.col("target"), F.lit(0.0)).alias("off")))
        worst = state.agg(F.max(F.when(F.col("hi") - F.col("lo") > 1e-15, F.col("off")))).first()[0]
        state = state.drop("off")
        if worst is None or worst <= TOLERANCE:
            break
    return state.select("source", "source_size", "target", "mean", "tilt")


#: Sources whose figures are broadcast to the documents.
MAX_SOURCES = 100_000


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         weights: tuple = WEIGHTS, max_rate: float = MAX_RATE) -> DataFrame:
    """id, source, h (text hash), size, source_size, target, rate, copies, taken of every document."""
    C.prepare(docs.sparkSession)
    rows = C.save(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                              F.xxhash64(text_col).alias("h"), word_count(text_col).alias("size")))
    table = C.save(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    goal = C.save(targets(table.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"),
                                                     F.sum("n").alias("docs")), weights, max_rate))
    state = tilts(table, goal, max_rate)
    of = goal.alias("g").join(state.alias("s"), F.expr("g.source <=> s.source"), "left").select(
        "g.source", "g.source_size", "g.target", "g.docs", "mean", "tilt")
    rate = (F.when(F.col("size") == 0, 1.0).when(F.col("tilt").isNull(), F.when(F.col("target") > 0, max_rate).otherwise(0.0))
            .otherwise(F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(math.log(max_rate))))))
    of = C.save(of)
    if of.count() <= MAX_SOURCES:               # a row per source: beyond the bound the rows are shuffled to it
        of = F.broadcast(of)
    rows = (rows.alias("d").join(of.alias("o"), F.expr("d.source <=> o.source"))
            .select("id", "d.source", "h", "size", "source_size", "target", rate.alias("rate"),
                    F.pmod(F.xxhash64("id", "h"), F.ceil(F.col("docs") / CHUNK)).alias("chunk")))

    def rounded(chunk: pa.Table) -> pa.Table:
        """Largest documents first; each takes its rate rounded down or up, whichever leaves
        the chunk's words nearer to what its rates ask for so far."""
        chunk = chunk.sort_by([("size", "descending"), ("id", "ascending"), ("h", "ascending")])
        owed, copies = 0.0, []
        for r, size in zip(chunk["rate"].to_pylist(), chunk["size"].to_pylist(), strict=True):
            c = math.floor(r)
            if owed + (r - c) * size > size / 2 or (not size and r > c):
                c += r > c
            owed += (r - c) * size
            copies.append(c)
        return chunk.drop_columns(["chunk"]).append_column("copies", pa.array(copies, pa.int64()))

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("chunk").schema.fields)
    return (rows.groupBy("source", "chunk").applyInArrow(rounded, f"{kind}, copies long")
            .withColumn("taken", F.col("copies") * F.col("size")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The documents (all columns), each as often as its copies."""
    p = plan(docs, id_col, text_col, source_col, **how)
    n = {c: C.free_name(docs, c) for c in ("i", "s", "h", "sum", "n", "c", "copy")}
    # equal rows are told apart by their order: their copies are spread over them
    p = C.save(p.groupBy(F.col("id").alias(n["i"]), F.col("source").alias(n["s"]), F.col("h").alias(n["h"])).agg(
        F.sum("copies").alias(n["sum"]), F.count(F.lit(1)).alias(n["n"])).where(F.col(n["sum"]) > 0))
    same = (F.col(id_col).eqNullSafe(F.col(n["i"])) & F.col(source_col).eqNullSafe(F.col(n["s"]))
            & F.xxhash64(text_col).eqNullSafe(F.col(n["h"])))
    out = docs.join(p, same)
    nth = F.row_number().over(Window.partitionBy(n["i"], n["s"], n["h"]).orderBy(F.lit(0)))
    share = F.expr(f"{n['sum']} div {n['n']} + cast({n['c']} <= {n['sum']} % {n['n']} as int)")
    times = (out.where(F.col(n["n"]) == 1).withColumn(n["c"], F.col(n["sum"]))
             .union(out.where(F.col(n["n"]) > 1).withColumn(n["c"], nth).withColumn(n["c"], share)))
    return (times.where(F.col(n["c"]) > 0).withColumn(n["copy"], F.explode(F.sequence(F.lit(1), F.col(n["c"]).cast("int"))))
            .select(*[f"`{c}`" for c in docs.columns]))
