"""Line dedup by a suffix array over line sequences; DataFrame operations only.

Every document is the sequence of its lines (pieces between line feeds) that are not blank,
every line an id (128 hash bits).  Distributed prefix doubling ranks the suffixes that begin
with a line that occurs twice anywhere: a round pairs a suffix's rank with the rank of the
suffix ``size`` lines further on, counts the pairs and ranks them in order by a range
partition, so equal ranks mean equal first 2 * ``size`` lines.  Doubling ends when no pair has
two members.  A suffix that becomes the only one of its pair keeps its place and its two neighbours
in that order, and the longest prefix it shares with them follows from the ranks of all rounds, the
longest step first: that is its maximal repeated run (``longest_run`` is a document's longest).

Every interval of suffixes with a common prefix of ``min_lines`` lines knows its first member
(by id, then text hash, then line); what the other members cover is a later copy and is
deleted.  A single repeated line is a run too when it has at least ``min_chars`` characters:
with 1, the default, every one.

Only suffixes of repeated lines take part, a round moves about 40 bytes for each, and partial
counts are taken before every shuffle, so a line that a third of the corpus repeats is no hot group.

Defined cases: null and empty texts have 0 lines; blank lines are never deleted, and a run goes
on over them; null ids come first; rows that are equal in id and text are one document and get
the same result; texts differ by their 64-bit hash where ids are equal; an empty table gives no
rows.  Only id and text are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

MIN_LINES, MIN_CHARS = 2, 1
#: Sorted before every real id (ids are whole numbers).
NO_ID = -(1 << 63)


def _save(df: DataFrame) -> DataFrame:
    return C.stored(df, "lines")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("k"),
                       F.xxhash64(text).alias("h"), text.alias("text"))


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k, h, pos, at, l1, l2, chars) of every line that is not blank: ``at`` counts all lines, ``pos`` these."""
    numbered = F.expr(r"filter(transform(split(text, '\n'), (x, i) -> struct(i AS at, x AS line)), x -> trim(x.line) <> '')")
    return (_keyed(docs, id_col, text_col).select("k", "h", F.posexplode(numbered).alias("pos", "x"))
            .select("k", "h", "pos", "x.at", F.xxhash64("x.line").alias("l1"), F.xxhash64(F.lit(1), "x.line").alias("l2"),
                    F.length("x.line").alias("chars")))


def _ranked(rows: DataFrame, keys: list[str], single: bool = True) -> DataFrame:
    """Groups of equal ``keys`` in order: members, first and last member, ``rank`` (how many members stand
    before), ``start`` (how many before the first group with the same first key), and the first members of
    the groups before and after that have the same first key (else null).  Without ``single``, only groups
    with two members or more.

    The groups are dealt out by range; what a range needs from the others (members ahead, where the first
    key's groups begin, the group before, the group after) is one row a range."""
    place = F.struct("k", "h", "pos")
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("members"), F.min(place).alias("first"), F.max(place).alias("last"))
    if not single:
        groups = groups.where("first < last")
    dealt = _save(groups.withColumnRenamed(keys[0], "a").repartitionByRange("a", *keys[1:]).withColumn("range", F.spark_partition_id()))
    rest, ranges = F.struct(*keys[1:]), Window.orderBy("range")
    edge = (dealt.groupBy("range", "a").agg(F.sum("members").alias("n"), F.min_by("first", rest).alias("low"), F.max_by("first", rest).alias("high"))
            .groupBy("range").agg(F.sum("n").alias("n"), F.min_by(F.struct("a", F.col("low").alias("first")), "a").alias("low"),
                                  F.max_by(F.struct("a", F.col("high").alias("first")), "a").alias("high"), F.max_by("n", "a").alias("tail"))
            .withColumn("begin", F.coalesce(F.sum("n").over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("opened", F.min(F.col("begin") + F.col("n") - F.col("tail")).over(Window.partitionBy("high.a")))
            .select(F.col("range").alias("of"), "begin", F.lag("opened").over(ranges).alias("opened"),
                    F.lag("high").over(ranges).alias("high"), F.lead("low").over(ranges).alias("low")))
    inside, me = Window.partitionBy("range").orderBy("a", *keys[1:]), F.struct("a", "first")
    same = lambda x: F.when(x["a"] == F.col("a"), x["first"])
    return (dealt.withColumn("ahead", F.coalesce(F.sum("members").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("p", F.lag(me).over(inside)).withColumn("n", F.lead(me).over(inside))
            .withColumn("local", F.min("ahead").over(Window.partitionBy("range", "a")))
            .join(edge, F.col("range") == F.col("of"))
            .select(F.col("a").alias(keys[0]), *keys[1:], "members", "first", "last", (F.col("begin") + F.col("ahead")).alias("rank"),
                    F.coalesce(F.when(F.col("high.a") == F.col("a"), F.col("opened")), F.col("begin") + F.col("local")).alias("start"),
                    same(F.coalesce("p", "high")).alias("before"), same(F.coalesce("n", "low")).alias("after")))


_LATER = "struct(k, h, pos) > first AS later"


def _ahead(ranks: DataFrame, step: int) -> DataFrame:
    return ranks.select("k", "h", (F.col("pos") - step).alias("pos"), F.col("rank").alias("r2"))


def repeated_lines(lines: DataFrame) -> DataFrame:
    """Suffixes that begin with a repeated line: k, h, pos, at, chars, rank, later (not the first of its interval)."""
    first = _ranked(lines, ["l1", "l2"], single=False).select("l1", "l2", "rank", "first")
    # rows that are equal in id and text are one document: one suffix each, so a round joins one to one
    return _save(lines.join(first, ["l1", "l2"]).select("k", "h", "pos", "at", "chars", "rank", F.expr(_LATER)).distinct())


def prefix_doubling(rows: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """(rounds, near) of ``repeated_lines``.  Round j: k, h, pos, rank, later of the suffixes whose first 2**j
    lines are repeated.  near[j]: the suffixes that round j + 1 sets apart, beside their neighbours q."""
    rounds, near = [rows.select("k", "h", "pos", "rank", "later")], []
    alone = rows.where("false").select("k", "h", "pos", "rank")      # a place of their own in the order
    while True:
        size, now = 1 << (len(rounds) - 1), rounds[-1]
        ahead = _ahead(now.select("k", "h", "pos", "rank").union(alone), size)
        # no rank ahead: the text ends there or goes on with a line that occurs once, so nothing else goes on alike
        paired = _save(now.select("k", "h", "pos", F.col("rank").alias("r1")).join(ahead, ["k", "h", "pos"], "left")
                        .withColumn("own", F.when(F.col("r2").isNull(), F.struct("k", "h", "pos"))))
        groups = _save(_ranked(paired, ["r1", "r2", "own"]).withColumn("rank", F.expr("r1 + rank - start")))
        apart = groups.where("first = last")
        near.append(apart.where("own IS NULL").select("first.*", F.explode(F.array_compact(F.array("before", "after"))).alias("q")))
        more = groups.where("first < last").select("r1", "r2", "rank", "first")
        if more.isEmpty():
            return rounds, near
        alone = _save(alone.union(apart.select("first.*", "rank")))
        rounds.append(_save(paired.join(more, ["r1", "r2"]).select("k", "h", "pos", "rank", F.expr(_LATER))))


def longest_runs(rounds: list[DataFrame], near: list[DataFrame]) -> DataFrame:
    """k, h, pos, lines: the most lines from there on that also stand elsewhere."""
    whole, pairs = rounds[0].select("k", "h", "pos", F.lit(1).alias("lines")), None
    for j, ranks in enumerate(rounds[1:], 1):
        whole = whole.union(ranks.select("k", "h", "pos", F.lit(1 << j)))
    for j in range(len(rounds) - 1, 0, -1):        # suffixes that share 2**j lines, not 2**(j + 1); of round 0: one line
        new = near[j].withColumn("lines", F.lit(1 << j))
        pairs, i = new if pairs is None else pairs.union(new), j - 1
        ranks = rounds[i]
        mine = ranks.select(F.col("k").alias("k1"), F.col("h").alias("h1"), F.col("pos").alias("p1"), F.col("rank").alias("m"))
        its = ranks.select(F.col("k").alias("k2"), F.col("h").alias("h2"), F.col("pos").alias("p2"), F.col("rank").alias("o"))
        pairs = _save(
            pairs.join(mine, (F.col("k") == F.col("k1")) & (F.col("h") == F.col("h1")) & (F.col("pos") + F.col("lines") == F.col("p1")), "left")
            .join(its, (F.col("q.k") == F.col("k2")) & (F.col("q.h") == F.col("h2")) & (F.col("q.pos") + F.col("lines") == F.col("p2")), "left")
            .select("k", "h", "pos", "q", (F.col("lines") + F.when(F.col("m") == F.col("o"), 1 << i).otherwise(0)).alias("lines")))
    if pairs is not None:
        whole = whole.union(pairs.select("k", "h", "pos", "lines"))
    return whole.groupBy("k", "h", "pos").agg(F.max("lines").alias("lines"))


def shared_prefix(rounds: list[DataFrame], n: int) -> DataFrame:
    """k, h, pos, rank, later of the suffixes whose first ``n`` lines are repeated: two overlapping powers of two."""
    j = n.bit_length() - 1
    if j >= len(rounds):
        return rounds[-1].where("false").select("k", "h", "pos", "rank", "later")
    ranks, step = rounds[j].select("k", "h", "pos", "rank", "later"), n - (1 << j)
    if not step:
        return ranks
    paired = _save(ranks.select("k", "h", "pos", F.col("rank").alias("r1")).join(_ahead(ranks, step), ["k", "h", "pos"]))
    found = _ranked(paired, ["r1", "r2"], single=False).select("r1", "r2", "rank", "first")
    return paired.join(found, ["r1", "r2"]).select("k", "h", "pos", "rank", F.expr(_LATER))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES,
                 min_chars: int = MIN_CHARS) -> DataFrame:
    """id, n_lines, n_removed, n_runs, longest_run, kept_text per row of ``docs``."""
    C.prepare(docs.sparkSession)
    rows = repeated_lines(lines_of(docs, id_col, text_col))
    rounds, near = prefix_doubling(rows)
    single = rows.where(F.col("later") & (F.col("chars") >= min_chars)).select("k", "h", "pos")
    covered = (shared_prefix(rounds, min_lines).where("later")
               .select("k", "h", F.explode(F.sequence("pos", F.col("pos") + min_lines - 1)).alias("pos")))
    order = Window.partitionBy("k", "h").orderBy("pos")
    # a run goes on over blank lines (pos), its lines are cut where they stand (at)
    spans = (rows.select("k", "h", "pos", "at").join(single.union(covered).distinct(), ["k", "h", "pos"])
             .withColumn("opens", (F.col("pos") - F.coalesce(F.lag("pos").over(order), F.lit(-9)) > 1).cast("int"))
             .withColumn("island", F.col("at") - F.row_number().over(order))
             .groupBy("k", "h", "island").agg(F.min("at").alias("s"), (F.max("at") + 1).alias("e"), F.sum("opens").alias("opens"))
             .groupBy("k", "h").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("cut"), F.sum("opens").alias("runs"),
                                    F.lit(None).cast("int").alias("longest")))
    facts = _save(spans.unionByName(longest_runs(rounds, near).groupBy("k", "h").agg(F.max("lines").alias("longest")), allowMissingColumns=True)
                   .groupBy("k", "h").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("cut", "runs", "longest")]))
    whole = _keyed(docs, id_col, text_col).select("id", "k", "h", F.split("text", "\n").alias("lines"),
                                                  (F.col("text") == "").alias("empty"))
    kept = """flatten(transform(zip_with(concat(array(0), cut.e), concat(cut.s, array(size(lines))), (s, e) -> struct(s, e)),
                                g -> slice(lines, g.s + 1, g.e - g.s)))"""
    return (whole.join(facts, ["k", "h"], "left")
            .select(F.col("id").alias(id_col), F.when(F.col("empty"), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
                    F.coalesce(F.expr("aggregate(cut, 0L, (n, c) -> n + c.e - c.s)"), F.lit(0)).cast("long").alias("n_removed"),
                    F.coalesce("runs", F.lit(0)).cast("long").alias("n_runs"),
                    F.coalesce("longest", F.lit(0)).cast("long").alias("longest_run"),
                    F.array_join(F.when(F.col("cut").isNull(), F.col("lines")).otherwise(F.expr(kept)), "\n").alias("kept_text")))


#: Every later copy of a repeated line goes, alone or in a run (``MIN_CHARS`` is 1).  A run that stands at two
#: places is an island of equal lines on one diagonal.
ORACLE = """
with d as (select doc_id, coalesce(text, '') as text, row_number() over (order by doc_id nulls first, coalesce(text, '')) as k from documents),
l as (select k, unnest(range(len(string_split(text, chr(10))))) as nth, unnest(string_split(text, chr(10))) as line from d),
a as (select k, nth, line, row_number() over (partition by k order by nth) as pos from l where trim(line) <> ''),
b as (select *, row_number() over (partition by line order by k, pos) > 1 as gone from a),
c as (select *, gone and not coalesce(lag(gone) over (partition by k order by pos), false) as opens from b),
p as (select x.k, y.k as k2, x.pos, x.pos - y.pos as diagonal from a x join a y on x.line = y.line and (x.k <> y.k or x.pos <> y.pos)),
q as (select k, k2, diagonal, pos - row_number() over (partition by k, k2, diagonal order by pos) as island from p),
r as (select k, max(n) as longest from (select k, count(*) as n from q group by k, k2, diagonal, island) group by k)
select any_value(d.doc_id) as doc_id, case when any_value(d.text) = '' then 0 else count(*) end::bigint as n_lines,
  coalesce(sum(c.gone::int), 0)::bigint as n_removed, coalesce(sum(c.opens::int), 0)::bigint as n_runs,
  coalesce(any_value(r.longest), 0)::bigint as longest_run,
  sha256(coalesce(string_agg(l.line, chr(10) order by l.nth) filter (not coalesce(c.gone, false)), '')) as kept_sha256
from l join d using (k) left join c on c.k = l.k and c.nth = l.nth left join r on r.k = l.k group by l.k
"""
