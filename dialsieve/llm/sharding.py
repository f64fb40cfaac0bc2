"""Shards of near equal bytes by minimax contiguous partition (DataFrame functions only).

Equal texts are one atomic group.  Groups stand in the order of their text's SHA-256, so
their order, and with it every shard, depends on the texts alone.  A group that is larger
than an equal share of what is left (at most ``shards - 1`` of them) gets a shard of its
own.  The other groups are cut, in their order, into the remaining shards: a binary search
finds the smallest capacity with which greedy filling needs no more shards than there are,
and the cuts stand where greedy filling with that capacity puts them.

The groups' sizes never come to the driver.  It holds a bounded list of known group ends
(running byte sums): filling at known ends only is feasible no sooner than the true
filling, filling that may cut anywhere inside an unknown stretch no later.  Both searches
give a bracket for the capacity; the stretches that any cut in the bracket can fall into
are split by one filtered aggregate over the stored sums, until the bracket and every cut
are exact.  A round splits each stretch into ``POINTS`` / (stretches) parts, so 10**11
groups take three or four.

Rows move twice, without their texts: once into groups (partial sums first, so a text that
a third of the rows share is no hot key), once into range partitions of (shard, text,
id, row) that number the slots; the last of these keys splits even rows that are equal in
id and text.

Defined results: a null text counts as empty and is in the empty text's group; null ids
come first among a group's slots; repeated rows keep a slot each; an empty table gives an
empty result; with fewer groups than shards, each group has its own shard and the last
shards stay empty.  Only the id and text columns are read, so other columns may have any
name.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

SHARDS = 24
#: Bytes that a row counts besides its text.
ROW_BYTES = 8
#: Known group ends that one round adds to the driver's list.
POINTS = 32768


@dataclass
class Cuts:
    """Where the shards begin: texts with a shard of their own, then the last text of each other shard."""
    lone: list[bytes]
    ends: list[bytes]
    capacity: int

    def shard(self, digest: Column) -> Column:
        """Shard of a text's digest (``text_digest``)."""
        at = F.lit(len(self.lone))
        for end in self.ends:
            at = at + (digest > F.lit(end)).cast("int")
        for i, one in reversed(list(enumerate(self.lone))):
            at = F.when(digest == F.lit(one), F.lit(i)).otherwise(at)
        return at.cast("int")


def text_digest(text: str = "text") -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def measure(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, size, crc, digest) of every row: what the operator needs of a document."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(id).alias("id"), (F.octet_length(whole).cast("long") + ROW_BYTES).alias("size"),
                       F.crc32(whole.cast("binary")).alias("crc"), text_digest(text).alias("digest"))


def _stored(df: DataFrame, name: str) -> DataFrame:
    folder = C.shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def _width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def find_cuts(rows: DataFrame, shards: int = SHARDS) -> Cuts:
    """Cuts of the rows' groups (``rows``: digest, size) into ``shards`` shards."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    # digests are uniform, so their first bits deal the groups into even ranges without sampling
    parts = _width(rows.sparkSession)
    first = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    groups = _stored(rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
                     .withColumn("part", F.shiftright(first * F.lit(parts), 32).cast("int")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0]
    if total is None:
        return Cuts([], [], 0)
    lone, left = [], total
    for r in groups.orderBy(F.desc("bytes"), "digest").limit(shards - 1).select("digest", "bytes").collect():
        if r["bytes"] * (shards - len(lone)) <= left:
            break
        lone.append(bytes(r["digest"]))
        left -= r["bytes"]
    rest = groups.where(~F.col("digest").isin([F.lit(x) for x in lone])) if lone else groups
    if not left:
        return Cuts(lone, [], 0)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)   # one row per range
    starts = (rest.groupBy("part").agg(F.sum("bytes").alias("of_part"))
              .select("part", F.coalesce(F.sum("of_part").over(before), F.lit(0)).alias("start")))
    running = F.sum("bytes").over(Window.partitionBy("part").orderBy("digest").rowsBetween(Window.unboundedPreceding, 0))
    ends = _stored(rest.withColumn("sum", running).join(F.broadcast(starts), "part")
                   .select("digest", "bytes", (F.col("start") + F.col("sum")).alias("end")), "group-ends")
    largest = ends.agg(F.max("bytes")).first()[0]
    capacity, cuts = minimax(ends, left, largest, shards - len(lone))
    at = {r["end"]: bytes(r["digest"]) for r in ends.where(F.col("end").isin(cuts)).collect()} if cuts else {}
    return Cuts(lone, [at[c] for c in cuts], capacity)


class _Known:
    """Group ends that are known, whether others lie between one and the next, and the width of the slice that told."""

    def __init__(self, total: int):
        self.points, self.hides, self.widths = [0, total], [True], [total]

    def reach(self, limit: int) -> tuple[int, int]:
        """Bounds of the last group end at or before ``limit``."""
        i = bisect_right(self.points, limit) - 1
        low = self.points[i]
        return low, limit if i < len(self.hides) and self.hides[i] else low

    def fill(self, capacity: int, shards: int, side: int) -> list[int]:
        """Greedy ends of the shards, with the lower (0) or upper (1) bound of each."""
        at, out = 0, []
        for _ in range(shards):
            at = self.reach(at + capacity)[side]
            out.append(min(at, self.points[-1]))
        return out

    def least(self, low: int, high: int, shards: int, side: int) -> int:
        """Smallest capacity above ``low`` that fills everything (``high`` does)."""
        while high - low > 1:
            mid = (low + high) // 2
            if self.fill(mid, shards, side)[-1] == self.points[-1]:
                high = mid
            else:
                low = mid
        return high

    def between(self, a: int, b: int) -> slice:
        """Where what is known of the stretch from the end ``a`` to the end ``b`` stands."""
        return slice(bisect_left(self.points, a), bisect_left(self.points, b))

    def put(self, a: int, b: int, found: list[tuple[int, int]], width: int) -> None:
        """Replace what is known between the ends ``a`` and ``b`` by (end, groups up to it) rows."""
        at = self.between(a, b)
        self.points[at.start + 1:at.stop + 1] = [e for e, _ in found]
        self.hides[at] = [n > 1 for _, n in found]
        self.widths[at] = [width] * len(found)


def minimax(ends: DataFrame, total: int, largest: int, shards: int) -> tuple[int, list[int]]:
    """(smallest capacity, ends of all shards but the last that holds anything)."""
    known = _Known(total)
    low = max(largest, -(-total // shards)) - 1                # no smaller capacity can do
    stretches = [(0, total)]
    while True:
        _split(ends, known, stretches)
        sure = known.least(low, max(total, low + 1), shards, 0)
        may = known.least(low, sure, shards, 1)
        lows, highs = known.fill(may, shards, 0), known.fill(sure, shards, 1)
        if may == sure and lows == highs:
            cuts = [e for e in dict.fromkeys(lows) if 0 < e < total]
            return sure, cuts
        # every lookup of any capacity between the two falls into one of these spans
        spans = [(a + may, b + sure) for a, b in zip([0, *lows[:-1]], [0, *highs[:-1]])]
        stretches = []
        for i, hides in enumerate(known.hides):
            a, b = known.points[i], known.points[i + 1]
            if hides and any(x < b and a < y for x, y in spans):
                if stretches and stretches[-1][1] == a:
                    stretches[-1] = (stretches[-1][0], b)
                else:
                    stretches.append((a, b))


def _longs(values: list[int]) -> Column:
    return F.expr(f"array({', '.join(f'{v}L' for v in values)})")


def _stretch_of(end: Column, starts: list[int]) -> Column:
    """Number (from 1) of the last of the ascending ``starts`` below ``end``, else 0: a binary search in
    one array, so that the expression is as small for thousands of stretches as for one."""
    held, steps = _longs(starts), [1 << bit for bit in reversed(range(len(starts).bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0),
                       lambda at, step: F.when(F.try_element_at(held, at + step) < end, at + step).otherwise(at))


def _split(ends: DataFrame, known: _Known, stretches: list[tuple[int, int]]) -> None:
    """Learn more group ends inside the stretches, by one aggregate over them.

    Slices are at most a quarter as wide as those that told of the stretch, so each round learns something."""
    widths = [max(1, min((b - a) // max(POINTS // len(stretches), 1), min(known.widths[known.between(a, b)]) // 4)) for a, b in stretches]
    of = lambda values: F.get(_longs(values), F.col("k") - 1)
    found = (ends.where((F.col("end") > stretches[0][0]) & (F.col("end") <= stretches[-1][1]))
             .select("end", _stretch_of(F.col("end"), [a for a, _ in stretches]).alias("k"))
             .where(F.col("end") <= of([b for _, b in stretches]))
             .withColumns({"start": of([a for a, _ in stretches]), "width": of(widths)})
             .groupBy("k", F.expr("(`end` - `start` - 1) div width").alias("slice"))
             .agg(F.max("end").alias("last"), F.count(F.lit(1)).alias("n")).select("k", "last", "n").collect())
    by: dict[int, list[tuple[int, int]]] = {}
    for r in found:
        by.setdefault(r["k"], []).append((r["last"], r["n"]))
    for k, ((a, b), width) in enumerate(zip(stretches, widths, strict=True), 1):
        known.put(a, b, sorted(by[k]), width)


def assign(docs: DataFrame, shards: int = SHARDS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, size, crc, shard, slot) of every row; slots of a shard are gapless from 0."""
    spark = C.prepare(docs.sparkSession)
    rows = _stored(measure(docs, id, text), "rows")
    cuts = find_cuts(rows, shards)
    # rows equal in id and text are told apart by where they stand, so that no key is hot
    placed = (rows.withColumns({"shard": cuts.shard(F.col("digest")), "row": F.monotonically_increasing_id()})
              .repartitionByRange(_width(spark), "shard", "digest", "id", "row")
              .withColumn("part", F.spark_partition_id()))
    placed = _stored(placed, "placed")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per shard and range: as many as there are ranges and shards
    starts = (placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
              .select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy("digest", "id", "row"))
    return (placed.withColumn("own", own).join(F.broadcast(starts), ["shard", "part"])
            .select("id", "size", "crc", "shard", (F.col("start") + F.col("own") - 1).cast("long").alias("slot")))


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS, id: str = "doc_id", text: str = "text") -> Cuts:
    """Write whole documents (all columns) as Parquet, one folder ``shard=N`` per shard.

    The shard is computed from the text and the cuts, so texts are not joined or shuffled."""
    C.prepare(docs.sparkSession)
    if "shard" in docs.columns:
        raise ValueError("the documents have a column shard, which names the folders")
    cuts = find_cuts(_stored(measure(docs, id, text), "rows"), shards)
    docs.withColumn("shard", cuts.shard(text_digest(text))).write.partitionBy("shard").parquet(folder)
    return cuts


def digest(assigned: DataFrame) -> DataFrame:
    """The query's columns."""
    return assigned.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
                           "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def oracle() -> str:
    """DuckDB SQL: the same cuts by filling over the whole list of group ends.

    crc32 goes over the hexadecimal digits of the text, low one of each byte first, with its
    table of 16 values made by its rule."""
    fill = ("list_reduce(list_prepend(0::BIGINT, range(k)), lambda cur, i: "
            "coalesce(list_max(list_filter(es, lambda e: e <= cur + {c})), 0))")
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, octet_length(encode(coalesce(text, '')))::BIGINT + {ROW_BYTES} AS size,
                            sha256(coalesce(text, '')) AS h FROM documents),
g AS (SELECT h, sum(size)::BIGINT AS bytes, any_value(t) AS t FROM d GROUP BY h),
tab AS (SELECT list_transform(range(16), lambda v: list_reduce(list_prepend(v, range(4)), lambda x, i:
        CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS tab),
crc AS (SELECT h, xor(list_reduce(list_prepend(4294967295::BIGINT, codes), lambda reg, c:
            xor(xor(reg >> 4, tab[xor(reg & 15, c & 15) + 1]) >> 4,
                tab[xor(xor(reg >> 4, tab[xor(reg & 15, c & 15) + 1]) & 15, c >> 4) + 1])), 4294967295) AS crc
        FROM (SELECT h, list_transform(regexp_extract_all(lower(hex(encode(t))), '..'), lambda b:
                ((strpos('0123456789abcdef', b[1]) - 1) * 16 + strpos('0123456789abcdef', b[2]) - 1)::BIGINT) AS codes FROM g), tab),
by_size AS (SELECT h, bytes, row_number() OVER (ORDER BY bytes DESC, h) AS i, sum(bytes) OVER () AS total,
                   sum(bytes) OVER (ORDER BY bytes DESC, h) - bytes AS before FROM g),
lone AS (SELECT h, i - 1 AS shard FROM by_size a WHERE i < {SHARDS} AND NOT EXISTS (
           SELECT 1 FROM by_size b WHERE b.i <= a.i AND b.bytes * ({SHARDS} - b.i + 1) <= b.total - b.before)),
e AS (SELECT h, bytes, (sum(bytes) OVER (ORDER BY h))::BIGINT AS e FROM g WHERE h NOT IN (SELECT h FROM lone)),
l AS (SELECT list(e ORDER BY e) AS es, max(e) AS total, {SHARDS} - (SELECT count(*) FROM lone) AS k FROM e),
search(bit, low) AS (SELECT 1::BIGINT << 44, 0::BIGINT UNION ALL
  SELECT bit >> 1, low + CASE WHEN {fill.format(c='(low + bit)')} = total THEN 0 ELSE bit END FROM search, l WHERE bit > 0),
capacity AS (SELECT low + 1 AS c FROM search WHERE bit = 0),
cut(i, e) AS (SELECT 0, 0::BIGINT UNION ALL
  SELECT i + 1, list_max(list_filter(es, lambda x: x <= e + c)) FROM cut, l, capacity WHERE i < k AND e < total),
placed AS (SELECT h, shard FROM lone UNION ALL
  SELECT h, (SELECT count(*) FROM lone) + (SELECT count(*) FROM cut WHERE i > 0 AND cut.e < e.e) FROM e)
SELECT doc_id, size, crc::BIGINT AS text_crc32, 'bytes' AS law, shard::INT AS shard,
       (row_number() OVER (PARTITION BY shard ORDER BY h, doc_id NULLS FIRST) - 1)::BIGINT AS slot, NULL::INT AS grown_shard
FROM d JOIN crc USING (h) JOIN placed USING (h)"""
