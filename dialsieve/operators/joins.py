"""Join helpers: counted broadcasts and skew-safe keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..schema import q
from ..session import materialize

# A list / lookup side is broadcast only when it was counted and has at most
# this many rows and bytes; else the join is a shuffle join, whatever the
# optimizer estimates.
DEFAULT_BROADCAST_ROWS = 2_000_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def measured(df: DataFrame, by: str | None = None, names: Sequence[str] = ("",)) -> tuple[DataFrame, dict[str, tuple[int, int]]]:
    """``df`` checkpointed, with its (rows, bytes of text) per value in ``names`` of column ``by``.

    Both figures are observed by the job that writes the checkpoint: the frame is computed
    once and no job counts it again."""
    size = F.lit(8 * len(df.columns))
    for c, kind in df.dtypes:
        if kind == "string":
            size = size + F.coalesce(F.octet_length(F.col(q(c))), F.lit(0))
    seen, figures = Observation(), []
    for i, name in enumerate(names):
        own = F.lit(True) if by is None else F.col(q(by)) == name
        figures += [F.count_if(own).alias(f"n{i}"), F.sum(F.when(own, size)).alias(f"b{i}")]
    stored = materialize(df.observe(seen, *figures))
    got = seen.get
    return stored, {name: (got[f"n{i}"], got[f"b{i}"] or 0) for i, name in enumerate(names)}


def by_size(df: DataFrame, rows: int, size: int, max_rows: int = DEFAULT_BROADCAST_ROWS,
            max_bytes: int = MAX_BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """Broadcast hint for a frame that was measured within the bounds, else a shuffle-join hint."""
    if 0 < max_rows and rows <= max_rows and size <= max_bytes:
        return F.broadcast(df), True
    return df.hint("merge"), False


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS,
                      max_bytes: int = MAX_BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """Broadcast-hinted ``df`` when it has at most ``max_rows`` rows and ``max_bytes``
    bytes of text, else ``df`` with a shuffle-join hint; checkpointed and measured by
    the same job.  The hint only chooses the physical join, never the result."""
    stored, figures = measured(df)
    return by_size(stored, *figures[""], max_rows, max_bytes)


def spread_blank_sql(key: str, row_id: Sequence[str]) -> str:
    """Join-key text where blank becomes a value of its own row that matches nothing.

    Blank keys (no email, no phone ...) never match a list, but in a shuffle
    join they would all hash to one partition; giving each row its own value
    spreads them.  It is built from the row's order columns (which may be NULL or
    repeated: that only spreads less), so a retried task rebuilds it."""
    ids = ", ".join(f"CAST({q(c)} AS STRING)" for c in row_id) or "''"
    return f"coalesce(nullif({key}, ''), concat(char(0), concat_ws(',', {ids})))"


def row_id(df: DataFrame) -> list[str]:
    return [c for c in ("src_ord", "row_ord") if c in df.columns]


def mark_join(df: DataFrame, key_sql: str, marks: DataFrame, marks_key: str, payload: list[str],
              broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Attach ``payload`` columns of the ``marks`` row whose ``marks_key``
    equals the row's key (``marks`` has one row per key; NULL when none).

    One plan at every size: the rows themselves are left-joined on their key, so
    rows need no unique id.  Counted small marks are broadcast (map-side); larger
    ones shuffle, with blank keys spread and hot keys left to AQE's skew join."""
    side, _ = bounded_broadcast(marks.select(marks_key, *payload), broadcast_rows)
    return attach(df, key_sql, side, marks_key)


def attach(df: DataFrame, key_sql: str, side: DataFrame, side_key: str) -> DataFrame:
    """Left join of the rows with a side that already carries its join hint."""
    return (df.withColumn("_mk", F.expr(spread_blank_sql(key_sql, row_id(df))))
              .join(side, F.col("_mk") == F.col(side_key), "left").drop("_mk", side_key))


class Marks:
    """The list keys of a run, stored once: e-mails (with the list's priority), domains and
    direct numbers, each with the join that its measured size allows."""

    def __init__(self, dead: DataFrame | None = None, rpc: DataFrame | None = None, domain: DataFrame | None = None,
                 direct: DataFrame | None = None, broadcast_rows: int = DEFAULT_BROADCAST_ROWS):
        given = [("email", dead, "key", 1), ("email", rpc, "key", 2), ("domain", domain, "key", 1), ("direct", direct, "phone", 1)]
        parts = [f.select(F.lit(kind).alias("kind"), F.col(c).alias("key"), F.lit(p).alias("prio")) for kind, f, c, p in given if f is not None]
        self._sides: dict[str, DataFrame] = {}
        if not parts:
            return
        union = parts[0]
        for more in parts[1:]:
            union = union.unionByName(more)
        kinds = list(dict.fromkeys(kind for kind, f, _, _ in given if f is not None))
        stored, sizes = measured(union.groupBy("kind", "key").agg(F.min("prio").alias("prio")), "kind", kinds)
        for kind in kinds:
            side = stored.where(F.col("kind") == kind).select(F.col("key").alias("_lkey"), F.col("prio").alias("_lprio"))
            self._sides[kind] = by_size(side, *sizes[kind], broadcast_rows)[0]

    def join(self, df: DataFrame, kind: str, key_sql: str, name: str) -> DataFrame:
        """Column ``name``: the list's priority for the row's key, NULL when it is not listed."""
        if kind not in self._sides:
            return df.withColumn(name, F.lit(None).cast("int"))
        return attach(df, key_sql, self._sides[kind], "_lkey").withColumnRenamed("_lprio", name)
