"""Call-history store: alignment, ingest, profile, match, preview.

The store is a Parquet dataset partitioned by ``dial_week`` (Monday of the ISO
week of ``pbx_dialing_date``; no date -> the default partition), unique on
``(call_id, dialed_number)``.  Uniqueness is kept by the ingest, which only
appends keys that are not stored yet; re-running an interrupted ingest is
therefore safe.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import sql as X
from ..functions.dates import DATE_BLANKS, parse_date_sql, week_start
from ..functions.text import HISTORY_NULL_TOKENS
from ..schema import CALL_LAYOUT, HISTORY_COLUMNS, key_columns, q
from ..session import materialize, observed
from ..sources.tabular import read_if_written
from .joins import DEFAULT_BROADCAST_ROWS, bounded_broadcast

KEYS = ["call_id", "dialed_number"]
_HEADER_TO_COL = dict(CALL_LAYOUT)


def align_history(raw: DataFrame, flag: str | None = None) -> DataFrame:
    """Align an uploaded call file to the 61 history columns.

    Headers are matched exactly (after trim); the dialled number keeps digits
    only; the dialling date is parsed to DATE (NULL when blank or
    unparseable); missing columns are ''; every other value is trimmed and
    null sentinels are blanked.  ``src_ord``/``row_ord`` are carried for the
    keep-first dedup.  ``flag`` names a further column: the dialling date is not blank and
    no date format parses it."""
    present = {}
    for c in raw.columns:
        h = c.strip()
        if h in _HEADER_TO_COL and _HEADER_TO_COL[h] not in present:
            present[_HEADER_TO_COL[h]] = c
        elif h in HISTORY_COLUMNS and h not in present:
            present[h] = c
    cols = []
    for name in HISTORY_COLUMNS:
        src = q(present[name]) if name in present else "''"
        if name == "pbx_dialing_date":
            cols.append(f"{parse_date_sql(src)} AS {name}")
        elif name == "dialed_number":
            cols.append(f"{X.digits(src)} AS {name}")
        elif name in present:
            cols.append(f"{X.blank_whole(src, HISTORY_NULL_TOKENS)} AS {name}")
        else:
            cols.append(f"'' AS {name}")
    order = [f"CAST({q(c)} AS BIGINT) AS {c}" for c in ("src_ord", "row_ord") if c in raw.columns]
    if "src_ord" not in raw.columns:
        order = ["CAST(1 AS BIGINT) AS src_ord"] + order
    if "row_ord" not in raw.columns:
        order.append("monotonically_increasing_id() AS row_ord")
    if flag and "pbx_dialing_date" in present:
        src = q(present["pbx_dialing_date"])
        text = X.norm(f"CAST({src} AS STRING)")
        order.append(f"coalesce({parse_date_sql(src)} IS NULL AND {text} NOT IN ({X.lits(DATE_BLANKS)}), false) AS {flag}")
    elif flag:
        order.append(f"false AS {flag}")
    return raw.selectExpr(*cols, *order)


def upload_keys(raw: DataFrame) -> DataFrame:
    """(call_id, dialed_number, n, unparsed) of an upload: its keys, their rows, and how many of
    these have a dialling date that no format parses.  The totals of a load are sums over this
    small frame, so an upload is read once for its keys and figures and once for its rows."""
    return (align_history(raw, "_unparsed").groupBy(*KEYS)
            .agg(F.count(F.lit(1)).alias("n"), F.count_if("_unparsed").alias("unparsed")))


def upload_totals(keys: DataFrame) -> tuple[int, int]:
    """(rows, unparsed dates) of an upload from its stored ``upload_keys``."""
    n, unparsed = keys.agg(F.sum("n"), F.sum("unparsed")).first()
    return n or 0, unparsed or 0


def dedup_batch(aligned: DataFrame) -> DataFrame:
    """One row per (call_id, dialed_number): the first in upload order.
    Plans as a partial ``WindowGroupLimit`` before the shuffle, so a hot key
    is cut to one row per map task."""
    w = Window.partitionBy(*KEYS).orderBy("src_ord", "row_ord")
    return aligned.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def new_rows(store: DataFrame | None, batch_aligned: DataFrame, broadcast_rows: int = DEFAULT_BROADCAST_ROWS,
             wanted: tuple[DataFrame, bool] | None = None) -> DataFrame:
    """Rows of the batch whose key is not in the store (J6 / K1 plan).

    A batch whose keys were counted small is broadcast against the store's two
    key columns (a map-only filter over the store), and the hits against the
    batch.  A larger batch is anti-joined with the store's keys by a shuffle: only
    the keys of the store move, and blank call ids, which share one key per
    number, are reduced map-side first.  ``wanted`` may give the batch's distinct keys as
    ``bounded_broadcast`` stored them."""
    batch = dedup_batch(batch_aligned)
    if store is None:
        return batch
    keys = store.select(*KEYS)
    bkeys, small = wanted or bounded_broadcast(batch_aligned.select(*KEYS).distinct(), broadcast_rows)
    if small:
        hits = F.broadcast(keys.join(bkeys, KEYS, "left_semi").distinct())
        return batch.join(hits, KEYS, "left_anti")
    return batch.join(keys.distinct().hint("merge"), KEYS, "left_anti")


def ingest_counts(batch_aligned: DataFrame, inserted: DataFrame) -> DataFrame:
    """One row {total, inserted, skipped}; skipped = total - inserted, so
    in-batch duplicates count as skipped.  One aggregate over a union of the
    two inputs (no join)."""
    both = (batch_aligned.select(F.lit(1).alias("_t"), F.lit(0).alias("_i"))
            .unionByName(inserted.select(F.lit(0).alias("_t"), F.lit(1).alias("_i"))))
    agg = both.agg(F.sum("_t").alias("total"), F.sum("_i").alias("inserted"))
    z = F.lit(0).cast("long")
    return agg.select(F.coalesce(F.col("total").cast("long"), z).alias("total"),
                      F.coalesce(F.col("inserted").cast("long"), z).alias("inserted"),
                      F.coalesce((F.col("total") - F.col("inserted")).cast("long"), z).alias("skipped"))


def with_store_columns(rows: DataFrame, batch_id: str, loaded_at: dt.datetime) -> DataFrame:
    return (rows.withColumn("batch_id", F.lit(batch_id))
                .withColumn("loaded_at", F.expr(X.ts_ntz(loaded_at)))
                .withColumn("dial_week", week_start("pbx_dialing_date")))


def append_history(spark: SparkSession, store_path: str, raw_batch: DataFrame, batch_id: str,
                   loaded_at: dt.datetime, broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> dict:
    """K1: align, dedup, keep new keys, append to the store; returns counts, with the
    number of non-blank dialling dates that no date format parses.

    The new rows are checkpointed first, counted by the job that does so, and the write reads
    the checkpoint; the upload's totals come from its stored keys.  Single writer: a crash between checkpoint and commit is
    repaired by re-running the same batch (already stored keys are skipped)."""
    aligned = align_history(raw_batch)
    wanted = bounded_broadcast(upload_keys(raw_batch), broadcast_rows)
    total, unparsed = upload_totals(wanted[0])
    store = read_if_written(spark, store_path)
    rows, seen = observed(with_store_columns(new_rows(store, aligned, broadcast_rows, wanted), batch_id, loaded_at), n=F.count(F.lit(1)))
    fresh = materialize(rows)
    inserted = seen.get["n"]
    if inserted:
        fresh.write.mode("append").partitionBy("dial_week").parquet(store_path)
    return {"total": total, "inserted": inserted, "skipped": total - inserted, "unparsed_dates": unparsed}


def store_schema() -> T.StructType:
    """Columns of the store."""
    text = [T.StructField(c, T.DateType() if c == "pbx_dialing_date" else T.StringType()) for c in HISTORY_COLUMNS]
    return T.StructType([*text, T.StructField("src_ord", T.LongType()), T.StructField("row_ord", T.LongType()),
                         T.StructField("batch_id", T.StringType()), T.StructField("loaded_at", T.TimestampNTZType()),
                         T.StructField("dial_week", T.DateType())])


def read_store(spark: SparkSession, store_path: str) -> DataFrame:
    """The store; an empty frame with its columns when nothing was written yet.
    Always re-read after a write: an old frame keeps its old file list."""
    stored = read_if_written(spark, store_path)
    return spark.createDataFrame([], store_schema()) if stored is None else stored


def truncate_history(spark: SparkSession, store_path: str, like: DataFrame) -> None:
    """K8: empty the store.  The empty frame is built from the schema alone (the
    path being replaced is not read); an empty store reads back as an empty frame."""
    spark.createDataFrame([], like.schema).write.mode("overwrite").partitionBy("dial_week").parquet(store_path)


def history_profile(store: DataFrame, approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """A2: rows, distinct campaigns, distinct contacts, first and last dialling date.

    Exact distinct counts of two columns plan as an Expand (each store row
    twice) plus two aggregation levels; ``approx=True`` uses HyperLogLog++
    sketches instead (one pass, map-side combined, relative error ``rsd``)."""
    distinct = (lambda c: F.approx_count_distinct(c, rsd)) if approx else F.count_distinct
    return store.agg(
        F.count(F.lit(1)).cast("long").alias("total_rows"),
        distinct("campaign_name").cast("long").alias("campaigns"),
        distinct("contact_link").cast("long").alias("contacts"),
        F.min("pbx_dialing_date").alias("earliest_date"),
        F.max("pbx_dialing_date").alias("latest_date"))


#: Log2 of a sketch's entries: the standard error of a distinct count is about 0.65 %.
SKETCH_BITS = 14


def profile_sketch(rows: DataFrame) -> DataFrame:
    """What A2 needs of some calls, as one mergeable row: rows, HyperLogLog sketches of the two
    distinct columns, first and last dialling date.  A value is marked, as sketches leave out the
    empty text and the exact count does not."""
    sketch = lambda c: F.hll_sketch_agg(F.concat(F.lit("="), F.col(c)), SKETCH_BITS).alias(c)
    return rows.agg(F.count(F.lit(1)).alias("n"), sketch("campaign_name"), sketch("contact_link"),
                    F.min("pbx_dialing_date").alias("earliest_date"), F.max("pbx_dialing_date").alias("latest_date"))


def profile_of_sketches(sketches: DataFrame) -> DataFrame:
    """A2 from ``profile_sketch`` rows of disjoint parts of a store."""
    distinct = lambda c: F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0)).cast("long")
    return sketches.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_rows"), distinct("campaign_name").alias("campaigns"),
                        distinct("contact_link").alias("contacts"), F.min("earliest_date").alias("earliest_date"),
                        F.max("latest_date").alias("latest_date"))


def history_match(f3: DataFrame, store: DataFrame) -> DataFrame:
    """Extract rows whose (lower(trim(campaign)), lower(trim(contact link)))
    occur in the history store.  Key columns are found by their aliases, else the
    extract's first and second column stand in; blank keys never match.

    The store's key pairs are reduced map-side before they move, and only
    (pair) columns of the store are read."""
    camp, link = key_columns(f3, ["campaign_name"], ["contact_link", "profile_url", "contactid"])
    pair = lambda c, l: (X.norm_lower(f"coalesce(CAST({q(c)} AS STRING), '')"), X.norm_lower(f"coalesce(CAST({q(l)} AS STRING), '')"))
    ec, el = pair(camp, link)
    sc, sl = pair("campaign_name", "contact_link")
    known = store.selectExpr(f"{sc} AS _hc", f"{sl} AS _hl").where("_hc <> '' AND _hl <> ''").distinct()
    rows = f3.withColumns({"_hc": F.expr(ec), "_hl": F.expr(el)}).where("_hc <> '' AND _hl <> ''")
    return rows.join(known, ["_hc", "_hl"], "left_semi").drop("_hc", "_hl")


def history_preview(store: DataFrame, n: int = 200) -> DataFrame:
    """First ``n`` rows by (src_ord, row_ord) - a top-k, not a full sort."""
    return store.orderBy("src_ord", "row_ord").limit(n)
