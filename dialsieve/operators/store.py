"""Call-history store with what its ingest keeps beside the calls.

Below one root: ``calls`` (the rows, by ``dial_week``), ``keys`` (the key of every call, a
table bucketed by the key), ``counts`` (calls per week, number and day, by ``dial_week``),
``sketches`` (one row per load: what the profile needs of its calls),
``loads`` (one row per finished load) and ``layout`` (where keys and counts are, newest last).

Everything that a load writes carries its load id, and readers take finished loads only.  A
load that died leaves rows that nobody reads; running its batch again is a new load, and
a batch that was loaded already finds its keys stored and adds nothing.  One writer at a time.

* A batch is tested against the bucketed keys: a small one (measured) is broadcast to a
  map-only scan of the two key columns, a larger one is shuffled into the table's buckets.
  The stored side is never shuffled.
* The counts of a load are added, not recomputed: a call is stored once, so calls per
  number and day of different loads sum up to the store's distinct calls.  The dial
  limits read one week of counts instead of the week's calls.
* A load also adds one row of distinct-value sketches; the approximate profile merges these rows
  and reads no call.
* Many loads leave many small files; ``compact`` writes keys and counts anew (one file a bucket,
  one row per number and day, any number of buckets) and then names the new folders.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, observed
from ..sources.bucketed import Bucketed
from ..sources.tabular import read_if_written
from .dial import week_bounds
from .history import (KEYS, align_history, dedup_batch, history_profile, profile_of_sketches, profile_sketch, store_schema, upload_keys,
                      upload_totals, with_store_columns)
from .joins import DEFAULT_BROADCAST_ROWS, bounded_broadcast

BUCKETS = 64
_COUNT_SCHEMA = "dialed_number string, day date, n long, load_id string, dial_week date"
_LAYOUT_SCHEMA = "version long, keys string, counts string, buckets int"


class HistoryStore:
    """The store below ``root``; ``buckets`` is used when it is first written."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root = spark, root.rstrip("/")
        newest = self._newest()
        if newest is None:
            newest = self._name(0, f"{self.root}/keys-0", f"{self.root}/counts-0", buckets)
        self._use(newest)

    def _newest(self):
        layouts = read_if_written(self.spark, f"{self.root}/layout")
        return None if layouts is None else layouts.orderBy(F.desc("version")).first()

    def _name(self, version: int, keys: str, counts: str, buckets: int) -> dict:
        row = {"version": version, "keys": keys, "counts": counts, "buckets": buckets}
        self.spark.createDataFrame([row], _LAYOUT_SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.root}/layout")
        return row

    def _use(self, layout) -> None:
        self.version, self._counts, self.buckets = layout["version"], layout["counts"], layout["buckets"]
        self._keys = Bucketed(layout["keys"], (*((k, "STRING") for k in KEYS), ("load_id", "STRING")), tuple(KEYS), self.buckets)

    # --- reading ---------------------------------------------------------------

    def loads(self) -> DataFrame:
        """(load_id, batch_id, loaded_at, total, inserted) of the finished loads."""
        done = read_if_written(self.spark, f"{self.root}/loads")
        return done if done is not None else self.spark.createDataFrame(
            [], "load_id string, batch_id string, loaded_at timestamp_ntz, total long, inserted long")

    def _finished(self, rows: DataFrame) -> DataFrame:
        # one short row per load: as many as uploads, not as many as calls
        return rows.join(F.broadcast(self.loads().select("load_id")), "load_id", "left_semi")

    def calls(self) -> DataFrame:
        """The stored calls (an empty frame with their columns before the first load)."""
        rows = read_if_written(self.spark, f"{self.root}/calls")
        return self.spark.createDataFrame([], store_schema()) if rows is None else self._finished(rows).drop("load_id")

    def keys(self) -> DataFrame:
        return self._finished(self._keys.read(self.spark)).select(*KEYS)

    def counts(self) -> DataFrame:
        """(dial_week, dialed_number, day, n) as kept: one row per load that dialled the number on the day."""
        rows = read_if_written(self.spark, self._counts)
        if rows is None:
            rows = self.spark.createDataFrame([], _COUNT_SCHEMA)
        return self._finished(rows).drop("load_id")

    def week_counts(self, check_date: dt.date) -> DataFrame:
        """A1: (dialed_number, daily_count, weekly_count) of the check date's ISO week, from the kept counts."""
        day = F.when(F.col("day") == F.lit(check_date), F.col("n")).otherwise(0)
        return (self.counts().where(F.col("dial_week") == F.lit(week_bounds(check_date)[0])).groupBy("dialed_number")
                .agg(F.sum(day).cast("long").alias("daily_count"), F.sum("n").cast("long").alias("weekly_count")))

    def profile(self, approx: bool = False) -> DataFrame:
        """A2 of the stored calls.  ``approx`` merges the loads' sketches (distinct counts within a few
        per cent, the rest exact) and reads no call; a store with loads from before there were sketches
        is counted exactly."""
        kept = read_if_written(self.spark, f"{self.root}/sketches") if approx else None
        if kept is not None:
            kept = self._finished(kept)
            if kept.count() == self.loads().where("inserted > 0").count():
                return profile_of_sketches(kept)
        return history_profile(self.calls())

    # --- loading ---------------------------------------------------------------

    def new_rows(self, batch_aligned: DataFrame, broadcast_rows: int = DEFAULT_BROADCAST_ROWS,
                 wanted: tuple[DataFrame, bool] | None = None) -> DataFrame:
        """Rows of the batch, one per key, whose key is not stored.  ``wanted`` may give the batch's
        distinct keys as ``bounded_broadcast`` stored them."""
        batch = dedup_batch(batch_aligned)
        wanted, small = wanted or bounded_broadcast(batch_aligned.select(*KEYS).distinct(), broadcast_rows)
        if small:
            hits = self.keys().join(wanted, KEYS, "left_semi").distinct()
            return batch.join(F.broadcast(hits), KEYS, "left_anti")       # no more hits than wanted keys
        # an anti join would be moved below the deal, and the stored keys then shuffled to meet it
        stored = self.keys().withColumn("_stored", F.lit(True)).hint("merge")
        return self._keys.dealt(batch).join(stored, KEYS, "left").where("_stored IS NULL").drop("_stored")

    def load(self, raw_batch: DataFrame, batch_id: str, loaded_at: dt.datetime,
             broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> dict:
        """K1: align, keep the first row of each key, add what is not stored; returns counts.

        The new rows are checkpointed and counted by one job, so calls, keys, counts and sketches come
        from one computation; the row in ``loads`` is written last and makes them visible together.
        The upload's totals come from its stored keys."""
        load_id = f"{batch_id}-{uuid.uuid4().hex}"
        wanted = bounded_broadcast(upload_keys(raw_batch), broadcast_rows)
        total, unparsed = upload_totals(wanted[0])
        rows = with_store_columns(self.new_rows(align_history(raw_batch), broadcast_rows, wanted), batch_id, loaded_at)
        rows, seen = observed(rows.withColumn("load_id", F.lit(load_id)), n=F.count(F.lit(1)))
        fresh = materialize(rows)
        inserted = seen.get["n"]
        if inserted:
            fresh.write.mode("append").partitionBy("dial_week").parquet(f"{self.root}/calls")
            self._keys.add(fresh)
            dated = fresh.where("pbx_dialing_date IS NOT NULL")
            (dated.groupBy("dialed_number", F.col("pbx_dialing_date").alias("day"), "load_id", "dial_week")
             .agg(F.count(F.lit(1)).alias("n")).write.mode("append").partitionBy("dial_week").parquet(self._counts))
            profile_sketch(fresh).withColumn("load_id", F.lit(load_id)).coalesce(1).write.mode("append").parquet(f"{self.root}/sketches")
        self.spark.createDataFrame([(load_id, batch_id, loaded_at, total, inserted)], self.loads().schema) \
            .coalesce(1).write.mode("append").parquet(f"{self.root}/loads")
        return {"total": total, "inserted": inserted, "skipped": total - inserted, "unparsed_dates": unparsed}

    def compact(self, buckets: int | None = None) -> None:
        """Write keys and counts of the finished loads anew and use the new folders.

        A crash before the last step leaves the old folders in use; the old ones may be
        removed once no reader uses them."""
        version = self.version + 1
        load_id = f"compact-{version}-{uuid.uuid4().hex}"
        folder = f"{self.root}/keys-{load_id}"
        keys = Bucketed(folder, self._keys.columns, self._keys.keys, buckets or self.buckets)
        keys.add(self.keys().withColumn("load_id", F.lit(load_id)))
        counts = f"{self.root}/counts-{load_id}"
        (self.counts().groupBy("dial_week", "dialed_number", "day").agg(F.sum("n").alias("n")).withColumn("load_id", F.lit(load_id))
         .select("dialed_number", "day", "n", "load_id", "dial_week").write.partitionBy("dial_week").parquet(counts))
        newest = self.loads().agg(F.max("loaded_at")).first()[0]
        self.spark.createDataFrame([(load_id, "", newest, 0, 0)], self.loads().schema) \
            .coalesce(1).write.mode("append").parquet(f"{self.root}/loads")
        self._use(self._name(version, folder, counts, keys.buckets))

