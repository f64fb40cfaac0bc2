"""Key index of the contact snapshot, kept up batch by batch (J10, W4, W5, J7, S6, FL8).

For every non-blank (campaign, link) key the index holds the place of the row that counts: the
batch loaded last, then the first row in upload order.  It is a table bucketed by
the key.  A new batch is reduced to one place per key by itself and joined, in the
index's buckets, with the index in force; the later place of each key is written as the next
version.  The index is read without a shuffle, no other batch is read, and no window
runs over all batches.  ``versions`` names the version in force and the batches it covers;
readers of an older version are not disturbed.  The job that writes a version also takes the profile's
figures (``profiles``, a row per version).

A lookup joins the wanted keys with the index (small ones are broadcast, others shuffled into
the buckets) and then reads the snapshot's full rows once, of the batches that hold a
wanted row only: the batches' names, a row each, prune the partitions at run time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.bucketed import Bucketed
from ..sources.tabular import read_if_written
from .audit import snapshot_profile
from .history import SKETCH_BITS
from .joins import DEFAULT_BROADCAST_ROWS, bounded_broadcast
from .snapshot import extract_keys, read_snapshot, winners

BUCKETS = 64
_KEY = ("_campaign_name", "_contact_link")
#: The place of a row, the later the greater (null load times first), and then its order columns.
_PLACE = (("loaded_at", "TIMESTAMP_NTZ"), ("batch_id", "STRING"), ("src_ord", "BIGINT"), ("row_ord", "BIGINT"))
_VERSIONS = "version long, folder string, buckets int, batches array<string>"
_PROFILES = "version long, total_rows long, campaigns binary, earliest timestamp_ntz, latest timestamp_ntz"


class SnapshotIndex:
    """Index below ``root`` over the snapshot at ``snapshot``."""

    def __init__(self, spark: SparkSession, snapshot: str, root: str, buckets: int = BUCKETS):
        self.spark, self.snapshot, self.root, self._buckets = spark, snapshot, root.rstrip("/"), buckets

    def _newest(self):
        versions = read_if_written(self.spark, f"{self.root}/versions")
        return None if versions is None else versions.orderBy(F.desc("version")).first()

    def _table(self, folder: str, buckets: int) -> Bucketed:
        return Bucketed(folder, (*((k, "STRING") for k in _KEY), *_PLACE), _KEY, buckets)

    def read(self) -> DataFrame | None:
        """(campaign, link, place) of every key; None before the first batch."""
        newest = self._newest()
        return None if newest is None else self._table(newest["folder"], newest["buckets"]).read(self.spark)

    def latest(self) -> DataFrame:
        """(batch_id, campaign_name, contact_link, loaded_at) of every key."""
        return self.read().select("batch_id", F.col("_campaign_name").alias("campaign_name"),
                                  F.col("_contact_link").alias("contact_link"), "loaded_at")

    def profile(self, approx: bool = False) -> DataFrame:
        """A3 of the index in force.  ``approx`` reads the version's one row of figures (distinct campaigns from
        a sketch, within a few per cent; the rest exact); a version without such a row is counted."""
        newest, kept = self._newest(), read_if_written(self.spark, f"{self.root}/profiles") if approx else None
        if kept is not None:
            kept = kept.where(F.col("version") == newest["version"])
            if kept.count() == 1:
                return kept.select("total_rows", F.coalesce(F.hll_sketch_estimate("campaigns"), F.lit(0)).cast("long").alias("campaigns"),
                                   "earliest", "latest")
        return snapshot_profile(self.latest())

    def update(self, batch_id: str) -> None:
        """Take a batch of the snapshot into the index.

        A batch that the index covers already was written again: its old places may be gone,
        so the index is built anew from the whole snapshot, as it is for the first batch."""
        newest = self._newest()
        snap = read_snapshot(self.spark, self.snapshot)
        if snap is None:
            raise ValueError(f"no snapshot at {self.snapshot}")
        if newest is None or batch_id in newest["batches"]:
            places = self._places(snap)
            covered = sorted(r["batch_id"] for r in snap.select("batch_id").distinct().collect())   # partition names
            self._write(places, covered, newest)
            return
        delta = self._places(snap.where(F.col("batch_id") == batch_id))
        table = self._table(newest["folder"], newest["buckets"])
        place = F.struct(*[F.col(c) for c, _ in _PLACE])
        old = table.read(self.spark).select(*_KEY, place.alias("old"))
        new = table.dealt(delta).select(*_KEY, place.alias("new"))
        # batches differ, so load time and batch id decide; greatest() skips a side that is missing
        merged = old.join(new.hint("merge"), list(_KEY), "full_outer").select(*_KEY, F.greatest("old", "new").alias("p")).select(*_KEY, "p.*")
        self._write(merged, [*newest["batches"], batch_id], newest)

    def _places(self, snap: DataFrame) -> DataFrame:
        if "loaded_at" not in snap.columns:
            snap = snap.withColumn("loaded_at", F.lit(None).cast("timestamp_ntz"))
        return winners(snap).select(*_KEY, *[F.col(c).cast(t).alias(c) for c, t in _PLACE])

    def _write(self, places: DataFrame, batches: list[str], newest) -> None:
        version = 0 if newest is None else newest["version"] + 1
        buckets = self._buckets if newest is None else newest["buckets"]
        folder = f"{self.root}/v{version}-{uuid.uuid4().hex}"
        seen = self._table(folder, buckets).add(
            places, total_rows=F.count(F.lit(1)), campaigns=F.hll_sketch_agg("_campaign_name", SKETCH_BITS),
            earliest=F.min("loaded_at"), latest=F.max("loaded_at"))
        figures = seen.get
        row = (version, figures["total_rows"], figures["campaigns"], figures["earliest"], figures["latest"])
        self.spark.createDataFrame([row], _PROFILES).coalesce(1).write.mode("append").parquet(f"{self.root}/profiles")
        self.spark.createDataFrame([(version, folder, buckets, batches)], _VERSIONS).coalesce(1) \
            .write.mode("append").parquet(f"{self.root}/versions")

    def places(self, f3: DataFrame, broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
        """Places of the extract's keys."""
        newest = self._newest()
        table = self._table(newest["folder"], newest["buckets"])
        keys, small = bounded_broadcast(extract_keys(f3), broadcast_rows)
        return table.read(self.spark).join(keys if small else table.dealt(keys).hint("merge"), list(_KEY), "left_semi")

    def lookup(self, f3: DataFrame, broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame | None:
        """The latest snapshot rows of the extract's keys; None when there is no snapshot."""
        snap = read_snapshot(self.spark, self.snapshot)
        if snap is None or self._newest() is None:
            return None
        places, _ = bounded_broadcast(self.places(f3, broadcast_rows).select("batch_id", "src_ord", "row_ord", *_KEY), broadcast_rows)
        # one row per batch that holds a wanted row; Spark prunes partitions by a side that has a
        # comparison in its plan, and a stored frame has none of its own
        held = materialize(places.select("batch_id").distinct()).where(F.col("batch_id") > "")
        at = [*_KEY, "batch_id", "src_ord", "row_ord"]
        return snap.join(F.broadcast(held), "batch_id", "left_semi").join(places, at, "left_semi")
