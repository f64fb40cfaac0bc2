"""P3 - history load: ingest a call file into the store, then extend the lists."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from ..operators.history import append_history
from ..operators.suppress import read_list, update_dead_list, update_rpc_list, write_list
from ..schema import CALL_LAYOUT, canonicalize
from ..session import materialize


def load_history(spark: SparkSession, store_path: str, raw_batch: DataFrame, batch_id: str,
                 loaded_at: dt.datetime, lists_dir: str | None = None, as_of: dt.datetime | None = None,
                 version: str | None = None) -> dict:
    """K1 then K5.  An empty upload is a no-op (no list maintenance).

    The stored lists are read, extended and, where this upload adds to them, written as a
    new version; a list that would not change keeps the version in force."""
    counts = append_history(spark, store_path, raw_batch, batch_id, loaded_at)
    if counts["total"] and lists_dir is not None:
        maintain_lists(spark, canonicalize(raw_batch, CALL_LAYOUT), lists_dir, version or batch_id, as_of or loaded_at, loaded_at)
    return counts


def maintain_lists(spark: SparkSession, calls: DataFrame, lists_dir: str, version: str, as_of: dt.datetime,
                   written_at: dt.datetime) -> None:
    """K5: the dead and RPC+ lists with what these calls add."""
    dead, rpc = read_list(spark, lists_dir, "dead"), read_list(spark, lists_dir, "rpc")
    for name, stored, longer in (("dead", dead, update_dead_list(calls, dead)), ("rpc", rpc, update_rpc_list(calls, as_of, rpc))):
        if longer is None or longer is stored:
            continue
        longer = materialize(longer)
        added = longer.limit(1).count() if stored is None else longer.exceptAll(stored.select(*longer.columns)).limit(1).count()
        if added:
            write_list(longer, lists_dir, name, version, written_at)
