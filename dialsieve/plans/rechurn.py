"""P2 - rechurn run over a call extract: suppress -> dial limits -> merge with the
snapshot -> clean -> output.  Writes no audit and no snapshot."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.audit import (activity_row, campaign_list, export_rows, export_run, observed_metrics, status_figures,
                               write_run_log)
from ..operators.output import transform_and_output
from ..operators.qa import gtg_filter, rechurn_filter
from ..operators.snapshot import rechurn_merge, snapshot_lookup
from ..schema import OUTPUT_COLUMNS
from ..session import materialize, observed
from .contact import Limits, Lists, tag


def rechurn_tagged(f3: DataFrame, lists: Lists, history: DataFrame, limits: Limits,
                   filter_rechurn: bool = False) -> DataFrame:
    """Tagged extract rows; ``filter_rechurn`` applies the disposition filter
    first (off by default, as in the reference's pipeline)."""
    src = rechurn_filter(f3) if filter_rechurn else f3
    return tag(src, lists, history, limits)


def rechurn_output(f3: DataFrame, snapshot: DataFrame | None, lists: Lists, history: DataFrame,
                   limits: Limits, run_ts: str, filter_rechurn: bool = False) -> DataFrame:
    """Lazy P2 output (66 columns)."""
    return _output(rechurn_tagged(f3, lists, history, limits, filter_rechurn), f3, snapshot, run_ts)


def _output(tagged: DataFrame, f3: DataFrame, snapshot: DataFrame | None, run_ts: str) -> DataFrame:
    allowed = tagged.where(F.col("row_status") == "GTG").drop("suppression_reason", "dial_limit_reason", "row_status")
    merged = rechurn_merge(allowed, snapshot, keys_from=f3)
    merged = merged.drop("_matched")
    out = transform_and_output(merged, run_ts)
    return out.select(*[F.col(f"`{c}`") for c in OUTPUT_COLUMNS])


def gtg_output(f3: DataFrame, snapshot: DataFrame, run_ts: str) -> DataFrame:
    """The extract's second output: snapshot rows matched by the extract's
    (campaign, link) keys, GTG-filtered by their QA columns (FL4), then the
    cleaning chain, the 66 columns and the keep-first dedup."""
    # the filter decides on all matched rows before it reads them: one computation serves both
    matched = materialize(snapshot_lookup(snapshot, f3))
    matched = matched.drop(*[c for c in ("batch_id", "loaded_at", "_campaign_name", "_contact_link")
                             if c in matched.columns])
    out = transform_and_output(gtg_filter(matched), run_ts)
    return out.select(*[F.col(f"`{c}`") for c in OUTPUT_COLUMNS])


def run_rechurn(f3: DataFrame, snapshot: DataFrame | None, lists: Lists, history: DataFrame | None, limits: Limits, *,
                run_ts: str, batch_id: str, out_dir: str, runlog_path: str | None = None, username: str = "",
                filter_rechurn: bool = False, csv_dir: str | None = None) -> dict:
    """Run P2 end to end: output, removed rows (partitioned by ``row_status``), run-log row.

    The tagged extract is checkpointed once and every sink reads it; the metrics are observed by the
    jobs that write.  ``csv_dir`` also gets the rows as CSV.  A run that is started again replaces
    its own files and its own run-log row."""
    at = dt.datetime.strptime(run_ts, "%Y-%m-%d %H:%M:%S")
    rows, statuses = observed(rechurn_tagged(f3, lists, history, limits, filter_rechurn), **status_figures())
    tagged = materialize(rows)
    output, written = observed(_output(tagged, f3, snapshot, run_ts), n=F.count(F.lit(1)))
    output.write.mode("overwrite").parquet(f"{out_dir}/output")
    export_rows(tagged.where(F.col("row_status") != "GTG")).write.mode("overwrite") \
        .partitionBy("row_status").parquet(f"{out_dir}/removed")
    if csv_dir:
        export_run(tagged.sparkSession, out_dir, csv_dir)
    metrics_df = observed_metrics(tagged.sparkSession, statuses.get, written.get["n"])
    metrics = metrics_df.first().asDict() | {"campaigns": campaign_list(f3).first()["campaigns"], "batch_id": batch_id}
    if runlog_path:
        write_run_log(activity_row(metrics_df, at, username, "rechurn", batch_id, metrics["campaigns"]), runlog_path)
    return metrics
