"""P1 - contact-list run: collate -> suppress -> dial limits -> audit + snapshot -> clean -> output."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.audit import (activity_row, audit_rows, batch_campaign, campaign_list, export_rows, export_run, observed_metrics,
                               replace_batch, status_figures, write_run_log)
from ..operators.dial import tag_dial_limits
from ..operators.joins import Marks
from ..operators.output import transform_and_output
from ..operators.snapshot import snapshot_rows, write_snapshot
from ..operators.suppress import tag_suppressions
from ..schema import OUTPUT_COLUMNS
from ..session import materialize, observed


@dataclass
class Lists:
    """Suppression and direct-dial key frames; ``None`` = missing or toggled off."""
    dead: DataFrame | None = None
    rpc: DataFrame | None = None
    domain: DataFrame | None = None
    direct: DataFrame | None = None


@dataclass
class Limits:
    check_date: dt.date
    max_day: int | None = None
    max_direct: int | None = None
    is_dell: bool = False


def tag(collated: DataFrame, lists: Lists, history: DataFrame | None, limits: Limits,
        counts: DataFrame | None = None) -> DataFrame:
    """One tagged frame: every input row with suppression / dial-limit reasons
    and ``row_status`` in {GTG, SUPPRESSED, OVER_LIMIT}.

    The lists are stored once as one frame and measured in the same job.  ``counts`` may
    give the week's dial counts in place of ``history``."""
    marks = Marks(lists.dead, lists.rpc, lists.domain, lists.direct)
    return tag_dial_limits(tag_suppressions(collated, marks=marks), history, limits.check_date, None, limits.max_day,
                           limits.max_direct, limits.is_dell, marks=marks, counts=counts)


def output_of(tagged: DataFrame, run_ts: str) -> DataFrame:
    """The 66-column output of the GTG rows (deduplicated)."""
    return transform_and_output(tagged.where(F.col("row_status") == "GTG"), run_ts)


def contact_output(collated: DataFrame, lists: Lists, history: DataFrame, limits: Limits,
                   run_ts: str) -> DataFrame:
    """Lazy P1 output (66 columns, no order columns)."""
    return output_of(tag(collated, lists, history, limits), run_ts).select(*[F.col(f"`{c}`") for c in OUTPUT_COLUMNS])


def run_contact(collated: DataFrame, lists: Lists, history: DataFrame, limits: Limits, *, run_ts: str,
                batch_id: str, campaign_type: str, out_dir: str, snapshot_path: str | None = None,
                audit_path: str | None = None, runlog_path: str | None = None, username: str = "",
                csv_dir: str | None = None) -> dict:
    """Run P1 end to end with sinks.

    The tagged frame is checkpointed once (shared checkpoint folder), then
    every sink reads it: output, suppressed and over-limit rows (one Parquet
    dataset partitioned by ``row_status``), the audit rows, the snapshot
    batch.  Nothing is recomputed per sink and a lost executor re-reads the
    checkpoint instead of the whole upstream plan.  The metrics are observed by the jobs that
    store the tagged rows and write the output, no pass counts them.  ``csv_dir`` also gets
    output and removed rows as CSV.  Audit, snapshot and run log are
    partitioned by ``batch_id``: a run that is started again replaces its own rows."""
    processed_at = dt.datetime.strptime(run_ts, "%Y-%m-%d %H:%M:%S")
    rows, statuses = observed(tag(collated, lists, history, limits), **status_figures())
    tagged = materialize(rows)
    output, written = observed(output_of(tagged, run_ts).select(*[F.col(f"`{c}`") for c in OUTPUT_COLUMNS]), n=F.count(F.lit(1)))
    output.write.mode("overwrite").parquet(f"{out_dir}/output")
    export_rows(tagged.where(F.col("row_status") != "GTG")).write.mode("overwrite") \
        .partitionBy("row_status").parquet(f"{out_dir}/removed")
    camp = batch_campaign(tagged)
    if audit_path:
        replace_batch(audit_rows(tagged, batch_id, processed_at, campaign_type, camp, camp), audit_path)
    if snapshot_path:
        snap = snapshot_rows(collated, batch_id, processed_at)
        if snap is not None:
            write_snapshot(snap, snapshot_path)
    if csv_dir:
        export_run(tagged.sparkSession, out_dir, csv_dir)
    metrics_df = observed_metrics(tagged.sparkSession, statuses.get, written.get["n"])
    metrics = metrics_df.first().asDict()
    metrics["campaigns"] = campaign_list(tagged).first()["campaigns"]
    metrics["batch_id"] = batch_id
    if runlog_path:
        write_run_log(activity_row(metrics_df, processed_at, username, "contact", batch_id, metrics["campaigns"]),
                      runlog_path)
    return metrics
