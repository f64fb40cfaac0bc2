"""Audit trail, run metrics and reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sql as X
from ..functions.phone import STATUSES
from ..schema import ORDER_COLUMNS, col_or_blank, first_present, labels_of, q, sql_or_blank
from ..sources.tabular import read_if_written

BLANK_CAMPAIGN = ["", "nan", "None", "-"]


def campaign_first(df: DataFrame) -> DataFrame:
    """The first non-blank (trimmed) campaign code in upload order, one row."""
    c = F.expr(X.norm(sql_or_blank(df, "campaign_name")))
    return (df.where(c != "")
              .agg(F.min_by(c, F.struct(*[F.col(x) for x in ORDER_COLUMNS if x in df.columns])).alias("campaign_code"))
              .select(F.coalesce("campaign_code", F.lit("")).alias("campaign_code")))


def campaign_list(df: DataFrame) -> DataFrame:
    """Distinct non-blank campaign codes, sorted, joined with ', ' (one row, as wide as
    the result is).  Distinct values are found with a distributed aggregate first;
    only the distinct codes reach the final row."""
    codes = df.selectExpr(f"{X.norm(sql_or_blank(df, 'campaign_name'))} AS c").where("c != ''").distinct()
    return codes.agg(F.array_join(F.sort_array(F.collect_list("c")), ", ").alias("campaigns")) \
                .select(F.coalesce("campaigns", F.lit("")).alias("campaigns"))


def batch_campaign_frame(tagged: DataFrame) -> DataFrame:
    """One row, one column: the first non-blank campaign among GTG rows, else
    suppressed, else over-limit rows (NULL when there is none)."""
    c = F.expr(X.norm(sql_or_blank(tagged, "campaign_name")))
    rank = F.expr("CASE row_status WHEN 'GTG' THEN 1 WHEN 'SUPPRESSED' THEN 2 ELSE 3 END")
    return (tagged.where(c != "")
                  .agg(F.min_by(c, F.struct(rank, *[F.col(x) for x in ORDER_COLUMNS if x in tagged.columns]))
                       .alias("v")))


def batch_campaign(tagged: DataFrame, fallback: str = "") -> str:
    """Batch-level campaign as a Python value (one bounded row), for run logs."""
    row = batch_campaign_frame(tagged).first()
    return (row["v"] if row and row["v"] else "") or fallback


def _json_sql(df: DataFrame, with_limit: bool) -> str:
    cols = [c for c in df.columns if not c.startswith("_") and c not in ORDER_COLUMNS
            and c not in ("row_status", "dial_limit_reason", "suppression_reason")]
    label = labels_of(df, cols)
    fields = [f"{X.lit(label[c])}, coalesce(CAST({q(c)} AS STRING), '')" for c in cols]
    fields.append("'suppression_reason', suppression_reason")
    if with_limit:
        fields.append("'dial_limit_reason', dial_limit_reason")
    return "to_json(named_struct(" + ", ".join(fields) + "))"


def audit_rows(tagged: DataFrame, batch_id: str, processed_at: dt.datetime, campaign_type: str,
               campaign_code: str = "", batch_campaign_name: str | None = None) -> DataFrame:
    """K3: one audit row per input row.

    ``campaign_code``/``campaign_name`` = the row's trimmed campaign, or the
    batch-level campaign when blank; ``row_json`` = the row's input columns
    (export labels) plus its reasons - a suppressed row carries no dial-limit
    reason, as it was never checked."""
    if batch_campaign_name is None:
        # a scalar subquery: computed once inside the same query, no collect
        fallback = F.coalesce(batch_campaign_frame(tagged).scalar(), F.lit(campaign_code))
    else:
        fallback = F.lit(batch_campaign_name)
    c = X.norm(sql_or_blank(tagged, "campaign_name"))
    tagged = tagged.withColumn("_fallback_campaign", fallback)
    camp = f"CASE WHEN {c} IN ({X.lits(BLANK_CAMPAIGN)}) THEN _fallback_campaign ELSE {c} END"
    row_json = (f"CASE WHEN row_status = 'SUPPRESSED' THEN {_json_sql(tagged, False)} "
                f"ELSE {_json_sql(tagged, True)} END")
    order = [x for x in ORDER_COLUMNS if x in tagged.columns]
    return tagged.selectExpr(
        *order, f"{X.lit(batch_id)} AS batch_id",
        f"{X.ts_ntz(processed_at)} AS processed_at",
        f"{camp} AS campaign_code", f"{camp} AS campaign_name", f"{X.lit(campaign_type)} AS campaign_type",
        "row_status", "suppression_reason",
        "CASE WHEN row_status = 'OVER_LIMIT' THEN dial_limit_reason ELSE '' END AS dial_limit_reason",
        f"{row_json} AS row_json")


def run_metrics(tagged: DataFrame, output: DataFrame | None = None) -> DataFrame:
    """A11/K4 metrics of one run in one pass: total, GTG, suppressed, over
    limit, and duplicates removed by the output dedup (total GTG - output)."""
    m = tagged.agg(
        F.count(F.lit(1)).cast("long").alias("total_rows"),
        F.count_if(F.col("row_status") == "GTG").cast("long").alias("gtg_rows"),
        F.count_if(F.col("row_status") == "SUPPRESSED").cast("long").alias("suppressed"),
        F.count_if(F.col("row_status") == "OVER_LIMIT").cast("long").alias("over_limit"))
    if output is None:
        return m.withColumn("dedup_removed", F.lit(0).cast("long"))
    both = (tagged.select(F.col("row_status"), F.lit(0).alias("_o"))
                  .unionByName(output.select(F.lit("_OUT").alias("row_status"), F.lit(1).alias("_o"))))
    return both.agg(
        F.count_if(F.col("_o") == 0).cast("long").alias("total_rows"),
        F.count_if(F.col("row_status") == "GTG").cast("long").alias("gtg_rows"),
        F.count_if(F.col("row_status") == "SUPPRESSED").cast("long").alias("suppressed"),
        F.count_if(F.col("row_status") == "OVER_LIMIT").cast("long").alias("over_limit"),
        (F.count_if(F.col("row_status") == "GTG") - F.count_if(F.col("_o") == 1)).cast("long").alias("dedup_removed"))


def status_figures() -> dict[str, F.Column]:
    """The tagged rows' part of the metrics, as figures that the job that stores them takes."""
    rows = lambda status: F.count_if(F.col("row_status") == status)
    return {"total_rows": F.count(F.lit(1)), "gtg_rows": rows("GTG"), "suppressed": rows("SUPPRESSED"), "over_limit": rows("OVER_LIMIT")}


def observed_metrics(spark: SparkSession, tagged: dict, output_rows: int) -> DataFrame:
    """``run_metrics`` from what was observed while the tagged rows and the output were written: one row."""
    row = {**tagged, "dedup_removed": tagged["gtg_rows"] - output_rows}
    return spark.createDataFrame([row], ", ".join(f"{c} long" for c in row))


def activity_row(metrics: DataFrame, logged_at: dt.datetime, username: str, pipeline: str, batch_id: str,
                 campaign_name: str, notes: str = "") -> DataFrame:
    """K4: the run-log row built from the metrics frame."""
    return metrics.select(
        F.expr(X.ts_ntz(logged_at)).alias("logged_at"), F.lit(username).alias("username"),
        F.lit(pipeline).alias("pipeline"), F.lit(batch_id).alias("batch_id"),
        F.lit(campaign_name).alias("campaign_name"), "total_rows", "gtg_rows", "suppressed", "over_limit",
        "dedup_removed", F.lit(notes).alias("notes"))


def export_rows(tagged: DataFrame) -> DataFrame:
    """K7: removed rows as exported - input columns under their file labels,
    then the reasons and the status (used to partition the export)."""
    cols = [c for c in tagged.columns if not c.startswith("_") and c not in ORDER_COLUMNS
            and c not in ("row_status", "dial_limit_reason", "suppression_reason")]
    label = labels_of(tagged, cols)
    return tagged.selectExpr(*[f"{q(c)} AS {q(label[c])}" for c in cols],
                             "suppression_reason", "dial_limit_reason", "row_status")


def activity_report(runs: DataFrame, n: int = 1000) -> DataFrame:
    """K7: the newest ``n`` rows of the written run log as exported (ties by batch), label cleaned."""
    return (runs.select("logged_at", "username", "pipeline", "batch_id", _label(F.col("campaign_name")).alias("campaign"),
                        "total_rows", "gtg_rows", "suppressed", "over_limit", "notes")
                .orderBy(F.col("logged_at").desc(), F.col("batch_id").desc()).limit(n))


def write_csv(rows: DataFrame, path: str) -> None:
    """K7: a folder of CSV files, each with the header line; every cell is quoted and quotes are
    doubled, so ``read_table`` gives the texts back (with ``multiLine`` where cells hold line breaks)."""
    rows.write.mode("overwrite").options(header="true", quoteAll="true", escape='"', emptyValue="", nullValue="",
                                         ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)


def export_run(spark: SparkSession, out_dir: str, csv_dir: str) -> None:
    """K7: what a run wrote below ``out_dir`` as CSV: the output and, apart, the suppressed and the
    over-limit rows.  The Parquet files are read, nothing is computed again."""
    write_csv(spark.read.parquet(f"{out_dir}/output"), f"{csv_dir}/output")
    removed = read_if_written(spark, f"{out_dir}/removed")
    for status in ("SUPPRESSED", "OVER_LIMIT") if removed is not None else ():
        write_csv(removed.where(F.col("row_status") == status).drop("row_status"), f"{csv_dir}/{status.lower()}")


def export_reports(audit: DataFrame, runs: DataFrame, csv_dir: str, n: int = 1000) -> None:
    """K7: the audit summary and the activity log as CSV."""
    write_csv(audit_summary(audit), f"{csv_dir}/audit")
    write_csv(activity_report(runs, n), f"{csv_dir}/activity")


def replace_batch(rows: DataFrame, path: str) -> None:
    """Write the rows of a batch into its ``batch_id`` partition, replacing what an earlier
    run of the same batch left there; other batches are not touched."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def write_run_log(row: DataFrame, path: str) -> None:
    """K4: the run-log row (``activity_row``) of a batch."""
    replace_batch(row, path)


def _label(*cols) -> F.Column:
    """First non-blank trimmed value, else an em dash."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cols], F.lit("—"))


def audit_summary(audit: DataFrame) -> DataFrame:
    """A5: per batch x campaign label x type; newest first (O1)."""
    lab = _label(F.col("campaign_name"), F.col("campaign_code"))
    return (audit.groupBy("batch_id", lab.alias("campaign"), "campaign_type")
                 .agg(F.min("processed_at").alias("processed_at"),
                      F.count(F.lit(1)).cast("long").alias("total_rows"),
                      F.count_if(F.col("row_status") == "GTG").cast("long").alias("gtg"),
                      F.count_if(F.col("row_status") == "SUPPRESSED").cast("long").alias("suppressed"),
                      F.count_if(F.col("row_status") == "OVER_LIMIT").cast("long").alias("over_limit"))
                 .orderBy(F.col("processed_at").desc(), "batch_id", "campaign", "campaign_type"))


def pipeline_stats(runs: DataFrame) -> DataFrame:
    """A4/O3: per pipeline runs, sums and last run, most recent first."""
    return (runs.groupBy("pipeline")
                .agg(F.count(F.lit(1)).cast("long").alias("runs"),
                     F.sum("total_rows").cast("long").alias("total_rows"),
                     F.sum("gtg_rows").cast("long").alias("gtg_rows"),
                     F.sum("suppressed").cast("long").alias("suppressed"),
                     F.sum("over_limit").cast("long").alias("over_limit"),
                     F.max("logged_at").alias("last_run"))
                .orderBy(F.col("last_run").desc(), "pipeline"))


def grand_totals(runs: DataFrame) -> DataFrame:
    """Totals over every pipeline."""
    return runs.agg(*[F.sum(c).cast("long").alias(c) for c in ("total_rows", "gtg_rows", "suppressed", "over_limit")])


def list_sizes(lists: dict[str, DataFrame | None]) -> DataFrame:
    """Rows of every list, 0 for an empty or missing one."""
    frames = [df for df in lists.values() if df is not None]
    spark = frames[0].sparkSession
    parts = spark.createDataFrame([(name, 0) for name in lists], "list string, n int")
    for name, df in lists.items():
        if df is not None:
            parts = parts.unionByName(df.select(F.lit(name).alias("list"), F.lit(1).alias("n")))
    return parts.groupBy("list").agg(F.sum("n").cast("long").alias("n"))


def activity_topk(runs: DataFrame, n: int = 1000) -> DataFrame:
    """O2: newest ``n`` run-log rows (ties broken by id), campaign label cleaned.
    ``orderBy().limit()`` plans as TakeOrderedAndProject: a per-partition top-n,
    never a full sort."""
    return (runs.select("id", "logged_at", "username", "pipeline", "batch_id",
                        _label(F.col("campaign_name")).alias("campaign"),
                        "total_rows", "gtg_rows", "suppressed", "over_limit")
                .orderBy(F.col("logged_at").desc(), F.col("id").desc()).limit(n))


def snapshot_profile(snap: DataFrame, loaded_at_col: str = "loaded_at") -> DataFrame:
    """A3: rows, distinct campaigns, first/last load time of the key index."""
    return snap.agg(F.count(F.lit(1)).cast("long").alias("total_rows"),
                    F.count_distinct("campaign_name").cast("long").alias("campaigns"),
                    F.min(loaded_at_col).alias("earliest"), F.max(loaded_at_col).alias("latest"))


def phone_profile(validated: DataFrame) -> DataFrame:
    """Count and share (one decimal) per phone status, zero rows shown.

    Counts per status are one aggregate (a handful of rows); the total is a
    sum over that tiny frame, so nothing row-sized leaves the aggregate."""
    spark = validated.sparkSession
    zeros = spark.createDataFrame([(s, 0) for s in STATUSES], "tel_valid string, n long")
    counts = validated.groupBy("tel_valid").agg(F.count(F.lit(1)).cast("long").alias("n"))
    allc = counts.unionByName(zeros).withColumn("total", F.sum("n").over(Window.partitionBy()))
    per = (allc.where(F.col("tel_valid").isin(STATUSES)).groupBy("tel_valid")
               .agg(F.sum("n").cast("long").alias("n"), F.max("total").cast("long").alias("total")))
    pct = F.when(F.col("total") > 0, F.round(F.lit(100.0) * F.col("n") / F.col("total"), 1)).otherwise(F.lit(0.0))
    return per.select("tel_valid", "n", pct.cast("double").alias("pct"))


def limit_breakdown(tagged: DataFrame) -> DataFrame:
    """Over-limit reasons by frequency."""
    return (tagged.where(F.col("row_status") == "OVER_LIMIT").groupBy("dial_limit_reason")
                  .agg(F.count(F.lit(1)).cast("long").alias("n"))
                  .orderBy(F.col("n").desc(), "dial_limit_reason"))


def suppression_summary(tagged: DataFrame) -> DataFrame:
    """Rows per suppression reason ('' = clean)."""
    return tagged.groupBy("suppression_reason").agg(F.count(F.lit(1)).cast("long").alias("n"))


def invalid_sample(validated: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` invalid raw numbers in upload order.

    A top-n with invalid rows ranked first, filtered after the limit: the same
    rows as filter-then-top-n, but the status test stays above the top-n
    instead of being pushed (and inlined) into the scan."""
    tel = first_present(validated, ["telephone", "phone_office"])
    order = [F.col(x) for x in ORDER_COLUMNS if x in validated.columns]
    bad = F.col("tel_valid") == "invalid"
    top = (validated.select(*order, bad.alias("_bad"),
                            col_or_blank(validated, tel).alias("tel") if tel else F.lit("").alias("tel"))
                    .orderBy(F.col("_bad").desc(), *order).limit(n))
    return top.where("_bad").drop("_bad")
