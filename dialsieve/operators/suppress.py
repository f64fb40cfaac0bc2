"""Suppression tagging (J1-J3, FL1) and suppression-list maintenance."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sql as X
from ..functions.dates import parse_timestamp_sql
from ..schema import first_present, q, sql_or_blank
from ..sources.tabular import read_if_written
from .joins import DEFAULT_BROADCAST_ROWS, Marks

# --- fixed values: suppression reasons, in priority order
DEAD_REASON = "DEAD/DNC Email"
RPC_REASON = "RPC+ Email"
DOMAIN_REASON = "Company Domain DNC"

# --- fixed values: dispositions that extend the lists
DEAD_DISPOSITIONS = ["dead contact", "dnc prospect"]
RPC_DISPOSITIONS = ["bant lead", "lead scored", "operator confirmed", "prospect call back",
                    "rpc vm reached", "rpc vm reached replacement"]
RPC_WINDOW_DAYS = 31


def tag_suppressions(df: DataFrame, dead: DataFrame | None = None, rpc: DataFrame | None = None,
                     domain: DataFrame | None = None,
                     broadcast_rows: int = DEFAULT_BROADCAST_ROWS, marks: Marks | None = None) -> DataFrame:
    """Add ``suppression_reason``: dead > RPC+ > domain, first hit wins, '' when clean.

    Lists are one-column key frames (``key``), already trimmed/lower-cased
    (``sources.lists.suppression_keys``); ``None`` = list missing or toggled off.  The two
    email lists are one (key, priority) side, so an input row meets one email join and one
    domain join.  ``marks`` gives lists that are stored already, in place of the frames."""
    marks = marks or Marks(dead, rpc, domain, broadcast_rows=broadcast_rows)
    out = marks.join(df, "email", X.norm_lower(sql_or_blank(df, "email_address")), "_eprio")
    out = marks.join(out, "domain", X.norm_lower(sql_or_blank(df, "domain")), "_dhit")
    reason = (F.when(F.col("_eprio") == 1, F.lit(DEAD_REASON)).when(F.col("_eprio") == 2, F.lit(RPC_REASON))
               .when(F.col("_dhit").isNotNull(), F.lit(DOMAIN_REASON)).otherwise(F.lit("")))
    return out.withColumn("suppression_reason", reason).drop("_eprio", "_dhit")


def _last_per_key(frame: DataFrame, key: str) -> DataFrame:
    """Keep the last row per key in (list version, ord) order."""
    w = Window.partitionBy(key).orderBy(F.col("_ver").desc(), F.col("_ord").desc())
    return frame.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_ver", "_ord")


def _calls_view(calls: DataFrame):
    email = first_present(calls, ["email_address", "email"])
    disp = first_present(calls, ["dgs_disposition"])
    date = first_present(calls, ["pbx_dialing_date"])
    return email, disp, date


def update_dead_list(calls: DataFrame, existing: DataFrame | None = None) -> DataFrame | None:
    """New dead/DNC list: existing list + emails of calls with a dead disposition,
    one row per email (the last one; new rows rank after existing ones).
    ``None`` when the calls lack an email or disposition column."""
    email, disp, _ = _calls_view(calls)
    if email is None or disp is None:
        return existing
    ord_cols = [F.col(c) for c in ("src_ord", "row_ord") if c in calls.columns] or [F.lit(0)]
    new = (calls.where(F.expr(f"{X.norm_lower(q(disp))} IN ({X.lits(DEAD_DISPOSITIONS)})"))
                .select(F.expr(X.norm_lower(q(email))).alias("email"), F.lit(2).alias("_ver"),
                        F.struct(*ord_cols).cast(old_ord_type(ord_cols)).alias("_ord"))
                .where(F.col("email") != ""))
    if existing is not None:
        ecol = next((c for c in existing.columns if c.lower() in ("email id", "email", "emailaddress")),
                    existing.columns[0])
        old = existing.select(F.expr(X.norm_lower(q(ecol))).alias("email"), F.lit(1).alias("_ver"),
                              _list_order(existing, len(ord_cols)).alias("_ord"))
        new = old.select("email", "_ver", F.col("_ord").cast(old_ord_type(ord_cols))).unionByName(new)
    return _last_per_key(new, "email")


def _list_order(existing: DataFrame, width: int):
    """Order key of an existing list's rows: its ``row_ord`` when present (file
    order), padded to the width of the new rows' order key."""
    o = F.col("row_ord").cast("long") if "row_ord" in existing.columns else F.monotonically_increasing_id()
    return F.struct(*([F.lit(0).cast("long")] * (width - 1) + [o])).cast(
        "struct<" + ",".join(f"col{i + 1}:long" for i in range(width)) + ">")


def old_ord_type(ord_cols) -> str:
    return "struct<" + ",".join(f"col{i + 1}:long" for i in range(len(ord_cols))) + ">"


def update_rpc_list(calls: DataFrame, as_of: dt.datetime, existing: DataFrame | None = None) -> DataFrame | None:
    """New RPC+ list (email, disposition, dialing_date): existing + emails of
    right-party dispositions dialled on/after ``as_of`` - 31 days (the date
    test is skipped when there is no date column; an unparseable date fails
    it).  ``dialing_date`` is the maintenance date.  Last row per email kept."""
    email, disp, date = _calls_view(calls)
    if email is None or disp is None:
        return existing
    ord_cols = [F.col(c) for c in ("src_ord", "row_ord") if c in calls.columns] or [F.lit(0)]
    cond = F.expr(f"{X.norm_lower(q(disp))} IN ({X.lits(RPC_DISPOSITIONS)})")
    if date is not None:
        # compared as wall-clock (no time zone) values on both sides
        cutoff = as_of - dt.timedelta(days=RPC_WINDOW_DAYS)
        typed = dict(calls.dtypes)[date] in ("date", "timestamp", "timestamp_ntz")
        ts = f"CAST({q(date)} AS TIMESTAMP_NTZ)" if typed else f"CAST({parse_timestamp_sql(q(date))} AS TIMESTAMP_NTZ)"
        cond = cond & F.expr(f"coalesce({ts} >= {X.ts_ntz(cutoff)}, false)")
    new = (calls.where(cond)
                .select(F.expr(X.norm_lower(q(email))).alias("email"), F.expr(X.norm(q(disp))).alias("disposition"),
                        F.lit(as_of.strftime("%Y-%m-%d")).alias("dialing_date"), F.lit(2).alias("_ver"),
                        F.struct(*ord_cols).cast(old_ord_type(ord_cols)).alias("_ord"))
                .where(F.col("email") != ""))
    if existing is not None:
        ecol = next((c for c in existing.columns if c.lower() == "email"), existing.columns[0])
        old = existing.select(
            F.expr(X.norm_lower(q(ecol))).alias("email"),
            (F.col("disposition") if "disposition" in existing.columns else F.lit("")).cast("string").alias("disposition"),
            (F.col("dialing_date") if "dialing_date" in existing.columns else F.lit("")).cast("string").alias("dialing_date"),
            F.lit(1).alias("_ver"),
            _list_order(existing, len(ord_cols)).alias("_ord"))
        new = old.unionByName(new)
    return _last_per_key(new, "email")


def write_list(keys: DataFrame, lists_dir: str, name: str, version: str, written_at: dt.datetime | None = None) -> str:
    """K5/K6: write a list as a new version and record it in the list's manifest.

    A list is never overwritten in place (readers may be reading it).  The newest
    manifest row (by write time, then version) names the list in force, so a list
    can also be replaced by an empty one."""
    root = lists_dir.rstrip("/")
    path = f"{root}/{name}/v={version}"
    keys.write.mode("overwrite").parquet(path)
    spark = keys.sparkSession
    at = written_at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    spark.createDataFrame([(version, at)], "version string, written_at timestamp_ntz") \
        .write.mode("append").parquet(f"{root}/{name}-versions")
    return path


def read_list(spark, lists_dir: str, name: str) -> DataFrame | None:
    """The list in force, or None when no version was ever written - the matching
    suppression step is then skipped.  Any other trouble (no permission, a broken
    file, a recorded version that is gone) raises: a list is never skipped silently."""
    root = lists_dir.rstrip("/")
    versions = read_if_written(spark, f"{root}/{name}-versions")
    newest = None if versions is None else versions.orderBy(F.col("written_at").desc(), F.col("version").desc()).first()
    return None if newest is None else spark.read.parquet(f"{root}/{name}/v={newest['version']}")
