"""Dial counts and the dial-limit rule (A1, A1b, J4, J5, U3, FL2)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sql as X
from ..schema import first_present, sql_or_blank
from .joins import DEFAULT_BROADCAST_ROWS, Marks, bounded_broadcast, row_id, spread_blank_sql

# canonical candidates for the dialled number and the direct number, in order
TEL_CANDIDATES = ["telephone", "phone_office", "dialed_number"]
DIRECT_CANDIDATES = ["direct_number", "direct_number_1", "telephone", "phone_office"]

#: Columns of the dial counts.
COUNTS = "dialed_number string, daily_count long, weekly_count long"

# --- fixed values: campaign defaults (max per day, max per direct period)
DELL_MAX_DAY = 3
DELL_MAX_DIRECT = 3
NON_DELL_MAX_DAY = 9
NON_DELL_MAX_DIRECT = 3


def week_bounds(check_date: dt.date) -> tuple[dt.date, dt.date]:
    monday = check_date - dt.timedelta(days=check_date.weekday())
    return monday, monday + dt.timedelta(days=7)


def with_phone_keys(df: DataFrame) -> DataFrame:
    """Add ``_tel`` (digits of the dialled number) and ``_dtel`` (digits of the
    direct number); the source columns are chosen at plan time from the frame's
    canonical columns."""
    tel = first_present(df, TEL_CANDIDATES)
    dtel = first_present(df, DIRECT_CANDIDATES)
    return df.withColumns({"_tel": F.expr(X.digits(sql_or_blank(df, tel))),
                           "_dtel": F.expr(X.digits(sql_or_blank(df, dtel)))})


def mark_direct(df: DataFrame, direct: DataFrame | None,
                broadcast_rows: int = DEFAULT_BROADCAST_ROWS, marks: Marks | None = None) -> DataFrame:
    """Add boolean ``_is_direct``: the row's direct number is on the direct-dial list
    (given as a frame, or stored already in ``marks``)."""
    marks = marks or Marks(direct=direct, broadcast_rows=broadcast_rows)
    return marks.join(df, "direct", "_dtel", "_dhit").withColumn("_is_direct", F.col("_dhit").isNotNull()).drop("_dhit")


def phone_universe(marked: DataFrame) -> DataFrame:
    """Distinct numbers to count: every dialled number plus listed direct numbers."""
    # one pass over the input: both numbers of a row as an array, exploded
    both = F.array(F.col("_tel"), F.when(F.col("_is_direct"), F.col("_dtel")).otherwise(F.lit("")))
    return (marked.select(F.explode(F.array_distinct(both)).alias("phone"))
                  .where(F.col("phone") != "").distinct())


def week_counts(history: DataFrame, check_date: dt.date, phones: DataFrame | None = None) -> DataFrame:
    """Per number that was dialled in the ISO week of ``check_date``: distinct call ids on the
    day and in the week, from the calls (``dialed_number``, ``call_id``, ``pbx_dialing_date``).

    The store is cut to one week first: a date range that Parquet can push
    down, plus ``dial_week = monday`` on the partition column when the store
    is partitioned that way.  With ``phones`` only its numbers are kept (semi join).
    (number, call) pairs are then deduplicated and counted - two aggregates
    with map-side combine, so a hot number does not land whole in one task."""
    monday, next_monday = week_bounds(check_date)
    h = history
    if "dial_week" in h.columns:
        h = h.where((F.col("dial_week") == F.lit(monday)) & (F.col("pbx_dialing_date") >= F.lit(monday))
                    & (F.col("pbx_dialing_date") < F.lit(next_monday)))
    else:  # calls that are no store yet: their date is parsed, so it stands in the filter once
        h = h.where(F.date_trunc("week", "pbx_dialing_date") == F.lit(monday).cast("timestamp"))
    h = h.select("dialed_number", "call_id", "pbx_dialing_date")
    if phones is not None:
        h = h.join(phones, "dialed_number", "left_semi")
    calls = (h.groupBy("dialed_number", "call_id")
              .agg(F.max(F.col("pbx_dialing_date") == F.lit(check_date)).alias("_today")))
    return calls.groupBy("dialed_number").agg(
        F.count_if(F.col("_today")).cast("long").alias("daily_count"),
        F.count(F.lit(1)).cast("long").alias("weekly_count"))


def dial_counts(history: DataFrame | None, phones: DataFrame, check_date: dt.date) -> DataFrame:
    """Per number in ``phones``: ``week_counts``; 0, 0 for numbers never dialled, and for
    every number when there is no history yet (None or an empty store)."""
    zero = F.lit(0).cast("long")
    p = phones.select(F.col("phone").alias("dialed_number")).distinct()
    if history is None:
        return p.select("dialed_number", zero.alias("daily_count"), zero.alias("weekly_count"))
    return (p.join(week_counts(history, check_date, p), "dialed_number", "left")
             .select("dialed_number", F.coalesce("daily_count", zero).alias("daily_count"),
                     F.coalesce("weekly_count", zero).alias("weekly_count")))


def tag_dial_limits(df: DataFrame, history: DataFrame | None, check_date: dt.date,
                    direct: DataFrame | None = None, max_day: int | None = None,
                    max_direct: int | None = None, is_dell: bool = False,
                    max_direct_week: int | None = None, max_direct_day: int | None = None,
                    max_week: int | None = None, broadcast_rows: int = DEFAULT_BROADCAST_ROWS,
                    marks: Marks | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Add ``dial_limit_reason`` to the rows with a blank ``suppression_reason``
    (suppressed rows are not checked) and the final ``row_status``.

    Checks in order, first failure wins (comparison is ``>``):
    1. direct number listed and its weekly dials > max_direct_week
    2. direct number listed, not Dell, and its daily dials > max_direct_day
    3. dialled number's weekly dials > max_week
    4. dialled number's daily dials > max_day
    A blank dialled number is always allowed.  ``max_direct_week``,
    ``max_direct_day`` and ``max_week`` default to ``max_direct``.  ``marks`` may hold the
    direct list, and ``counts`` the week's counts (``week_counts``, or those that an ingest
    keeps), in place of ``direct`` and ``history``."""
    if max_day is None:
        max_day = DELL_MAX_DAY if is_dell else NON_DELL_MAX_DAY
    if max_direct is None:
        max_direct = DELL_MAX_DIRECT if is_dell else NON_DELL_MAX_DIRECT
    m_dw = max_direct if max_direct_week is None else max_direct_week
    m_dd = max_direct if max_direct_day is None else max_direct_day
    m_w = max_direct if max_week is None else max_week

    if "suppression_reason" not in df.columns:
        df = df.withColumn("suppression_reason", F.lit(""))
    keyed = mark_direct(with_phone_keys(df), direct, broadcast_rows, marks)
    rid = row_id(df)
    # Only numbers that can fail a check matter: a number at or under every
    # threshold behaves exactly like a number never dialled.  They follow from the
    # history alone, without the input's joins; stored once and measured, both
    # lookups are broadcast joins and the wide input rows are never shuffled.
    # Above the bound they are cut to the input's numbers and measured again.
    lo_week, lo_day = min(m_dw, m_w), min(max_day, m_dd if not is_dell else max_day)
    if counts is None:
        counts = week_counts(history, check_date) if history is not None else df.sparkSession.createDataFrame([], COUNTS)
    over, small = bounded_broadcast(counts.where((F.col("weekly_count") > lo_week) | (F.col("daily_count") > lo_day)), broadcast_rows)
    if not small:
        universe = phone_universe(keyed.where(F.col("suppression_reason") == "")).withColumnRenamed("phone", "dialed_number")
        over, _ = bounded_broadcast(over.join(universe, "dialed_number", "left_semi"), broadcast_rows)
    d = check_date.isoformat()
    day, week = "coalesce(_day, 0)", "coalesce(_week, 0)"
    dday, dweek = "coalesce(_dday, 0)", "coalesce(_dweek, 0)"
    # the number of the failing check (0 = none) first, then the reason text
    # and the status from it: a filter on the status that Catalyst pushes down
    # then carries these comparisons only, not the text building
    code = ("CASE WHEN suppression_reason <> '' THEN 0 WHEN _tel = '' THEN 0 "
            f"WHEN _is_direct AND {dweek} > {m_dw} THEN 1 "
            f"WHEN _is_direct AND {str(not is_dell).upper()} AND {dday} > {m_dd} THEN 2 "
            f"WHEN {week} > {m_w} THEN 3 WHEN {day} > {max_day} THEN 4 ELSE 0 END")
    reason = (
        f"CASE _dl_code WHEN 1 THEN concat('Direct-dial weekly limit exceeded: ', "
        f"CAST({dweek} AS STRING), ' dials this ISO week (max {m_dw}, Direct Number in repo)') "
        f"WHEN 2 THEN concat("
        f"'Direct-dial daily limit exceeded: ', CAST({dday} AS STRING), ' dials on {d} (max {m_dd}, Direct Number in repo)') "
        f"WHEN 3 THEN concat('Weekly dial limit exceeded: ', CAST({week} AS STRING), "
        f"' dials this ISO week (max {m_w})') "
        f"WHEN 4 THEN concat('Daily dial limit exceeded: ', CAST({day} AS STRING), "
        f"' dials on {d} (max {max_day})') ELSE '' END")
    ct = over.select(F.col("dialed_number").alias("_ct_k"), F.col("daily_count").alias("_day"),
                     F.col("weekly_count").alias("_week"))
    cd = over.select(F.col("dialed_number").alias("_cd_k"), F.col("daily_count").alias("_dday"),
                     F.col("weekly_count").alias("_dweek"))
    j = (keyed.withColumns({"_tk": F.expr(spread_blank_sql("_tel", rid)),
                            "_dk": F.expr(spread_blank_sql("CASE WHEN _is_direct THEN _dtel ELSE '' END", rid))})
              .join(ct, F.col("_tk") == F.col("_ct_k"), "left")
              .join(cd, F.col("_dk") == F.col("_cd_k"), "left"))
    status = ("CASE WHEN suppression_reason <> '' THEN 'SUPPRESSED' WHEN _dl_code > 0 THEN 'OVER_LIMIT' "
              "ELSE 'GTG' END")
    out = (j.withColumn("_dl_code", F.expr(code))
            .withColumns({"dial_limit_reason": F.expr(reason), "row_status": F.expr(status)}))
    return out.drop("_tk", "_ct_k", "_day", "_week", "_dk", "_cd_k", "_dday", "_dweek", "_tel", "_dtel",
                    "_is_direct", "_dl_code")


def phone_coverage(keyed: DataFrame) -> DataFrame:
    """A14 as (metric, value) rows: non-blank dialled numbers, non-blank direct
    numbers, distinct listed direct numbers present, distinct numbers queried.

    One pass: every row gives its numbers with what they count for; numbers are
    combined map-side, then the per-number flags are summed."""
    listed = F.when(F.col("_is_direct"), F.col("_dtel")).otherwise(F.lit(""))
    each = keyed.select(F.explode(F.array(F.struct(F.col("_tel").alias("phone"), F.lit(1).alias("t"), F.lit(0).alias("d"), F.lit(False).alias("l")),
                                          F.struct(listed.alias("phone"), F.lit(0).alias("t"),
                                                   (F.col("_dtel") != "").cast("int").alias("d"), F.col("_is_direct").alias("l")))).alias("x"))
    per = each.groupBy("x.phone").agg(F.sum("x.t").alias("t"), F.sum("x.d").alias("d"), F.max("x.l").alias("l"))
    named = F.col("phone") != ""
    sums = per.agg(F.sum(F.when(named, F.col("t")).otherwise(0)).alias("tel_nonblank"), F.sum("d").alias("dtel_nonblank"),
                   F.count_if(named & F.col("l")).alias("direct_in_list"), F.count_if(named).alias("phones_queried"))
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("value"))
                                           for c in sums.columns])).alias("m")).select("m.metric", "m.value")
