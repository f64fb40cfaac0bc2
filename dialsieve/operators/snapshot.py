"""Contact snapshot: write, latest-wins read, lookup and the field-override
merge with later call extracts (K2, K9, J7, J8, J10, W4, W5, FL8).

A snapshot batch holds every collated row of a contact run plus ``batch_id``
and the normalised join keys ``_campaign_name`` / ``_contact_link`` (lower,
trim, URL uncleaned).  It is Parquet partitioned by ``batch_id``; an upsert is
a new batch, and readers take, per key, the row of the batch loaded last (then
the first row in upload order; the order columns are unique within a batch).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sql as X
from ..schema import ORDER_COLUMNS, first_present, key_columns, sql_or_blank
from ..sources.tabular import read_if_written
from .audit import replace_batch
from .joins import row_id, spread_blank_sql

CAMPAIGN_CANDIDATES = ["campaign_name"]
SNAPSHOT_LINK_CANDIDATES = ["profile_url", "contact_link", "contact_li_url"]
EXTRACT_LINK_CANDIDATES = ["contact_link", "profile_url", "contactid"]
INTERNAL = ("batch_id", "loaded_at", "_campaign_name", "_contact_link")


def snapshot_rows(collated: DataFrame, batch_id: str, loaded_at=None) -> DataFrame | None:
    """K2 frame: all collated rows + batch id (+ load time) + normalised keys;
    ``None`` when the input has no campaign or no link column."""
    camp = first_present(collated, CAMPAIGN_CANDIDATES)
    link = first_present(collated, SNAPSHOT_LINK_CANDIDATES)
    if camp is None or link is None:
        return None
    if loaded_at is not None:
        collated = collated.withColumn("loaded_at", F.expr(X.ts_ntz(loaded_at)))
    return collated.withColumns({
        "batch_id": F.lit(batch_id),
        "_campaign_name": F.expr(X.norm_lower(sql_or_blank(collated, camp))),
        "_contact_link": F.expr(X.norm_lower(sql_or_blank(collated, link)))})


def write_snapshot(rows: DataFrame, path: str) -> None:
    """Write each batch into its ``batch_id`` partition; a batch that is run again
    replaces its own rows only."""
    replace_batch(rows, path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """The snapshot, or None when no contact run has written one."""
    return read_if_written(spark, path)


def truncate_snapshot(spark: SparkSession, path: str, like: DataFrame) -> None:
    """K9: drop every batch (empty frame from the schema; the path is not read)."""
    spark.createDataFrame([], like.schema).write.mode("overwrite").partitionBy("batch_id").parquet(path)


_KEY = ["_campaign_name", "_contact_link"]
_PLACE = ["batch_id", "src_ord", "row_ord"]


def winners(snap: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """One (key, place) per non-blank key (of ``keys`` only, when given): the batch that
    was loaded last, then the greatest batch id, then the first row in upload order.

    Only the key and place columns are read and moved, so a key that very many rows
    share costs narrow rows, cut to one per map task before the shuffle."""
    loaded = ["loaded_at"] if "loaded_at" in snap.columns else []
    rows = snap.select(*_KEY, *_PLACE, *loaded).where("_campaign_name <> '' AND _contact_link <> ''")
    if keys is not None:
        rows = rows.join(keys, _KEY, "left_semi")
    order = [F.col(c).desc() for c in [*loaded, "batch_id"]] + [F.col("src_ord"), F.col("row_ord")]
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*_KEY).orderBy(*order))).where("_rn = 1").drop("_rn")


def _rows_at(snap: DataFrame, places: DataFrame) -> DataFrame:
    """The full rows at the winners' places; ``batch_id`` is the partition column, so only
    the batches that hold a winner are read."""
    return snap.join(places.select(*_KEY, *_PLACE), [*_KEY, *_PLACE], "left_semi")


def snapshot_index(snap: DataFrame) -> DataFrame:
    """J10 / W5 / FL8: the key index - one (batch_id, campaign, link) per non-blank key."""
    extra = ["loaded_at"] if "loaded_at" in snap.columns else []
    return winners(snap).select("batch_id", F.col("_campaign_name").alias("campaign_name"),
                                F.col("_contact_link").alias("contact_link"), *extra)


def snapshot_latest(snap: DataFrame) -> DataFrame:
    """One full snapshot row per non-blank join key."""
    return _rows_at(snap, winners(snap))


def extract_key_sql(f3: DataFrame) -> tuple[str, str]:
    """(campaign key, link key) SQL text of an extract; columns by name, else the first two."""
    camp, link = key_columns(f3, CAMPAIGN_CANDIDATES, EXTRACT_LINK_CANDIDATES)
    return X.norm_lower(sql_or_blank(f3, camp)), X.norm_lower(sql_or_blank(f3, link))


def extract_keys(f3: DataFrame) -> DataFrame:
    """Distinct non-blank (campaign, link) keys of an extract."""
    c, l = extract_key_sql(f3)
    return (f3.selectExpr(f"{c} AS _campaign_name", f"{l} AS _contact_link")
              .where("_campaign_name <> '' AND _contact_link <> ''").distinct())


def snapshot_lookup(snap: DataFrame | None, f3: DataFrame) -> DataFrame | None:
    """Latest snapshot rows whose (campaign, link) key occurs in the extract (no
    key cap, blank keys never match); None when there is no snapshot."""
    return None if snap is None else _rows_at(snap, winners(snap, extract_keys(f3)))


def rechurn_merge(f3: DataFrame, snap: DataFrame | None, keys_from: DataFrame | None = None) -> DataFrame:
    """Each extract row joined to its snapshot row (one per key).

    Matched: the snapshot's fields, with email, dialled number and direct
    number taken from the extract (when it has them); extract-only columns are
    ''.  Unmatched: the extract row as it is, snapshot-only columns ''.  Column
    aliases are resolved per side before the merge, so unmatched rows keep
    their own campaign, name and link.  Order columns are the extract's.

    ``keys_from`` may give the raw extract the rows came from: its keys (a
    superset) select the snapshot rows, so the lookup branch does not
    recompute whatever produced ``f3``."""
    if snap is None:
        return f3
    latest = snapshot_lookup(snap, keys_from if keys_from is not None else f3)
    s_cols = [c for c in latest.columns if c not in INTERNAL and c not in ORDER_COLUMNS and not c.startswith("_")]
    f_cols = [c for c in f3.columns if c not in ORDER_COLUMNS]
    kc, kl = extract_key_sql(f3)
    # a row without a whole key matches nothing: it gets a key of its own, so none pile up
    fx = f3.withColumns({"_fk_c": F.expr(spread_blank_sql(f"if({kl} = '', '', {kc})", row_id(f3))), "_fk_l": F.expr(kl)})
    right = latest.select(*[F.col(c).alias(f"_s_{c}") for c in s_cols],
                          F.col("_campaign_name").alias("_sk_c"), F.col("_contact_link").alias("_sk_l"),
                          F.lit(True).alias("_matched"))
    # ``right`` holds one row per extract key at most: AQE broadcasts it when small
    j = fx.join(right, (F.col("_fk_c") == F.col("_sk_c")) & (F.col("_fk_l") == F.col("_sk_l")), "left")
    overrides = {}
    email = first_present(f3, ["email_address"])
    if email:
        overrides["email_address"] = email
    phone = first_present(f3, ["dialed_number", "telephone"])
    if phone:
        overrides["dialed_number"] = phone
    direct = first_present(f3, ["direct_number", "direct_number_1"])
    if direct:
        overrides["direct_number"] = direct

    out_cols = list(dict.fromkeys(f_cols + s_cols + list(overrides)))
    sel = [c for c in ORDER_COLUMNS if c in f3.columns]
    m = "coalesce(_matched, false)"
    for c in out_cols:
        f_val = f"coalesce(CAST({X.ref(c)} AS STRING), '')" if c in f_cols else "''"
        s_val = f"coalesce(CAST({X.ref('_s_' + c)} AS STRING), '')" if c in s_cols else "''"
        m_val = f"coalesce(CAST({X.ref(overrides[c])} AS STRING), '')" if c in overrides else s_val
        sel.append(f"CASE WHEN {m} THEN {m_val} ELSE {f_val} END AS {X.ref(c)}")
    sel.append(f"{m} AS _matched")
    return j.selectExpr(*sel)
