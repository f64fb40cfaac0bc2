"""Driver query catalog: one DataFrame per operator of the inventory.

Each entry takes ``(spark, sf_dir)``, binds the driver's tables to the
library's inputs (``sources.bindings``) and returns the operator's result
without collecting it.  Building a query that tags rows runs a few jobs: the lists and the
over-limit numbers are stored and measured first, since their sizes choose the joins.  The SQL twins live in ``plans.oracle``.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import iso_week, iso_year, parse_date, week_start
from ..functions.geo import area_code, timezone
from ..functions.keys import fingerprint
from ..functions.phone import with_phone_validity
from ..functions.text import clean_url, digits
from ..operators import audit as A
from ..operators import dial as D
from ..operators import history as H
from ..operators import qa as Q
from ..operators import snapshot as S
from ..operators.joins import Marks
from ..operators.snapshot_index import SnapshotIndex
from ..operators.store import HistoryStore
from ..operators.output import (add_phone_validity, clean_columns, contacted, first_usable_phone,
                                output_dedup, output_projection)
from ..operators.suppress import read_list, tag_suppressions, update_dead_list, update_rpc_list
from ..schema import CALL_LAYOUT, CONTACT_LAYOUT, OUTPUT_COLUMNS, canonicalize
from ..session import checkpoint_dir, materialize
from ..sources import bindings as B
from ..sources.lists import DEAD_KEYS, DOMAIN_KEYS, RPC_KEYS, direct_dial_keys, suppression_keys
from ..sources.tabular import blank_na, collate, collate_calls, read_table
from .contact import Limits, Lists, output_of, run_contact, tag
from .history_load import load_history
from .rechurn import gtg_output, rechurn_output, rechurn_tagged

OLD_BATCH_ID = "20240101_000000_f0e1d2"
OLD_LOADED_AT = dt.datetime(2024, 1, 1, 0, 0, 0)
RUN_AT = dt.datetime.strptime(B.RUN_TS, "%Y-%m-%d %H:%M:%S")
CAMPAIGN_TYPE = "NON-DELL"


# --- bound inputs ------------------------------------------------------------

def collated(spark, d) -> DataFrame:
    return collate(B.contact_files(spark, d))


def lists(spark, d, distinct: bool = False) -> Lists:
    """The four lists; tagging drops repeated keys itself."""
    return Lists(dead=suppression_keys(B.dead_list_file(spark, d), DEAD_KEYS, distinct),
                 rpc=suppression_keys(B.rpc_list_file(spark, d), RPC_KEYS, distinct),
                 domain=suppression_keys(B.domain_list_file(spark, d), DOMAIN_KEYS, distinct),
                 direct=direct_dial_keys(B.direct_list_file(spark, d), distinct))


def limits() -> Limits:
    return Limits(check_date=B.CHECK_DATE, max_day=B.MAX_DAY, max_direct=B.MAX_DIRECT, is_dell=False)


def dial_history(spark, d) -> DataFrame:
    """The call history of the limits: every call, aligned."""
    return H.align_history(B.call_file(spark, d))


def tagged(spark, d) -> DataFrame:
    return tag(collated(spark, d), lists(spark, d), dial_history(spark, d), limits())


def tagged_once(spark, d) -> DataFrame:
    """The tagged rows, stored: for queries that read them more than once."""
    return materialize(tagged(spark, d))


def extract(spark, d) -> DataFrame:
    return collate_calls([B.extract_file(spark, d)])


def store_before(spark, d) -> DataFrame:
    """Existing history store: the first upload, deduplicated."""
    return H.dedup_batch(H.align_history(B.call_file(spark, d, date_to=B.STORE_BEFORE)))


def batch_aligned(spark, d) -> DataFrame:
    return H.align_history(B.call_file(spark, d, date_from=B.BATCH_FROM))


def store_after(spark, d) -> DataFrame:
    return store_before(spark, d).unionByName(H.new_rows(store_before(spark, d), batch_aligned(spark, d)))


def snapshot(spark, d) -> DataFrame:
    """Two contact runs in the snapshot: an older one with the Format-1 file
    and the current one with the Format-2 file (overlapping keys)."""
    f1, f2 = B.contact_files(spark, d)
    old = S.snapshot_rows(collate([f1]), OLD_BATCH_ID, OLD_LOADED_AT)
    new = S.snapshot_rows(collate([f2]), B.BATCH_ID, RUN_AT)
    return old.unionByName(new, allowMissingColumns=True)


def contact_fields(spark, d) -> DataFrame:
    return B.contacts(spark, d)


# --- queries -----------------------------------------------------------------

def q_scan_blank_tokens(spark, d):
    c = B.table(spark, d, "customer")
    k = F.col("c_custkey")
    m = k % 10
    state = (F.when(m == 0, "NA").when(m == 1, "N/A").when(m == 2, "null").when(m == 3, "None")
              .when(m == 4, " nan").when(m == 5, "#N/A").when(m == 6, "").otherwise(F.col("c_mktsegment")))
    n5 = F.col("c_nationkey") % 5
    country = (F.when(n5 == 0, "NULL").when(n5 == 1, "n/a").when(n5 == 2, "<NA>")
                .otherwise(F.col("c_nationkey").cast("string")))
    raw = c.select(k.alias("row_ord"), state.alias(" state "), country.alias("country"), F.col("c_name").alias("name"))
    return blank_na(raw)


def q_collate_formats(spark, d):
    return collated(spark, d).select("src_ord", "row_ord", "campaign_name", "full_name", "org_name", "email_address",
                                     "domain", "telephone", "state", "country", "profile_url", "intent")


def q_suppression_keys(spark, d):
    l = lists(spark, d, distinct=True)
    return (l.dead.select(F.lit("dead").alias("list"), "key")
            .unionByName(l.rpc.select(F.lit("rpc").alias("list"), "key"))
            .unionByName(l.domain.select(F.lit("domain").alias("list"), "key")))


def q_direct_dial_keys(spark, d):
    return lists(spark, d, distinct=True).direct


def q_suppression_sizes(spark, d):
    l = lists(spark, d, distinct=True)
    return A.list_sizes({"dead": l.dead, "rpc": l.rpc, "domain": l.domain, "direct": l.direct})


def q_suppression_tag(spark, d):
    l = lists(spark, d)
    t = tag_suppressions(collated(spark, d), l.dead, l.rpc, l.domain)
    return t.select("src_ord", "row_ord", "email_address", "domain", "suppression_reason")


def q_suppression_summary(spark, d):
    l = lists(spark, d)
    return A.suppression_summary(tag_suppressions(collated(spark, d), l.dead, l.rpc, l.domain))


def _keyed_clean(spark, d):
    l = lists(spark, d)
    marks = Marks(l.dead, l.rpc, l.domain, l.direct)
    s = tag_suppressions(collated(spark, d), marks=marks).where(F.col("suppression_reason") == "")
    return D.mark_direct(D.with_phone_keys(s), None, marks=marks)


def q_phone_universe(spark, d):
    return D.phone_universe(_keyed_clean(spark, d))


def q_dial_counts(spark, d):
    return D.dial_counts(dial_history(spark, d), D.phone_universe(_keyed_clean(spark, d)), B.CHECK_DATE)


def q_phone_coverage(spark, d):
    return D.phone_coverage(_keyed_clean(spark, d))


def q_dial_limit_tag(spark, d):
    return tagged(spark, d).select("src_ord", "row_ord", "suppression_reason", "dial_limit_reason", "row_status")


def q_limit_breakdown(spark, d):
    return A.limit_breakdown(tagged(spark, d))


def q_phone_clean(spark, d):
    c = contact_fields(spark, d)
    return c.select("row_ord", "tel", digits("tel").alias("tel_digits"))


def q_phone_validate(spark, d):
    c = contact_fields(spark, d).select("row_ord", "tel")
    return with_phone_validity(c, "tel")


def q_phone_profile(spark, d):
    return A.phone_profile(add_phone_validity(collated(spark, d)))


def q_invalid_sample(spark, d):
    return A.invalid_sample(add_phone_validity(collated(spark, d)))


def q_url_clean(spark, d):
    p = B.table(spark, d, "pages")
    return p.select(F.col("page_id").alias("row_ord"), "url", clean_url("url").alias("url_clean"))


def q_timezone_map(spark, d):
    c = contact_fields(spark, d)
    return c.select("row_ord", "country", "state", timezone("country", "state").alias("timezone"))


def q_area_code(spark, d):
    c = contact_fields(spark, d)
    return c.select("row_ord", "tel", area_code("tel").alias("ph_area_code"))


def q_fingerprints(spark, d):
    c = clean_columns(collated(spark, d))
    c = c.withColumn("_camp_lc", F.lower(F.trim("campaign_name")))
    return c.select("src_ord", "row_ord",
                    fingerprint("profile_url", "full_name").alias("contactid"),
                    fingerprint("org_name", "country").alias("companyid"),
                    fingerprint("profile_url", "_camp_lc").alias("li_cmp_md1"),
                    fingerprint("full_name", "org_name", "_camp_lc").alias("fnln_comp_cmp_md2"),
                    contacted(c).alias("contacted"))


def q_first_usable_phone(spark, d):
    c = B.calls(spark, d)
    et = F.col("event_type")
    raw = c.select(
        "row_ord",
        F.when(et == "click", "-").when(et == "view", "nan").when(et == "error", " ").otherwise(F.col("dialed_raw"))
         .alias("Direct Number-1"),
        F.when(et == "error", "None").when(et == "view", "").otherwise(F.concat(F.lit("+1 "), F.col("dialed_number")))
         .alias("Direct Number-2"),
        F.when(et == "view", F.col("dialed_number")).otherwise(F.lit("")).alias("Direct Number"))
    f = canonicalize(raw, CONTACT_LAYOUT)
    return f.select("row_ord", first_usable_phone(f).alias("phone_direct"))


def q_date_parse(spark, d):
    e = B.table(spark, d, "events")
    spelled = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy", "M/d/yyyy", "yyyy-MM-dd HH:mm", "M/d/yyyy h:mm:ss a",
               "dd-MMM-yyyy", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyyMMdd", "yyyy-M-d", "M/d/yyyy H:mm", "yyyy/M/d"]
    raw = F.when(F.col("event_type") == "signup", F.when(F.col("event_id") % 2 == 0, F.lit("-")).otherwise(F.lit("x")))
    for i, f in enumerate(spelled):
        raw = raw.when(F.col("event_id") % 13 == i, F.date_format("ts", f))
    return e.select(F.col("event_id").alias("row_ord"), raw.otherwise(F.lit("")).alias("raw")) \
            .withColumn("parsed", parse_date("raw"))


def q_iso_week(spark, d):
    e = B.table(spark, d, "events").select(F.col("event_id").alias("row_ord"), F.col("ts").cast("date").alias("d"))
    return e.select("row_ord", "d", iso_year("d").alias("iso_year"), iso_week("d").alias("iso_week"),
                    week_start("d").alias("week_start"))


def q_history_align(spark, d):
    return H.align_history(B.call_file(spark, d)).drop("src_ord")


_HIST_OUT = ["row_ord", "call_id", "dialed_number", "pbx_dialing_date", "email_address", "dgs_disposition",
             "system_disposition", "campaign_name", "contact_link"]


def q_history_ingest(spark, d):
    return H.new_rows(store_before(spark, d), batch_aligned(spark, d)).select(*_HIST_OUT)


def q_history_ingest_counts(spark, d):
    b = batch_aligned(spark, d)
    return H.ingest_counts(b, H.new_rows(store_before(spark, d), b))


def q_history_profile(spark, d):
    return H.history_profile(store_after(spark, d))


def q_history_match(spark, d):
    return H.history_match(extract(spark, d), store_after(spark, d)).select("row_ord", "campaign_name", "contact_link")


def q_history_preview(spark, d):
    return H.history_preview(store_after(spark, d), 200).select("row_ord", "call_id", "dialed_number", "pbx_dialing_date")


def q_output_projection(spark, d):
    t = tagged(spark, d).where(F.col("row_status") == "GTG")
    return output_projection(clean_columns(add_phone_validity(t)), B.RUN_TS)


def q_output_dedup(spark, d):
    """W1 over every collated row (both overlapping files)."""
    out = output_projection(clean_columns(add_phone_validity(collated(spark, d))), B.RUN_TS)
    return output_dedup(out).select("src_ord", "row_ord", "contactid", "campaign_code", "fullname", "contact_li_url")


def q_contact_run(spark, d):
    return output_of(tagged(spark, d), B.RUN_TS).select(*[F.col(f"`{c}`") for c in OUTPUT_COLUMNS])


def q_snapshot_rows(spark, d):
    s = S.snapshot_rows(collated(spark, d), B.BATCH_ID, RUN_AT)
    return s.select("src_ord", "row_ord", "batch_id", "loaded_at", F.col("_campaign_name").alias("campaign_key"),
                    F.col("_contact_link").alias("link_key"), "campaign_name", "profile_url")


def q_snapshot_latest(spark, d):
    return S.snapshot_index(snapshot(spark, d))


def q_snapshot_profile(spark, d):
    return A.snapshot_profile(S.snapshot_index(snapshot(spark, d)))


def q_snapshot_lookup(spark, d):
    return S.snapshot_lookup(snapshot(spark, d), extract(spark, d)) \
            .select("batch_id", "src_ord", "row_ord", "campaign_name", "profile_url", "full_name")


def q_rechurn_merge(spark, d):
    m = S.rechurn_merge(extract(spark, d), snapshot(spark, d))
    return m.select("src_ord", "row_ord", "campaign_name", "full_name", "profile_url", "contact_link",
                    "email_address", "dialed_number", "direct_number", "asset_pitched", "org_name", "telephone",
                    "qa_final_status", "_matched")


def q_rechurn_filter(spark, d):
    f3 = collate_calls([B.call_file(spark, d)])
    return Q.rechurn_filter(f3).select("row_ord", "dgs_disposition")


def q_gtg_filter(spark, d):
    return Q.gtg_filter(extract(spark, d)).select("row_ord", "qa_final_status")


def q_rechurn_run(spark, d):
    return rechurn_output(extract(spark, d), snapshot(spark, d), lists(spark, d), dial_history(spark, d),
                          limits(), B.RUN_TS)


def q_rechurn_gtg_output(spark, d):
    return gtg_output(extract(spark, d), snapshot(spark, d), B.RUN_TS)


def q_audit_rows(spark, d):
    t = tagged_once(spark, d)
    return A.audit_rows(t, B.BATCH_ID, RUN_AT, CAMPAIGN_TYPE)


def q_audit_summary(spark, d):
    return A.audit_summary(q_audit_rows(spark, d))


def q_run_metrics(spark, d):
    t = tagged_once(spark, d)
    return A.run_metrics(t, output_of(t, B.RUN_TS))


def q_campaign_list(spark, d):
    return A.campaign_list(collated(spark, d))


def q_campaign_first(spark, d):
    return A.campaign_first(collated(spark, d))


def q_run_stats(spark, d):
    return A.pipeline_stats(B.runs(spark, d))


def q_grand_totals(spark, d):
    return A.grand_totals(B.runs(spark, d))


def q_activity_topk(spark, d):
    return A.activity_topk(B.runs(spark, d), 1000)


def _upload(spark, d):
    return canonicalize(B.call_file(spark, d, date_from=B.BATCH_FROM), CALL_LAYOUT)


def q_dead_list_update(spark, d):
    return update_dead_list(_upload(spark, d), B.dead_list_file(spark, d, B.STORE_BEFORE))


def q_rpc_list_update(spark, d):
    return update_rpc_list(_upload(spark, d), B.AS_OF, B.rpc_list_file(spark, d, B.STORE_BEFORE))


def q_history_ingest_stream(spark, d):
    """K1 stream mode: the call log lands as files in a folder under the shared
    checkpoint directory and is ingested by a file stream (availableNow)."""
    from ..streaming.ingest import ingest_stream
    base = _folder(spark, "history-stream")
    B.call_file(spark, d).write.parquet(f"{base}/landing")
    ingest_stream(spark, f"{base}/landing", f"{base}/store", f"{base}/progress", loaded_at=RUN_AT)
    return spark.read.parquet(f"{base}/store").select(*_HIST_OUT)


def _folder(spark, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def loaded_store(spark, d) -> HistoryStore:
    """The store after three loads: the first upload, the second one, and the second one again."""
    store = HistoryStore(spark, _folder(spark, "history"), buckets=16)
    store.load(B.call_file(spark, d, date_to=B.STORE_BEFORE), OLD_BATCH_ID, OLD_LOADED_AT)
    for _ in range(2):
        store.load(B.call_file(spark, d, date_from=B.BATCH_FROM), B.BATCH_ID, RUN_AT)
    return store


def q_history_store(spark, d):
    """K1 with the kept keys: every stored call with the batch that brought it."""
    return loaded_store(spark, d).calls().select(*_HIST_OUT, "batch_id")


def q_history_loads(spark, d):
    return loaded_store(spark, d).loads().select("batch_id", "loaded_at", "total", "inserted")


def q_dial_counts_kept(spark, d):
    """A1 from the counts that the ingest keeps: every number dialled in the check date's week."""
    return loaded_store(spark, d).week_counts(B.CHECK_DATE)


def q_dial_limit_kept(spark, d):
    """FL2 / A1b with the kept counts."""
    t = tag(collated(spark, d), lists(spark, d), None, limits(), loaded_store(spark, d).week_counts(B.CHECK_DATE))
    return t.select("src_ord", "row_ord", "suppression_reason", "dial_limit_reason", "row_status")


def indexed_snapshot(spark, d) -> SnapshotIndex:
    """The two runs' snapshot written batch by batch, each batch merged into the key index."""
    folder = _folder(spark, "snapshot")
    index = SnapshotIndex(spark, f"{folder}/rows", f"{folder}/index", buckets=16)
    f1, f2 = B.contact_files(spark, d)
    for files, batch_id, at in (([f1], OLD_BATCH_ID, OLD_LOADED_AT), ([f2], B.BATCH_ID, RUN_AT)):
        S.write_snapshot(S.snapshot_rows(collate(files), batch_id, at), f"{folder}/rows")
        index.update(batch_id)
    return index


def q_snapshot_index(spark, d):
    return indexed_snapshot(spark, d).latest()


def q_snapshot_index_lookup(spark, d):
    return indexed_snapshot(spark, d).lookup(extract(spark, d)) \
        .select("batch_id", "src_ord", "row_ord", "campaign_name", "profile_url", "full_name")


def _near(estimate: str, exact: DataFrame, name: str) -> F.Column:
    """The estimate is within 3 % of the exact count."""
    right = exact.select(estimate).scalar()
    return (F.abs(F.col(estimate) - right) <= 0.03 * right).alias(name)


def q_history_profile_kept(spark, d):
    """A2 from the sketches that the ingest keeps: exact figures, and whether the distinct counts are near."""
    store = loaded_store(spark, d)
    exact = store.profile()
    return store.profile(approx=True).select("total_rows", _near("campaigns", exact, "campaigns_near"), _near("contacts", exact, "contacts_near"),
                                             "earliest_date", "latest_date")


def q_snapshot_profile_kept(spark, d):
    """A3 from the figures taken while the key index was written."""
    index = indexed_snapshot(spark, d)
    return index.profile(approx=True).select("total_rows", _near("campaigns", index.profile(), "campaigns_near"), "earliest", "latest")


def q_rechurn_removed(spark, d):
    """The extract's suppressed and over-limit rows."""
    t = rechurn_tagged(extract(spark, d), lists(spark, d), dial_history(spark, d), limits())
    return t.where(F.col("row_status") != "GTG").select("row_ord", "suppression_reason", "dial_limit_reason", "row_status")


def q_list_growth(spark, d):
    """The dead and RPC+ lists after two uploads that both extend them."""
    folder = _folder(spark, "growth")
    for raw, batch_id, at in ((B.call_file(spark, d, date_to=B.STORE_BEFORE), OLD_BATCH_ID, OLD_LOADED_AT),
                              (B.call_file(spark, d, date_from=B.BATCH_FROM), B.BATCH_ID, RUN_AT)):
        load_history(spark, f"{folder}/store", raw, batch_id, at, lists_dir=f"{folder}/lists", as_of=B.AS_OF)
    dead, rpc = (read_list(spark, f"{folder}/lists", name) for name in ("dead", "rpc"))
    return (dead.select(F.lit("dead").alias("list"), "email", F.lit("").alias("disposition"))
            .unionByName(rpc.select(F.lit("rpc").alias("list"), "email", "disposition")))


def q_export_removed(spark, d):
    """K7: the removed rows of a run as its CSV files give them back."""
    folder = _folder(spark, "export")
    run_contact(collated(spark, d), lists(spark, d), dial_history(spark, d), limits(), run_ts=B.RUN_TS, batch_id=B.BATCH_ID,
                campaign_type="NON-DELL", out_dir=f"{folder}/run", csv_dir=f"{folder}/csv")
    parts = [read_table(spark, f"{folder}/csv/{status.lower()}").withColumn("row_status", F.lit(status)) for status in ("SUPPRESSED", "OVER_LIMIT")]
    return parts[0].unionByName(parts[1]).select(F.col("Full name").alias("full_name"), F.col("EmailAddress").alias("email_address"),
                                                 F.col("Profile url").alias("profile_url"), "suppression_reason", "dial_limit_reason", "row_status")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}
