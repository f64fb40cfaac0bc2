"""Paths that a user's first files reach: other headers, no history yet, re-runs, stored lists."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from dialsieve.functions.dates import parse_date
from dialsieve.operators.dial import dial_counts, tag_dial_limits
from dialsieve.operators.history import append_history, history_match, history_preview, history_profile, new_rows, read_store
from dialsieve.operators.joins import bounded_broadcast, mark_join
from dialsieve.operators.snapshot import extract_keys, read_snapshot, rechurn_merge, snapshot_latest, snapshot_lookup, snapshot_rows
from dialsieve.operators.suppress import read_list, tag_suppressions, write_list
from dialsieve.plans import catalog as C
from dialsieve.plans.contact import Limits, Lists, run_contact, tag
from dialsieve.plans.history_load import load_history
from dialsieve.plans.rechurn import run_rechurn
from dialsieve.schema import CALL_LAYOUT, CONTACT_LAYOUT, canonicalize, labels_of, resolve
from dialsieve.sources import bindings as B
from dialsieve.sources.tabular import collate, collate_calls
from dialsieve.streaming.ingest import ingest_stream

from conftest import strings

SF = "/root/testdata/sf0.001"
DAY = dt.datetime(2024, 2, 1)


def keys(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "key string")


# --- headers ------------------------------------------------------------------

@pytest.mark.parametrize("email,domain,phone", [("EmailAddress", "Domain", "TelephoneNumber"), ("email", "domain", "Telephone Number"),
                                                ("Email_Address", "DOMAIN", "telephone-number")])
def test_one_result_under_any_spelling(spark, email, domain, phone):
    rows = [("a@x.com", "x.com", "212-555-0100"), ("b@y.com", "Listed.com ", "212-555-0101"), ("c@z.com", "z.com", "1")]
    got = tag_suppressions(collate([(strings(spark, rows, [email, domain, phone]), "1")]), keys(spark, "a@x.com"), None, keys(spark, "listed.com"))
    assert sorted((r.email_address, r.telephone, r.suppression_reason) for r in got.collect()) == [
        ("a@x.com", "212-555-0100", "DEAD/DNC Email"), ("b@y.com", "212-555-0101", "Company Domain DNC"), ("c@z.com", "1", "")]


def test_call_file_with_a_domain_column(spark):
    f3 = collate_calls([strings(spark, [("a@x.com", "Listed.com")], ["EmailAddress", "Domain"])])
    assert tag_suppressions(f3, None, None, keys(spark, "listed.com")).first().suppression_reason == "Company Domain DNC"


def test_contact_file_with_a_dialed_number(spark):
    history = spark.createDataFrame([(str(i), "2125550100", dt.date(2024, 1, 17)) for i in range(9)],
                                    "call_id string, dialed_number string, pbx_dialing_date date")
    df = collate([(strings(spark, [("(212) 555-0100",)], ["Dialed Number"]), "1")])
    got = tag_dial_limits(df, history, dt.date(2024, 1, 18), max_direct=3).first()
    assert got.row_status == "OVER_LIMIT"


def test_headers_that_differ_only_in_signs_or_case(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5, 6)], "a int, b int, c int, d int, e int, f int").toDF("My Note", "My-Note", "日本", "本日", "Domain", "domain")
    out = canonicalize(df, CONTACT_LAYOUT)
    assert out.columns == ["x_my_note", "x_my_note_2", "x_column", "x_column_2", "domain"] and tuple(out.first()) == (1, 2, 3, 4, 5)
    assert list(labels_of(out, out.columns).values()) == ["My Note", "My-Note", "日本", "本日", "Domain"]


def test_resolve_ranks(spark):
    assert resolve(["b", "A"], ["a", "b"]) == "A" and resolve(["my_col", "MYCOL"], ["mycol"]) == "MYCOL"
    assert resolve(["x y", "x_y"], ["xy"]) == "x_y" and resolve([], ["a"]) is None and resolve(["q"], ["a"]) is None


def test_original_headers_reach_audit_and_export(spark):
    from dialsieve.operators.audit import audit_rows, export_rows
    df = collate([(strings(spark, [("a@x.com", "hi")], ["email", "Odd Note!"]), "1")])
    t = tag(df, Lists(), None, Limits(dt.date(2024, 1, 18)))
    assert '"email":"a@x.com"' in audit_rows(t, "b", DAY, "X").first().row_json and '"Odd Note!":"hi"' in audit_rows(t, "b", DAY, "X").first().row_json
    assert {"email", "Odd Note!"} <= set(export_rows(t).columns)


# --- joins ----------------------------------------------------------------------

def test_marks_do_not_depend_on_the_plan_or_on_row_ids(spark):
    rows = [(1, "a"), (1, "b"), (None, "a"), (None, ""), (2, None), (2, "a")]
    df = spark.createDataFrame(rows, "row_ord long, k string")
    marks = spark.createDataFrame([("a", 7)], "mk string, hit int")
    want = sorted(((r, k, 7 if k == "a" else None) for r, k in rows), key=str)
    for limit in (10, 0):
        got = mark_join(df, "coalesce(k, '')", marks, "mk", ["hit"], limit)
        assert sorted((tuple(r) for r in got.collect()), key=str) == want
        assert ("BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()) == bool(limit)


def test_broadcast_counts_rows_and_bytes(spark):
    wide = spark.range(3000).selectExpr("repeat('x', 50) || id AS k")
    assert bounded_broadcast(wide)[1] and not bounded_broadcast(wide, max_rows=2999)[1] and not bounded_broadcast(wide, max_bytes=100_000)[1]


def test_whole_ids_give_distinct_numbers(spark):
    df = spark.createDataFrame([(i,) for i in (7, 10_000, 10_001, 1_000_000)], "user_id long")
    assert df.selectExpr(f"{B._padded('user_id')} AS p").distinct().count() == 4


# --- lists ------------------------------------------------------------------------

def calls(spark, *emails, disposition="Dead Contact"):
    return strings(spark, [(str(i), "2125550100", e, disposition, "2024-01-20") for i, e in enumerate(emails)],
                   ["call_id", "Dialed Number", "EmailAddress", "DGS Disposition", "PBX DialingDate"])


def test_history_loads_keep_and_extend_the_stored_lists(spark, scratch):
    load = lambda batch, at, *e, **k: load_history(spark, f"{scratch}/s", calls(spark, *e, **k), batch, DAY + dt.timedelta(days=at), f"{scratch}/lists")
    load("run9", 0, "first@x.com")
    load("run10", 1, "second@x.com")
    load("run11", 2, "other@x.com", disposition="Ringing")            # nothing to add: no new version
    assert {r[0] for r in read_list(spark, f"{scratch}/lists", "dead").select("email").collect()} == {"first@x.com", "second@x.com"}
    assert spark.read.parquet(f"{scratch}/lists/dead-versions").count() == 2
    write_list(keys(spark).limit(0), f"{scratch}/lists", "dead", "empty", DAY + dt.timedelta(days=9))
    assert read_list(spark, f"{scratch}/lists", "dead").count() == 0  # replaced by an empty list


def test_a_broken_list_raises(spark, scratch):
    write_list(keys(spark, "a"), scratch, "dead", "v1", DAY)
    assert read_list(spark, scratch, "rpc") is None
    spark.createDataFrame([("v2", DAY + dt.timedelta(days=1))], "version string, written_at timestamp_ntz").write.mode("append").parquet(f"{scratch}/dead-versions")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_list(spark, scratch, "dead")


# --- first run, re-runs -----------------------------------------------------------

def test_first_run_without_history_or_snapshot(spark, scratch):
    store = read_store(spark, f"{scratch}/none")
    assert read_snapshot(spark, f"{scratch}/none") is None
    assert history_profile(store).first().total_rows == 0 and history_preview(store).count() == 0
    col = C.collated(spark, SF)
    for history in (None, store):
        assert tag(col, Lists(), history, C.limits()).where("row_status = 'GTG'").count() == col.count()
        assert dial_counts(history, spark.createDataFrame([("1",)], "phone string"), dt.date(2024, 1, 18)).first().weekly_count == 0
    f3 = C.extract(spark, SF)
    assert history_match(f3, store).count() == 0 and rechurn_merge(f3, None) is f3 and snapshot_lookup(None, f3) is None
    assert new_rows(store, C.batch_aligned(spark, SF)).count() == new_rows(None, C.batch_aligned(spark, SF)).count()


def test_running_a_batch_again_replaces_it(spark, scratch):
    col = C.collated(spark, SF)
    for _ in range(2):
        for batch in ("b1", "b2"):
            run_contact(col, Lists(), None, C.limits(), run_ts=B.RUN_TS, batch_id=batch, campaign_type="X", out_dir=f"{scratch}/o",
                        snapshot_path=f"{scratch}/snap", audit_path=f"{scratch}/audit", runlog_path=f"{scratch}/log")
    n = col.count()
    for path, rows in (("snap", 2 * n), ("audit", 2 * n), ("log", 2)):
        assert spark.read.parquet(f"{scratch}/{path}").count() == rows


def test_rechurn_run_with_sinks(spark, scratch):
    f3 = C.extract(spark, SF)
    args = (f3, C.snapshot(spark, SF), C.lists(spark, SF), C.dial_history(spark, SF), C.limits())
    for _ in range(2):
        m = run_rechurn(*args, run_ts=B.RUN_TS, batch_id="r1", out_dir=f"{scratch}/o", runlog_path=f"{scratch}/log", username="u")
    assert m["gtg_rows"] + m["suppressed"] + m["over_limit"] == m["total_rows"] == f3.count()
    assert spark.read.parquet(f"{scratch}/o/output").count() + m["dedup_removed"] == m["gtg_rows"]
    assert spark.read.parquet(f"{scratch}/o/removed").count() == m["suppressed"] + m["over_limit"]
    log = spark.read.parquet(f"{scratch}/log").collect()
    assert [(r.pipeline, r.batch_id, r.total_rows) for r in log] == [("rechurn", "r1", m["total_rows"])]


# --- snapshot -----------------------------------------------------------------------

def test_latest_is_by_load_time_and_blank_keys_never_match(spark):
    def batch(name, at, *rows):
        df = strings(spark, rows, ["Campaign Name", "Profile url", "Full name"]).withColumn("row_ord", F.monotonically_increasing_id())
        return snapshot_rows(collate([(df, "1")]), name, DAY + dt.timedelta(days=at))
    snap = batch("run9", 0, ("c", "l", "old"), ("", "l", "blank"), ("c", "", "blank")).unionByName(batch("run10", 1, ("c", "l", "new")))
    assert [r.full_name for r in snapshot_latest(snap).collect()] == ["new"]
    f3 = collate_calls([strings(spark, [("C ", " L"), ("", "l"), ("c", ""), ("", "")], ["campaignName", "Contact Link"])])
    assert [r.full_name for r in snapshot_lookup(snap, f3).collect()] == ["new"]
    assert sorted((r.full_name, r._matched) for r in rechurn_merge(f3, snap).collect()) == [("", False)] * 3 + [("new", True)]


def test_extract_without_key_headers_uses_its_first_columns(spark):
    f3 = collate_calls([strings(spark, [("Camp", "Link"), ("", "")], ["k1", "k2"])])
    assert [tuple(r) for r in extract_keys(f3).collect()] == [("camp", "link")]


def test_snapshot_plans(spark, scratch):
    from dialsieve.operators.snapshot import write_snapshot
    write_snapshot(C.snapshot(spark, SF), f"{scratch}/snap")
    snap = read_snapshot(spark, f"{scratch}/snap")
    for df in (snapshot_lookup(snap, C.extract(spark, SF)), rechurn_merge(C.extract(spark, SF), snap), snapshot_lookup(C.snapshot(spark, SF), C.extract(spark, SF))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


# --- dates, stream ------------------------------------------------------------------

def test_dates_as_people_write_them(spark):
    want = dt.date(2024, 1, 5)
    spelled = ["1/5/2024", "01/05/2024", "2024-01-05 09:30", "1/5/2024 9:30:00 AM", "05-Jan-2024", "2024-01-05T09:30:00Z", "20240105", "2024-1-5",
               "2024/1/5", "1/5/2024 21:30", "2024-01-05 09:30:00.123", "2024-01-05 09:30:00.123456"]
    df = spark.createDataFrame([(s,) for s in [*spelled, "-", "junk", "13/45/2024"]], "raw string")
    assert [r[0] for r in df.select(parse_date("raw")).collect()] == [want] * len(spelled) + [None] * 3


def test_ingest_counts_unparsed_dates(spark, scratch):
    raw = strings(spark, [("1", "2", "1/5/2024"), ("2", "3", "soon"), ("3", "4", "-")], ["call_id", "Dialed Number", "PBX DialingDate"])
    assert append_history(spark, f"{scratch}/s", raw, "b", DAY)["unparsed_dates"] == 1


def test_large_batch_does_not_depend_on_the_broadcast(spark):
    store, batch = C.store_before(spark, SF), C.batch_aligned(spark, SF)
    a, b = (sorted(map(tuple, new_rows(store, batch, n).select("call_id", "dialed_number", "row_ord").collect())) for n in (10**6, 0))
    assert a == b


def test_stream_keeps_file_order_and_lists_and_returns_its_query(spark, scratch):
    import time
    for i, email in enumerate(["one@x.com", "two@x.com"]):
        calls(spark, email).coalesce(1).write.mode("append").parquet(f"{scratch}/in")
        time.sleep(1.1)
    got = ingest_stream(spark, f"{scratch}/in", f"{scratch}/s", f"{scratch}/p", lists_dir=f"{scratch}/lists")
    assert sum(r["inserted"] for r in got) == 1 and read_store(spark, f"{scratch}/s").first().email_address == "one@x.com"
    assert read_list(spark, f"{scratch}/lists", "dead").count() == 2
    query = ingest_stream(spark, f"{scratch}/in", f"{scratch}/s", f"{scratch}/p2", available_now=False)
    query.processAllAvailable()
    query.stop()
    assert read_store(spark, f"{scratch}/s").count() == 1
