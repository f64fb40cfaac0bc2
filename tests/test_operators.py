"""Operator behaviour on hand-written fixtures: suppression, dial limits,
history ingest, snapshot merge, QA filters, list maintenance."""

import datetime as dt

from pyspark.sql import functions as F

from dialsieve.operators.dial import tag_dial_limits
from dialsieve.operators.history import align_history, ingest_counts, new_rows
from dialsieve.operators.qa import gtg_filter, rechurn_filter
from dialsieve.operators.snapshot import rechurn_merge, snapshot_index, snapshot_rows
from dialsieve.operators.suppress import tag_suppressions, update_dead_list, update_rpc_list
from dialsieve.schema import CALL_LAYOUT, CONTACT_LAYOUT, canonicalize
from dialsieve.sources.lists import direct_dial_keys, suppression_keys
from dialsieve.sources.tabular import collate

from conftest import strings

CHECK = dt.date(2024, 1, 18)


def contacts(spark, rows):
    raw = strings(spark, rows, ["row_ord", "Campaign Name", "EmailAddress", "Domain", "TelephoneNumber",
                                "Profile url", "Full name"]).withColumn("row_ord", F.col("row_ord").cast("long"))
    return collate([(raw, "1")])


def keys(spark, values, header="email"):
    return suppression_keys(strings(spark, [(v,) for v in values], [header]), [header])


def history(spark, rows):
    raw = strings(spark, rows, ["call_id", "Dialed Number", "PBX DialingDate"])
    return align_history(raw)


def test_suppression_priority_and_blanks(spark):
    c = contacts(spark, [("1", "c", " A@x.com ", "d.com", "", "", ""),
                         ("2", "c", "b@x.com", "bad.com", "", "", ""),
                         ("3", "c", "", "", "", "", ""),
                         ("4", "c", "z@x.com", "ok.com", "", "", "")])
    dead, rpc = keys(spark, ["a@x.com", ""]), keys(spark, ["a@x.com", "b@x.com"])
    dom = keys(spark, ["bad.com"], "domain")
    got = {r["row_ord"]: r["suppression_reason"]
           for r in tag_suppressions(c, dead, rpc, dom).collect()}
    assert got == {1: "DEAD/DNC Email", 2: "RPC+ Email", 3: "", 4: ""}
    # toggles off: no row of that reason
    got = {r["row_ord"]: r["suppression_reason"] for r in tag_suppressions(c, None, None, dom).collect()}
    assert got == {1: "", 2: "Company Domain DNC", 3: "", 4: ""}


def test_dial_limit_boundaries(spark):
    # number A dialled 3 times this week (at the limit), B 4 times, C twice today
    h = history(spark, [("1", "2125550001", "2024-01-15"), ("2", "2125550001", "2024-01-16"),
                        ("3", "2125550001", "2024-01-17"),
                        ("4", "2125550002", "2024-01-15"), ("5", "2125550002", "2024-01-16"),
                        ("6", "2125550002", "2024-01-16"), ("7", "2125550002", "2024-01-17"),
                        ("8", "2125550003", "2024-01-18"), ("9", "2125550003", "2024-01-18"),
                        ("9", "2125550003", "2024-01-18"), ("10", "2125550003", "2024-01-08")])
    c = contacts(spark, [("1", "c", "", "", "212-555-0001", "", ""), ("2", "c", "", "", "212 555 0002", "", ""),
                         ("3", "c", "", "", "2125550003", "", ""), ("4", "c", "", "", "", "", "")])
    t = tag_dial_limits(c.withColumn("suppression_reason", F.lit("")), h, CHECK, None, max_day=3, max_direct=3)
    got = {r["row_ord"]: r["dial_limit_reason"] for r in t.collect()}
    assert got[1] == ""                                   # exactly at limit passes
    assert got[2].startswith("Weekly dial limit exceeded: 4 dials")
    assert got[3] == ""                                   # 2 today <= 3
    assert got[4] == ""                                   # blank number always allowed
    t = tag_dial_limits(c.withColumn("suppression_reason", F.lit("")), h, CHECK, None, max_day=1, max_direct=3)
    got = {r["row_ord"]: r["dial_limit_reason"] for r in t.collect()}
    assert got[3] == "Daily dial limit exceeded: 2 dials on 2024-01-18 (max 1)"
    # raising a limit never adds over-limit rows
    lo = {r["row_ord"] for r in t.where("row_status = 'OVER_LIMIT'").collect()}
    t2 = tag_dial_limits(c.withColumn("suppression_reason", F.lit("")), h, CHECK, None, max_day=5, max_direct=5)
    assert {r["row_ord"] for r in t2.where("row_status = 'OVER_LIMIT'").collect()} <= lo


def test_direct_dial_checks(spark):
    h = history(spark, [(str(i), "2125550009", "2024-01-18") for i in range(5)])
    raw = strings(spark, [("1", "", "2125550009"), ("2", "212-555-0009", "2125550009")],
                  ["row_ord", "Dialed Number", "Direct Number"]).withColumn("row_ord", F.col("row_ord").cast("long"))
    f3 = canonicalize(raw, CALL_LAYOUT).withColumn("suppression_reason", F.lit(""))
    direct = direct_dial_keys(strings(spark, [("(212) 555-0009",)], ["Phone"]))
    got = {r["row_ord"]: r["dial_limit_reason"] for r in tag_dial_limits(f3, h, CHECK, direct, 9, 3).collect()}
    assert got[1] == ""  # blank dialled number: allowed even with an over-limit direct number
    assert got[2] == "Direct-dial weekly limit exceeded: 5 dials this ISO week (max 3, Direct Number in repo)"
    # check 2 (daily, direct, non-Dell) needs its own threshold to be reachable
    t = tag_dial_limits(f3, h, CHECK, direct, 9, 3, is_dell=False, max_direct_week=10, max_direct_day=4)
    got = {r["row_ord"]: r["dial_limit_reason"] for r in t.collect()}
    assert got[2] == "Direct-dial daily limit exceeded: 5 dials on 2024-01-18 (max 4, Direct Number in repo)"


def test_history_ingest_is_idempotent(spark):
    batch = history(spark, [("1", "(212) 555-0001", "2024-01-15"), ("1", "2125550001", "2024-01-16"),
                            ("2", "2125550001", "nan"), ("", "2125550002", "")])
    fresh = new_rows(None, batch)
    assert fresh.count() == 3
    c = ingest_counts(batch, fresh).first()
    assert (c["total"], c["inserted"], c["skipped"]) == (4, 3, 1)
    again = new_rows(fresh, batch)
    assert again.count() == 0
    kept = {(r["call_id"], r["dialed_number"]): r["pbx_dialing_date"] for r in fresh.collect()}
    assert kept[("1", "2125550001")] == dt.date(2024, 1, 15)  # first in upload order
    assert kept[("2", "2125550001")] is None                  # sentinel date -> NULL


def test_rechurn_merge_keeps_unmatched_rows_own_values(spark):
    snap_raw = strings(spark, [("1", "Camp", "https://li/u1/", "Ann Old", "Org A", "111")],
                       ["row_ord", "Campaign Name", "Profile url", "Full name", "Organization 1", "TelephoneNumber"])
    snap = snapshot_rows(collate([(snap_raw.withColumn("row_ord", F.col("row_ord").cast("long")), "1")]), "b1")
    f3_raw = strings(spark, [("1", " camp ", "HTTPS://li/u1/", "Ann New", "new@x.com", "2125550001"),
                             ("2", "other", "https://li/u2/", "Bob", "bob@x.com", "2125550002")],
                     ["row_ord", "campaignName", "Contact Link", "Full_Name", "EmailAddress", "Dialed Number"])
    f3 = canonicalize(f3_raw.withColumn("row_ord", F.col("row_ord").cast("long")), CALL_LAYOUT)
    m = {r["row_ord"]: r for r in rechurn_merge(f3, snap).collect()}
    assert m[1]["_matched"] and m[1]["full_name"] == "Ann Old" and m[1]["org_name"] == "Org A"
    assert m[1]["email_address"] == "new@x.com" and m[1]["dialed_number"] == "2125550001"
    assert not m[2]["_matched"] and m[2]["campaign_name"] == "other" and m[2]["full_name"] == "Bob"
    assert m[2]["org_name"] == ""


def test_snapshot_latest_batch_wins(spark):
    raw = strings(spark, [("1", "C", "u1"), ("2", "C", "u1"), ("3", "", "u3")], ["row_ord", "Campaign Name", "Profile url"])
    raw = raw.withColumn("row_ord", F.col("row_ord").cast("long"))
    s1 = snapshot_rows(collate([(raw, "1")]), "20240101_000000_aaaaaa")
    s2 = snapshot_rows(collate([(raw.where("row_ord = 2"), "1")]), "20240201_000000_bbbbbb")
    idx = snapshot_index(s1.unionByName(s2)).collect()
    assert [(r["batch_id"], r["campaign_name"], r["contact_link"]) for r in idx] == \
        [("20240201_000000_bbbbbb", "c", "u1")]


def test_gtg_filter_cases(spark):
    def run(rows, cols):
        df = strings(spark, rows, ["row_ord"] + cols)
        return sorted(r["row_ord"] for r in gtg_filter(canonicalize(df, CALL_LAYOUT + CONTACT_LAYOUT)).collect())
    assert run([("1", "GTG"), ("2", "Failed"), ("3", "")], ["QA_Final_Status"]) == ["1"]
    assert run([("1", "Pending"), ("2", "Failed"), ("3", "")], ["QA_Final_Status"]) == ["1", "3"]
    assert run([("1", "Pending"), ("2", "")], ["QA_Final_Status"]) == ["1", "2"]
    assert run([("1", "x", "approved"), ("2", "x", "no")], ["QA_Final_Status", "QA/VV Disposition"]) == ["1"]
    assert run([("1", "gtg"), ("2", "fail")], ["Status"]) == ["1"]


def test_rechurn_filter_substring(spark):
    df = canonicalize(strings(spark, [("1", "RPC VM Reached"), ("2", "Completed"), ("3", " LINE BUSY ")],
                              ["row_ord", "DGS Disposition"]), CALL_LAYOUT)
    assert sorted(r["row_ord"] for r in rechurn_filter(df).collect()) == ["1", "3"]


def test_list_maintenance(spark):
    calls = canonicalize(strings(spark, [
        ("1", "A@x.com", "Dead Contact", "2024-01-10"),
        ("2", "a@x.com ", "BANT Lead", "2024-01-10 00:00:00"),
        ("3", "b@x.com", "Lead Scored", "2024-01-09"),
        ("4", "c@x.com", "RPC VM Reached", "garbage"),
        ("5", "d@x.com", "rpc vm reached", "2024-02-01")], ["row_ord", "EmailAddress", "DGS Disposition",
                                                            "PBX DialingDate"]).withColumn("row_ord", F.col("row_ord").cast("long")),
        CALL_LAYOUT)
    existing = strings(spark, [("d@x.com", "Old", "2023-12-01"), ("e@x.com", "Old", "2023-12-01")],
                       ["email", "disposition", "dialing_date"])
    rpc = {r["email"]: (r["disposition"], r["dialing_date"])
           for r in update_rpc_list(calls, dt.datetime(2024, 2, 10), existing).collect()}
    # exactly 31 days before as-of kept, older and unparseable dropped, repeat email -> last kept
    assert rpc == {"a@x.com": ("BANT Lead", "2024-02-10"), "d@x.com": ("rpc vm reached", "2024-02-10"),
                   "e@x.com": ("Old", "2023-12-01")}
    dead = sorted(r["email"] for r in update_dead_list(calls, strings(spark, [("z@x.com",)], ["Email ID"])).collect())
    assert dead == ["a@x.com", "z@x.com"]


def test_large_list_path_matches_broadcast_path(spark):
    """Lists too large to broadcast take the narrow join; results are the same."""
    from dialsieve.plans import catalog as C
    sf = "/root/testdata/sf0.001"
    col, l, h = C.collated(spark, sf), C.lists(spark, sf), C.dial_history(spark, sf)

    def run(rows):
        s = tag_suppressions(col, l.dead, l.rpc, l.domain, broadcast_rows=rows)
        t = tag_dial_limits(s, h, C.limits().check_date, l.direct, 1, 3, broadcast_rows=rows)
        return sorted((r["src_ord"], r["row_ord"], r["suppression_reason"], r["dial_limit_reason"], r["row_status"])
                      for r in t.collect())
    assert run(0) == run(2_000_000)
