"""What runs observe and export, kept sketches, and replays that state drops."""

import datetime as dt
import shutil

import pytest
from pyspark.sql import functions as F

from conftest import strings
from dialsieve.operators.audit import activity_report, export_reports, observed_metrics, run_metrics, status_figures, write_csv
from dialsieve.operators.history import align_history, append_history, history_profile, read_store
from dialsieve.operators.snapshot import snapshot_rows, write_snapshot
from dialsieve.operators.snapshot_index import SnapshotIndex
from dialsieve.operators.store import HistoryStore
from dialsieve.plans.contact import Limits, Lists, run_contact
from dialsieve.session import materialize, observed
from dialsieve.sources.tabular import collate, read_table
from dialsieve.streaming.ingest import ingest_stream

AT = dt.datetime(2024, 2, 1, 9, 0, 0)
CALLS = ["row_ord", "call_id", "Dialed Number", "PBX DialingDate", "Campaign Name", "Contact Link"]


def calls(spark, rows):
    df = strings(spark, rows, CALLS)
    return df.withColumn("row_ord", F.col("row_ord").cast("long"))


def contacts(spark, rows):
    raw = strings(spark, rows, ["Campaign Name", "Full name", "EmailAddress", "Domain", "TelephoneNumber", "Profile url"])
    return collate([(raw.coalesce(1).withColumn("row_ord", F.monotonically_increasing_id()), "1")])


def test_observed_metrics_equal_the_counted_ones(spark):
    for rows in ([("GTG",)] * 5 + [("SUPPRESSED",)] * 2 + [("OVER_LIMIT",)], []):
        tagged, seen = observed(strings(spark, rows, ["row_status"]).repartition(3), **status_figures())
        stored = materialize(tagged)
        out = stored.where("row_status = 'GTG'").limit(4)
        assert observed_metrics(spark, seen.get, out.count()).collect() == run_metrics(stored, out).collect()


def test_a_run_exports_what_it_wrote(spark, scratch):
    rows = [("C", 'Ann "A" O', "a@x", "x.com", "212-555-0001", "https://l/1"), ("C", "Bo, Jr", "dead@x", "x.com", "212-555-0002", "https://l/2"),
            ("", " Cy ", "c@x", "", "", "https://l/3"), ("C", "Ann again", "a@x", "x.com", "212-555-0001", "https://l/1")]
    got = run_contact(contacts(spark, rows), Lists(dead=strings(spark, [("dead@x",)], ["key"])), None, Limits(dt.date(2024, 1, 16)),
                      run_ts="2024-02-01 09:00:00", batch_id="b", campaign_type="T", out_dir=f"{scratch}/o", csv_dir=f"{scratch}/csv",
                      audit_path=f"{scratch}/audit", runlog_path=f"{scratch}/log", username="u")
    out = spark.read.parquet(f"{scratch}/o/output")
    assert (got["total_rows"], got["gtg_rows"], got["suppressed"], got["over_limit"]) == (4, 3, 1, 0)
    assert got["dedup_removed"] == 3 - out.count() and got["campaigns"] == "C"
    back = read_table(spark, f"{scratch}/csv/output").drop("row_ord")
    assert back.columns == out.columns and sorted(map(str, back.collect())) == sorted(str(r) for r in out.fillna("").collect())
    gone = read_table(spark, f"{scratch}/csv/suppressed").collect()
    assert [(r["Full name"], r["EmailAddress"]) for r in gone] == [("Bo, Jr", "dead@x")]
    assert read_table(spark, f"{scratch}/csv/over_limit").count() == 0
    export_reports(spark.read.parquet(f"{scratch}/audit"), spark.read.parquet(f"{scratch}/log"), f"{scratch}/csv")
    audit = read_table(spark, f"{scratch}/csv/audit").collect()
    assert [(r["campaign"], r["total_rows"], r["gtg"], r["suppressed"]) for r in audit] == [("C", "4", "3", "1")]
    act = read_table(spark, f"{scratch}/csv/activity").first()
    assert (act["username"], act["pipeline"], act["total_rows"], act["campaign"]) == ("u", "contact", "4", "C")


def test_a_run_without_clean_rows(spark, scratch):
    got = run_contact(contacts(spark, [("C", "a", "dead@x", "", "", "u")]), Lists(dead=strings(spark, [("dead@x",)], ["key"])), None,
                      Limits(dt.date(2024, 1, 16)), run_ts="2024-02-01 09:00:00", batch_id="b", campaign_type="T", out_dir=f"{scratch}/o",
                      csv_dir=f"{scratch}/csv")
    assert (got["total_rows"], got["gtg_rows"], got["suppressed"], got["dedup_removed"]) == (1, 0, 1, 0)


def test_cells_survive_csv(spark, scratch):
    rows = [('say "x"', " b ", "1,2"), ("\\", "", '"'), ("a\nb", "c\td", "ü日")]
    write_csv(strings(spark, rows, ["A b", "C,d", 'E"f']), f"{scratch}/c")
    back = spark.read.options(header="true", escape='"', multiLine="true").csv(f"{scratch}/c").fillna("")
    assert back.columns == ["A b", "C,d", 'E"f'] and sorted(map(tuple, back.collect())) == sorted(rows)


def test_activity_newest_first(spark):
    runs = spark.createDataFrame([(AT + dt.timedelta(hours=h), "u", "contact", f"b{h}", " ", 1, 1, 0, 0, 0, "") for h in range(4)],
                                 "logged_at timestamp_ntz, username string, pipeline string, batch_id string, campaign_name string, "
                                 "total_rows long, gtg_rows long, suppressed long, over_limit long, dedup_removed long, notes string")
    assert [(r["batch_id"], r["campaign"]) for r in activity_report(runs, 2).collect()] == [("b3", "—"), ("b2", "—")]


def test_sketched_profile(spark, scratch):
    store = HistoryStore(spark, f"{scratch}/h", buckets=2)
    assert store.profile(approx=True).first()["total_rows"] == 0
    for b in range(3):
        rows = spark.range(b * 20_000, b * 20_000 + 30_000).selectExpr(
            "id AS row_ord", "CAST(id AS STRING) AS call_id", "'1' AS `Dialed Number`", "'2024-01-16' AS `PBX DialingDate`",
            "CASE WHEN id % 7 = 0 THEN '' ELSE concat('c', id % 40) END AS `Campaign Name`", "concat('https://l/', id) AS `Contact Link`")
        store.load(rows, f"b{b}", AT)
    exact, kept = store.profile().first(), store.profile(approx=True)
    near = kept.first()
    assert exact == history_profile(store.calls()).first() and exact["total_rows"] == 70_000
    assert (near["total_rows"], near["campaigns"], near["earliest_date"]) == (70_000, exact["campaigns"], exact["earliest_date"])
    assert abs(near["contacts"] - exact["contacts"]) <= 0.03 * exact["contacts"]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "/sketches" in plan and "/calls" not in plan and "Bucketed" not in plan
    shutil.move(f"{scratch}/h/sketches", f"{scratch}/old")         # a store from before there were sketches
    assert store.profile(approx=True).first() == exact


def test_index_profile_is_taken_while_it_is_written(spark, scratch):
    path, index = f"{scratch}/snap", SnapshotIndex(spark, f"{scratch}/snap", f"{scratch}/index", buckets=2)
    for b in range(3):
        rows = contacts(spark, [(f"c{b}{i % 5}", "n", "", "", "", f"u{i + b}") for i in range(30)])
        write_snapshot(snapshot_rows(rows, f"b{b}", AT + dt.timedelta(hours=b)), path)
        index.update(f"b{b}")
        assert index.profile(approx=True).collect() == index.profile().collect()
    assert "/profiles" in index.profile(approx=True)._jdf.queryExecution().executedPlan().toString()


def test_totals_come_from_the_keys(spark, scratch):
    rows = [("1", "a", "1", "junk"), ("2", "a", "1", "2024-01-16"), ("3", "b", "1", " - "), ("4", "", "", None)]
    raw = strings(spark, rows, CALLS[:4])
    want = {"total": 4, "inserted": 3, "skipped": 1, "unparsed_dates": 1}
    for rows_bound in (0, 100):
        assert append_history(spark, f"{scratch}/s{rows_bound}", raw, "b", AT, rows_bound) == want
        again = append_history(spark, f"{scratch}/s{rows_bound}", raw, "b", AT, rows_bound)
        assert again == want | {"inserted": 0, "skipped": 4}
    assert append_history(spark, f"{scratch}/n", raw.drop("PBX DialingDate"), "b", AT)["unparsed_dates"] == 0
    assert "flag" not in align_history(raw).columns


def test_state_drops_files_that_come_again(spark, scratch):
    land = f"{scratch}/land"
    rows = [(str(i), f"k{i % 40}", str(i % 3), "2024-01-16", None if i % 2 else "C", "") for i in range(60)]
    calls(spark, rows).coalesce(1).write.parquet(f"{land}/a")
    shutil.copytree(f"{land}/a", f"{land}/b")
    more = [("0", "k1", "1", "2024-01-16", "other", ""), ("1", "new", "1", "2024-01-17", "C", "")]
    calls(spark, more).coalesce(1).write.parquet(f"{land}/c")
    options = {"recursiveFileLookup": "true"}
    first = ingest_stream(spark, land, f"{scratch}/store", f"{scratch}/p", options=options, replay_delay="7 days")
    assert sorted(r["total"] for r in first if r["total"]) == [2, 60]             # the copy's rows never reach the store
    assert sum(r["inserted"] for r in first) == 61 and sum(r["skipped"] for r in first) == 1
    plain = ingest_stream(spark, land, f"{scratch}/plain", f"{scratch}/q", options=options)
    assert sum(r["total"] for r in plain) == 122
    cols = ["call_id", "dialed_number", "campaign_name", "row_ord"]
    kept = lambda path: sorted(map(str, read_store(spark, path).select(*cols).collect()))
    assert kept(f"{scratch}/store") == kept(f"{scratch}/plain")
    calls(spark, rows[:5]).coalesce(1).write.parquet(f"{land}/d")                 # again after a restart: rows that state knows
    later = ingest_stream(spark, land, f"{scratch}/store", f"{scratch}/p", options=options, replay_delay="7 days")
    assert sum(r["total"] for r in later) == 0
    fresh = ingest_stream(spark, land, f"{scratch}/store", f"{scratch}/p2", options=options, replay_delay="7 days")
    assert sum(r["inserted"] for r in fresh) == 0                                 # state that knows nothing: the keys stop them


def test_replay_state_needs_places(spark, scratch):
    calls(spark, [("1", "a", "1", "", "", "")]).drop("row_ord").write.option("header", "true").csv(f"{scratch}/l")
    with pytest.raises(ValueError, match="row_ord"):
        ingest_stream(spark, f"{scratch}/l", f"{scratch}/s", f"{scratch}/p", fmt="csv", options={"header": "true"}, replay_delay="1 day")
    with pytest.raises(ValueError, match="one file"):
        ingest_stream(spark, f"{scratch}/l", f"{scratch}/s", f"{scratch}/p", replay_delay="1 day", max_files_per_trigger=3)
    calls(spark, [("1", "a", "1", "", "", "")] * 3).drop("row_ord").coalesce(1).write.parquet(f"{scratch}/q")
    got = ingest_stream(spark, f"{scratch}/q", f"{scratch}/s", f"{scratch}/p", replay_delay="1 day")
    assert sum(r["total"] for r in got) == 3 and sum(r["inserted"] for r in got) == 1
