"""End-to-end runs with sinks, conservation properties and plan assertions."""

import datetime as dt
import os

from pyspark.sql import functions as F

from dialsieve.operators.history import read_store
from dialsieve.plans import catalog as C
from dialsieve.plans.contact import run_contact
from dialsieve.plans.history_load import load_history
from dialsieve.schema import OUTPUT_COLUMNS
from dialsieve.sources import bindings as B
from dialsieve.streaming.ingest import ingest_stream

SF = "/root/testdata/sf0.001"


def test_contact_run_with_sinks(spark, scratch):
    col = C.collated(spark, SF)
    m = run_contact(col, C.lists(spark, SF), C.dial_history(spark, SF), C.limits(), run_ts=B.RUN_TS,
                    batch_id=B.BATCH_ID, campaign_type="NON-DELL", out_dir=f"{scratch}/out",
                    snapshot_path=f"{scratch}/snap", audit_path=f"{scratch}/audit",
                    runlog_path=f"{scratch}/runlog", username="tester")
    total = col.count()
    assert m["total_rows"] == total
    assert m["gtg_rows"] + m["suppressed"] + m["over_limit"] == total          # clean + suppressed = input
    out = spark.read.parquet(f"{scratch}/out/output")
    assert out.columns == OUTPUT_COLUMNS
    assert out.count() + m["dedup_removed"] == m["gtg_rows"]                    # output + duplicates = allowed
    removed = spark.read.parquet(f"{scratch}/out/removed")
    assert removed.count() == m["suppressed"] + m["over_limit"]
    assert {"Campaign Name", "EmailAddress", "suppression_reason", "dial_limit_reason"} <= set(removed.columns)
    audit = spark.read.parquet(f"{scratch}/audit")
    assert audit.count() == total
    snap = spark.read.parquet(f"{scratch}/snap")
    assert snap.count() == total and set(r[0] for r in snap.select("batch_id").distinct().collect()) == {B.BATCH_ID}
    assert m["campaigns"]
    log = spark.read.parquet(f"{scratch}/runlog").first()
    assert (log["pipeline"], log["total_rows"], log["username"]) == ("contact", total, "tester")


def test_results_do_not_depend_on_partitioning(spark):
    """Keep-first and every reason depend on the carried upload order, not on
    how the input happens to be split."""
    from dialsieve.plans.contact import contact_output
    from dialsieve.sources.tabular import collate
    files = B.contact_files(spark, SF)
    lists, hist, lim = C.lists(spark, SF), C.dial_history(spark, SF), C.limits()
    a = contact_output(collate(files), lists, hist, lim, B.RUN_TS)
    shuffled = [(f.repartition(7, "Full name"), fmt) for f, fmt in files]
    b = contact_output(collate(shuffled), lists, hist.repartition(5), lim, B.RUN_TS)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_history_load_twice_inserts_nothing(spark, scratch):
    store = f"{scratch}/store"
    raw = B.call_file(spark, SF)
    first = load_history(spark, store, raw, "b1", dt.datetime(2024, 2, 1), lists_dir=f"{scratch}/lists",
                         as_of=B.AS_OF)
    assert first["inserted"] > 0 and first["inserted"] + first["skipped"] == first["total"]
    again = load_history(spark, store, raw, "b2", dt.datetime(2024, 2, 2))
    assert again["inserted"] == 0 and again["skipped"] == again["total"]
    s = read_store(spark, store)
    assert s.count() == s.select("call_id", "dialed_number").distinct().count() == first["inserted"]
    assert os.path.isdir(f"{scratch}/lists/dead/v=b1")
    # the store is partitioned by ISO week: a week's dial counts prune partitions
    from dialsieve.operators.dial import dial_counts
    plan = dial_counts(s, s.select(F.col("dialed_number").alias("phone")), B.CHECK_DATE)._jdf \
        .queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dial_week" in plan


def test_stream_ingest_replay_is_idempotent(spark, scratch):
    B.call_file(spark, SF).write.parquet(f"{scratch}/landing")
    r1 = ingest_stream(spark, f"{scratch}/landing", f"{scratch}/store", f"{scratch}/progress")
    n = read_store(spark, f"{scratch}/store").count()
    assert sum(x["inserted"] for x in r1) == n > 0
    # a second stream (fresh progress) over the same files inserts nothing
    r2 = ingest_stream(spark, f"{scratch}/landing", f"{scratch}/store", f"{scratch}/progress2")
    assert sum(x["inserted"] for x in r2) == 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_have_no_python_udfs(spark):
    for name in ["contact_run", "rechurn_run", "audit_rows", "dial_limit_tag", "history_ingest"]:
        p = _plan(C.QUERIES[name](spark, SF))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name


def test_list_joins_are_broadcast_and_dedup_is_map_side_limited(spark):
    p = _plan(C.q_suppression_tag(spark, SF))
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p
    p = C.q_contact_run(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in p


def test_store_scan_is_pruned(spark):
    p = _plan(C.q_history_ingest(spark, SF))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string>" in p


def test_snapshot_lookup_prunes_batches(spark, scratch):
    from dialsieve.operators.snapshot import snapshot_lookup, write_snapshot
    write_snapshot(C.snapshot(spark, "/root/testdata/sf0.1"), f"{scratch}/snap")
    snap = spark.read.parquet(f"{scratch}/snap")
    f3 = C.extract(spark, SF).where("row_ord < 100")
    df = snapshot_lookup(snap, f3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruningexpression(batch_id" in plan
    mem = snapshot_lookup(C.snapshot(spark, "/root/testdata/sf0.1"), f3)
    cols = sorted(mem.columns)
    want = sorted(map(tuple, mem.select(*cols).collect()))
    got = sorted(map(tuple, df.select(*cols).collect()))
    assert got == want


def test_versioned_lists(spark, scratch):
    from dialsieve.operators.suppress import read_list, write_list
    assert read_list(spark, f"{scratch}/lists", "dead") is None
    a = spark.createDataFrame([("a@x.com",)], "key string")
    b = spark.createDataFrame([("b@x.com",), ("c@x.com",)], "key string")
    write_list(a, f"{scratch}/lists", "dead", "20240101")
    write_list(b, f"{scratch}/lists", "dead", "20240201")
    assert sorted(r[0] for r in read_list(spark, f"{scratch}/lists", "dead").collect()) == ["b@x.com", "c@x.com"]


def test_truncate_store_and_snapshot(spark, scratch):
    from dialsieve.operators.history import truncate_history
    from dialsieve.operators.snapshot import truncate_snapshot, write_snapshot
    load_history(spark, f"{scratch}/store", B.call_file(spark, SF), "b1", dt.datetime(2024, 2, 1))
    s = read_store(spark, f"{scratch}/store")
    n = s.count()
    truncate_history(spark, f"{scratch}/store", s)
    assert read_store(spark, f"{scratch}/store").count() == 0     # empty store = no rows yet
    again = load_history(spark, f"{scratch}/store", B.call_file(spark, SF), "b2", dt.datetime(2024, 2, 2))
    assert again["inserted"] == n
    write_snapshot(C.snapshot(spark, SF), f"{scratch}/snap")
    snap = spark.read.parquet(f"{scratch}/snap")
    truncate_snapshot(spark, f"{scratch}/snap", snap)
    import glob
    assert not glob.glob(f"{scratch}/snap/batch_id=*")
