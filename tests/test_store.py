"""History store with kept keys and counts; snapshot index: equality with the plain ways, plans, crashes."""

import datetime as dt
import glob
import random

import pytest
from pyspark.sql import functions as F

from conftest import strings
from dialsieve.operators import store as store_module
from dialsieve.operators.dial import tag_dial_limits, week_bounds, week_counts
from dialsieve.operators.history import KEYS, align_history, new_rows
from dialsieve.operators.snapshot import snapshot_index, snapshot_lookup, snapshot_rows, write_snapshot
from dialsieve.operators.snapshot_index import SnapshotIndex
from dialsieve.operators.store import HistoryStore
from dialsieve.sources.tabular import collate

AT = dt.datetime(2024, 2, 1, 9, 0, 0)
MONDAY = dt.date(2024, 1, 15)


def upload(spark, rows):
    return strings(spark, rows, ["row_ord", "call_id", "Dialed Number", "PBX DialingDate"]).withColumn("row_ord", F.col("row_ord").cast("long"))


def keys_of(df):
    return sorted((r["call_id"], r["dialed_number"], str(r["pbx_dialing_date"])) for r in df.collect())


def exchanges_over(df, needle):
    """Exchange nodes of the executed plan that have a scan with ``needle`` below them."""
    df.collect()
    lines = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    found = []
    for i, line in enumerate(lines):
        if "Exchange" in line and "Broadcast" not in line:
            for below in lines[i + 1:]:
                if depth(below) <= depth(line):
                    break
                if needle in below:
                    found.append(line.strip())
    return found


@pytest.mark.parametrize("broadcast_rows", [0, 2_000_000])
def test_random_batches_with_replays_and_late_calls(spark, scratch, broadcast_rows):
    rnd = random.Random(broadcast_rows)
    store = HistoryStore(spark, f"{scratch}/h", buckets=4)
    plain = {}
    sent = []
    for load in range(4):
        rows = [(str(i), str(rnd.randrange(60)) if rnd.random() > .1 else "", f"555-{rnd.randrange(12)}",
                 rnd.choice(["", "junk"] + [(MONDAY + dt.timedelta(days=rnd.randrange(-9, 12))).isoformat() for _ in range(9)]))
                for i in range(80)]
        rows = sent[0] if load == 2 else rows                       # the first upload again
        sent.append(rows)
        counts = store.load(upload(spark, rows), f"b{load}", AT + dt.timedelta(hours=load), broadcast_rows)
        before = len(plain)
        for _, c, n, d in rows:
            try:
                day = dt.date.fromisoformat(d)
            except ValueError:
                day = None
            plain.setdefault((c, "".join(x for x in n if x.isdigit())), day)
        assert counts["total"] == 80 and counts["inserted"] == len(plain) - before and counts["skipped"] == 80 - counts["inserted"]
        assert counts["unparsed_dates"] == sum(r[3] == "junk" for r in rows)
    assert keys_of(store.calls()) == sorted((c, n, str(d)) for (c, n), d in plain.items())
    for day in (MONDAY, MONDAY + dt.timedelta(days=3), MONDAY + dt.timedelta(days=9)):
        raw = sorted(map(tuple, week_counts(store.calls(), day).collect()))
        assert sorted(map(tuple, store.week_counts(day).collect())) == raw
        monday, after = week_bounds(day)
        own = {}
        for (_, n), d in plain.items():
            if d and monday <= d < after:
                own[n] = (own.get(n, (0, 0))[0] + (d == day), own.get(n, (0, 0))[1] + 1)
        assert raw == sorted((n, a, b) for n, (a, b) in own.items())


def test_same_new_rows_as_the_plain_anti_join(spark, scratch):
    store = HistoryStore(spark, f"{scratch}/h", buckets=3)
    store.load(upload(spark, [("1", "a", "1", ""), ("2", "b", "1", "2024-01-16"), ("3", "", "1", "")]), "b", AT)
    batch = align_history(upload(spark, [("1", "a", "1", ""), ("2", "a", "2", ""), ("3", "", "1", ""), ("4", "", "2", ""), ("5", "", "2", "")]))
    want = keys_of(new_rows(store.calls(), batch))
    assert keys_of(store.new_rows(batch)) == keys_of(store.new_rows(batch, 0)) == want == [("", "2", "None"), ("a", "2", "None")]


def test_large_batch_does_not_shuffle_the_stored_keys(spark, scratch):
    store = HistoryStore(spark, f"{scratch}/h", buckets=5)
    for b in range(3):
        store.load(upload(spark, [(str(i), str(i), str(i % 3), "2024-01-16") for i in range(b * 50, b * 50 + 80)]), f"b{b}", AT)
    big = (spark.range(3_000_000).selectExpr("id AS row_ord", "CAST(id AS STRING) AS call_id", "CAST(id % 3 AS STRING) AS `Dialed Number`",
                                             "'2024-01-17' AS `PBX DialingDate`"))
    fresh = store.new_rows(align_history(big)).select(*KEYS)                 # beyond the broadcast bound by its size
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    counted = fresh.groupBy().count()
    assert [x for x in exchanges_over(counted, "Bucketed: true") if "SinglePartition" not in x] == []
    assert counted.first()[0] == 3_000_000 - 180


def test_a_load_that_died_is_not_read_and_can_be_run_again(spark, scratch, monkeypatch):
    store = HistoryStore(spark, f"{scratch}/h", buckets=2)
    store.load(upload(spark, [("1", "a", "1", "2024-01-16")]), "b0", AT)
    rows = upload(spark, [("1", "a", "1", "2024-01-16"), ("2", "b", "1", "2024-01-17")])
    real = store_module.Bucketed.add

    def dies(self, frame):
        real(self, frame)
        raise RuntimeError("lost")
    monkeypatch.setattr(store_module.Bucketed, "add", dies)
    with pytest.raises(RuntimeError):
        store.load(rows, "b1", AT)
    monkeypatch.undo()
    assert store.calls().count() == 1 and store.keys().count() == 1 and store.loads().count() == 1
    store.load(rows, "b1", AT)
    assert keys_of(store.calls()) == [("a", "1", "2024-01-16"), ("b", "1", "2024-01-17")]
    assert store.week_counts(dt.date(2024, 1, 17)).collect()[0].asDict() == {"dialed_number": "1", "daily_count": 1, "weekly_count": 2}


def test_compaction_keeps_the_answers_and_another_session_finds_them(spark, scratch):
    store = HistoryStore(spark, f"{scratch}/h", buckets=3)
    for b in range(3):
        store.load(upload(spark, [(str(i), str(i), "7", "2024-01-16") for i in range(b * 5, b * 5 + 8)]), f"b{b}", AT)
    before = store.week_counts(MONDAY).collect()
    store.compact(buckets=2)
    again = HistoryStore(spark, f"{scratch}/h")
    assert again.buckets == 2 and again.week_counts(MONDAY).collect() == before
    assert again.keys().count() == again.calls().count() == 18 and again.counts().count() == 1
    other = HistoryStore(spark.newSession(), f"{scratch}/h")
    assert other.load(upload(spark, [("1", "17", "7", "2024-01-16"), ("2", "99", "7", "2024-01-16")]), "b9", AT)["inserted"] == 1
    assert again.keys().count() == 19


def test_empty_store_and_empty_load(spark, scratch):
    store = HistoryStore(spark, f"{scratch}/h")
    assert store.calls().count() == 0 and store.week_counts(MONDAY).count() == 0 and store.keys().count() == 0
    assert store.load(upload(spark, []), "b", AT) == {"total": 0, "inserted": 0, "skipped": 0, "unparsed_dates": 0}
    assert store.loads().count() == 1


def test_limits_from_kept_counts(spark, scratch):
    store = HistoryStore(spark, f"{scratch}/h", buckets=2)
    calls = [(str(i), str(i), f"212555000{i % 3}", "2024-01-16") for i in range(14)]
    store.load(upload(spark, calls[:9]), "b0", AT)
    store.load(upload(spark, calls[4:]), "b1", AT)
    rows = collate([(strings(spark, [(f"212-555-000{i}", "c") for i in range(4)], ["TelephoneNumber", "Campaign Name"])
                     .withColumn("row_ord", F.monotonically_increasing_id()), "1")])
    day = dt.date(2024, 1, 16)
    kept = tag_dial_limits(rows, None, day, None, 9, 4, counts=store.week_counts(day))
    raw = tag_dial_limits(rows, store.calls(), day, None, 9, 4)
    assert sorted(map(str, kept.collect())) == sorted(map(str, raw.collect()))
    assert kept.where("row_status = 'OVER_LIMIT'").count() == 2


# --- snapshot index ------------------------------------------------------------

def contacts(spark, rows):
    raw = strings(spark, rows, ["row_ord", "Campaign Name", "Profile url", "Full name"]).withColumn("row_ord", F.col("row_ord").cast("long"))
    return collate([(raw, "1")])


def extract(spark, links):
    return strings(spark, [("C", x) for x in links], ["campaign_name", "contact_link"])


def batch(spark, path, batch_id, hour, rows):
    write_snapshot(snapshot_rows(contacts(spark, rows), batch_id, AT + dt.timedelta(hours=hour)), path)


def indexed(index):
    return sorted(tuple(r) for r in index.latest().collect())


def plain(spark, path):
    return sorted(tuple(r) for r in snapshot_index(spark.read.parquet(path)).select("batch_id", "campaign_name", "contact_link", "loaded_at").collect())


def test_index_equals_the_window_over_all_batches(spark, scratch):
    path, rnd = f"{scratch}/snap", random.Random(4)
    index = SnapshotIndex(spark, path, f"{scratch}/index", buckets=4)
    for b, hour in enumerate([5, 1, 9, 9, 3]):                    # loaded out of order, two at the same time
        rows = [(str(i), rnd.choice(["C", "D", ""]), rnd.choice(["", *(f"https://l/{k}" for k in range(12))]), f"n{b}-{i}") for i in range(30)]
        batch(spark, path, f"batch{b}", hour, rows)
        index.update(f"batch{b}")
        assert indexed(index) == plain(spark, path)
    f3 = extract(spark, ["https://l/3", "https://l/4", "https://none"])
    cols = ["batch_id", "src_ord", "row_ord", "full_name"]
    want = sorted(map(tuple, snapshot_lookup(spark.read.parquet(path), f3).select(*cols).collect()))
    for rows in (0, 2_000_000):
        assert sorted(map(tuple, index.lookup(f3, rows).select(*cols).collect())) == want


def test_a_batch_that_is_written_again_replaces_its_places(spark, scratch):
    path = f"{scratch}/snap"
    index = SnapshotIndex(spark, path, f"{scratch}/index", buckets=2)
    batch(spark, path, "b0", 0, [("1", "C", "u1", "a"), ("2", "C", "u2", "b")])
    index.update("b0")
    batch(spark, path, "b1", 1, [("1", "C", "u1", "new"), ("2", "C", "u3", "c")])
    index.update("b1")
    batch(spark, path, "b1", 2, [("1", "C", "u2", "newer")])       # u1 goes back to b0, u3 is gone
    index.update("b1")
    assert indexed(index) == plain(spark, path) and [r[2] for r in indexed(index)] == ["u1", "u2"]


def test_an_update_reads_its_batch_only_and_shuffles_no_index(spark, scratch, monkeypatch):
    path = f"{scratch}/snap"
    index = SnapshotIndex(spark, path, f"{scratch}/index", buckets=3)
    for b in range(3):
        batch(spark, path, f"b{b}", b, [(str(i), "C", f"u{i + b}", "x") for i in range(20)])
        if b < 2:
            index.update(f"b{b}")
    seen = {}
    monkeypatch.setattr(index, "_write", lambda places, batches, newest: seen.update(places=places, batches=batches))
    index.update("b2")
    plan = seen["places"]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch_id" in plan and "Bucketed: true" in plan and seen["batches"] == ["b0", "b1", "b2"]
    assert exchanges_over(seen["places"], "Bucketed: true") == []


def test_lookup_reads_the_winning_batches_only(spark, scratch):
    path = f"{scratch}/snap"
    index = SnapshotIndex(spark, path, f"{scratch}/index", buckets=2)
    for b in range(6):
        batch(spark, path, f"b{b}", b, [(str(i), "C", f"u{b}-{i}", "x") for i in range(5)])
        index.update(f"b{b}")
    for b in (2, 3, 5):                       # whoever opens one of these files fails
        for part in glob.glob(f"{path}/batch_id=b{b}/*.parquet"):
            with open(part, "wb") as f:
                f.write(b"not a parquet file")
    got = index.lookup(extract(spark, ["u1-2", "u4-0", "u4-1"]))
    assert sorted(r["batch_id"] for r in got.collect()) == ["b1", "b4", "b4"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    assert plan.split("== Initial Plan ==")[0].count("full_name") and plan.split("== Initial Plan ==")[0].count("Scan parquet") == 1
    with pytest.raises(Exception):
        spark.read.parquet(path).where("full_name = 'x'").collect()


def test_no_snapshot_and_no_load_times(spark, scratch):
    index = SnapshotIndex(spark, f"{scratch}/none", f"{scratch}/index")
    assert index.lookup(extract(spark, ["u"])) is None and index.read() is None
    with pytest.raises(ValueError):
        index.update("b0")
    path = f"{scratch}/plain"
    index = SnapshotIndex(spark, path, f"{scratch}/index2", buckets=2)
    for b in range(2):
        write_snapshot(snapshot_rows(contacts(spark, [("1", "C", "u1", f"n{b}"), ("2", "", "u2", "x")]), f"b{b}"), path)
        index.update(f"b{b}")
    assert [r["batch_id"] for r in index.latest().collect()] == ["b1"]
