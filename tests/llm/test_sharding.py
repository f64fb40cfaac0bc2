"""Shards: cuts against plain filling over all group sizes, edge cases, plan without Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from dialsieve.llm import sharding


def plain(rows, shards):
    """Shard of every text, by filling over the whole list of groups."""
    size = Counter()
    for _, t in rows:
        size[t or ""] += len((t or "").encode()) + 8
    key = lambda t: hashlib.sha256(t.encode()).digest()
    lone, left = [], sum(size.values())
    for t in sorted(size, key=lambda t: (-size[t], key(t))):
        if len(lone) == shards - 1 or size[t] * (shards - len(lone)) <= left:
            break
        lone.append(t)
        left -= size[t]
    rest, k = sorted((t for t in size if t not in lone), key=key), shards - len(lone)

    def fill(c):
        bins, room = [[]], c
        for t in rest:
            if size[t] > room:
                bins.append([])
                room = c
            room -= size[t]
            bins[-1].append(t)
        return bins
    low, high = max((size[t] for t in rest), default=0) - 1, left
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if len(fill(mid)) <= k else (mid, high)
    out = {t: i for i, t in enumerate(lone)}
    out |= {t: len(lone) + i for i, b in enumerate(fill(high)) for t in b}
    return out


def check(got, rows, shards):
    want = plain(rows, shards)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, set()).add(t or "")
    assert sorted((r["id"] is None, r["id"] or 0, r["size"], r["crc"], r["shard"]) for r in got) == sorted(
        (i is None, i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), want[t or ""]) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("shards,points", [(1, 32768), (5, 32768), (24, 7), (7, 40)])
def test_matches_plain_filling(docs, monkeypatch, shards, points):
    monkeypatch.setattr(sharding, "POINTS", points)          # few points: several rounds of the search
    rnd = random.Random(shards)
    rows = [(i, "x" * rnd.randrange(60) + str(rnd.randrange(150))) for i in range(400)]
    rows += [(1000 + i, "copied é text") for i in range(300)]
    check(sharding.assign(docs([(i, t, None) for i, t in rows]), shards).collect(), rows, shards)


def test_nulls_empty_repeated_and_few_groups(docs):
    rows = [(None, None), (1, None), (2, ""), (3, "ü" * 9000), (3, "ü" * 9000), (3, "other"), (None, "other")]
    check(sharding.assign(docs([(i, t, None) for i, t in rows]), 24).collect(), rows, 24)


def test_one_group_and_empty_table(docs):
    one = sharding.assign(docs([(7, "same", None)] * 50), 24).collect()
    assert {r["shard"] for r in one} == {0} and sorted(r["slot"] for r in one) == list(range(50))
    assert sharding.assign(docs([]), 24).count() == 0
    assert sharding.find_cuts(sharding.measure(docs([])), 3) == sharding.Cuts([], [], 0)


def test_string_ids(docs):
    got = sharding.assign(docs([(str(i), str(i), None) for i in range(30)], "doc_id string, text string, source string"), 3)
    assert dict(got.dtypes)["id"] == "string" and got.count() == 30


def test_hot_rows_are_dealt_over_ranges(spark, docs, monkeypatch):
    monkeypatch.setattr(sharding, "_width", lambda s: 16)
    seen = {}
    keep = sharding._stored

    def stored(df, name):
        seen[name] = keep(df, name)
        return seen[name]
    monkeypatch.setattr(sharding, "_stored", stored)
    docs([])
    base = spark.range(20500).selectExpr("if(id < 20000, 5, id) AS doc_id", "if(id < 20000, 'hot', concat('t', id)) AS text")
    got = sharding.assign(base, 4)
    assert got.select("shard", "slot").distinct().count() == 20500
    most = seen["placed"].groupBy("part").count().agg(F.max("count")).first()[0]
    assert most < 4000                                       # of 20 500 equal rows in 16 ranges


def test_no_python_on_the_path(docs):
    plan = sharding.digest(sharding.assign(docs([(i, str(i % 3), None) for i in range(20)])))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_written_shards_hold_the_same_rows(spark, docs, scratch):
    df = docs([(i, "y" * (i % 17), str(i)) for i in range(200)])
    sharding.write_shards(df, f"{scratch}/shards", 6)
    back = {r["doc_id"]: r["shard"] for r in spark.read.parquet(f"{scratch}/shards").collect()}
    assert back == {r["id"]: r["shard"] for r in sharding.assign(df, 6).collect()}
    with pytest.raises(ValueError):
        sharding.write_shards(df.withColumn("shard", F.lit(0)), f"{scratch}/no", 6)


def test_many_stretches_make_a_small_plan(spark, docs):
    """Thousands of stretches are looked up in one array, not by as many conditions."""
    docs([])
    ends = spark.range(1, 20001).select((F.col("id") * 10).alias("end"))
    known = sharding._Known(200000)
    known.points, known.hides, known.widths = list(range(0, 200001, 20)), [True] * 10000, [20] * 10000
    stretches = [(a, a + 20) for a in range(0, 200000, 40)]
    sharding._split(ends, known, stretches)
    assert known.points == sorted({*range(0, 200001, 20), *(a + 10 for a, _ in stretches)})
    assert known.hides == [False, False, True] * 5000


def test_ends_close_together_after_a_wide_gap(spark, docs):
    """Slices become narrower each round, also where many stretches share the points."""
    docs([])
    ends, at = [], 0
    for _ in range(40):
        for size in (100000, 8, 8):
            at += size
            ends.append((at, size))
    frame = spark.createDataFrame(ends, "end long, bytes long")
    known = sharding._Known(at)
    stretches = [(0, at)]
    for _ in range(20):
        sharding._split(frame, known, stretches)
        stretches = [(a, b) for a, b, hides in zip(known.points, known.points[1:], known.hides) if hides]
        if not stretches:
            break
    assert known.points == [0, *(e for e, _ in ends)]


def test_search_ends_on_uneven_groups(docs, monkeypatch):
    monkeypatch.setattr(sharding, "POINTS", 16)
    rows = [(i, ("z" * 20000 if i % 3 == 0 else "") + str(i)) for i in range(180)]
    check(sharding.assign(docs([(i, t, None) for i, t in rows]), 40).collect(), rows, 40)
