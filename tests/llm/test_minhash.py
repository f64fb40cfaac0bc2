"""Near-duplicate groups against all pairs."""

import itertools
import random
import re

import pytest

from dialsieve.llm import minhash as M
from dialsieve.llm.common import WORD_RE
from dialsieve.llm.components import components

UPPER = {c: c + 32 for c in range(65, 91)}


def sets(rows, k=4):
    out = []
    for key, t in rows:
        w = re.findall(WORD_RE, (t or "").translate(UPPER))
        out.append((key, {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    return out


def brute(rows, percent=80):
    s = sets(rows)
    root = {k: k for k, _ in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, p), (b, q) in itertools.combinations(s, 2):
        if p and q and 100 * len(p & q) >= percent * len(p | q):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return sorted((k, len(p), find(k), find(k) == k) for k, p in s)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(400))
    boiler = [word() for _ in range(30)]
    bases = [[word() for _ in range(rng.randrange(3, 120))] for _ in range(25)]
    rows = []
    for i in range(260):
        w = list(rng.choice(bases)) if rng.random() < .7 else [word() for _ in range(rng.randrange(60))]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            if w:
                w[rng.randrange(len(w))] = word()
        if rng.random() < .3:
            w += boiler
        t = " ".join(w)
        rows.append((i * 3 % 997, t.upper() if rng.random() < .2 else t.replace(" ", "\n", 2)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_match_all_pairs(spark, docs, seed):
    rows = [*corpus(seed), (2000, None), (2001, ""), (2002, " \t"), (2003, "one two"), (2004, "ONE two"), (2005, "one two three"),
            (2006, "日本 ü Ü x y"), (2007, "日本 ü Ü x y"), (2008, "日本 ü ü x y"), (2009, "la " * 30_000), (2010, "la " * 9)]
    got = M.near_groups(docs([(k, t, "s") for k, t in rows]).repartition(5)).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


def test_large_group_and_chain(spark, docs):
    """Thousands of copies cost a star; a chain whose ends are unlike is still one group."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[:50], f"x{i}", *base[50:]])) for i in range(400)]
    chain = [[f"c{(i if i >= 3 * n else i + 1000)}" for i in range(60)] for n in range(12)]
    rows += [(1000 + n, " ".join(w)) for n, w in enumerate(chain)]
    rng.shuffle(rows)
    got = M.near_groups(docs([(k, t, "s") for k, t in rows])).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


def test_nulls_repeats_and_drop(spark, docs):
    t = " ".join(f"w{i}" for i in range(30))
    frame = docs([(5, t, "a"), (5, t, "a"), (7, t + " z", "b"), (None, t, "c"), (9, None, "d"), (4, "q r s t u", "e")])
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in M.near_groups(frame).collect())
    assert got == [("4", 2, "4", True), ("5", 27, "5", True), ("5", 27, "5", True), ("7", 28, "5", False),
                   ("9", 0, "9", True), ("None", 27, "None", True)]
    kept = M.drop_near(frame)
    assert kept.columns == frame.columns and sorted(r.source for r in kept.collect()) == ["a", "a", "c", "d", "e"]


def test_one_id_with_two_texts_joins_their_groups(spark, docs):
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    got = M.near_groups(docs([(3, a, "s"), (2, b, "s"), (3, b, "s"), (8, a, "s")])).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(2, 2, True), (3, 2, False), (3, 2, False), (8, 2, False)]


def test_empty_table(spark, docs):
    assert M.near_groups(docs([])).collect() == []


def test_components_of_random_links(spark):
    rng = random.Random(6)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    root = {x: x for e in links for x in e}
    for _ in range(400):
        for u, v in links:
            root[u] = root[v] = min(root[u], root[v])
    got = components(spark.createDataFrame(links, "u long, v long")).collect()
    assert {r.node: r.component for r in got} == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in links)}


def test_sql_twin(spark, docs):
    import duckdb
    rows = [(k, t, "s") for k, t in corpus(5)] + [(2000, None, "s"), (2001, "", "s"), (2003, "one two", "s"), (2004, "ONE two", "s")]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", rows)
    assert sorted(con.sql(M.oracle()).fetchall()) == brute([(k, t) for k, t, _ in rows])


def test_blocks_against_blocks(spark, docs, monkeypatch):
    """Near copies around the threshold: the star leaves many components, blocks settle them."""
    monkeypatch.setattr(M, "BLOCK_SHINGLES", 1500)
    rng = random.Random(12)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(7)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(12)}"
        rows.append((i, " ".join(w)))
    got = M.near_groups(docs([(k, t, "s") for k, t in rows])).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


def test_repeated_rows_are_compared_once(spark, docs, monkeypatch):
    """Two near texts with very many rows each: one pair is verified, with one text a side."""
    t = " ".join(f"w{i}" for i in range(40))
    seen = []
    real = M._verify
    monkeypatch.setattr(M, "_verify", lambda pairs, texts, *how: seen.append((pairs.count(), texts.count())) or real(pairs, texts, *how))
    rows = [(5, t, "s")] * 3000 + [(9, t + " z", "s")] * 3000 + [(None, t, "s")] * 500
    got = M.near_groups(docs(rows).repartition(6)).groupBy("doc_id", "n_shingles", "component_id", "kept").count().collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept, r["count"]) for r in got) == [
        ("5", 37, "5", True, 3000), ("9", 38, "5", False, 3000), ("None", 37, "None", True, 500)]
    assert seen == [(1, 2)]


def test_short_alike_texts_make_small_blocks(spark, docs, monkeypatch):
    """Texts that share most shingles and are no copies: blocks are bounded by their sets."""
    monkeypatch.setattr(M, "BLOCK_SETS", 128)
    rows = [(i, f"your order was shipped today under number {i}", "s") for i in range(700)]
    rows += [(1000 + i, f"one two three four five six seven eight nine ten eleven twelve {'x' * (i % 3)} {i // 3 % 5}", "s") for i in range(60)]
    got = M.near_groups(docs(rows).repartition(4)).collect()
    assert sorted(tuple(r) for r in got) == brute([r[:2] for r in rows])


def test_a_frequent_key_is_dealt_in_slots(spark):
    from pyspark.sql import functions as F

    from dialsieve.llm.common import spread
    rows = spark.range(5000).select(F.when(F.col("id") < 4000, 1).otherwise(F.col("id")).alias("u"), F.col("id").alias("v"))
    dealt, slots = spread(rows, "u", "v", 100)
    assert dealt.count() == dealt.join(slots, ["u", "slot"]).count() == 5000
    most = dealt.groupBy("u", "slot").count().agg(F.max("count")).first()[0]
    assert most < 160 and slots.where("u = 1").count() == 40 and slots.where("u <> 1").count() == 1000


def test_components_of_a_hub(spark, monkeypatch):
    from dialsieve.llm import components as K
    monkeypatch.setattr(K, "PARTS", 3)
    links = [(7, i) for i in range(100, 900)] + [(i, 2000 + i) for i in range(100, 130)] + [(3, 899), (5000, 5001)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: 5000 if x >= 5000 else 3 for e in links for x in e}


def test_components_stop_at_stars(spark, monkeypatch):
    """Links that are stars need no step, a star of stars one; each step costs two writes."""
    from dialsieve.llm import components as K
    saves, real = [], K._save
    monkeypatch.setattr(K, "_save", lambda links: saves.append(1) or real(links))

    def of(links):
        saves.clear()
        rows = components(spark.createDataFrame(links, "u long, v long")).collect()
        assert len(rows) == len({r.node for r in rows})
        return {r.node: r.component for r in rows}, len(saves)

    star = [(1, i) for i in range(2, 40)] + [(50, 51), (51, 50)]
    assert of(star) == ({**{i: 1 for i in range(1, 40)}, 50: 50, 51: 50}, 1)
    got, writes = of([*star, (40, 39), (40, 60), (60, 61)])
    assert got == {**{i: 1 for i in (*range(1, 41), 60, 61)}, 50: 50, 51: 50} and writes <= 5
    assert of([(7, 7)]) == ({}, 1)


def test_components_take_few_wide_stages(spark):
    """Two steps over a small table: every stage costs as many tasks as the session shuffles large tables in."""
    links = spark.createDataFrame([(i, i + 1) for i in range(40, 44)] + [(1, i) for i in range(2, 40)], "u long, v long")
    sc = spark.sparkContext
    sc.setJobGroup("few-stages", "components")
    try:
        got = components(links).collect()
        jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup("few-stages")]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)
    assert {r.node: r.component for r in got} == {i: 1 if i < 40 else 40 for i in range(1, 45)}
    assert sum(len(j.stageIds) for j in jobs) <= 45


def test_blocks_of_a_region_are_dealt_over_tasks(spark, docs, monkeypatch):
    """A region's pairs of blocks go to tasks each by itself, not all to the one that has the region."""
    monkeypatch.setattr(M, "BLOCK_SETS", 64)
    plans, real = [], M._save

    def save(df):
        plans.append(df._jdf.queryExecution().toString())
        return real(df)

    monkeypatch.setattr(M, "_save", save)
    rows = [(i, f"your order was shipped today under number {i}", "s") for i in range(300)]
    got = M.near_groups(docs(rows).repartition(4)).collect()
    assert sorted(tuple(r) for r in got) == brute([r[:2] for r in rows])
    compared = [p for p in plans if "FlatMapGroupsInArrow" in p]
    assert compared and all(re.search(r"hashpartitioning\(region#\d+L?, i#\d+L?, j#\d+L?, \d+\)", p) for p in compared)
    assert not any(re.search(r"hashpartitioning\(region#\d+L?, \d+\)", p) for p in compared)


def test_narrowed_and_counted(spark):
    from dialsieve.llm import common as C
    cores = spark.sparkContext.defaultParallelism
    wide = spark.range(1000).repartition(cores * 5)
    assert C.narrowed(wide, 1000).rdd.getNumPartitions() == cores
    assert C.narrowed(wide, 3 * cores * 10, 10).rdd.getNumPartitions() == 3 * cores
    assert C.narrowed(spark.range(0, 10, 1, 1), 1000).rdd.getNumPartitions() == 1
    kept, rows = C.counted(C.narrowed(wide, 1000).where("id % 2 = 0"), lambda df: C.stored(df, "few"))
    assert rows == 500 and sorted(r.id for r in kept.collect()) == list(range(0, 1000, 2))
    assert C.counted(wide.where("id < 0"), lambda df: C.stored(df, "none"))[1] == 0
