"""Line runs against plain Python and the SQL twin."""

import hashlib
import random

import duckdb
import pytest

from dialsieve.llm import linededup as L


def brute(rows, min_lines, min_chars):
    """Every run that began earlier, and the longest run that stands elsewhere, by comparing lines position by position."""
    order = sorted({(k is not None, k or 0, t or "") for k, t, _ in rows})
    lines = {d: [(at, x) for at, x in enumerate(d[2].split("\n")) if x.strip(" ")] for d in order}
    seen, gone = {}, {}
    for d in order:                       # earlier starts of each run, up to min_lines long
        ls = [x for _, x in lines[d]]
        gone[d] = set()
        for i in range(len(ls)):
            for n in range(1, min(min_lines, len(ls) - i) + 1):
                run = tuple(ls[i:i + n])
                if run in seen and (n == min_lines or (n == 1 and len(run[0]) >= min_chars)):
                    gone[d] |= set(range(i, i + n))
                seen.setdefault(run, (d, i))
    places = {}
    for d in order:
        for i, (_, x) in enumerate(lines[d]):
            places.setdefault(x, []).append((d, i))
    longest = dict.fromkeys(order, 0)
    for same in places.values():
        for d, i in same:
            for e, j in same:
                # only where the run cannot begin a line earlier
                if (d, i) != (e, j) and not (i and j and lines[d][i - 1][1] == lines[e][j - 1][1]):
                    n = 0
                    while i + n < len(lines[d]) and j + n < len(lines[e]) and lines[d][i + n][1] == lines[e][j + n][1]:
                        n += 1
                    longest[d] = max(longest[d], n)
    out = []
    for k, t, _ in rows:
        d = (k is not None, k or 0, t or "")
        cut = {lines[d][i][0] for i in gone[d]}
        ls = d[2].split("\n")
        runs = sum(i - 1 not in gone[d] for i in gone[d])
        kept = "\n".join(x for at, x in enumerate(ls) if at not in cut)
        out.append((k, len(ls) if d[2] else 0, len(cut), runs, longest[d], kept))
    return sorted(out, key=str)


def corpus(seed, n=80):
    rng = random.Random(seed)
    line = lambda: rng.choice(["short", "a", "", " ", "another", "the same long line that many documents have in common", "x" * 45, "日本 " * 14,
                               f"own {rng.randrange(40)}"])
    block = [[f"block {b} line {i}" for i in range(rng.randrange(2, 9))] for b in range(4)]
    rows = []
    for i in range(n):
        ls = [line() for _ in range(rng.randrange(8))]
        if rng.random() < .5:
            b = rng.choice(block)
            a = rng.randrange(len(b))
            at = rng.randrange(len(ls) + 1)
            ls[at:at] = b[a:a + rng.randrange(1, 9)]
        rows.append((i * 7 % 101, "\n".join(ls), "s"))
    return rows


EXTRA = [(500, None, "s"), (501, "", "s"), (502, "\n\n\n", "s"), (None, "no id\nshort", "s"), (503, "long one\n" * 60, "s")]


@pytest.mark.parametrize("min_lines,min_chars", [(2, 1), (2, 40), (1, 10**6), (3, 40), (5, 10**6)])
def test_matches_brute_force(spark, docs, min_lines, min_chars):
    rows = corpus(min_lines) + EXTRA
    rows.append(rows[3])                  # equal in id and text: one document
    got = L.drop_repeats(docs(rows).repartition(5), min_lines=min_lines, min_chars=min_chars).collect()
    # documents with equal ids follow each other by text hash: keep the ids apart
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, min_lines, min_chars)


def test_ranks_are_suffix_order(spark, docs):
    lines = L.lines_of(docs(corpus(9)))
    rounds, _ = L.prefix_doubling(L.repeated_lines(lines))
    ids = {(r.k, r.pos): (r.l1, r.l2) for r in lines.collect()}
    assert len(rounds) >= 3
    for j, frame in enumerate([*rounds, L.shared_prefix(rounds, 3)]):
        size = 3 if j == len(rounds) else 1 << j
        got = frame.collect()
        assert got
        prefix = {(r.k, r.pos): tuple(ids[r.k, r.pos + i] for i in range(size)) for r in got}
        order = sorted(got, key=lambda r: r["rank"])
        for a, b in zip(order, order[1:], strict=False):
            assert (a["rank"] == b["rank"]) == (prefix[a.k, a.pos] == prefix[b.k, b.pos])
            assert prefix[a.k, a.pos] <= prefix[b.k, b.pos]


def test_longest_run_of_every_suffix(spark, docs):
    rows = corpus(11) + [(700, "a\nb\n\nc\nd\ne\nf\ng", "s"), (701, "z\nb\nc\nd\n \ne\nf\ny", "s"), (702, "c\nd\ne\nx", "s")]
    lines = L.lines_of(docs(rows))
    ids = {(r.k, r.pos): (r.l1, r.l2) for r in lines.collect()}
    got = {(r.k, r.pos): r.lines for r in L.longest_runs(*L.prefix_doubling(L.repeated_lines(lines))).collect()}

    def common(p, q):
        n = 0
        while ids.get((p[0], p[1] + n), 0) == ids.get((q[0], q[1] + n), 1):
            n += 1
        return n
    want = {p: max(common(p, q) for q in ids if q != p) for p in ids}
    assert got == {p: n for p, n in want.items() if n}
    assert got[700, 1] == 5 and got[702, 0] == 3


def test_repeated_lines_go_at_any_length_and_runs_cross_blank_lines(spark, docs):
    rows = [(1, "All rights reserved.\n\nMenu\n}", "s"), (2, "own\nAll rights reserved.\n\nMenu\n\n}\nlast", "s")]
    got = {r.doc_id: r for r in L.drop_repeats(docs(rows)).collect()}
    assert got[1].n_removed == 0
    assert (got[2].n_removed, got[2].n_runs, got[2].longest_run, got[2].kept_text) == (3, 1, 3, "own\n\n\nlast")


def test_equal_rows_are_one_document_in_every_round(spark, docs):
    rows = corpus(3)
    rows += [rows[5], (900, "one\ntwo\nthree\nfour", "s")] + [(901, "one\ntwo\nthree\nfour", "s")] * 40
    for frame in L.prefix_doubling(L.repeated_lines(L.lines_of(docs(rows))))[0]:
        got = [(r.k, r.h, r.pos) for r in frame.collect()]
        assert len(got) == len(set(got)) > 0
    cut = {r.doc_id: (r.n_removed, r.longest_run) for r in L.drop_repeats(docs(rows)).collect()}
    assert (cut[900], cut[901]) == ((0, 4), (4, 4))
    alone = L.drop_repeats(docs([(1, "x\ny", "s")] * 5)).collect()
    assert {(r.n_removed, r.longest_run) for r in alone} == {(0, 0)}


def test_sql_twin(spark, docs):
    rows = corpus(5) + EXTRA + [(504, "line of a long text\nother\n" * 1500, "s")]
    got = L.drop_repeats(docs(rows)).collect()
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", rows)
    want = con.sql(L.ORACLE).fetchall()
    mine = [(*tuple(r)[:5], hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got]
    assert sorted(mine, key=str) == sorted(want, key=str)


def test_native_plan_and_empty_table(spark, docs):
    out = L.drop_repeats(docs(corpus(1)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    assert L.drop_repeats(docs([])).collect() == []
