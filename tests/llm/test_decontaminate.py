"""Leaks against full edit-distance search."""

import random

import numpy as np
import pytest

from dialsieve.llm import decontaminate as D

LETTERS = "etaoinshrdlu"


def words(rng, n):
    return " ".join("".join(rng.choice(LETTERS) for _ in range(rng.randrange(2, 8))) for _ in range(n))


def edit(rng, text, n):
    s = list(text)
    for _ in range(n):
        i, what = rng.randrange(len(s)), rng.random()
        if what < .33:
            s[i] = rng.choice(LETTERS)
        elif what < .66:
            del s[i]
        else:
            s.insert(i, rng.choice(LETTERS))
    return "".join(s)


def nearest(item, text):
    """Least edits of the whole item against any stretch of the text."""
    cost = np.zeros(len(text) + 1, int)
    chars = np.array(list(text))
    for i, c in enumerate(item):
        here = np.concatenate([[i + 1], np.minimum(cost[:-1] + (chars != c), cost[1:] + 1)])
        ramp = np.arange(len(here))
        cost = np.minimum.accumulate(here - ramp) + ramp
    return int(cost.min())


def folded(t):
    return " ".join(t.lower().split())


@pytest.fixture(scope="module")
def case():
    rng = random.Random(11)
    items = [(i, words(rng, rng.randrange(8, 40))) for i in range(12)]
    rows, planted = [], {}
    for n in range(80):
        t = words(rng, rng.randrange(0, 120))
        if n % 2:
            key, item = rng.choice(items)
            p, leak = rng.randrange(len(t) + 1), edit(rng, item, rng.choice([0, 1, int(len(item) * D.EDIT_RATE * .8)]))
            planted[n] = (key, leak)
            t = t[:p] + " " + (leak.upper() if n % 3 else leak.replace(" ", " \n ")) + " " + t[p:]
        rows.append((n, t, "s"))
    return items, rows, planted


def test_every_leak_within_budget_and_no_other(spark, docs, case):
    items, rows, planted = case
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.find_leaks(docs(rows).repartition(3), bench).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    budget = {k: int(len(folded(t)) * D.EDIT_RATE) for k, t in items}
    want = {(n, k) for n, t, _ in rows for k, item in items if nearest(folded(item), folded(t)) <= budget[k]}
    assert found == want and {(n, k) for n, (k, _) in planted.items()} <= found
    text, item = {n: t for n, t, _ in rows}, dict(items)
    for r in got:
        stretch = folded(text[r.doc_id][r.start:r.end])
        assert nearest(folded(item[r.item_id]), stretch) == r.edits <= budget[r.item_id]


def test_short_items_have_their_whole_budget(spark, docs):
    rng = random.Random(4)
    items = [(m, "".join(rng.choice(LETTERS) for _ in range(m))) for m in range(5, 41)] + [(1, "z"), (2, "Q é"), (3, " \n"), (4, "")]
    rows, planted = [], set()
    for n in range(400):
        key, item = items[n % len(items)]
        t, leak = words(rng, rng.randrange(0, 30)), edit(rng, item, int(len(item) * D.EDIT_RATE)) if item.strip() else ""
        rows.append((n, t + leak + words(rng, rng.randrange(0, 9)), "s"))
        planted |= {(n, key)} if leak else set()
    got = D.find_leaks(docs(rows).repartition(2), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    want = {(n, k) for n, t, _ in rows for k, x in items if folded(x) and nearest(folded(x), folded(t)) <= int(len(folded(x)) * D.EDIT_RATE)}
    assert found == want and planted <= found
    assert {k for _, k in found} == {k for k, x in items if x.strip()}


def test_copies_side_by_side_are_all_found(spark, docs):
    rng = random.Random(6)
    items = [(m, "".join(rng.choice(LETTERS) for _ in range(m))) for m in (5, 9, 10, 20, 25, 30, 60)]
    rows = [(m, " ".join([x] * 7), "s") for m, x in items]
    got = D.find_leaks(docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    own = sorted((r.item_id, r.start, r.end, r.edits) for r in got if r.item_id == r.doc_id)
    assert own == sorted((m, i * (m + 1), i * (m + 1) + m, 0) for m, _ in items for i in range(7))


def test_a_better_overlapping_leak_stays_among_many(monkeypatch):
    import pyarrow as pa
    good = [(0, 0, 100 * i, 100 * i + 40, 0) for i in range(30)]
    worse = [(0, 0, a + shift, b + shift, 2) for _, _, a, b, _ in good for shift in (-3, 3) if a + shift >= 0]
    monkeypatch.setattr(D.Items, "align", lambda self, *_: iter(worse + good + [(0, 0, 50, 90, 3)]))
    got = D.Items([(1, "x" * 40)], D.EDIT_RATE, D.Q).leaks(pa.array(["y" * 3000]))
    assert got == sorted([*good, (0, 0, 50, 90, 3)])


def test_blocks_and_small_expansions_change_nothing(spark, docs, case, monkeypatch):
    items, rows, _ = case
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(tuple(r) for r in D.find_leaks(docs(rows), bench).collect())
    monkeypatch.setattr(D, "HITS", 50)
    monkeypatch.setattr(D, "BLOCK_CHARS", 64)
    index, small = D.Items(items, D.EDIT_RATE, D.Q), []
    import pyarrow as pa
    for n, t, _ in rows:
        small += [(n, index.ids[x], a, e, c) for _, x, a, e, c in index.leaks(pa.array([t]))]
    assert sorted(small) == one
    assert sorted(tuple(r) for r in D.find_leaks(docs(rows), bench, block_bytes=300).collect()) == one


def test_drop_keeps_clean_rows_and_all_columns(spark, docs, case):
    items, rows, planted = case
    bench = spark.createDataFrame([*items, (77, None), (78, "short"), items[0]], "item_id long, text string")
    extra = [(500, None, "s"), (501, "", None), (None, items[0][1], "s"), (502, "🙂 " * 5000 + items[1][1] + "é" * 9000, "s"), (503, "the " * 9000, "s")]
    frame = docs(rows + extra)
    kept = D.drop_leaks(frame, bench)
    leaky = {r.doc_id for r in D.find_leaks(frame, bench).collect()}
    assert set(planted) | {None, 502} <= leaky
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {n for n, *_ in rows + extra} - leaky
    assert 500 not in leaky and 501 not in leaky and 503 not in leaky


def test_empty_tables(spark, docs, case):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert D.find_leaks(docs(case[1]), bench).collect() == []
    assert D.drop_leaks(docs(case[1]), bench).count() == len(case[1])
    assert D.find_leaks(docs([]), spark.createDataFrame(case[0], "item_id long, text string")).collect() == []
