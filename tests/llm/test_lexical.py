"""Ranked search against scoring every document; blocks, masks and edge cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from dialsieve.llm import lexical
from dialsieve.llm.common import prepare

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, top=10):
    counts = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        asked, rows = Counter(terms(text)), []
        for i, c in counts:
            m = 25 + (75 * sum(c.values()) * n_docs) // total
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t, q in asked.items() if c[t])
            if s > 0:
                rows.append((-s, i is None, i if i is not None else 0, i))
        out += [(item, k + 1, r[3], -r[0]) for k, r in enumerate(sorted(rows)[:top])]
    return sorted(out, key=str)


def ask(spark, docs, items, parts=3, kind="long", **more):
    prepare(spark)
    d = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5) for i, t in docs],
                              f"doc_id {kind}, text string, item_id int, score int, rank int, id int, term int").repartition(parts)
    b = spark.createDataFrame([(i, t, 9, 8) for i, t in items], "item_id long, text string, doc_id int, key int")
    return sorted((tuple(r) for r in lexical.search(d, b, **more).collect()), key=str)


def corpus(seed, n, words):
    rnd = random.Random(seed)
    vocab = [f"w{int(rnd.paretovariate(1))}" for _ in range(words)] + ["Ünï", "ß9", "THE", "the", "The"]
    text = lambda k: rnd.choice([" ", ", ", "-"]).join(rnd.choices(vocab, k=k))
    docs = [(i, text(rnd.randrange(1, 60))) for i in range(n)]
    items = [(i, text(rnd.randrange(1, 30))) for i in range(25)] + [(100, docs[3][1]), (101, docs[3][1]), (101, docs[3][1])]
    return docs, items


@pytest.mark.parametrize("block,words", [(8192, 300), (17, 40), (64, 2000)])
def test_matches_scoring_everything(spark, monkeypatch, block, words):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", block)
    docs, items = corpus(block, 700, words)
    assert ask(spark, docs, items) == plain(docs, items)


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ITEM_BYTES", 300)
    docs, items = corpus(4, 200, 100)
    assert ask(spark, docs, items) == plain(docs, items)


def test_ties_copies_nulls_and_empty_texts(spark):
    docs = [(i, "alpha beta") for i in range(40, 0, -1)] + [(None, "alpha beta"), (7, "alpha beta"), (50, None), (51, ""), (52, "... !!"),
                                                             (53, "alpha " * 5000), (None, "gamma")]
    items = [(1, "Alpha, BETA"), (1, "Alpha, BETA"), (2, None), (3, ""), (4, "-- ?"), (5, "unknown"), (None, "gamma gamma"), (6, "alpha")]
    got = ask(spark, docs, items)
    assert got == plain(docs, items)
    assert [r[2] for r in sorted(r for r in got if r[0] == 1)][:9] == [1, 2, 3, 4, 5, 6, 7, 7, 8]


def test_fewer_matches_than_asked_and_other_tops(spark):
    docs, items = [(1, "a b"), (2, "b c"), (3, "d")], [(1, "a b c"), (2, "d d d")]
    assert ask(spark, docs, items) == plain(docs, items)
    docs, items = corpus(9, 300, 50)
    assert ask(spark, docs, items, top=3) == plain(docs, items, 3)


def test_empty_tables(spark):
    assert ask(spark, [], [(1, "a")]) == [] and ask(spark, [(1, "a")], []) == [] and ask(spark, [(1, None)], [(1, "a")]) == []


def test_string_ids(spark):
    docs = [(f"d{i}", "alpha " + "x " * (i % 4)) for i in range(30)]
    assert ask(spark, docs, [(1, "alpha x")], kind="string") == plain(docs, [(1, "alpha x")])


def test_terms_are_compared_by_bytes():
    items = lexical.Items.of(["alpha beta"])
    items.keys[:] = np.sort(lexical.Items.of(["gamma delt"]).keys)       # values of other words
    buf = np.frombuffer(b"gamma delt", np.uint8)
    assert len(items.find(buf, np.array([0, 6]), np.array([5, 10]))[0]) == 0


def test_a_task_passes_on_ten_rows_an_item(spark):
    docs, items = corpus(2, 900, 30)
    prepare(spark)
    d = spark.createDataFrame(docs, "id long, text string").coalesce(1)
    block = lexical.count_terms(d, lexical.Items.of([t for _, t in items[:20]]))
    assert lexical.rank_block(d, block, 10).count() <= 200
