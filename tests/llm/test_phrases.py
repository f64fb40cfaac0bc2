"""Repeated passages against a count of all windows."""

import collections
import hashlib
import random
import re

import pytest

from dialsieve.llm import phrases
from dialsieve.llm.common import WORD_RE


def brute(rows, window):
    words = [re.findall(WORD_RE, t or "") for _, t in rows]
    seen = collections.Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (key, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((key, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def corpus(seed, n=60, vocabulary=30):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(vocabulary))
    passages = [[word() for _ in range(rng.randrange(4, 40))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randrange(5)):
            w += [word() for _ in range(rng.randrange(20))] + (rng.choice(passages) if rng.random() < .5 else [])
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(w)))
    return rows


@pytest.mark.parametrize("window,anchor,shard", [(8, 3, 200), (8, 8, 1 << 20), (12, 1, 500)])
def test_matches_brute_force(spark, docs, monkeypatch, window, anchor, shard):
    monkeypatch.setattr(phrases, "RANGE_BYTES", 1000)
    rows = corpus(window) + [(900, None), (901, ""), (902, "  \n"), (903, "to " * 50), (904, "x y " * 30), (None, "p q r"),
                             (905, "Ünïcode 日本 " * 20), (905, "Ünïcode 日本 " * 20), (906, "one")]
    frame = docs([(k, t, "s") for k, t in rows]).repartition(5)
    monkeypatch.setattr(phrases, "SHARD_BYTES", shard)
    monkeypatch.setattr(phrases.pack, "__defaults__", (shard,))
    got = phrases.remove_repeats(frame, window=window, anchor=anchor).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, window)


def test_long_repetitive_text_and_shared_passage(spark, docs):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"a{i} b{i} {passage} c{i}") for i in range(30)] + [(99, "na " * 20_000)]
    got = phrases.remove_repeats(docs([(k, t, "s") for k, t in rows])).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 35)


def test_empty_table(spark, docs):
    out = phrases.remove_repeats(docs([]))
    assert out.collect() == [] and out.columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]


def test_sql_twin(spark, docs):
    import duckdb
    rows = [(i, t, "s") for i, t in corpus(21)] + [(900, None, "s"), (901, "", "s"), (905, "Ünïcode 日本 " * 20, "s"), (906, "Ünïcode 日本 " * 20, "s")]
    got = phrases.remove_repeats(docs(rows), window=8, anchor=3, texts=False).collect()
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", rows)
    assert sorted(map(tuple, got)) == sorted(con.sql(phrases.oracle(8)).fetchall())
