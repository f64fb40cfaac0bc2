"""Targets, tilts and copies against plain Python."""

import collections
import math
import random
import re

import pytest

from dialsieve.llm import mixing as M
from dialsieve.llm.common import WORD_RE


def sized(rows):
    return [(k, len(re.findall(WORD_RE, t or "")), s) for k, t, s in rows]


def water_fill(sizes, weights=M.WEIGHTS, rate=M.MAX_RATE):
    total = sum(sizes.values())
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), total
    while free:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > rate * sizes[s]}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        for s in over:
            target[s] = rate * sizes[s]
            rest -= target[s]
        free -= over
    return target


def corpus(seed, sources, n=300):
    rng = random.Random(seed)
    return [(i, rng.choice([" ", "\n", "\t "]).join("w" for _ in range(int(rng.paretovariate(1.2) * 5) % 400)), rng.choice(sources)) for i in range(n)]


CASES = [corpus(1, ["b", "a", "é", "Z", None]), corpus(2, ["big"] * 30 + ["x", "y"]), corpus(3, ["only"]),
         corpus(4, ["p"] * 200 + ["q", "r", "s"], 400) + [(900, None, "q"), (901, "", "empty"), (902, " ", None), (None, "a b", "p"), (903, "w " * 5000, "r")]]


@pytest.mark.parametrize("rows", CASES)
def test_targets_rates_and_copies(spark, docs, rows):
    got = M.plan(docs(rows).repartition(4)).collect()
    size = collections.Counter()
    for _, n, s in sized(rows):
        size[s] += n
    target = water_fill({s: size[s] for s in {r[2] for r in rows}})
    assert sorted(((r.id, r.size, r.source) for r in got), key=str) == sorted(sized(rows), key=str)
    taken = collections.Counter()
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source], rel=1e-9)
        assert r.copies in (math.floor(r.rate), math.ceil(r.rate)) and r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source] += r.taken
    for s in target:
        own = [r for r in got if r.source == s]
        assert sum(r.rate * r.size for r in own) == pytest.approx(target[s], rel=1e-6)
        slope = {round(math.log(r.rate) / r.size, 9) for r in own if r.size and 0 < r.rate < M.MAX_RATE}
        assert len(slope) <= 1                             # exponentially tilted below the limit
        assert abs(taken[s] - target[s]) <= max(r.size for r in own) / 2 + 1e-6
    again = M.plan(docs(rows).repartition(2)).collect()
    assert sorted((tuple(r) for r in again), key=str) == sorted((tuple(r) for r in got), key=str)


def test_small_chunks_keep_near_the_target(spark, docs, monkeypatch):
    monkeypatch.setattr(M, "CHUNK", 25)
    rows = [(k, "w " * (1 + k % 9), s) for k, _, s in corpus(6, ["a"] * 5 + ["b"], 600)]
    got = M.plan(docs(rows)).collect()
    for s in "ab":
        own = [r for r in got if r.source == s]
        assert sum(r.taken for r in own) == pytest.approx(own[0].target, rel=0.01)


def test_mix_repeats_documents(spark, docs):
    rows = [*CASES[3], (7, CASES[3][7][1], CASES[3][7][2])]
    frame = docs(rows)
    out = M.mix(frame)
    assert out.columns == frame.columns
    want = collections.Counter()
    for r in M.plan(frame).collect():
        want[r.id] += r.copies
    assert collections.Counter(r.doc_id for r in out.select("doc_id").collect()) == +want


def test_empty_table(spark, docs):
    assert M.plan(docs([])).collect() == [] and M.mix(docs([])).collect() == []


def test_word_count(spark):
    texts = ["a b\t c\x0bd ", "", None, " \n", "x", "a\xa0b c", "\x1c y", "日 本", "\r\n z"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(M.word_count("text")).collect()] == [len(re.findall(WORD_RE, t or "")) for t in texts]
