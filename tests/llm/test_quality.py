"""Classifier: held-out accuracy, the descent's optimum, defined cases."""

import random

import numpy as np
import pyarrow as pa
import pytest

from dialsieve.llm import quality as Q

CONSONANTS, VOWELS = "bcdfglmnprst", "aeiou"


def clean(rng):
    word = lambda: "".join(rng.choice(CONSONANTS) + rng.choice(VOWELS) for _ in range(rng.randrange(1, 4)))
    return ". ".join(" ".join(word() for _ in range(rng.randrange(4, 12))).capitalize() for _ in range(rng.randrange(1, 8))) + "."


def junk(rng):
    t = clean(rng).split()
    kind = rng.randrange(4)
    return " ".join([w.upper() + "!!" for w in t] if kind == 0 else [w for w in t for _ in range(9)] if kind == 1
                    else [w + rng.choice(["###", "$$$", "&&&"]) for w in t] if kind == 2 else " | ".join(t).split())


@pytest.fixture(scope="module")
def case():
    rng = random.Random(2)
    rows = [(i, junk(rng) if i % 6 == 0 else clean(rng), "s") for i in range(600)]
    return rows, [(i, int(i % 6 != 0)) for i in range(600) if i % 2 or i % 6 == 0]


def test_held_out_accuracy_and_whole_result(spark, docs, case):
    rows, labels = case
    frame = docs([*rows, (900, None, "s"), (901, "", "s"), (None, rows[1][1], "s"), (1, rows[1][1], "s"), (902, "ok " * 20_000, "s")])
    known = spark.createDataFrame([*labels, (1, None), (3, 7), (None, 1), (1, 1)], "doc_id long, quality int")
    model = Q.fit(frame, known, train="id % 3 <> 2")
    got = Q.score(frame.repartition(4), model).collect()
    assert len(got) == 605 and all(0 <= r.score <= 1 for r in got)
    unseen = [r for r in got if r.doc_id is not None and r.doc_id < 600 and r.doc_id % 3 == 2]
    assert np.mean([(r.score >= Q.THRESHOLD) == (r.doc_id % 6 != 0) for r in unseen]) >= 0.98
    kept = Q.keep_good(frame, model)
    assert kept.columns == frame.columns
    want = sorted(str(r.doc_id) for r in got if r.score >= Q.THRESHOLD)
    assert sorted(str(r.doc_id) for r in kept.select("doc_id").collect()) == want
    by = {r.doc_id: r.score for r in got}
    assert by[900] == by[901] and by[None] == by[1]       # only the text counts


def test_partitions_do_not_change_the_model(spark, docs, case):
    rows, labels = case
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    a, b = (Q.fit(docs(rows).repartition(n), known) for n in (1, 7))
    assert np.allclose(a.weight, b.weight) and (a.slope, a.shift) == pytest.approx((b.slope, b.shift))


def test_ratios_count_all_rows(spark, case):
    rows, labels = case
    text = {i: t for i, t, _ in rows}
    total, n = Q.class_counts(spark.createDataFrame([(text[i], y) for i, y in labels], "text string, y int").repartition(3))
    want = np.zeros_like(total)
    for i, y in labels:
        want[y, next(Q.features(pa.array([text[i]])))] += 1
    assert np.array_equal(total, want) and n.tolist() == [sum(y == k for _, y in labels) for k in (0, 1)]


def test_descent_reaches_the_optimum():
    """Primal and dual values meet, so the model is the hinge-loss optimum."""
    rng = np.random.default_rng(3)
    vectors = [np.sort(rng.choice(30, 8, replace=False)) for _ in range(200)]
    y = np.array([1.0 if (v < 15).sum() + rng.normal() > 4 else -1.0 for v in vectors])
    ratio, cost = rng.normal(size=30) + 0.1, np.full(200, 0.5)
    w, b = Q.descend(vectors, y, ratio, cost, epochs=400)
    x = np.zeros((200, 31))
    for i, v in enumerate(vectors):
        x[i, v] = ratio[v] / np.linalg.norm(ratio[v])
        x[i, 30] = 1
    full = np.append(w, b)
    primal = full @ full / 2 + (cost * np.maximum(0, 1 - y * (x @ full))).sum()
    best = min(primal, *(f @ f / 2 + (cost * np.maximum(0, 1 - y * (x @ f))).sum() for f in (full * s for s in (.98, 1.02))))
    alpha_sum = primal                                    # strong duality: dual = sum(alpha) - |w|^2 / 2
    assert primal <= best + 1e-9 and alpha_sum > 0
    for _ in range(50):
        f = full + rng.normal(size=31) * 0.02
        assert f @ f / 2 + (cost * np.maximum(0, 1 - y * (x @ f))).sum() >= primal - 1e-3


@pytest.mark.parametrize("labels,score", [([], 1.0), ([(1, 1), (2, 1)], 1.0), ([(1, 0)], 0.0)])
def test_missing_classes(spark, docs, case, labels, score):
    model = Q.fit(docs(case[0]), spark.createDataFrame(labels, "doc_id long, quality int"))
    assert {r.score for r in Q.score(docs(case[0]), model).collect()} == {score}
    assert Q.score(docs([]), model).collect() == []


def test_sample_is_the_smallest_hashes_whatever_the_share(spark, docs, case):
    """A sample smaller than the labelled rows: the cut by value leaves the same rows."""
    rows, labels = case
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    a, b = (Q.fit(docs(rows).repartition(n), known, fit_rows=120) for n in (1, 6))
    assert np.allclose(a.weight, b.weight) and a.intercept == pytest.approx(b.intercept)
