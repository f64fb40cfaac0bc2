"""Quality classifier: naive Bayes support vectors (log-count ratios, then a linear SVM).

A text's features are indicators of two kinds of n-grams, hashed into ``BUCKETS``:
byte n-grams (1 to 3) and n-grams (1 to 3) of word shapes - how a word begins, how
it ends, whether it holds lower case letters, whether it repeats the word before.
Every indicator is scaled by the class log-count ratio of its bucket; a text's vector
has length 1.  A hinge-loss linear model
is fitted on the scaled vectors by dual coordinate descent, and a logistic curve
fitted on labelled rows that the descent did not see turns margins into scores.

The model is fitted on a bounded sample: the ratios on at most ``SAMPLE_ROWS`` labelled
rows (those with the smallest hash of the id), the descent and the curve on ``FIT_ROWS``
of them.  The sample's ids are broadcast, so no text is shuffled for training.  Scoring
reads every whole text, in the task that holds it; the model is a few hundred kB.

Defined cases: null and empty texts have no features and get the score of margin =
intercept; rows without a label, or with a label other than 0 and 1, do not train;
a document labelled twice trains once per label row; with no labelled rows of one
class every score is 1.0 (0.0 when only class 0 is known), with no labels 1.0.
Only the text is ever an input of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: Hash buckets of byte n-grams; as many again hold the word-shape n-grams.
BUCKETS = 1 << 15
#: Labelled rows that class counts are taken of: the bound of the training sample.
SAMPLE_ROWS = 20_000
#: Of these, rows used for coordinate descent (four fifths) and the logistic curve (one fifth).
FIT_ROWS = 5_000
EPOCHS, COST, SMOOTH = 12, 1.0, 1.0
THRESHOLD = 0.7

_KIND = np.zeros(256, np.int64)          # 0 other sign, 1 upper case, 2 lower case or beyond ASCII, 3 digit, 4 . , ; : ? '
_KIND[65:91] = 1
_KIND[97:123] = 2
_KIND[128:] = 2
_KIND[48:58] = 3
_KIND[[0x2E, 0x2C, 0x3B, 0x3A, 0x3F, 0x27]] = 4


def features(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted buckets of each text."""
    buf, offsets = C.flat_bytes(texts)
    starts, ends, rows = C.words(buf, offsets)
    one = buf.astype(np.uint32)
    grams = [one]
    if len(buf) > 2:
        two = one[:-1] * np.uint32(256) + one[1:] + np.uint32(1 << 24)
        grams += [two, two[:-1] * np.uint32(256) + one[2:]]
    codes = [(g * np.uint32(2654435761)) >> np.uint32(32 - 15) for g in grams]
    shapes: list[np.ndarray] = []
    if len(starts):
        value = C.spans_hash(buf, starts, ends)
        lower = np.concatenate([[0], np.cumsum(_KIND[buf] == 2)])
        again = np.zeros(len(starts), np.int64)
        again[1:] = (value[1:] == value[:-1]) & (rows[1:] == rows[:-1])
        s = ((_KIND[buf[starts]] * 5 + _KIND[buf[ends - 1]]) * 2 + (lower[ends] > lower[starts])) * 2 + again
        shapes = [s, s[:-1] * 100 + s[1:] + 1000, (s[:-2] * 100 + s[1:-1]) * 100 + s[2:] + 100_000]
        shapes = [((x.astype(np.uint32) * np.uint32(2246822519)) >> np.uint32(32 - 15)) + np.uint32(BUCKETS) for x in shapes]
    per = np.searchsorted(rows, np.arange(len(offsets)))
    flag = np.zeros(2 * BUCKETS, bool)
    for d in range(len(offsets) - 1):
        for n, c in enumerate(codes):
            flag[c[offsets[d]:max(offsets[d], offsets[d + 1] - n)]] = True
        for n, c in enumerate(shapes):
            flag[c[per[d]:max(per[d], per[d + 1] - n)]] = True
        at = np.flatnonzero(flag)
        flag[at] = False
        yield at.astype(np.int32)


@dataclass
class Model:
    """Scaled weights per bucket, squared ratios per bucket, intercept, logistic curve."""

    weight: np.ndarray
    square: np.ndarray
    intercept: float
    slope: float
    shift: float
    constant: float | None = None

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        margin = np.array([self.weight[at].sum() / max(1e-9, self.square[at].sum()) ** 0.5 for at in features(texts)]
                          or np.zeros(0)) + self.intercept
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def class_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """((2, buckets) documents of each class that have the bucket, documents per class)
    over labelled rows (text, y): summed per task, then per bucket by Spark."""

    def count(batches):
        total, n = np.zeros((2, 2 * BUCKETS), np.int64), np.zeros(2, np.int64)
        for b in batches:
            for s in C.text_slices(b):
                y = s.column(1).to_pylist()
                for label, at in zip(y, features(s.column(0)), strict=True):
                    total[label, at] += 1
                    n[label] += 1
        k, at = np.nonzero(total)
        yield pa.record_batch([pa.array(np.concatenate([k, [0, 1]]), pa.int32()), pa.array(np.concatenate([at, [-1, -1]]), pa.int32()),
                               pa.array(np.concatenate([total[k, at], n]), pa.int64())], ["y", "bucket", "n"])

    found = (rows.mapInArrow(count, "y int, bucket int, n long").groupBy("y", "bucket").agg(F.sum("n").alias("n")))
    total, n = np.zeros((2, 2 * BUCKETS)), np.zeros(2)
    for r in C.bounded_rows(found, 4 * BUCKETS + 2, "class counts"):
        if r["bucket"] < 0:
            n[r["y"]] = r["n"]
        else:
            total[r["y"], r["bucket"]] = r["n"]
    return total, n


def log_ratios(total: np.ndarray) -> np.ndarray:
    p, q = total[1] + SMOOTH, total[0] + SMOOTH
    return np.log((p / p.sum()) / (q / q.sum()))


def descend(vectors: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: np.ndarray,
            epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L1 hinge loss; the intercept is a constant feature of 1."""
    scaled = [(ratio[at] / max(1e-9, float((ratio[at] ** 2).sum()) ** 0.5)).astype(np.float32) for at in vectors]
    w, b, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(y))
    norm = np.array([float((x ** 2).sum()) + 1.0 for x in scaled])
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            at, x = vectors[i], scaled[i]
            slack = y[i] * (float(w[at] @ x) + b) - 1
            new = min(max(alpha[i] - slack / norm[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[at] += step * x
                b += step
    return w, b


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton fit of slope and shift with targets smoothed by the class counts."""
    pos, neg = int((y > 0).sum()), int((y < 0).sum())
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + c, -30, 30)))
        g, h = p - t, p * (1 - p) + 1e-6
        grad = np.array([(g * margin).sum() + 1e-3 * a, g.sum()])
        hess = np.array([[(h * margin ** 2).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum()]])
        step = np.linalg.solve(hess, grad)
        a, c = a - step[0], c - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(a), float(c)


def _smallest(rows: DataFrame, key: str, ties: list[str], count: int) -> DataFrame:
    """The ``count`` rows of smallest 64-bit hash ``key``.  They are cut off by value first,
    so that few more rows than needed are ordered and meet in one task."""
    share = min(1.0, 1.3 * count / max(1, rows.count()))
    some = rows if share == 1.0 else rows.where(F.col(key) <= int(-(1 << 63) + share * ((1 << 64) - 1)))
    return some.orderBy(key, *ties).limit(count)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        train: str | None = None, fit_rows: int = FIT_ROWS, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Train on the labelled documents whose id passes the SQL condition ``train`` (over column ``id``)."""
    C.prepare(docs.sparkSession)
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)"))
    if train:
        known = known.where(train)
    known = _smallest(known.where("id is not null").withColumn("k", F.xxhash64("id")), "k", ["id", "y"], sample_rows)
    rows = C.save(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
                  .join(F.broadcast(known.select("id", "y")), "id").select("text", "y", F.xxhash64("id", "text", "y").alias("h")))
    total, n = class_counts(rows.select("text", "y"))
    if not n.all():
        return Model(np.zeros(0), np.zeros(0), 0, 0, 0, constant=0.0 if n[0] else 1.0)
    ratio = log_ratios(total)

    def train_one(pdf):
        """The bounded sample, in one task: descent on four fifths, curve on the rest."""
        import pandas as pd
        pdf = pdf.sort_values("h", kind="stable")
        texts = pa.record_batch([pa.array(pdf["text"], pa.string())], ["text"])
        vectors = [at for s in C.text_slices(texts) for at in features(s.column(0))]
        y = np.where(pdf["y"] == 1, 1.0, -1.0)
        fold = np.zeros(len(y), bool)
        for side in (1.0, -1.0):
            fold[np.flatnonzero(y == side)[4::5]] = True
        use = np.flatnonzero(~fold)
        share = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
        w, b = descend([vectors[i] for i in use], y[use], ratio, COST * share[use])
        margin = np.array([float(w[at] @ ratio[at]) / max(1e-9, float((ratio[at] ** 2).sum()) ** 0.5) for at in vectors]) + b
        test = fold if (y[fold] > 0).any() and (y[fold] < 0).any() else np.ones(len(y), bool)
        a, c = logistic(margin[test], y[test])
        return pd.DataFrame({"w": [(w * ratio).astype(np.float64).tobytes()], "b": [b], "a": [a], "c": [c]})

    got = (_smallest(rows, "h", ["text", "y"], fit_rows).groupBy(F.lit(0).alias("k"))
           .applyInPandas(train_one, "w binary, b double, a double, c double").first())
    if got is None:
        return Model(np.zeros(0), np.zeros(0), 0, 0, 0, constant=1.0)
    return Model(np.frombuffer(got["w"]), ratio ** 2, got["b"], got["a"], got["c"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1, higher: class 1 likelier) of every document."""
    C.prepare(docs.sparkSession)

    def run(batches):
        for b in batches:
            for s in C.text_slices(b, "text"):
                yield pa.record_batch([s.column(0), pa.array(model.scores(s.column(1)))], [id_col, "score"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents (all columns) that score at least ``threshold``."""
    C.prepare(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            for s in C.text_slices(b, text_col):
                yield s.filter(pa.array(model.scores(s.column(at)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
