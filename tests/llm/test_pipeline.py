"""The pipeline's stages, each against a brute-force version on its own input."""

import collections
import zlib

import pyarrow as pa
import pytest

import corpus_pipeline as P
from dialsieve.llm import decontaminate, mixing, quality
from dialsieve.llm.common import prepare, table

from .test_decontaminate import folded, nearest
from .test_idfiles import direct
from .test_minhash import brute as groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output rows of every stage, written and read as ``run`` does."""
    prepare(spark)
    docs, out = table(spark, SF, "documents").cache(), []
    for name, stage in P.STAGES:
        after = stage(spark, docs, SF).cache()
        out.append((name, docs.collect(), after.collect(), docs.columns == after.columns))
        docs = after
    return out


def test_order_and_columns(stages):
    assert [n for n, *_ in stages] == ["quality classifier", "MinHash near-dedup", "benchmark decontamination",
                                       "mixing sources to target weights", "token-ID / binary output"]
    assert [same for *_, same in stages] == [True, True, True, True, False]
    assert all(len(after) for _, _, after, _ in stages)


def test_quality_stage(spark, stages):
    _, before, after, _ = stages[0]
    model = quality.fit(table(spark, SF, "documents"), table(spark, SF, "labels"), train=f"not ({P.HELD_OUT})")
    score = dict(zip((r.doc_id for r in before), model.scores(pa.array([r.text for r in before], pa.string())), strict=True))
    assert sorted(map(tuple, after)) == sorted(tuple(r) for r in before if score[r.doc_id] >= quality.THRESHOLD)
    label = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    held = [r.doc_id for r in before if r.doc_id in label and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum((score[k] >= quality.THRESHOLD) == label[k] for k in held) >= 0.95 * len(held) > 0


def test_near_copies_stage(stages):
    _, before, after, _ = stages[1]
    kept = {k for k, _, _, keep in groups([(r.doc_id, r.text) for r in before]) if keep}
    assert sorted(map(tuple, after)) == sorted(tuple(r) for r in before if r.doc_id in kept)


def test_decontamination_stage(spark, stages):
    _, before, after, _ = stages[2]
    items = [folded(r.text) for r in table(spark, SF, "benchmark").collect()]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    exact = {r.doc_id for r in before if any(x in folded(r.text) for x in items)}
    assert exact and exact <= gone
    for r in before:                       # the full search on what went and on every tenth other
        if r.doc_id in gone or r.doc_id % 10 == 0:
            t = folded(r.text)
            assert any(nearest(x, t) <= int(len(x) * decontaminate.EDIT_RATE) for x in items) == (r.doc_id in gone)


def test_mixing_stage(spark, stages):
    _, before, after, _ = stages[3]
    copies = {r.id: r.copies for r in mixing.plan(spark.createDataFrame(before)).collect()}
    want = collections.Counter({tuple(r): copies[r.doc_id] for r in before})
    assert collections.Counter(map(tuple, after)) == +want


def test_token_stage(stages):
    _, before, after, _ = stages[4]
    at, rows = 0, sorted(before, key=lambda r: r.doc_id)
    for r, got, ids in zip(rows, sorted(after, key=lambda r: r.start), direct([r.text for r in rows]), strict=True):
        assert tuple(got) == (r.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_run_returns_the_last_stage(spark, stages):
    assert sorted(map(tuple, P.run(spark, SF).collect())) == sorted(map(tuple, stages[-1][2]))
