"""Words, spans and n-grams against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa

from dialsieve.llm import common as C

SIGNS = ["a", "B", "é", "日", "🙂", " ", "  ", "\t", "\n", "\x0b", "\r", "\xa0", "\x1c", "\x00"]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(40))) for _ in range(n)] + ["", None, " ", "x"]


def test_words_match_the_pattern():
    rows = texts(300, 1)
    buf, off = C.flat_bytes(pa.array(rows, pa.string()))
    s, e, r = C.words(buf, off)
    got = [[] for _ in rows]
    for a, b, i in zip(s, e, r, strict=True):
        got[i].append(buf[a:b].tobytes().decode())
    assert got == [re.findall(C.WORD_RE, t or "") for t in rows]


def test_equal_spans_and_grams_have_equal_values(monkeypatch):
    monkeypatch.setattr(C, "SLICE_BYTES", 16)            # values do not depend on the blocks
    rows = texts(200, 2)
    buf, off = C.flat_bytes(pa.array(rows, pa.string()))
    s, e, r = C.words(buf, off)
    v = C.spans_hash(buf, s, e)
    by = {}
    for a, b, x in zip(s, e, v, strict=True):
        by.setdefault(buf[a:b].tobytes(), set()).add(int(x))
    assert all(len(x) == 1 for x in by.values()) and len(set().union(*by.values())) == len(by)
    names = [buf[a:b].tobytes() for a, b in zip(s, e, strict=True)]
    g, of = C.grams(v, 3), {}
    for i, x in enumerate(g):
        of.setdefault(tuple(names[i:i + 3]), set()).add(int(x))
    assert all(len(x) == 1 for x in of.values()) and len(set().union(*of.values())) == len(of)


def test_text_slices_cover_a_batch():
    rows = texts(50, 3) + ["z" * 5000]
    b = pa.record_batch([pa.array(range(len(rows))), pa.array(rows, pa.string())], ["id", "text"])
    parts = list(C.text_slices(b, "text", 100))
    assert pa.Table.from_batches(parts).to_pylist() == b.to_pylist()
    assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column(1).to_pylist()) <= 100 for p in parts)
    assert list(C.text_slices(b.slice(0, 0), "text")) == []
    assert np.array_equal(C.flat_bytes(pa.array([], pa.string()))[1], [0])
