"""Fingerprints, the edited digest and the similarity join against plain Python."""

import hashlib
import itertools
import random

import pytest

from dialsieve.llm import spotsigs as S

ROWS = [(3, "The cat sat on the mat and a dog of the house was there", "s"), (1, "", "s"), (2, None, "s"),
        (10, "ÜBER die Straße 🙂 und der Hund", "s"), (7, "no", "s"), (None, "null id first, the others next", "s"),
        (5, "!!! ??", "s"), (20, "the " * 4000 + "end", "s")]


def test_chains():
    words = "the big cat is on a red mat near it".split()
    content = ["big", "cat", "red", "mat", "near"]
    spots = [("the", 0), ("is", 2), ("on", 2), ("a", 2)]      # nothing follows the last anchor
    from zlib import crc32
    want = sorted({crc32(f"{a} {' '.join(content[i:i + 6:2])}".encode()) for a, i in spots})
    assert S.signature(" ".join(words)).tolist() == want
    assert len(S.signature("x y z")) and not len(S.signature("...")) and not len(S.signature(None))
    assert S.likeness(S.signature(""), S.signature("?")) == 1.0 and S.likeness(S.signature(""), S.signature("a")) == 0.0


@pytest.mark.parametrize("n_words", [30, 60, 1200])
@pytest.mark.parametrize("commons", [0, 1, 2, 3])
def test_few_anchors_degrade_gradually(spark, docs, commons, n_words):
    """Half of a text is enough for a likeness, whatever common words the other half or the next text has."""
    rng = random.Random(n_words)
    text = lambda: [f"w{rng.randrange(10**6)}" for _ in range(n_words)]
    first, after = text(), text()
    for at, w in zip((n_words - 2, n_words // 3, n_words * 2 // 3), ("the", "und", "la"), strict=True):
        if commons:
            first[at], commons = w, commons - 1
    after[3] = "of"                       # only the edited text has this anchor
    rows = [(1, " ".join(first), "s"), (2, " ".join(after), "s")]
    got = {r.doc_id: r for r in S.edited_digest(docs(rows)).collect()}
    assert len(S.signature(rows[0][1])) >= n_words // S.WINDOW
    assert got[1].near_edited >= (0.2 if n_words >= 60 else 0.05) and got[2].near_edited > 0
    one = rows[0][1].split()
    one[n_words // 2] = "mit"             # a single word becomes an anchor: only its surroundings change
    assert S.likeness(S.signature(rows[0][1]), S.signature(" ".join(one))) >= (0.9 if n_words >= 1200 else 0.3 if n_words >= 60 else 0.05)


def test_common_words_only(spark, docs):
    rng = random.Random(2)
    text = " ".join(rng.choice(["the", "of", "und", "la", "que", "to"]) for _ in range(200))
    a, b = S.signature(text), S.signature(text + " house")
    assert len(a) >= 200 // S.WINDOW // 2 and S.likeness(a, b) >= 0.6


@pytest.mark.parametrize("range_bytes", [8, 60, 1 << 20])
def test_edited_digest(spark, docs, range_bytes):
    rng = random.Random(range_bytes)
    rows = ROWS + [(100 + i, " ".join(rng.choice("the of cat dog und der x y z".split()) for _ in range(rng.randrange(40))), "s") for i in range(60)]
    got = {r.doc_id: r for r in S.edited_digest(docs(rows).repartition(4), range_bytes=range_bytes).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(rows)
    for i, (k, t, _) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        edited = t[:len(t) - len(t) // 2] + after[:len(t) // 2]
        r, f = got[k], S.signature
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (S.as_text(f(t)), S.as_text(f(edited)))
        assert (r.near_edited, r.near_next) == (S.likeness(f(t), f(edited)), S.likeness(f(t), f(after)))


def test_repeated_ids_follow_by_text_and_single_document(spark, docs):
    got = S.edited_digest(docs([(1, "aa bb", "s"), (1, "aa bb", "s"), (2, "cc", "s")]), range_bytes=2).collect()
    assert sorted((r.doc_id, r.near_next) for r in got) == [(1, 0.0), (1, 1.0), (2, 0.0)]
    one, = S.edited_digest(docs([(4, "the lone text", "s")])).collect()
    assert one.near_next == 1.0
    assert S.edited_digest(docs([])).collect() == []


def test_near_pairs_match_all_pairs(spark, docs):
    rng = random.Random(9)
    common, rare = ["the", "of", "und", "la"], [f"w{i}" for i in range(60)]
    bases = [[rng.choice(common if i % 3 == 0 else rare) for i in range(rng.randrange(6, 120))] for _ in range(12)]
    rows = []
    for i in range(150):
        w = list(rng.choice(bases))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice(rare)
        rows.append((i, " ".join(w), "s"))
    rows += [(500, "", "s"), (501, None, "s"), (None, rows[0][1], "s")]
    for threshold in (0.6, 0.8, 1.0):
        pairs, member = S.near_pairs(S.fingerprints(docs(rows)), threshold=threshold)
        sig = {k: tuple(S.signature(t).tolist()) for k, t, _ in rows if k is not None}
        rep = {s: min(k for k in sig if sig[k] == s) for s in set(sig.values())}
        assert {r.doc_id: r.class_id for r in member.collect()} == {k: rep[s] for k, s in sig.items()}
        want = {}
        for a, b in itertools.combinations(sorted(rep.values()), 2):
            x, y = set(sig[a]), set(sig[b])
            if x and y and len(x & y) / len(x | y) >= threshold:
                want[a, b] = len(x & y) / len(x | y)
        assert {(r.a, r.b): r.jaccard for r in pairs.collect()} == pytest.approx(want)
