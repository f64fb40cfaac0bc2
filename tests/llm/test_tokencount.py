"""Counts against the tokenizers library's unigram model."""

import random

import pytest
from tokenizers import Tokenizer, models

from dialsieve.llm import tokencount as K
from dialsieve.llm.queries import tokenizer_file


def library(pieces, fallback):
    vocabulary = [("<unk>", min(s for _, s in pieces))] + pieces + [(f"<0x{i:02X}>", 0.0) for i in range(256)]
    m = Tokenizer(models.Unigram(vocabulary, 0, byte_fallback=fallback))
    return lambda t: len(m.encode("▁" + t.replace(" ", "▁"), add_special_tokens=False).ids) if t else 0


def texts(n, signs, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("fallback", [True, False])
def test_public_vocabulary(fallback):
    pieces, has = K.vocabulary(tokenizer_file("piece_bpe_32k.model"))
    assert has
    counter, want = K.Counter(pieces, fallback), library(pieces, fallback)
    assert counter.by_word
    for t in texts(600, " ab cé日🙂▁\n\tthe  ing", 3) + ["the cat " * 300, "x" * 500, " " * 70, "🙂" * 9]:
        assert counter.count(t)[1] == want(t)


@pytest.mark.parametrize("crossing", [False, True])
def test_ties_follow_the_tokenizer(crossing):
    rng = random.Random(5)
    for _ in range(60):
        # many equal sums; with ``crossing``, pieces that words cannot be cut at
        pieces = {"▁": -2.0, "a": -2.0, "b": -3.0}
        while len(pieces) < 14:
            p = "".join(rng.choice("ab▁" if crossing else "abc") for _ in range(rng.randrange(1, 6)))
            pieces[p if crossing or rng.random() < .6 else "▁" + p] = -float(rng.randrange(1, 5))
        if crossing:
            pieces["a▁b"] = -1.0
        counter, want = K.Counter(list(pieces.items()), False), library(list(pieces.items()), False)
        assert counter.by_word != crossing
        for t in texts(40, "aabbc  ", rng.random()):
            assert counter.count(t)[1] == want(t) and counter.path("▁" + t.replace(" ", "▁"))[1] == (want(t) if t else 1)


def test_query_rows(spark, docs, monkeypatch):
    pieces, fallback = K.vocabulary(tokenizer_file("piece_bpe_32k.model"))
    want = library(pieces, fallback)
    rows = [(1, "the cat\nsat", "s"), (2, None, "s"), (3, "", "s"), (None, "no id 日", "s"), (1, "the cat\nsat", "s"), (4, "ab" * 9000, "s")]
    got = K.count_tokens(docs(rows), pieces, fallback).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.n_tokens) for r in got) == sorted((str(k), len(t or ""), want(t or "")) for k, t, _ in rows)
    assert K.count_tokens(docs([]), pieces, fallback).collect() == []
    monkeypatch.setattr(K, "MAX_PIECES", 3)
    with pytest.raises(ValueError, match="more than 3 pieces"):
        K.count_tokens(docs(rows), pieces, fallback)
