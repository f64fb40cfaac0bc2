"""Token files: an exact round trip, and the tokenizers library on whole texts."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from dialsieve.llm import idfiles as I
from dialsieve.llm.common import shared_folder
from dialsieve.llm.queries import tokenizer_file

BPE = "byte_bpe_50k.json"
PIECES = ["a", "b'", "'s", "é", "ß", "²", "½", "1", "23", ".", ",", "!!", " ", "  ", "\n", "\t", "\xa0", " ", "\x1c", "\x85",
          "<|endoftext|>", "Ω", "日", "🙂", "_", "-", "don't ", "\r\n", "​", "A", "Word", "word, ", "\x00"]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(40))) for _ in range(n)]


def direct(rows):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_file(BPE))
    t.encode_special_tokens = True
    return [np.array([*e.ids, 0], "<u4") for e in t.encode_batch([r or "" for r in rows], add_special_tokens=False)]


def test_pieces_give_the_ids_of_whole_texts(monkeypatch):
    monkeypatch.setattr(I, "MEMORY_PIECES", 200)
    monkeypatch.setattr(I, "TABLE_PIECES", 900)
    rows = [*texts(2000, 1), "", None, "x" * 30_000, "ab " * 20_000]
    tokens = I.Tokens(tokenizer_file(BPE), 0)
    got = [x for a in range(0, len(rows), 50) for x in tokens.ids(rows[a:a + 50])]
    assert all(a == b.tobytes() for a, b in zip(got, direct(rows), strict=True))


def test_pieces_are_cut_as_the_pattern_cuts():
    tokens = I.Tokens(tokenizer_file(BPE), None)
    white = ["a", "é", "日b", " ", "  ", "\n", "\t", "\xa0", "\x85", "\u1680", "\u2003", "\u2028", "\u202f", "\u205f", "\u3000", "\u200b", "\x1c"]
    rng = random.Random(8)
    rows = ["".join(rng.choice(white) for _ in range(rng.randrange(12))) for _ in range(3000)] + ["", " ", "\n\n", " a", "a ", "\u3000"]
    from dialsieve.llm.common import flat_bytes
    buf, offsets = flat_bytes(pa.array(rows))
    got = [[] for _ in rows]
    for a, b, r in zip(*I.cut_pieces(buf, offsets), strict=True):
        got[r].append(buf[a:b].tobytes().decode())
    assert got == [tokens.cut(t) for t in rows]


def test_a_clash_of_values_is_seen(monkeypatch):
    rows = [*texts(60, 5), "one two three", "two", ""]
    monkeypatch.setattr(I.C, "spans_hash", lambda buf, a, b: ((b - a) % 3).astype(np.uint64))
    got = I.Tokens(tokenizer_file(BPE), 0).ids(rows)
    assert all(a == b.tobytes() for a, b in zip(got, direct(rows), strict=True))


@pytest.mark.parametrize("top", [1, 3, 255, 256, 70_000, 20_000_000])
def test_block_round_trip(top):
    rng = np.random.default_rng(top)
    ids = (rng.integers(0, top, 5003) if top < 10**6 else np.concatenate([np.arange(70_000), [top]])).astype(np.uint32)
    counts = np.array([0, 1, 2, len(ids) - 3], np.uint32)
    keys = pa.array([None, 5, 5, 7], pa.int64())
    raw = I.encode_block(ids, counts, keys)
    (back, n, k), = I.decode_blocks(raw)
    assert np.array_equal(back, ids) and np.array_equal(n, counts) and k.equals(keys)
    assert [len(x[0]) for x in I.decode_blocks(raw + raw)] == [len(ids)] * 2
    assert len(list(I.decode_blocks(I.encode_block(ids[:0], counts[:0], keys[:0])))) == 1


def test_table_lookup_matches_a_plain_reader():
    ids = np.array([9, 9, 9, 400, 9, 70_000, 400, 1], np.uint32)
    raw = I.encode_block(ids, np.array([8], np.uint32), pa.array([1]))
    import json
    size = int.from_bytes(raw[4:8], "little")
    h, at = json.loads(raw[8:8 + size]), 8 + size
    ranks = np.frombuffer(raw, "<u4", h["ranks"], at)
    assert ranks.tolist() == [9, 400, 1, 70_000]         # frequent first, ties by id
    at += 4 * h["ranks"]
    control, data, out = raw[at:at + h["control"]], raw[at + h["control"]:], []
    for i in range(h["ids"]):
        n = (control[i // 4] >> (i % 4 * 2) & 3) + 1
        out.append(int(ranks[int.from_bytes(data[:n], "little")]))
        data = data[n:]
    assert out == ids.tolist()


def test_files_in_key_order(spark, docs, monkeypatch):
    monkeypatch.setattr(I, "RANGE_BYTES", 3000)
    rows = [(i * 7 % 200, t, "s") for i, t in enumerate(texts(200, 3))] + [(300, None, "s"), (301, "", "s"), (301, "", "s"), (None, "no id", "s")]
    frame = docs(rows).repartition(6)
    folder = shared_folder(spark, "test-ids")
    manifest = I.write_files(frame, folder, tokenizer_file(BPE))
    assert manifest.count() > 1
    got = sorted(I.read_files(spark, folder, manifest).collect(), key=lambda r: (r.start, r.n_tokens))
    at, key = 0, lambda r: (r[0] is not None, r[0] or 0)
    ordered = sorted(rows, key=key)
    for r, (k, _, _), ids in zip(got, ordered, direct([t for _, t, _ in ordered]), strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (k, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    back = {r.start: r.ids for r in I.read_files(spark, folder, manifest, digest=False).collect()}
    assert back[got[5].start] == direct([ordered[5][1]])[0].tolist()


def test_empty_table(spark, docs):
    folder = shared_folder(spark, "test-ids")
    manifest = I.write_files(docs([]), folder, tokenizer_file(BPE))
    assert manifest.count() == 0 and I.read_files(spark, folder, manifest).collect() == []


def test_new_words_are_cut_with_numpy(monkeypatch):
    """Words are not spelled one by one, and every kind of piece has the library's ids."""
    import os
    import random
    import re

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer
    path = os.fspath(public_tokenizers.path("byte_bpe_50k.json"))
    tokens, rng, spelled = I.Tokens(path, 0), random.Random(3), set()
    learn = tokens._learn
    monkeypatch.setattr(tokens, "_learn", lambda pieces: spelled.update(pieces) or learn(pieces))
    letters = "abcdefgéßłžA×÷Ω日7.,'-"
    texts = [" ".join("".join(rng.choices(letters, [9] * 7 + [2] * 4 + [1] * 10, k=rng.randrange(1, 9)))
                      for _ in range(2000)) + rng.choice(["", " ", "\n", "\u3000"]) for _ in range(6)] + [None, "", " ", " x"]
    plain = Tokenizer.from_file(path)
    want = [np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for t in texts]
    assert tokens.ids(texts) == want and tokens.ids(texts) == want
    assert not [p for p in spelled if tokens.word(p)]
    pieces = sorted({p for t in texts for p in tokens.cut(t or "")})
    buf = np.frombuffer("".join(pieces).encode(), np.uint8)
    ends = np.cumsum([len(p.encode()) for p in pieces])
    starts = np.concatenate([[0], ends[:-1]])
    assert I._are_words(buf, starts, ends).tolist() == [bool(tokens.word(p)) for p in pieces]
    assert re.search("[0-9]", "".join(spelled))
