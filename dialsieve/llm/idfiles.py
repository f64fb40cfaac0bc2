"""Token ids as binary files: frequency-ranked ids, byte-aligned variable-length coding.

A file is a sequence of blocks; all integers are little-endian.

    magic "FRQ1" | u32 header bytes | header | ranks | control bytes | data bytes | index

* header (JSON): counts of documents and ids, number of ranks, byte lengths of the parts;
* ranks: u32 id of every rank, the block's most frequent id first (ties: smaller id first);
* control bytes: 2 bits an id, four ids a byte (low bits first): bytes of its rank, less one;
* data bytes: the ranks, low byte first, 1 to 4 bytes each;
* index: per document its n_tokens (u32) and its key (Arrow IPC).

Frequent ids thus take one byte and a quarter.  A reader finds all byte lengths with one
256-entry table lookup per control byte and gathers the ranks with numpy, without a loop.

Documents are dealt out by ranges of their key, so files are in ascending key order; each
task sorts its range, encodes block by block (bounded memory) and writes its files under a
temporary name before renaming them, so a task that is run again leaves the same files.

Defined cases: a null text is the empty text; null keys come first; documents with equal
keys are ordered by their text's hash, then text; an empty table gives no files and no rows.  Only key and text are
read, so other columns may have any name.
"""

from __future__ import annotations

import json
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: Ids of a block, and bytes of a file, at which the next one begins.
BLOCK_IDS, FILE_BYTES = 1 << 20, 32 << 20
#: Text bytes that are cut into pieces at a time.
SLICE_BYTES = 1 << 20
#: Text bytes of a key range (one task sorts and writes it).
RANGE_BYTES = 24 << 20
#: Pieces of text whose ids a worker remembers in each of two generations.
MEMORY_PIECES = 100_000
#: Pieces that a worker holds in its table (some 60 MB).
TABLE_PIECES = 1_000_000

MAGIC = b"FRQ1"


# --- coding ------------------------------------------------------------------

_SHIFT = np.arange(4, dtype=np.uint8) * 2
#: Of each control byte: its four ids' byte lengths.
LENGTHS = ((np.arange(256, dtype=np.uint8)[:, None] >> _SHIFT) & 3) + 1


def encode_block(ids: np.ndarray, counts: np.ndarray, keys: pa.Array) -> bytes:
    """One block from its ids (uint32), the documents' n_tokens and their keys."""
    freq = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    known = np.flatnonzero(freq)
    ranks = known[np.lexsort((known, -freq[known]))].astype("<u4")
    rank_of = np.zeros(len(freq), np.uint32)
    rank_of[ranks] = np.arange(len(ranks), dtype=np.uint32)
    r = rank_of[ids]
    width = np.ones(len(r), np.uint8)
    for top in (1 << 8, 1 << 16, 1 << 24):
        width += r >= top
    padded = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    padded[:len(r)] = width - 1
    control = np.bitwise_or.reduce(padded.reshape(-1, 4) << _SHIFT, axis=1).astype(np.uint8)
    bytes_of = r.astype("<u4").view(np.uint8).reshape(-1, 4)
    data = bytes_of[np.arange(4) < width[:, None]]
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("n", pa.uint32()), ("key", keys.type)])) as w:
        w.write_batch(pa.record_batch([pa.array(counts, pa.uint32()), keys], ["n", "key"]))
    index = sink.getvalue().to_pybytes()
    header = json.dumps({"docs": len(counts), "ids": len(ids), "ranks": len(ranks), "control": len(control),
                         "data": len(data), "index": len(index)}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, ranks.tobytes(), control.tobytes(), data.tobytes(), index])


def decode_blocks(raw) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """(ids, n_tokens per document, keys) of every block of a file."""
    raw, at = memoryview(raw), 0
    while at < len(raw):
        if bytes(raw[at:at + 4]) != MAGIC:
            raise ValueError("not a block of this format")
        size, = struct.unpack_from("<I", raw, at + 4)
        h = json.loads(bytes(raw[at + 8:at + 8 + size]))
        at += 8 + size
        ranks = np.frombuffer(raw, "<u4", h["ranks"], at)
        at += 4 * h["ranks"]
        control = np.frombuffer(raw, np.uint8, h["control"], at)
        at += h["control"]
        data = np.concatenate([np.frombuffer(raw, np.uint8, h["data"], at), np.zeros(3, np.uint8)])
        at += h["data"]
        index = pa.ipc.open_stream(pa.py_buffer(raw[at:at + h["index"]])).read_all().combine_chunks()
        at += h["index"]
        width = LENGTHS[control].reshape(-1)[:h["ids"]]
        first = np.cumsum(width, dtype=np.int64) - width
        rank = data[first].astype(np.uint32)
        for k in range(1, int(width.max(initial=1))):
            rank |= np.where(width > k, data[first + k], 0).astype(np.uint32) << np.uint32(8 * k)
        keys = index.column("key").chunk(0) if index.num_rows else index.schema.field("key").type
        yield ranks[rank], index.column("n").to_numpy(), keys


# --- tokens ------------------------------------------------------------------

#: Unicode white space, as the tokenizer's pattern means it.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class Tokens:
    """Ids of whole texts by the tokenizers library, remembered per piece of text.

    The byte-level pre-tokenizer never joins text over white space, but for one space before
    a word; so a text is cut into runs without white space (with one space before them) and
    the white space between, and the ids of the pieces, one after another, are the ids of the
    text (``tests/llm`` compares them).  Letters and the signs after them are separate there
    too, so a word's ids serve it with any signs.  Each new piece is encoded once; what a worker
    knows is looked up with numpy (``Table``)."""

    def __init__(self, path: str, end_id: int | None):
        import os
        import re
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")     # one task, one core
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        self.cut = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]").findall
        self.signs = re.compile(r"( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+)([!-/:-@\[-`{-~]+)").fullmatch
        self.word = re.compile(r" [A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+").fullmatch
        # bytes of every id: the byte-level alphabet writes each with one character
        vocabulary = self.model.get_vocab()
        self.width = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}        # what was known before: used again, a piece moves up
        self.table = Table()

    def _encode(self, pieces: list[str]) -> None:
        """Words are encoded many in one text: each is one word of the pre-tokenizer, and its ids
        are those whose bytes make it up.  Other pieces are encoded one by one."""
        plain = [p for p in pieces if self.word(p)]
        rest = set(pieces).difference(plain)
        parts = [plain[a:a + 1000] for a in range(0, len(plain), 1000)]
        for a in range(0, len(parts), 16):
            texts = ["".join(p) for p in parts[a:a + 16]]
            for part, e in zip(parts[a:a + 16], self.model.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.frombuffer(array("I", e.ids), np.uint32)
                made = np.cumsum(self.width[ids])
                wanted = np.cumsum([len(p.encode()) for p in part])
                last = np.searchsorted(made, wanted)
                if made[-1] != wanted[-1] or not np.array_equal(made[last], wanted):
                    rest.update(part)
                    continue
                cuts, raw = ((last + 1) * 4).tolist(), ids.tobytes()
                self.known.update((p, raw[x:y]) for p, x, y in zip(part, [0, *cuts], cuts))  # noqa: B905
        others = list(rest)
        for a in range(0, len(others), 2000):
            part = others[a:a + 2000]
            for p, e in zip(part, self.model.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[p] = array("I", e.ids).tobytes()

    def _learn(self, pieces: set[str]) -> None:
        new = pieces.difference(self.known)
        if not new:
            return
        if len(self.known) + len(new) > MEMORY_PIECES:
            self.older, self.known = self.known, {p: self.known[p] for p in pieces if p in self.known}
        again = [p for p in new if p in self.older]
        self.known.update((p, self.older[p]) for p in again)
        new.difference_update(again)
        parts = {p: m.groups() for p in new if not p[-1].isalpha() and (m := self.signs(p))}
        self._encode(list({x for m in parts.values() for x in m}.union(new.difference(parts)).difference(self.known)))
        for p, (word, signs) in parts.items():
            self.known[p] = self.known[word] + self.known[signs]

    def _plain(self, text: str) -> bytes:
        """Ids of one text, piece by piece."""
        cut = self.cut(text)
        self._learn(set(cut))
        return b"".join(map(self.known.__getitem__, cut))

    def flat(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a slice one after another with their end ids, n_tokens per text).

        Pieces are found and looked up with numpy, by a 64-bit value; only pieces that the
        table does not hold yet are handled one by one.  Every piece's bytes are compared
        with those in the table; a text where they differ is cut and encoded by itself."""
        buf, offsets = C.flat_bytes(col)
        starts, ends, rows = cut_pieces(buf, offsets)
        at = self.table.find(buf, starts, ends, self._new_ids)
        odd = self.table.differs(buf, starts, ends, at, rows)
        ids, sizes = self.table.ids_of(at)
        counts = np.bincount(rows, weights=sizes, minlength=len(col)).astype(np.int64)
        if len(odd):
            own = np.split(ids, np.cumsum(counts)[:-1])
            for r in odd.tolist():
                own[r] = np.frombuffer(self._plain(col[r].as_py()), "<u4")
            ids, counts = np.concatenate(own), np.array([len(x) for x in own], np.int64)
        if not self.end:
            return ids, counts
        out = np.empty(len(ids) + len(col), np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(col)), counts)] = ids
        out[np.cumsum(counts + 1) - 1] = np.frombuffer(self.end, "<u4")[0]
        return out, counts + 1

    def _new_ids(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces one after another, how many of each).

        Words, nearly all of what is new, are joined, encoded and cut with numpy; only the other
        pieces are spelled one by one."""
        sizes = ends - starts
        plain = np.flatnonzero(_are_words(buf, starts, ends))
        ids, counts, done = self._joined(buf[_ranges(starts[plain], sizes[plain])], sizes[plain])
        rest = np.ones(len(starts), bool)
        rest[plain[done]] = False
        rest = np.flatnonzero(rest)
        spelled = [buf[a:b].tobytes().decode() for a, b in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)]
        self._learn(set(spelled))
        own = [self.known[x] for x in spelled]
        n = np.zeros(len(starts), np.int64)
        n[plain], n[rest] = counts, [len(x) // 4 for x in own]
        first = np.zeros(len(starts), np.int64)
        first[plain] = np.cumsum(counts) - counts
        first[rest] = len(ids) + np.cumsum(n[rest]) - n[rest]
        return np.concatenate([ids, np.frombuffer(b"".join(own), "<u4")])[_ranges(first, n)], n

    def _joined(self, letters: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of words that stand one after another, how many of each, whether known) - a thousand words make
        one text, and a word's ids are those whose bytes make it up; where they don't, its thousand is left out."""
        ends = np.concatenate([[0], np.cumsum(sizes)])
        found, counts, done = [np.zeros(0, np.uint32)], np.zeros(len(sizes), np.int64), np.zeros(len(sizes), bool)
        for a in range(0, len(sizes), 16_000):
            parts = [(x, min(x + 1000, len(sizes))) for x in range(a, min(a + 16_000, len(sizes)), 1000)]
            texts = [letters[ends[x]:ends[y]].tobytes().decode() for x, y in parts]
            for (x, y), e in zip(parts, self.model.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.frombuffer(array("I", e.ids), np.uint32)
                made, wanted = np.cumsum(self.width[ids]), ends[x + 1:y + 1] - ends[x]
                last = np.minimum(np.searchsorted(made, wanted), len(made) - 1)
                if len(made) and made[-1] == wanted[-1] and np.array_equal(made[last], wanted):
                    found.append(ids)
                    counts[x:y], done[x:y] = np.diff(last, prepend=-1), True
        return np.concatenate(found), counts, done

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids (and the end id) as little-endian u32 bytes."""
        ids, counts = self.flat(pa.array(texts, pa.string()))
        return [x.astype("<u4").tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])] if texts else []


def cut_pieces(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte after the last, row) of every piece, in order: as ``Tokens.cut`` cuts.

    A word has the one space before it; of other white space before a word the last character
    is a piece of its own, and the rest, like white space at the end, is one piece."""
    z = np.zeros(0, np.int64)
    if not len(buf):
        return z, z, z
    white = C._SPACE[buf]
    for lead in (0xC2, 0xE1, 0xE2, 0xE3):                    # white space beyond ASCII
        p = np.flatnonzero(buf == lead)
        for tail in _WIDE[lead]:
            hit = p[p + len(tail) < len(buf)]
            for k, allowed in enumerate(tail, 1):
                hit = hit[np.isin(buf[hit + k], allowed)]
            for k in range(len(tail) + 1):
                white[hit + k] = True
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    first = ~white
    first[1:] &= white[:-1] | edge[1:-1]
    last = ~white
    last[:-1] &= white[1:] | edge[1:-1]
    words, after = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, words, "right") - 1
    # white space before a word: from the end of the word before it in its row
    gap = offsets[row]
    if len(words):
        gap[1:] = np.maximum(gap[1:], after[:-1])
    some = np.flatnonzero(words > gap)
    char = words[some] - 1                                   # first byte of its last character
    wide = buf[char] >= 0x80
    char[wide] -= np.where(buf[char[wide] - 1] == 0xC2, 1, 2)
    space = buf[char] == 0x20
    begin = words.copy()
    begin[some[space]] -= 1
    # white space after the last word of a row, or all of it
    tail = offsets[:-1].copy()
    np.maximum.at(tail, row, after)
    end = np.flatnonzero(tail < offsets[1:])
    more = char > gap[some]
    starts = np.concatenate([begin, gap[some[more]], char[~space], tail[end]])
    stops = np.concatenate([after, char[more], words[some[~space]], offsets[1:][end]])
    order = np.argsort(starts, kind="stable")
    starts = starts[order]
    return starts, stops[order], np.searchsorted(offsets, starts, "right") - 1


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _are_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each piece is what ``Tokens.word`` matches: a space and letters up to U+017F."""
    if not len(starts):
        return np.zeros(0, bool)
    letter = _ASCII_LETTER[buf]
    lead = np.flatnonzero((buf >= 0xC3) & (buf <= 0xC5))         # texts are valid, so one more byte follows
    second = buf[lead + 1]
    lead = lead[(buf[lead] != 0xC3) | ((second != 0x97) & (second != 0xB7))]
    letter[lead] = letter[lead + 1] = True
    other = np.concatenate([[0], np.cumsum(~letter)])
    return (buf[starts] == 0x20) & (ends - starts > 1) & (other[ends] == other[starts + 1])


#: The bytes after each lead byte that make Unicode white space (of ``_WS``).
_WIDE = {0xC2: [([0x85, 0xA0],)], 0xE1: [([0x9A], [0x80])],
         0xE2: [([0x80], [*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF]), ([0x81], [0x9F])], 0xE3: [([0x80], [0x80])]}


class _Grow:
    """A numpy array that is added to at its end."""

    def __init__(self, kind):
        self.data, self.n = np.zeros(1024, kind), 0

    def add(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.data):
            self.data = np.concatenate([self.data[:self.n], np.zeros(max(len(x), self.n), self.data.dtype)])
        self.data[self.n:self.n + len(x)] = x
        self.n += len(x)

    def view(self) -> np.ndarray:
        return self.data[:self.n]


class Table:
    """Pieces by their 64-bit value: bytes and ids, held in flat arrays.

    Beyond ``TABLE_PIECES`` the pieces that were not met since the last time are forgotten."""

    def __init__(self):
        self.values, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)      # ascending values
        self._clear()

    def _clear(self) -> None:
        self.bytes, self.ids = _Grow(np.uint8), _Grow(np.uint32)
        self.byte_ends, self.id_ends, self.used = _Grow(np.int64), _Grow(np.int64), _Grow(bool)
        self.byte_ends.add(np.zeros(1, np.int64))
        self.id_ends.add(np.zeros(1, np.int64))

    def find(self, buf, starts, ends, learn) -> np.ndarray:
        """Slot of every piece; pieces that are not held are learnt."""
        values, lead, which = np.unique(C.spans_hash(buf, starts, ends), return_index=True, return_inverse=True)
        if len(self.values) + len(values) > TABLE_PIECES:
            self._forget()
        at = np.searchsorted(self.values, values)
        held = np.zeros(len(values), bool)
        inside = at < len(self.values)
        held[inside] = self.values[at[inside]] == values[inside]
        slot = np.empty(len(values), np.int64)
        slot[held] = self.slots[at[held]]
        new = np.flatnonzero(~held)
        if len(new):
            first, after = starts[lead[new]], ends[lead[new]]
            ids, counts = learn(buf, first, after)
            slot[new] = len(self.used.view()) + np.arange(len(new))
            self._append(buf[_ranges(first, after - first)], after - first, ids, counts)
            self.values = np.insert(self.values, at[new], values[new])
            self.slots = np.insert(self.slots, at[new], slot[new])
        self.used.view()[slot] = True
        return slot[which]

    def _append(self, spelled: np.ndarray, sizes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Add pieces: their bytes and ids one after another, and how many of each."""
        self.bytes.add(spelled)
        self.ids.add(ids)
        self.byte_ends.add(self.byte_ends.view()[-1] + np.cumsum(sizes))
        self.id_ends.add(self.id_ends.view()[-1] + np.cumsum(counts))
        self.used.add(np.zeros(len(sizes), bool))

    def _forget(self) -> None:
        keep = self.used.view()[self.slots]
        if np.count_nonzero(keep) > TABLE_PIECES // 2:
            keep[:] = False
        slots, b, i = self.slots[keep], self.byte_ends.view(), self.id_ends.view()
        sizes, counts = b[slots + 1] - b[slots], i[slots + 1] - i[slots]
        spelled, ids = self.bytes.view()[_ranges(b[slots], sizes)], self.ids.view()[_ranges(i[slots], counts)]
        self.values, self.slots = self.values[keep], np.arange(len(slots))
        self._clear()
        self._append(spelled, sizes, ids, counts)

    def ids_of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the slots one after another, how many of each)."""
        ends = self.id_ends.view()
        sizes = ends[at + 1] - ends[at]
        return self.ids.view()[_ranges(ends[at], sizes)], sizes

    def differs(self, buf, starts, ends, at, rows) -> np.ndarray:
        """Rows with a piece whose bytes are not the slot's."""
        held = self.byte_ends.view()
        sizes = ends - starts
        bad = np.flatnonzero(held[at + 1] - held[at] != sizes)
        if len(bad):                       # lengths differ: no bytes to compare
            same = np.ones(len(at), bool)
            same[bad] = False
            starts, at, sizes, left = starts[same], at[same], sizes[same], rows[same]
        else:
            left = rows
        unlike = np.flatnonzero(buf[_ranges(starts, sizes)] != self.bytes.view()[_ranges(held[at], sizes)])
        return np.unique(np.concatenate([rows[bad], left[np.searchsorted(np.cumsum(sizes), unlike, "right")]]))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of every range [start, start + size), one range after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


_tokens: dict[tuple, Tokens] = {}


def _tokens_of(path: str, end_id: int | None) -> Tokens:
    """One per Python worker: what a task has learnt serves the next one."""
    if (path, end_id) not in _tokens:
        _tokens.clear()
        _tokens[path, end_id] = Tokens(path, end_id)
    return _tokens[path, end_id]


# --- files -------------------------------------------------------------------

def _store(folder: str):
    """(file system, path) of the shared folder, as executors see it."""
    from pyarrow import fs
    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def _publish(store, trial: str, path: str) -> None:
    """Rename, where another attempt of the same task may have left the same file."""
    from pyarrow import fs
    try:
        store.move(trial, path)
    except OSError:
        if store.get_file_info(path).type != fs.FileType.File:
            raise
        store.delete_file(trial)


def write_files(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                end_id: int | None = 0) -> DataFrame:
    """Write ``docs`` into ``folder`` and return its manifest: path, part, file, docs, ids.

    The manifest has a row per file; it is computed once (checkpointed), which runs the write."""
    spark = C.prepare(docs.sparkSession)
    parts = max(1, -(-C.size_of(docs, text_col)[1] // RANGE_BYTES))
    kind = docs.schema[id_col].dataType
    rows = (docs.select(F.col(id_col).alias("key"), F.coalesce(text_col, F.lit("")).alias("text"))
            .repartitionByRange(parts, F.col("key").asc_nulls_first(), F.xxhash64("text"))
            .sortWithinPartitions(F.col("key").asc_nulls_first(), F.xxhash64("text"), "text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        part, tokens = TaskContext.get().partitionId(), _tokens_of(tokenizer, end_id)
        held: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        keys: list[pa.Array] = []
        out, trial, number = None, "", 0
        size = docs_in = ids_in = written = 0

        def block() -> None:
            """Encode what is held and append it to the open file."""
            nonlocal held, counts, keys, size, out, trial, written
            if out is None:
                trial = f"{root}/_{uuid.uuid4().hex}"
                out, written = store.open_output_stream(trial), 0
            raw = encode_block(np.concatenate(held), np.concatenate(counts).astype(np.uint32), pa.concat_arrays(keys))
            out.write(raw)
            held, counts, keys, size, written = [], [], [], 0, written + len(raw)

        def close() -> pa.RecordBatch:
            nonlocal out, docs_in, ids_in, number
            out.close()
            name = f"part-{part:08d}-{number:05d}.ids"
            _publish(store, trial, f"{root}/{name}")
            row = pa.record_batch([pa.array([name]), pa.array([part], pa.int32()), pa.array([number], pa.int32()),
                                   pa.array([docs_in], pa.int64()), pa.array([ids_in], pa.int64())],
                                  ["path", "part", "file", "docs", "ids"])
            out, docs_in, ids_in, number = None, 0, 0, number + 1
            return row

        for b in batches:
            for s in C.text_slices(b, "text", SLICE_BYTES):
                ids, per_text = tokens.flat(s.column(1))
                held.append(ids)
                counts.append(per_text)
                keys.append(s.column(0))
                size, docs_in, ids_in = size + len(ids), docs_in + s.num_rows, ids_in + len(ids)
                if size >= BLOCK_IDS:
                    block()
                if out is not None and written >= FILE_BYTES:
                    yield close()
        if held:
            block()
        if out is not None:
            yield close()

    return C.save(rows.mapInArrow(write, "path string, part int, file int, docs long, ids long"))


def read_files(spark: SparkSession, folder: str, manifest: DataFrame, id_col: str = "doc_id",
               kind: T.DataType | None = None, digest: bool = True) -> DataFrame:
    """Every document from the files: id, start (ids of all documents before it), n_tokens and
    ids_crc32, or with ``digest=False`` its ids instead.

    Where a file begins is the running sum of the manifest's counts (one row per file)."""
    from pyspark.sql import Window
    C.prepare(spark)
    kind = kind or T.LongType()
    last = T.StructField("ids_crc32", T.LongType()) if digest else T.StructField("ids", T.ArrayType(T.LongType()))
    if not manifest.limit(1).count():           # no documents, no files
        return spark.createDataFrame([], T.StructType([T.StructField(id_col, kind), T.StructField("start", T.LongType()),
                                                       T.StructField("n_tokens", T.LongType()), last]))
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    begins = manifest.select("path", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("begin"))
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "part-*.ids").load(folder)
             .select(F.element_at(F.split("path", "/"), -1).alias("path"), "content"))
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("key", kind), T.StructField("at", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), last])

    def decode(batches):
        _tokens.clear()                         # a worker that wrote needs its pieces no longer
        for b in batches:
            for i in range(b.num_rows):
                path, begin = b.column(0)[i].as_py(), 0
                for ids, counts, keys in decode_blocks(b.column(1)[i].as_buffer()):
                    ends = np.cumsum(counts, dtype=np.int64)
                    starts = ends - counts
                    raw = np.ascontiguousarray(ids, "<u4")
                    if digest:
                        out = pa.array([zlib.crc32(raw[a:e]) for a, e in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64())
                    else:
                        out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(raw.astype(np.int64)))
                    yield pa.record_batch([pa.array([path] * len(counts), pa.string()), keys, pa.array(starts + begin),
                                           pa.array(counts.astype(np.int64)), out], schema.names)
                    begin += int(ends[-1]) if len(ends) else 0

    return (files.mapInArrow(decode, schema).join(begins, "path")
            .select(F.col("key").alias(id_col), (F.col("begin") + F.col("at")).alias("start"), "n_tokens", last.name))
