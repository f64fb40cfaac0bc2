"""Token counts without tokens: count-only Viterbi over a unigram vocabulary.

A pyahocorasick automaton enumerates the vocabulary pieces that end at each
character; dynamic programming carries, per end, only the best score, the number of
pieces and whether the last one was unknown.  Ties follow the unigram tokenizer: an
end takes the first best among its candidates in order of their starts (the longest
piece), and a later one only where it is strictly better.  A character that is no
piece by itself may also be unknown, at the least score less 10; unknown characters
count their UTF-8 bytes (byte fallback), or one for each unbroken run.

A text is "▁" + the text with "▁" for spaces.  Where no piece has "▁" after another
sign, the best path never crosses from another sign to "▁", so a text is the sum of
its words and equal words are counted once per task; else whole texts are counted.
The sums are exact for scores that are whole numbers.

Defined cases: null and empty texts have 0 tokens and score 0; only id and text are
read; repeated rows are each counted; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

MARK = "▁"
#: Words that a task remembers, and the longest of them (longer ones are counted anew).
MEMORY_WORDS, WORD_CHARS = 500_000, 64
#: What an unknown character costs below the least score.
UNKNOWN_PENALTY = 10.0
#: Pieces that a vocabulary may have: it goes to every task.
MAX_PIECES = 1_000_000


def vocabulary(path: str) -> tuple[list[tuple[str, float]], bool]:
    """(ordinary pieces with their scores, byte fallback) of a sentencepiece file."""
    import sentencepiece
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    special = [m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i) for i in range(n)]
    return ([(m.id_to_piece(i), m.get_score(i)) for i in range(n) if not special[i]],
            sum(m.is_byte(i) for i in range(n)) == 256)


class Counter:
    """Best score and token count of texts under a unigram vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool):
        import ahocorasick
        self.auto = ahocorasick.Automaton()
        for p, s in pieces:
            self.auto.add_word(p, (len(p), s))
        if pieces:
            self.auto.make_automaton()
        self.any = bool(pieces)
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.bytes, self.longest = byte_fallback, max((len(p) for p, _ in pieces), default=1)
        self.by_word = not any(re.search(f"[^{MARK}]{MARK}", p) for p, _ in pieces)
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.known: dict[str, tuple[float, int]] = {}

    def _word(self, word: str) -> tuple[float, int]:
        """``path`` of a word whose every character is a piece: nothing is unknown.  The
        automaton names an end's matches longest first, which is the tie rule's order."""
        if not self.single.issuperset(word):
            return self.path(word)
        score, count = [0.0] + [-np.inf] * len(word), [0] * (len(word) + 1)
        for end, (length, gain) in self.auto.iter(word):
            start = end + 1 - length
            new = score[start] + gain
            if new > score[end + 1]:
                score[end + 1], count[end + 1] = new, count[start] + 1
        return score[-1], count[-1]

    def path(self, text: str) -> tuple[float, int]:
        """(best score, tokens); the states of the last ``longest`` ends are kept."""
        size = self.longest + 1
        ring: list[tuple[float, int, bool]] = [(0.0, 0, False)] * size
        matches = self.auto.iter(text) if self.any else iter(())
        at, value = next(matches, (-1, None))
        for end, char in enumerate(text):
            found = []
            while at == end:
                found.append(value)
                at, value = next(matches, (-1, None))
            score, count, last = None, 0, False
            found.sort(reverse=True)                     # the longest, so the first start, first
            for length, gain in found:
                s, n, _ = ring[(end + 1 - length) % size]
                if score is None or s + gain > score:
                    score, count = s + gain, n + 1
            if not found or found[-1][0] > 1:
                s, n, was = ring[end % size]
                if score is None or s + self.unknown > score:
                    score, last = s + self.unknown, True
                    count = n + (len(char.encode("utf-8", "replace")) if self.bytes else 0 if was else 1)
            ring[(end + 1) % size] = (score, count, last)
        score, count, _ = ring[len(text) % size]
        return score, count

    def _words(self, text: str) -> list[str]:
        """Runs of the mark with the signs up to the next one."""
        words = text.split(" ")
        if "" in words or MARK in text:
            return re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))
        return [MARK + w for w in words]

    def count(self, text: str | None) -> tuple[float, int]:
        if not text:
            return 0.0, 0
        if not self.by_word:
            return self.path(MARK + text.replace(" ", MARK))
        words, known = self._words(text), self.known
        for w in set(words).difference(known):
            known[w] = self._word(w) if len(w) <= WORD_CHARS else self.path(w)
        got = [known[w] for w in words]
        for w in words:
            if len(w) > WORD_CHARS:
                known.pop(w, None)
        if len(known) > MEMORY_WORDS:
            self.known = {}
        return sum(g[0] for g in got), sum(g[1] for g in got)


def count_tokens(docs: DataFrame, pieces: list[tuple[str, float]], byte_fallback: bool, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """id, n_chars, n_tokens, best_score of every whole text."""
    spark = C.prepare(docs.sparkSession)
    if len(pieces) > MAX_PIECES:
        raise ValueError(f"the vocabulary has more than {MAX_PIECES} pieces")
    shared = spark.sparkContext.broadcast((pieces, byte_fallback))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_chars", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("best_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*shared.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            got = [counter.count(t) for t in texts]
            yield pa.record_batch([b.column(0), pa.array([len(t or "") for t in texts], pa.int64()),
                                   pa.array([n for _, n in got], pa.int64()),
                                   pa.array(np.array([s for s, _ in got], np.float64))], schema.names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
