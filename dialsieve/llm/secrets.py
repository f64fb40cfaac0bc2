"""Secret scans through a trigram inverted index; DataFrame operations only.

From each rule's regular expression a Boolean trigram query is derived: the texts that the
expression can match are expanded into alternatives of literal pieces, every alternative
asks for all trigrams of its pieces (lower case), and the rule for any one alternative.  A
rule with an alternative that has no trigram must scan every text.  The index holds
(trigram, document) postings for the trigrams that some query asks for; intersecting them
gives each document's candidate rules, and only those, and the rules that scan fully, are
run on the text.  Matches are leftmost and do not overlap (per rule); where they stand is
summed up from the pieces between them, in code points.

Defined cases: null texts are empty; an empty text has no spans; rows that are equal in id
and text have the same result; null ids are kept; an empty table gives no rows; only id and
text are read.  A rule's value must have ``least`` characters, other matches are dropped.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .linededup import _keyed

#: Alternatives of a rule beyond which a part counts as unknown text.
MAX_WAYS = 256


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose group ``value`` has ``least`` characters."""

    kind: str
    pattern: str
    value: int = 0
    least: int = 1


#: Base kinds in their order, then further kinds: fixed formats of keys and tokens.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    # a run's longest match begins at its first place: asking for the length is the same as dropping shorter runs
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
BASE = ("assign", "access", "hex")


# --- trigram queries ---------------------------------------------------------

_GAP = "\0"


def _ways(node) -> list[str]:
    """Texts that a parsed expression can match, as literals with gaps for unknown parts."""
    out = [""]
    for op, arg in node:
        name = str(op)
        if name == "LITERAL":
            part = [chr(arg).lower()]
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= 8:
            part = sorted({chr(a).lower() for _, a in arg})
        elif name == "SUBPATTERN":
            part = _ways(arg[3])
        elif name == "BRANCH":
            part = [w for b in arg[1] for w in _ways(b)]
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = arg
            ways = _ways(inner)
            if low == 0 and int(high) == 1:
                part = ["", *ways]
            elif low == high and len(ways) == 1:
                part = [ways[0] * min(low, 64)]
            else:
                part = [(w if low else "") + _GAP + (w if low else "") for w in ways] if low else [_GAP]
        elif name == "AT":
            part = [""]
        else:
            part = [_GAP]
        part = sorted(set(part))
        out = [a + b for a in out for b in part] if len(out) * len(part) <= MAX_WAYS else [a + _GAP for a in out]
    return sorted(set(out))


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives of trigrams that all must occur (lower case); None: scan every text."""
    try:
        from re import _parser
    except ImportError:  # pragma: no cover - older Pythons
        import sre_parse as _parser
    found = []
    for way in _ways(_parser.parse(pattern)):
        grams = frozenset(p[i:i + 3] for p in way.split(_GAP) for i in range(len(p) - 2))
        if not grams:
            return None
        found.append(grams)
    return sorted({a for a in found if not any(b < a for b in found)}, key=sorted)   # a wider demand adds nothing


# --- index and candidates ----------------------------------------------------

def build_index(docs: DataFrame, trigrams: set[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(trigram, k, h) postings of the given trigrams, checkpointed; k and h name a document."""
    asked = F.array(*[F.lit(t) for t in sorted(trigrams)])
    return C.save(_keyed(docs, id_col, text_col).where("text <> ''")
                  .withColumn("trigrams", asked)
                  .select("k", "h", F.expr("explode(element_at(transform(array(lower(text)), low -> "
                                           "filter(trigrams, t -> contains(low, t))), 1))").alias("trigram")))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(k, h, kinds): the rules whose trigram query a document meets."""
    spark = index.sparkSession
    asks = [(r.kind, n, t, len(way)) for r in rules for n, way in enumerate(trigram_query(r.pattern) or []) for t in sorted(way)]
    asked = spark.createDataFrame(asks, "kind string, way int, trigram string, need int")
    return (index.join(F.broadcast(asked), "trigram")               # as large as the rules' text
            .groupBy("k", "h", "kind", "way", "need").agg(F.size(F.collect_set("trigram")).alias("has"))
            .where("has = need").groupBy("k", "h").agg(F.collect_set("kind").alias("kinds")))


# --- verification ------------------------------------------------------------

def _spans(rule: Rule) -> str:
    """SQL: array of (start, end) of the rule's matches in ``text``, from the pieces between
    matches (`0`), the matches (`1`) and their values (`2`)."""
    quoted = "'" + rule.pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    value = f"regexp_extract_all(text, {quoted}, {rule.value})"
    return f"""aggregate(
        arrays_zip(split(text, {quoted}, -1), regexp_extract_all(text, {quoted}, 0), {value}),
        struct(0L as at, cast(array() as array<struct<start: bigint, end: bigint>>) as found),
        (a, x) -> if(x.`1` is null, a, struct(a.at + length(x.`0`) + length(x.`1`) as at,
            if(length(x.`2`) >= {rule.least},
               concat(a.found, array(struct(a.at + length(x.`0`) as start, a.at + length(x.`0`) + length(x.`1`) as end))), a.found) as found)),
        a -> a.found)"""


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and, per kind, the array of (start, end) spans of every document."""
    C.prepare(docs.sparkSession)
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    asked = set().union(*[w for q in queries.values() for w in q or []])
    rows = _keyed(docs, id_col, text_col)
    if asked:
        found = C.save(candidates(build_index(docs, asked, id_col, text_col), rules))
        rows = rows.join(found, ["k", "h"], "left")
    none = "cast(array() as array<struct<start: bigint, end: bigint>>)"
    quick = {r.kind: f"text rlike '{r.pattern}'" for r in rules if "'" not in r.pattern and "\\" not in r.pattern}
    test = lambda r: quick.get(r.kind, "true") if queries[r.kind] is None else f"array_contains(kinds, '{r.kind}')"
    return rows.select(F.col("id").alias(id_col), *[F.expr(f"if({test(r)}, {_spans(r)}, {none})").alias(r.kind) for r in rules])


def digest(spans: DataFrame, id_col: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """id, counts and the base spans' hash, and all spans as text."""

    def joined(kinds) -> str:
        each = ", ".join(f"transform(`{k}`, s -> struct(s.start as start, {n} as n, concat('{k}:', s.start, ':', s.end) as t))"
                         for n, k in enumerate(kinds))
        return f"array_join(transform(array_sort(concat({each})), x -> x.t), ',')"

    return spans.select(id_col, *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
                        F.sha2(F.expr(joined(BASE)), 256).alias("base_sha256"),
                        F.expr(joined([r.kind for r in rules])).alias("spans"))


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL of the query over ``documents``: every rule on every text, without an index."""
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    part = lambda n, r: f"""  select k, {n} as n, '{r.kind}' as kind, p, m, v, i, {r.least} as least from (
    select k, unnest(string_split_regex(text, {lit(r.pattern)})) as p, unnest(regexp_extract_all(text, {lit(r.pattern)}, 0)) as m,
      unnest(regexp_extract_all(text, {lit(r.pattern)}, {r.value})) as v,
      unnest(range(len(string_split_regex(text, {lit(r.pattern)})))) as i from d)"""  # noqa: E731
    base = ", ".join(f"'{k}'" for k in BASE)
    counts = ", ".join(f"count(*) filter (kind = '{k}')::bigint as n_{k}" for k in BASE)
    return f"""
with d as (select row_number() over () as k, doc_id, coalesce(text, '') as text from documents),
x as (
{chr(10).join(("  union all" + chr(10)) * (n > 0) + part(n, r) for n, r in enumerate(rules))}),
y as (select *, length(p) + coalesce(sum(length(p) + length(m)) over (partition by k, n order by i rows between unbounded preceding and 1 preceding), 0) as s from x),
z as (select k, n, kind, s, kind || ':' || s::bigint || ':' || (s + length(m))::bigint as t from y where m is not null and length(v) >= least),
g as (select k, {counts}, string_agg(t, ',' order by s, n) filter (kind in ({base})) as base, string_agg(t, ',' order by s, n) as spans from z group by k)
select doc_id, {", ".join(f"coalesce(n_{k}, 0) as n_{k}" for k in BASE)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join g using (k)
"""
