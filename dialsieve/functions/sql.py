"""SQL-text builders for the column rules.

Every rule is written once, as Spark SQL expression text over column
references; operators hand whole select lists to ``selectExpr`` /
``withColumns``.  The expression is parsed JVM-side in one call, which keeps
plan construction cheap (building the same trees with one Python->JVM call
per node costs seconds for a 66-column projection).  All functions are
built-ins, so the result stays inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterable


def ref(name: str) -> str:
    """Quoted column reference."""
    return "`" + name.replace("`", "``") + "`"


def lit(v: str) -> str:
    """SQL string literal."""
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def lits(values: Iterable[str]) -> str:
    return ", ".join(lit(v) for v in values)


BLANK = "''"

# The characters a scripting-language strip() removes: every code point whose
# str.isspace() is true (Unicode whitespace plus the file/group/record/unit
# separators), generated by that rule and written as \uXXXX escapes.
_WS_CHARS = [chr(i) for i in range(0x110000) if chr(i).isspace()]
_WS_SET = "'" + "".join(f"\\u{ord(c):04x}" for c in _WS_CHARS) + "'"


def s(x: str) -> str:
    """Null -> ''."""
    return f"coalesce(CAST({x} AS STRING), '')"


def norm(x: str) -> str:
    """Strip leading/trailing Unicode whitespace; null -> ''.  A trim with an
    explicit character set: a scan of the two edges, no regex."""
    return f"trim(BOTH {_WS_SET} FROM {s(x)})"


def norm_lower(x: str) -> str:
    return f"lower({norm(x)})"


def digits(x: str) -> str:
    """Digits only (ASCII 0-9)."""
    return f"regexp_replace({s(x)}, r'[^0-9]', '')"


def blank_tokens(x: str, tokens: Iterable[str]) -> str:
    """'' when the raw cell equals one of ``tokens`` (exact), else the cell."""
    return f"CASE WHEN {s(x)} IN ({lits(tokens)}) THEN '' ELSE {s(x)} END"


def blank_whole(x: str, tokens: Iterable[str]) -> str:
    """Trim, then '' when the whole value is one of ``tokens``."""
    n = norm(x)
    return f"CASE WHEN {n} IN ({lits(tokens)}) THEN '' ELSE {n} END"


def clean_url(x: str) -> str:
    """blank -> blank; lower+trim; drop from the first '?' to the end; strip all
    trailing '/'; prefix https:// unless it starts with 'http'.  One chain,
    each step evaluated once per row."""
    u = f"nullif({norm_lower(x)}, '')"
    u = f"regexp_replace({u}, r'(?d)\\?.*$', '')"
    u = f"regexp_replace({u}, r'/+\\z', '')"
    u = f"regexp_replace({u}, r'^(?!http)', 'https://')"
    return f"coalesce({u}, '')"


def usable(x: str, unusable=("", "-", "nan", "None")) -> str:
    return f"({norm(x)} NOT IN ({lits(unusable)}))"


def first_usable(xs: list[str]) -> str:
    """First value whose trim is not a 'no value' spelling, else ''."""
    if not xs:
        return BLANK
    branches = " ".join(f"WHEN {usable(x)} THEN {s(x)}" for x in xs)
    return f"CASE {branches} ELSE '' END"


def fingerprint(*parts: str) -> str:
    """md5 hex of concat(lower(trim(p)) ...); '' when every part is blank."""
    joined = "concat(" + ", ".join(norm_lower(p) for p in parts) + ")"
    return f"coalesce(md5(nullif({joined}, '')), '')"


def area_code(x: str) -> str:
    d = digits(x)
    return f"CASE WHEN length({d}) >= 10 THEN substring({d}, 1, 3) ELSE '' END"


def lit_map(d: dict) -> str:
    return "map(" + ", ".join(f"{lit(k)}, {lit(v)}" for k, v in d.items()) + ")"


def ts_ntz(value) -> str:
    """A wall-clock timestamp literal (no time zone), from a datetime or text."""
    text = value.strftime("%Y-%m-%d %H:%M:%S") if hasattr(value, "strftime") else str(value)
    return f"CAST({lit(text)} AS TIMESTAMP_NTZ)"
