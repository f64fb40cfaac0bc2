"""Tolerant date parsing and ISO week helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import sql as X

_D2, _D12, _D4 = "[0-9]{2}", "[0-9]{1,2}", "[0-9]{4}"
_DASH, _SLASH = f"{_D4}-{_D12}-{_D12}", f"{_D12}/{_D12}/{_D4}"

# --- fixed values: date spellings by shape (disjoint shapes; month first for slashes)
DATE_FORMATS: dict[str, str] = {
    _DASH: "yyyy-M-d",
    f"{_DASH} {_D12}:{_D2}": "yyyy-M-d H:mm",
    f"{_DASH} {_D12}:{_D2}:{_D2}": "yyyy-M-d H:mm:ss",
    f"{_DASH} {_D12}:{_D2}:{_D2}[.][0-9]{{3}}": "yyyy-M-d H:mm:ss.SSS",
    f"{_DASH} {_D12}:{_D2}:{_D2}[.][0-9]{{6}}": "yyyy-M-d H:mm:ss.SSSSSS",
    f"{_DASH}T{_D12}:{_D2}:{_D2}": "yyyy-M-d'T'H:mm:ss",
    f"{_DASH}T{_D12}:{_D2}:{_D2}Z": "yyyy-M-d'T'H:mm:ss'Z'",
    _SLASH: "M/d/yyyy",
    f"{_SLASH} {_D12}:{_D2}": "M/d/yyyy H:mm",
    f"{_SLASH} {_D12}:{_D2}:{_D2}": "M/d/yyyy H:mm:ss",
    f"{_SLASH} {_D12}:{_D2} [AP]M": "M/d/yyyy h:mm a",
    f"{_SLASH} {_D12}:{_D2}:{_D2} [AP]M": "M/d/yyyy h:mm:ss a",
    f"{_D12}-[A-Z][a-z]{{2}}-{_D4}": "d-MMM-yyyy",
    "[0-9]{8}": "yyyyMMdd",
    f"{_D4}/{_D12}/{_D12}": "yyyy/M/d",
}

DATE_BLANKS = ["", "-", "nan", "NaT", "NAT"]

#: Shapes that Spark's own cast reads alike; it is many times faster than a formatter.
CAST_SHAPES = {_DASH, f"{_DASH} {_D12}:{_D2}:{_D2}", f"{_DASH} {_D12}:{_D2}:{_D2}[.][0-9]{{3}}",
               f"{_DASH} {_D12}:{_D2}:{_D2}[.][0-9]{{6}}"}


def parse_timestamp_sql(x: str) -> str:
    """One parse attempt per value, with the format of its shape (a failed parse is
    costly in the JVM); blanks and values of no known shape are NULL."""
    v = X.norm(x)
    read = lambda shape, f: f"try_cast({v} AS TIMESTAMP)" if shape in CAST_SHAPES else f"try_to_timestamp({v}, {X.lit(f)})"
    shaped = " ".join(f"WHEN {v} rlike {X.lit(f'^{shape}$')} THEN {read(shape, f)}" for shape, f in DATE_FORMATS.items())
    return f"CASE WHEN {v} IN ({X.lits(DATE_BLANKS)}) THEN CAST(NULL AS TIMESTAMP) {shaped} END"


def parse_date_sql(x: str) -> str:
    return f"CAST({parse_timestamp_sql(x)} AS DATE)"


def parse_date(name: str) -> Column:
    """DATE from a string, trying each format per row; blanks and junk -> NULL."""
    return F.expr(parse_date_sql(X.ref(name)))


def parse_timestamp(name: str) -> Column:
    """TIMESTAMP from a string, trying each format per row; blanks and junk -> NULL."""
    return F.expr(parse_timestamp_sql(X.ref(name)))


def iso_year(name: str) -> Column:
    return F.expr(f"CAST(extract(YEAROFWEEK FROM {X.ref(name)}) AS INT)")


def iso_week(name: str) -> Column:
    return F.expr(f"weekofyear({X.ref(name)})")


def week_start(name: str) -> Column:
    """Monday of the ISO week."""
    return F.expr(f"CAST(date_trunc('week', {X.ref(name)}) AS DATE)")
