"""String normalisers as Columns (wrappers over ``functions.sql``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import sql as X

# --- fixed values: tokens a spreadsheet reader turns into "no value" (exact match)
SCAN_NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# --- fixed values: sentinels blanked (after trim) when aligning call history
HISTORY_NULL_TOKENS = ["nan", "<NA>", "None", "NaT", "NAT", "NaN"]


def s(name: str) -> Column:
    return F.expr(X.s(X.ref(name)))


def norm(name: str) -> Column:
    """Strip leading/trailing Unicode whitespace; null -> ''."""
    return F.expr(X.norm(X.ref(name)))


def norm_lower(name: str) -> Column:
    return F.expr(X.norm_lower(X.ref(name)))


def digits(name: str) -> Column:
    """Digits only (ASCII 0-9)."""
    return F.expr(X.digits(X.ref(name)))


def blank_tokens(name: str, tokens=SCAN_NA_TOKENS) -> Column:
    return F.expr(X.blank_tokens(X.ref(name), tokens))


def blank_sentinels(name: str) -> Column:
    return F.expr(X.blank_whole(X.ref(name), HISTORY_NULL_TOKENS))


def clean_url(name: str) -> Column:
    """Profile URL canonical form (see ``functions.sql.clean_url``)."""
    return F.expr(X.clean_url(X.ref(name)))


def usable(name: str) -> Column:
    return F.expr(X.usable(X.ref(name)))
