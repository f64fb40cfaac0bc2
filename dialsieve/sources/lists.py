"""Suppression-list and direct-dial-list loaders."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sql as X
from ..schema import q

# --- fixed values: key-column candidates per list
DEAD_KEYS = ["email id", "email", "Email ID", "Email"]
RPC_KEYS = ["email", "Email", "email id"]
DOMAIN_KEYS = ["domain", "Domain"]


def _column(raw: DataFrame, rank: Callable[[str], int]) -> str:
    """The column whose trimmed, lower-cased header ranks lowest, the first of equal ones."""
    return min(raw.columns, key=lambda c: rank(c.strip().lower()))


def suppression_keys(raw: DataFrame, candidates: Sequence[str], distinct: bool = True) -> DataFrame:
    """Distinct non-blank ``lower(trim(key))`` of a list file, column ``key``.

    The key column is the one whose header stands first among ``candidates`` (compared
    trimmed and lower-cased); a file without any of them is keyed by its first column.
    ``distinct=False`` leaves repeats in, for callers that drop them later anyway."""
    order = [c.lower() for c in candidates]
    found = _column(raw, lambda h: order.index(h) if h in order else len(order))
    keys = raw.selectExpr(f"{X.norm_lower(q(found))} AS key").where(F.col("key") != "")
    return keys.distinct() if distinct else keys


def direct_dial_keys(raw: DataFrame, distinct: bool = True) -> DataFrame:
    """Distinct digits-only numbers (column ``phone``) of a direct-dial list, from the
    first column that speaks of a phone or number in its header, else the first."""
    found = _column(raw, lambda h: 0 if re.search("phone|number", h) else 1)
    numbers = raw.selectExpr(f"{X.digits(q(found))} AS phone").where(~F.col("phone").isin("", "0"))
    return numbers.distinct() if distinct else numbers
