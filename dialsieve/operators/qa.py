"""Rechurn and GTG filters over call extracts (FL3, FL4, A10)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sql as X
from ..schema import first_present, q

# --- fixed values: disposition keywords that mark a contact for redialling (substring match)
RECHURN_KEYWORDS = [
    "ringing no response", "line busy", "prospect call back",
    "no answer", "busy", "voicemail", "vm", "rvm", "left message",
    "call back", "callback", "rechurn", "follow up", "incomplete call",
    "request timeout", "temporarily unavailable", "not found",
    "operator disconnected", "name not in the directory",
    "incorrect phone", "toll free",
]

# --- fixed values: QA status sets
GTG_VALUES = ["gtg", "good to go", "approved", "pass", "gtg - pass", "gtg-pass", "gtg pass"]
NON_GTG_VALUES = ["failed", "fail", "reject", "rejected", "no", "dq", "disqualified"]
QA_COLUMNS = ["qa_final_status", "qa_vv_disposition", "status"]


def rechurn_pattern(keywords=RECHURN_KEYWORDS) -> str:
    return "|".join(re.escape(k) for k in keywords)


def rechurn_filter(f3: DataFrame, keywords=RECHURN_KEYWORDS) -> DataFrame:
    """FL3: rows whose DGS disposition (else system disposition, else keep all)
    contains any keyword, case-insensitively."""
    col = first_present(f3, ["dgs_disposition", "system_disposition"])
    if col is None:
        return f3
    return f3.where(F.expr(f"{X.norm_lower(q(col))} rlike {X.lit(rechurn_pattern(keywords))}"))


def gtg_decision(df: DataFrame) -> DataFrame | None:
    """A10: one-row, one-column frame with the decision code, or None when no
    QA column is present.  Code 2i+1 = keep the GTG rows of QA column i, 2i+2
    = drop the failed rows of column i, 0 = keep everything.  The any-match
    flags are aggregates (map-side combined)."""
    present = [c for c in QA_COLUMNS if c in df.columns]
    if not present:
        return None
    branches = []
    for i, c in enumerate(present):
        v = X.norm_lower(q(c))
        branches.append(f"WHEN bool_or({v} IN ({X.lits(GTG_VALUES)})) THEN {2 * i + 1}")
        branches.append(f"WHEN bool_or({v} IN ({X.lits(NON_GTG_VALUES)})) THEN {2 * i + 2}")
    return df.agg(F.expr("CASE " + " ".join(branches) + " ELSE 0 END").alias("decision"))


def gtg_filter(df: DataFrame) -> DataFrame:
    """FL4: for the first QA column holding any GTG value keep only GTG rows;
    else for the first holding any failure value drop those rows; else keep all.

    The decision depends on all rows, so it is a global aggregate; it enters
    the filter as a scalar subquery (computed once, no driver round trip, no
    join)."""
    decision = gtg_decision(df)
    if decision is None:
        return df
    present = [c for c in QA_COLUMNS if c in df.columns]
    d = decision.scalar()
    cond = F.lit(True)
    for i, c in reversed(list(enumerate(present))):
        v = X.norm_lower(q(c))
        cond = (F.when(d == 2 * i + 1, F.expr(f"{v} IN ({X.lits(GTG_VALUES)})"))
                 .when(d == 2 * i + 2, F.expr(f"NOT ({v} IN ({X.lits(NON_GTG_VALUES)}))"))
                 .otherwise(cond))
    return df.where(cond)
