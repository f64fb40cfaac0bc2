"""Time zone and area code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import sql as X

# --- fixed values: US state -> zone (default EST)
US_STATE_ZONES = {
    "CT": "EST", "DE": "EST", "FL": "EST", "GA": "EST", "IN": "EST", "KY": "EST",
    "ME": "EST", "MD": "EST", "MA": "EST", "MI": "EST", "NH": "EST", "NJ": "EST",
    "NY": "EST", "NC": "EST", "OH": "EST", "PA": "EST", "RI": "EST", "SC": "EST",
    "TN": "EST", "VT": "EST", "VA": "EST", "WV": "EST", "DC": "EST",
    "AL": "CST", "AR": "CST", "IL": "CST", "IA": "CST", "KS": "CST", "LA": "CST",
    "MN": "CST", "MS": "CST", "MO": "CST", "NE": "CST", "ND": "CST", "OK": "CST",
    "SD": "CST", "TX": "CST", "WI": "CST",
    "AZ": "MST", "CO": "MST", "ID": "MST", "MT": "MST", "NV": "MST", "NM": "MST",
    "UT": "MST", "WY": "MST",
    "CA": "PST", "OR": "PST", "WA": "PST",
    "AK": "AKST", "HI": "HST",
}

# --- fixed values: Canadian province -> zone (default EST)
CA_PROVINCE_ZONES = {
    "AB": "MST", "BC": "PST", "MB": "CST", "NB": "AST", "NL": "NST",
    "NS": "AST", "NT": "MST", "NU": "EST", "ON": "EST", "PE": "AST",
    "QC": "EST", "SK": "CST", "YT": "PST",
}

# --- fixed values: country spellings
US_NAMES = ["usa", "united states", "us", "u.s.", "u.s.a."]
CA_NAMES = ["canada", "ca", "can"]


def timezone_sql(country: str, state: str) -> str:
    """US / Canada by two-letter state code (default EST); else the trimmed country."""
    c = X.norm_lower(country)
    st = f"upper({X.norm(state)})"
    return (f"CASE WHEN {c} IN ({X.lits(US_NAMES)}) "
            f"THEN coalesce(try_element_at({X.lit_map(US_STATE_ZONES)}, {st}), 'EST') "
            f"WHEN {c} IN ({X.lits(CA_NAMES)}) "
            f"THEN coalesce(try_element_at({X.lit_map(CA_PROVINCE_ZONES)}, {st}), 'EST') "
            f"ELSE {X.norm(country)} END")


def timezone(country: str, state: str) -> Column:
    return F.expr(timezone_sql(X.ref(country), X.ref(state)))


def area_code(name: str) -> Column:
    """First three digits when the number has at least ten digits."""
    return F.expr(X.area_code(X.ref(name)))
