"""Phone number validation as built-in expressions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sql as X

# --- fixed values: raw values treated as "no phone number" (after trim, case-sensitive)
EMPTY_PHONE = ["", "-", "nan", "None", "NA", "na"]

STATUSES = ["valid", "possible", "invalid", "empty"]

# rule codes, in evaluation order
EMPTY, NON_NUMERIC, SHORT, LONG, SAME_DIGIT, BAD_AREA, BAD_EXCHANGE, NANP, INTERNATIONAL, POSSIBLE = range(1, 11)

# separators removed before the digit test: [ ] ( ) - + . and all whitespace
_SEPARATORS = "'[]()-+." + X._WS_SET[1:]


def _nanp(c: str) -> str:
    return f"(CASE WHEN length({c}) = 11 AND startswith({c}, '1') THEN substring({c}, 2, 10) ELSE {c} END)"


def code_sql(is_empty: str, c: str) -> str:
    """The number of the first rule that fires: empty spelling; non-digit left
    after removing ``[ ] ( ) - + .`` and whitespace; < 7 or > 15 digits; one
    repeated digit; 10 digits (after dropping the 1 of an 11-digit 1xxx number)
    with area or exchange < 200; 10 digits; >= 10 digits; else possible."""
    n = f"length({c})"
    nanp = _nanp(c)
    return (f"CASE WHEN {is_empty} THEN {EMPTY} "
            f"WHEN NOT ({c} rlike r'^[0-9]+$') THEN {NON_NUMERIC} "
            f"WHEN {n} < 7 THEN {SHORT} WHEN {n} > 15 THEN {LONG} "
            f"WHEN replace({c}, substring({c}, 1, 1), '') = '' THEN {SAME_DIGIT} "
            f"WHEN length({nanp}) = 10 AND CAST(substring({nanp}, 1, 3) AS INT) < 200 THEN {BAD_AREA} "
            f"WHEN length({nanp}) = 10 AND CAST(substring({nanp}, 4, 3) AS INT) < 200 THEN {BAD_EXCHANGE} "
            f"WHEN length({nanp}) = 10 THEN {NANP} WHEN {n} >= 10 THEN {INTERNATIONAL} ELSE {POSSIBLE} END")


def status_sql(k: str) -> str:
    return (f"CASE WHEN {k} = {EMPTY} THEN 'empty' WHEN {k} <= {BAD_EXCHANGE} THEN 'invalid' "
            f"WHEN {k} <= {INTERNATIONAL} THEN 'valid' ELSE 'possible' END")


def reason_sql(k: str, c: str) -> str:
    n = f"CAST(length({c}) AS STRING)"
    nanp = _nanp(c)
    npa, nxx = f"substring({nanp}, 1, 3)", f"substring({nanp}, 4, 3)"
    return (f"CASE WHEN {k} = {EMPTY} THEN 'No phone number' "
            f"WHEN {k} = {NON_NUMERIC} THEN 'Contains non-numeric characters' "
            f"WHEN {k} = {SHORT} THEN concat('Too short - ', {n}, ' digits (min 7)') "
            f"WHEN {k} = {LONG} THEN concat('Too long - ', {n}, ' digits (E.164 max 15)') "
            f"WHEN {k} = {SAME_DIGIT} THEN concat('All same digit - ', substring({c}, 1, 1)) "
            f"WHEN {k} = {BAD_AREA} THEN concat('Invalid NANP area code ', {npa}) "
            f"WHEN {k} = {BAD_EXCHANGE} THEN concat('Invalid NANP exchange ', {nxx}) "
            f"WHEN {k} = {NANP} THEN concat('NANP (', {npa}, '-', {nxx}, '-', substring({nanp}, 7, 4), ')') "
            f"WHEN {k} = {INTERNATIONAL} THEN concat('International E.164 (', {n}, ' digits)') "
            f"ELSE concat({n}, '-digit number') END")


def empty_sql(raw: str) -> str:
    return f"({X.norm(raw)} IN ({X.lits(EMPTY_PHONE)}))"


def cleaned_sql(raw: str) -> str:
    """Raw value with the separators deleted (``translate`` drops every
    character of the set that has no replacement - no regex)."""
    return f"translate({X.s(raw)}, {_SEPARATORS}, '')"


def validate_phone(name: str) -> Column:
    """struct<status, reason> for a raw phone column (single expression).
    For whole frames prefer ``with_phone_validity``."""
    raw = X.ref(name)
    k = code_sql(empty_sql(raw), cleaned_sql(raw))
    return F.expr(f"named_struct('status', {status_sql(k)}, 'reason', {reason_sql(k, cleaned_sql(raw))})")


def with_phone_validity(df: DataFrame, src: str, status: str = "tel_valid", reason: str = "tel_reason") -> DataFrame:
    """Add ``status``/``reason`` columns for the raw phone column ``src``.

    Staged projections: the regex work (trim test, separator removal), then a
    small integer rule code, then status and reason from the code.  Catalyst
    keeps the stages apart because each staged value is referenced several
    times, so every regex runs once per row and a filter on ``status`` that is
    pushed down carries only the small code expression."""
    raw = X.ref(src)
    staged = df.withColumns({"_pv_e": F.expr(empty_sql(raw)), "_pv_c": F.expr(cleaned_sql(raw))})
    coded = staged.withColumn("_pv_k", F.expr(code_sql("_pv_e", "_pv_c")))
    return coded.withColumns({status: F.expr(status_sql("_pv_k")), reason: F.expr(reason_sql("_pv_k", "_pv_c"))}) \
                .drop("_pv_e", "_pv_c", "_pv_k")
