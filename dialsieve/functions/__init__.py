"""Column rules as built-in Spark SQL expressions (no UDFs).

``functions.sql`` holds the text builders; the other modules wrap them as
Columns over column names."""

from .dates import iso_week, iso_year, parse_date, parse_timestamp, week_start
from .geo import area_code, timezone
from .keys import fingerprint
from .phone import validate_phone, with_phone_validity
from .text import blank_sentinels, blank_tokens, clean_url, digits, norm, norm_lower, s, usable

__all__ = [
    "area_code", "blank_sentinels", "blank_tokens", "clean_url", "digits", "fingerprint",
    "iso_week", "iso_year", "norm", "norm_lower", "parse_date", "parse_timestamp", "s", "timezone",
    "usable", "validate_phone", "week_start", "with_phone_validity",
]
