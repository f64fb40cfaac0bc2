"""MD5 fingerprints over trimmed, lower-cased parts joined without separator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import sql as X


def fingerprint(*names: str) -> Column:
    """md5 hex of concat(lower(trim(p)) ...); '' when every part is blank."""
    return F.expr(X.fingerprint(*[X.ref(n) for n in names]))
