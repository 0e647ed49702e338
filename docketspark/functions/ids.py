"""Clean forms of identifiers that arrive padded or in another letter case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII control blanks and every Unicode separator, at either end.
_PADDING = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def clean_id(c: Column | str) -> Column:
    """Trimmed, lower-case; null where nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    t = F.lower(F.regexp_replace(c.cast("string"), _PADDING, ""))
    return F.when(t != "", t)
