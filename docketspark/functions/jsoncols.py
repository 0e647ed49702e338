"""JSON text columns read with Catalyst functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_text(c: Column) -> Column:
    """JSON text opened once where it is encoded twice; null where it cannot be read."""
    opened = F.get_json_object(F.concat(F.lit('{"x":'), c, F.lit("}")), "$.x")
    once = F.when(F.try_parse_json(c).isNotNull(), F.when(F.trim(c).startswith('"'), opened).otherwise(c))
    return F.when(F.try_parse_json(once).isNotNull(), once)


def field(c: Column, path: str) -> Column:
    return F.get_json_object(c, path)
