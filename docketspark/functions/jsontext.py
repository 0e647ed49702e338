"""Strict reading of JSON text that may be encoded more than once."""

from __future__ import annotations

import json

_BLANK = " \t\r\n\ufeff"


def _refuse(name: str):
    raise ValueError(name)


def read_json(text: str | None):
    """(readable, value).  A string value that is itself JSON of an object, list or string is opened again.

    Blank, cut off or otherwise unreadable text - NaN and Infinity included, and nesting beyond
    the parser's depth - gives (False, None), as does text whose value is no object or list.
    """
    if text is None:
        return False, None
    s = text.strip(_BLANK)
    while s[:1] in ("{", "[", '"'):
        try:
            v = json.loads(s, parse_constant=_refuse)
        except (ValueError, RecursionError):
            return False, None
        if not isinstance(v, str):
            return True, v
        s = v.strip(_BLANK)
    return False, None
