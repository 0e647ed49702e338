"""The text of a chat message: plain, or the decoded strings of a JSON event list."""

from __future__ import annotations

import json

_BLANK = " \t\r\n\ufeff"

#: What the start of a JSON event list looks like; other brackets open plain text.
_OBJECT_STARTS = ('{"', "{}")
_LIST_STARTS = ('[{', "[]", '["', "[[", "[null")


def _refuse(name: str):
    raise ValueError(name)


def _looks_json(s: str) -> bool:
    """Whether text means to be JSON: bracket and quote right at its start, blanks aside."""
    if s[:1] not in "[{":
        return False
    head = "".join(s[:64].split())
    if head.startswith(_OBJECT_STARTS) or head.startswith(_LIST_STARTS):
        return True
    return head in ("{", "[")  # cut off right after it began


def decode(content: str | None) -> tuple[str, object]:
    """('null' | 'plain' | 'json' | 'broken', value).

    JSON encoded twice counts as if once.  Text that begins as an event list does but cannot be
    read to its end is 'broken'; any other unreadable text is plain.
    """
    if content is None:
        return "null", None
    s = content.strip(_BLANK)
    for _ in range(8):
        if s[:1] == '"' and (_looks_json(s[1:200].replace('\\"', '"').replace("\\n", " ").lstrip())):
            pass
        elif not _looks_json(s):
            return "plain", content
        try:
            v = json.loads(s, parse_constant=_refuse)
        except (ValueError, RecursionError):
            return "broken", None
        if not isinstance(v, str):
            return "json", v
        s = v.strip(_BLANK)
    return "broken", None


def spoken_text(content: str | None) -> tuple[str | None, bool]:
    """(text, broken): the plain content, or the joined ``text`` of its content events.

    A lone event counts as a list of one.  Events of other types, and text that is no string, add
    nothing.
    """
    kind, v = decode(content)
    if kind == "null":
        return None, False
    if kind == "plain":
        return content, False
    if kind == "broken":
        return None, True
    events = v if isinstance(v, list) else [v]
    return "".join(e["text"] for e in events if isinstance(e, dict) and e.get("type") == "content" and isinstance(e.get("text"), str)), False
