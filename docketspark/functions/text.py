"""Text and date functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Quote marks and dashes that are read as one.
QUOTES = r"[“”„‟«»‘’‚‛']"
DASHES = r"[‐‑‒–—―−]"


def normalize_quote(c: Column) -> Column:
    """Line-break hyphens joined, quotes and dashes unified, lower case, blanks collapsed."""
    c = F.regexp_replace(c, r"-[ \t]*\r?\n[ \t]*", "")
    c = F.regexp_replace(c, QUOTES, '"')
    c = F.regexp_replace(c, DASHES, "-")
    return F.trim(F.regexp_replace(F.lower(c), r"[\s\u00a0]+", " "))


def split_gaps(c: Column) -> Column:
    """Parts between '...' or '[...]', trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(c, r"\[\.\.\.\]|\.\.\."), lambda x: F.trim(x)), lambda x: x != "")


def banded_distance(a: Column, b: Column, band: int = 40) -> Column:
    """Levenshtein distance; the longer length where the lengths differ by more than the band."""
    far = F.abs(F.length(a) - F.length(b)) > band
    return F.when(far, F.greatest(F.length(a), F.length(b))).otherwise(F.levenshtein(a, b))


def count_of(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences."""
    return F.when(F.lit(needle) == "", 0).otherwise(((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / max(len(needle), 1)).cast("long"))


def terms(c: Column) -> Column:
    """Search tokens: runs of letters and digits of the lower-case text."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), 1)


def stem(term: Column) -> Column:
    """Letters-only terms of 7 and more lose min(3, length - 5) letters; others stay."""
    n = F.length(term)
    return F.when((n >= 7) & term.rlike(r"^\p{L}+$"), F.substring(term, F.lit(1), n - F.least(F.lit(3), n - 5))).otherwise(term)


def excerpt(text: Column, start: Column, length: Column, context: int) -> Column:
    """``context`` characters either side of a span (start from 0), an ellipsis where cut, blanks collapsed."""
    a = F.greatest(start - context, F.lit(0))
    z = F.least(start + length + context, F.length(text))
    body = F.trim(F.regexp_replace(F.substring(text, a + 1, z - a), r"[\s\p{Z}]+", " "))
    return F.concat(F.when(a > 0, "…").otherwise(""), body, F.when(z < F.length(text), "…").otherwise(""))


def clip(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def slug(c: Column, fallback: str = "note", limit: int = 80) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9_-]+", "-"), r"^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(s, 1, limit), F.lit("")), F.lit(fallback))


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def strip_controls(c: Column, limit: int | None = None) -> Column:
    """Without control characters but tab, line feed and return; cut only where a limit is asked for."""
    s = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return F.substring(s, 1, limit) if limit else s


def ocr_quality(c: Column) -> Column:
    """Share of letters and digits among what is no blank; 0 for texts with fewer than 20 such characters."""
    solid = F.length(F.regexp_replace(c, r"\s", ""))
    good = F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    return F.when(solid < 20, 0.0).otherwise(good / solid)


def dotted_date(c: Column) -> Column:
    """First d.m.yyyy as yyyy-mm-dd, '' if none."""
    p = r"\b(\d{1,2})\.(\d{1,2})\.(\d{4})\b"
    d, m, y = (F.regexp_extract(c, p, i) for i in (1, 2, 3))
    return F.when(y == "", "").otherwise(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))


#: Polish month names in the genitive, with and without diacritics.
MONTHS = {
    "stycznia": 1, "lutego": 2, "marca": 3, "kwietnia": 4, "maja": 5, "czerwca": 6, "lipca": 7, "sierpnia": 8, "września": 9, "wrzesnia": 9, "października": 10, "pazdziernika": 10,
    "listopada": 11, "grudnia": 12,
}


def worded_date(c: Column) -> Column:
    """First 'd month yyyy' with a Polish month name as yyyy-mm-dd, '' if none."""
    p = rf"\b(\d{{1,2}}) ({'|'.join(MONTHS)}) (\d{{4}})\b"
    d, m, y = (F.regexp_extract(c, p, i) for i in (1, 2, 3))
    month = F.create_map(*(F.lit(x) for name, no in MONTHS.items() for x in (name, f"{no:02d}")))[m]
    return F.when(y == "", "").otherwise(F.concat_ws("-", y, month, F.lpad(d, 2, "0")))


def suspect_dates(c: Column, this_year: Column) -> Column:
    """Distinct dotted dates of a text whose year is before 1900 or after the next one."""
    dates = F.array_distinct(F.regexp_extract_all(c, F.lit(r"\b(\d{1,2}\.\d{1,2}\.\d{4})\b"), 1))
    return F.filter(dates, lambda x: (F.right(x, F.lit(4)).cast("int") < 1900) | (F.right(x, F.lit(4)).cast("int") > this_year + 1))


def is_iso_date(c: Column) -> Column:
    """Whether a text opens with a real calendar day as yyyy-mm-dd; null counts as no."""
    day = F.left(c, F.lit(10))
    return F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}(?:$|[T ])") & F.try_to_date(day, "yyyy-MM-dd").isNotNull(), F.lit(False))


def age_seconds(ts: Column, anchor: Column) -> Column:
    """Whole seconds from ``ts`` to ``anchor``."""
    return F.floor((F.unix_micros(anchor.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 1_000_000).cast("long")


def within_last(ts: Column, anchor: Column, interval: str) -> Column:
    """Whether ``ts`` is in the rolling window of ``interval`` (such as '24 HOURS') up to ``anchor``."""
    return (ts > anchor - F.expr(f"INTERVAL {interval}")) & (ts <= anchor)


def text_window(c: Column, offset: Column, limit: Column, hard: int = 200_000) -> Column:
    """struct(text, offset, limit, total, next_offset, truncated): offset clamped to the text, limit to 1..hard.

    Following next_offset until it is null reads the whole text.
    """
    total = F.length(c)
    start = F.least(F.greatest(offset, F.lit(0)), total)
    most = F.least(F.greatest(limit, F.lit(1)), F.lit(hard))
    end = F.least(start + most, total)
    return F.struct(
        F.substring(c, start + 1, end - start).alias("text"), start.alias("offset"), most.alias("limit"), total.alias("total"),
        F.when(end < total, end).alias("next_offset"), ((start > 0) | (end < total)).alias("truncated"),
    )


def folded_pattern(query: str) -> str:
    """A pattern that finds a phrase whatever its case and white space."""
    import re

    return r"(?iu)" + r"[\s\p{Z}]+".join(re.escape(w) for w in query.split())


def find_phrase(c: Column, query: str, most: int = 20, context: int = 80) -> Column:
    """struct(total, truncated, hits: array of struct(index, start, excerpt, context)) of a phrase in a text.

    Offsets are those of the raw text: they are the lengths of what stands between the matches, added up.
    """
    p = folded_pattern(query)
    found = F.regexp_extract_all(c, F.lit(f"({p})"), 1) if query.split() else F.array().cast("array<string>")
    between = F.split(c, p, -1)
    lengths = F.zip_with(between, found, lambda a, b: F.struct(F.length(a).alias("gap"), F.length(b).alias("hit")))
    ends = F.aggregate(
        F.slice(lengths, F.lit(1), F.size(found)), F.array().cast("array<int>"),
        lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x["gap"] + x["hit"])),
    )
    starts = F.zip_with(ends, found, lambda e, x: e - F.length(x))
    shown = F.slice(F.arrays_zip(starts.alias("s"), found.alias("x")), F.lit(1), F.lit(most))
    hits = F.transform(shown, lambda h, i: F.struct(i.alias("index"), h["s"].alias("start"), h["x"].alias("excerpt"), excerpt(c, h["s"], F.length(h["x"]), context).alias("context")))
    return F.struct(F.size(found).alias("total"), (F.size(found) > most).alias("truncated"), hits.alias("hits"))


def html_to_markdown(c: Column) -> Column:
    """Headings, strong, list items and paragraphs as markdown; other tags dropped, four entities decoded."""
    for n in range(1, 7):
        c = F.regexp_replace(c, rf"(?is)<h{n}[^>]*>(.*?)</h{n}>", "\n" + "#" * n + " $1\n")
    c = F.regexp_replace(c, r"(?is)<(?:strong|b)>(.*?)</(?:strong|b)>", "**$1**")
    c = F.regexp_replace(c, r"(?is)<li[^>]*>(.*?)</li>", "- $1\n")
    c = F.regexp_replace(c, r"(?i)</p>|<br ?/?>", "\n\n")
    c = F.regexp_replace(c, r"<[^>]+>", "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def repetition_ratio(c: Column, least: int = 100) -> Column:
    """1 - distinct / all sentences longer than 10 characters; null under ``least`` sentences."""
    s = F.filter(F.transform(F.split(c, r"[.!?\n]+"), lambda x: F.trim(x)), lambda x: F.length(x) > 10)
    low = F.transform(s, lambda x: F.lower(x))
    return F.when(F.size(s) >= least, 1 - F.size(F.array_distinct(low)) / F.size(s))


#: Zero-width characters, and letters that mix scripts within a word.
ZERO_WIDTH = r"[\u200b\u200c\u200d\u2060\ufeff\u00ad]"


def zero_width_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(ZERO_WIDTH)).cast("long")


def mixed_script_words(c: Column) -> Column:
    """Words of two and more letters that hold a Latin letter and a Cyrillic or Greek one."""
    words = F.filter(F.split(c, r"[^\p{L}]+"), lambda w: (F.length(w) > 1) & w.rlike("[A-Za-z]") & w.rlike(r"[Ͱ-ϿЀ-ӿ]"))
    return F.size(words).cast("long")


def inline_citations(c: Column) -> Column:
    """Array of (page, quote) from [[page:N||quote:...]] marks; blank quotes dropped."""
    p = r"\[\[page:([^|\]]*)\|\|quote:([^\]]*)\]\]"
    pages, quotes = F.regexp_extract_all(c, F.lit(p), 1), F.regexp_extract_all(c, F.lit(p), 2)
    return F.filter(F.zip_with(pages, quotes, lambda a, b: F.struct(F.trim(a).alias("page"), F.trim(b).alias("quote"))), lambda x: x["quote"] != "")


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common start of two texts: first unequal place of the zipped characters."""
    short = F.least(F.length(a), F.length(b))
    equal = F.zip_with(F.split(F.substring(a, F.lit(1), short), ""), F.split(F.substring(b, F.lit(1), short), ""), lambda x, y: x == y)
    first = F.array_position(equal, False)
    return F.when(first == 0, short).otherwise(first.cast("int") - 1)


def trim_common(a: Column, b: Column) -> tuple[Column, Column]:
    """(deleted, inserted): what is left of both texts without their common start and end."""
    head = common_prefix(a, b)
    rest_a, rest_b = F.substring(a, head + 1, F.length(a)), F.substring(b, head + 1, F.length(b))
    tail = common_prefix(F.reverse(rest_a), F.reverse(rest_b))
    return F.substring(rest_a, F.lit(1), F.length(rest_a) - tail), F.substring(rest_b, F.lit(1), F.length(rest_b) - tail)
