"""Marks inside texts: pills, citation placeholders and blocks, claims, quotations, labels, judge replies."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

PILL = r"\[\[(.*?)\]\]"
CITATION_MARK = r"\[\[page:[^|\]]*\|\|quote:[^\]]*\]\]"

#: Bounds of a quotation that counts, and of a claim.
INLINE_WORDS, INLINE_CHARS, BLOCK_WORDS, MAX_QUOTES, MAX_QUOTE_CHARS = 5, 25, 3, 40, 600
CLAIM_WINDOW, CLAIM_CHARS = 250, 600

#: Verdicts and confidences a judge may give, and the status words of a check.
VERDICTS, CONFIDENCES = ("tak", "czesciowo", "nie"), ("wysoka", "srednia", "niska")


def pill_segments(c: Column) -> Column:
    """Array of struct(text, pill): the text before each [[pill]], and at last the text after them with a null pill."""
    texts = F.split(c, r"\[\[.*?\]\]", -1)
    pills = F.regexp_extract_all(c, F.lit(PILL), 1)
    return F.transform(texts, lambda t, i: F.struct(t.alias("text"), F.get(pills, i).alias("pill")))


def placeholders(c: Column) -> Column:
    """The text with §0§, §1§ ... in place of its citation marks."""
    texts = F.split(c, CITATION_MARK, -1)
    last = F.size(texts) - 1
    return F.array_join(F.transform(texts, lambda t, i: F.when(i < last, F.concat(t, F.lit("§"), i.cast("string"), F.lit("§"))).otherwise(t)), "")


def label_value(c: Column) -> Column:
    """A label value with backslashes, quotes and line feeds escaped."""
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def claim(text: Column, ref: Column) -> Column:
    """What stands around the mark [ref] before any citation block: 250 characters each side, no further than its line; '' without the mark."""
    prose = F.split(text, r"(?i)<CITATIONS", 2)[0]
    mark = F.concat(F.lit("["), ref.cast("string"), F.lit("]"))
    at = F.call_function("locate", mark, prose)
    line_start = at - F.length(F.substring_index(F.left(prose, at - 1), "\n", -1))
    start = F.greatest(at - CLAIM_WINDOW, F.lit(1), line_start)
    end = F.least(at + F.length(mark) + CLAIM_WINDOW, F.length(prose) + 1, at + F.length(F.substring_index(F.substring(prose, at, F.length(prose)), "\n", 1)))
    return F.when(F.coalesce(at, F.lit(0)) == 0, "").otherwise(F.left(F.trim(F.substring(prose, start, end - start)), F.lit(CLAIM_CHARS)))


def citation_block(text: Column) -> Column:
    """Array of struct(ref, doc_id, page, quote) from the JSON list between <CITATIONS> tags.

    ref is a number or a '[n]' mark; page a number, a range 'a-b', or 1.  Rows without ref, doc_id or
    quote are left out; no block or unreadable JSON gives an empty array.
    """
    body = F.regexp_extract(text, r"(?s)<CITATIONS>\s*(.*?)\s*</CITATIONS>", 1)
    rows = F.from_json(F.when(body.startswith("["), body), "array<struct<ref:string,marker:string,doc_id:string,page:string,quote:string,text:string>>")

    def one(r: Column) -> Column:
        ref = F.coalesce(r["ref"].try_cast("int"), F.regexp_extract(r["marker"], r"^\[(\d+)\]$", 1).try_cast("int"))
        page = F.when(r["page"].rlike(r"^\d+\s*-\s*\d+$"), r["page"]).otherwise(F.coalesce(F.nullif(F.regexp_extract(r["page"], r"^\s*(\d+)", 1), F.lit("")), F.lit("1")))
        return F.struct(ref.alias("ref"), r["doc_id"].alias("doc_id"), page.alias("page"), F.coalesce(r["quote"], r["text"]).alias("quote"))

    good = F.filter(F.transform(rows, one), lambda x: x["ref"].isNotNull() & x["doc_id"].isNotNull() & (F.coalesce(F.length(x["quote"]), F.lit(0)) > 0))
    return F.coalesce(good, F.array().cast("array<struct<ref:int,doc_id:string,page:string,quote:string>>"))


def judge_reply(raw: Column) -> Column:
    """struct(verdict, confidence, reason), code fences taken off; null where a field is missing or no known word."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.trim(raw), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", ""))
    x = F.from_json(clean, "struct<verdict:string,confidence:string,uzasadnienie:string>")
    ok = x["verdict"].isin(*VERDICTS) & x["confidence"].isin(*CONFIDENCES)
    return F.when(ok, F.struct(x["verdict"].alias("verdict"), x["confidence"].alias("confidence"), F.coalesce(x["uzasadnienie"], F.lit("")).alias("reason")))


_BLOCK = re.compile(r"<CITATIONS>[\s\S]*?(?:</CITATIONS>|$)")
_INLINE = re.compile(r"[„\"«]([^„\"”«»\n]{10,}?)[”\"»]")
_QUOTED_LINE = re.compile(r"\s*>\s?(.*)$")


def _plain(s: str) -> str:
    """Without reference marks, emphasis and a list bullet."""
    s = re.sub(r"\[\d+(?:\s*,\s*\d+)*\]", "", s)
    return re.sub(r"^\s*[-*]\s+", "", re.sub(r"[*_`]+", "", s)).strip()


def quoted_spans(text: str | None, fold) -> list[tuple[str, str]]:
    """(quote, 'blockquote' | 'inline') of an answer, block quotations first; equal ones (by ``fold``) once.

    Block quotations need 3 words, inline ones 25 characters and 5 words; a quote has up to 600 characters, an
    answer up to 40.  These bounds are the feature: they say what counts as a quotation.
    """
    found: dict[str, tuple[str, str]] = {}

    def add(raw: str, kind: str) -> None:
        q = raw.strip()[:MAX_QUOTE_CHARS]
        if key := fold(q):
            found.setdefault(key, (q, kind))

    lines = re.split(r"\r?\n", _BLOCK.sub("", text or ""))
    block: list[str] = []
    rest: list[str] = []
    for line in [*lines, None]:
        m = _QUOTED_LINE.match(line) if line is not None else None
        if m:
            block += [m.group(1).strip()] if m.group(1).strip() else []
            continue
        if block:
            joined = re.sub(r"[”\"“»‘']+$", "", re.sub(r"^[„\"“«‚']+", "", _plain(" ".join(block)))).strip()
            if len(joined.split()) >= BLOCK_WORDS:
                add(joined, "blockquote")
            block = []
        if line is not None:
            rest.append(line)
    for m in _INLINE.finditer("\n".join(rest)):
        q = _plain(m.group(1))
        if len(q) >= INLINE_CHARS and len(q.split()) >= INLINE_WORDS:
            add(q, "inline")
    return list(found.values())[:MAX_QUOTES]
