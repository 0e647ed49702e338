"""Checking quotations against their sources: exact parts first, fuzzy windows for what is left."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketspark.functions.text import DASHES, QUOTES, normalize_quote, split_gaps

#: The statuses of a check.
VERIFIED, MODIFIED, UNVERIFIED, NO_SOURCE = "verified", "modified", "unverified", "no_source"


def parts_in_order(source: Column, parts: Column) -> Column:
    """Whether all parts occur in the source one after the other: a native fold of positions."""
    end = F.aggregate(parts, F.lit(1), lambda at, p: F.when(at == 0, 0).otherwise(_next(source, p, at)))
    return end > 0


def _next(source: Column, part: Column, at: Column) -> Column:
    found = F.call_function("locate", part, source, at)
    return F.when(found == 0, 0).otherwise(found + F.length(part))


def check_exact(pairs: DataFrame, quote_col: str, source_col: str, source_is_normal: bool = False) -> DataFrame:
    """``pairs`` with ``status``: no_source (blank quote or source), verified, or null for the fuzzy stage.

    Both sides are normalised natively; a source that many quotes share should come normalised.  A quote with
    gaps must have its parts in order.
    """
    quote, source = normalize_quote(F.col(quote_col)), F.col(source_col)
    with_norm = pairs.withColumn("_q", quote).withColumn("_s", source if source_is_normal else normalize_quote(source))
    blank = F.coalesce(F.col("_q") == "", F.lit(True)) | F.coalesce(F.col("_s") == "", F.lit(True))
    parts = split_gaps(F.col("_q"))
    hit = F.when(F.size(parts) == 1, F.col("_s").contains(parts[0])).otherwise(parts_in_order(F.col("_s"), parts))
    return with_norm.withColumn("status", F.when(blank, NO_SOURCE).when(hit, VERIFIED))


def window_ratio(source: str, part: str, enough: float = 0.0) -> float:
    """Least edit distance of the part to any window of the source, over its length.

    One dynamic programme over the whole source with free start and end (semi-global alignment), so
    windows of every length are covered at once.  Its columns are the bits of two integers (Myers 1999):
    where the distance goes up, and where down, from one character of the part to the next.
    """
    n = len(part)
    if not n:
        return 0.0
    if not source:
        return 1.0
    places: dict[str, int] = {}
    for j, ch in enumerate(part):
        places[ch] = places.get(ch, 0) | 1 << j
    full, last = (1 << n) - 1, 1 << (n - 1)
    up, down, now, best = full, 0, n, n
    for ch in source:
        equal = places.get(ch, 0)
        flat = equal | down
        level = (((equal & up) + up) ^ up) | equal
        more, less = down | (full & ~(level | up)), up & level
        if more & last:
            now += 1
        elif less & last:
            now -= 1
            if now < best:
                best = now
                if best <= enough:
                    break
        more = more << 1 & full
        up, down = (less << 1 & full) | (full & ~(flat | more)), more & flat
    return best / n


GRAM = 4


def _grams(text: str) -> np.ndarray:
    """The runs of GRAM characters of a text as numbers; different runs may share a number, which only weakens the filter."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    if len(codes) < GRAM:
        return codes[:0]
    out = np.zeros(len(codes) - GRAM + 1, dtype=np.uint64)
    for k in range(GRAM):
        out = out * np.uint64(0x1_0F_0F_0F_07) + codes[k : k + len(out)]
    return out


class Source:
    """A normalised source with its runs of GRAM characters in order of their numbers."""

    def __init__(self, text: str):
        self.text = text
        grams = _grams(text)
        self.order = np.argsort(grams, kind="stable")
        self.sorted = grams[self.order]

    def windows(self, part: str, errors: int) -> list[tuple[int, int]]:
        """Stretches that hold every window within ``errors`` edits of the part; none means there is no such window.

        A window within e edits shares at least n + 1 - q - q * e runs of q characters with the part, all on
        diagonals (place in the source minus place in the part) that differ by 2 e at most.
        """
        n, m = len(part), len(self.text)
        least = n + 1 - GRAM - GRAM * errors
        if least < 1 or m < GRAM:  # too short for the filter: the whole source
            return [(0, m)]
        mine = _grams(part)
        lo, hi = np.searchsorted(self.sorted, mine, "left"), np.searchsorted(self.sorted, mine, "right")
        count = hi - lo
        total = int(count.sum())
        if total < least:
            return []
        first = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(total)
        diagonal = self.order[first] - np.repeat(np.arange(len(mine)), count) + n
        upto = np.concatenate([[0], np.cumsum(np.bincount(diagonal, minlength=m + n + 1))])
        width = 2 * errors + 1
        start = np.arange(len(upto) - 1)
        near = upto[np.minimum(start + width, len(upto) - 1)] - upto[start]
        good = np.flatnonzero(near >= least)
        out: list[tuple[int, int]] = []
        for d in good.tolist():  # diagonals d .. d + width - 1 in shifted numbers
            a, z = max(0, d - n - errors), min(m, d - n + width + n + errors)
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], z)
            else:
                out.append((a, z))
        return out

    def ratio(self, part: str, limit: float, beyond: bool = False) -> float | None:
        """window_ratio() where it is at most ``limit``, else null; ``beyond`` asks for it in any case."""
        if beyond:
            return window_ratio(self.text, part)
        errors = int(limit * len(part) + 1e-9)
        best = min((window_ratio(self.text[a:z], part) for a, z in self.windows(part, errors)), default=1.0)
        return best if best <= limit else None


def check_fuzzy(left: DataFrame, keep: list[str], limit: float = 0.15, beyond: bool = False) -> DataFrame:
    """``keep``, ratio and status of pairs that are not verbatim: modified up to ``limit``, else unverified.

    ``left`` holds the normalised _q and _s of check_exact.  ratio is the worst of the parts' edit distances to
    their nearest windows anywhere in the source, over their lengths; null beyond the limit, unless ``beyond`` asks
    for it there too.  Only stretches that share enough runs of characters with a part are aligned, which loses no
    window within the limit; with ``beyond`` the whole source is.
    """
    kinds = ", ".join(f"`{c}` {left.schema[c].dataType.simpleString()}" for c in keep)

    def run(it: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        indexed = lru_cache(64)(Source)  # quotes of one source mostly come together
        for pdf in it:
            worst: list[float | None] = []
            for q, s in zip(pdf["_q"], pdf["_s"]):
                parts = [p.strip() for p in q.replace("[...]", "...").split("...") if p.strip()]
                source, w = indexed(s), 0.0 if parts else None
                for p in parts:
                    r = source.ratio(p, limit, beyond)
                    if r is None:
                        w = None
                        break
                    w = max(w, r)
                worst.append(w)
            out = pdf[keep].copy()
            out["ratio"] = pd.array(worst, dtype="Float64")
            out["status"] = [UNVERIFIED if r is None or r > limit else MODIFIED for r in worst]
            yield out

    return left.select(*keep, "_q", "_s").mapInPandas(run, f"{kinds}, ratio double, status string")


def check_quotes(pairs: DataFrame, quote_col: str, source_col: str, keep: list[str], limit: float = 0.15) -> DataFrame:
    """``keep``, ratio and status of every pair: the exact stage natively, the fuzzy one for what is left.

    ``source_col`` is normalised.  ratio is 0 for verified pairs, null for unverified and sourceless ones.
    """
    r = check_exact(pairs, quote_col, source_col, True)
    done = r.where("status IS NOT NULL").select(*keep, F.when(F.col("status") == VERIFIED, 0.0).alias("ratio"), "status")
    return done.unionByName(check_fuzzy(r.where("status IS NULL"), keep, limit))


#: What a status decides, its colour, the judge's confidences, and the tags and labels of source kinds.
DECISIONS = {VERIFIED: "verified", MODIFIED: "unverified", UNVERIFIED: "blocked", NO_SOURCE: "blocked"}
COLOURS = {VERIFIED: "green", MODIFIED: "yellow", UNVERIFIED: "red", NO_SOURCE: "red"}
TAGS = {"saos": "saos", "isap": "isap", "eurlex": "eurlex", "client-doc": "uzytkownik", "none": "model"}
TAG_LABELS = {"saos": "SAOS", "isap": "ISAP/ELI", "eurlex": "EUR-Lex", "uzytkownik": "uzytkownik", "model": "model - zweryfikuj"}


def _map(values: dict[str, str], c: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[c]


def decision(status: Column) -> Column:
    return _map(DECISIONS, status)


def verdict(status: Column, judge: Column | None = None) -> Column:
    """Colour of a check.  A judge's 'nie' is red, 'czesciowo' yellow, 'tak' green only for verbatim text; sourceless text is not judged."""
    text = _map(COLOURS, status)
    if judge is None:
        return text
    judged = F.when(judge == "nie", "red").when(judge == "czesciowo", "yellow").when(judge == "tak", F.when(status == VERIFIED, "green").otherwise("yellow"))
    return F.when(status == NO_SOURCE, text).otherwise(F.coalesce(judged, text))


def needs_judgment(status: Column, claim: Column, judge: Column) -> Column:
    """Whether a claim with a source is still without a judge's word."""
    return (F.coalesce(F.length(claim), F.lit(0)) > 0) & (status != NO_SOURCE) & judge.isNull()


def confidence(status: Column, ratio: Column) -> Column:
    """1 for verbatim text, else 1 - ratio within 0..1; an unknown ratio counts as 1."""
    return F.when(status == VERIFIED, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.coalesce(ratio, F.lit(1.0)))))


def provenance(kind: Column, pinpoint: Column) -> tuple[Column, Column]:
    """(tag, label) of a source kind; a pinpoint asks for a check."""
    tag = _map(TAGS, kind)
    base = _map(TAG_LABELS, tag)
    return tag, F.when((tag != "model") & pinpoint, F.concat(base, F.lit(" - zweryfikuj"))).otherwise(base)


def card_verdict(green: Column, yellow: Column, red: Column, has_text: Column) -> tuple[Column, Column]:
    """(colour, reason) of a source card from the counts of its quotes."""
    colour = F.when(~has_text, "yellow").when((red > 0) & (green == 0), "red").when(green > 0, "green").otherwise("yellow")
    reason = F.when(~has_text, "no_source").when((red > 0) & (green == 0), "quote_not_found").when(green > 0, "quote_found").when(yellow > 0, "quote_modified").otherwise("no_quote")
    return colour, reason


def cell_grounding(checks: DataFrame, by: str) -> DataFrame:
    """One row a cell: total, verified, modified, unverified, needs_review, and the worst status."""

    def n(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    per = checks.groupBy(by).agg(F.count("*").alias("total"), n(VERIFIED).alias("verified"), n(MODIFIED).alias("modified"), n(UNVERIFIED).alias("unverified"), n(NO_SOURCE).alias("needs_review"))
    status = F.when(F.col("needs_review") > 0, "needs_review").when(F.col("unverified") > 0, UNVERIFIED).when(F.col("modified") > 0, MODIFIED).otherwise(VERIFIED)
    return per.withColumn("status", status)


def grounding_totals(cells: DataFrame) -> DataFrame:
    """One row over the cells of cell_grounding()."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("verified", "modified", "unverified", "needs_review")]
    return cells.agg(
        F.count("*").alias("cells_grounded"), F.count_if(F.col("status") == UNVERIFIED).alias("cells_unverified"), F.count_if(F.col("status") == "needs_review").alias("cells_needs_review"),
        F.coalesce(F.sum("total"), F.lit(0)).alias("citations_total"), *sums,
    )


def find_quotations(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n, kind, quote: the quotations of every text in order; null texts have none."""
    from docketspark.functions.markup import quoted_spans

    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_text IS NOT NULL")
    kind = rows.schema["_id"].dataType.simpleString()

    def run(it: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = [(i, n, k, q) for i, t in zip(pdf["_id"], pdf["_text"]) for n, (q, k) in enumerate(quoted_spans(t, fold_quote))]
            yield pd.DataFrame(out, columns=["_id", "n", "kind", "quote"])

    return rows.mapInPandas(run, f"_id {kind}, n int, kind string, quote string").withColumnRenamed("_id", id_col)


_JOIN, _QUOTES, _DASHES, _BLANKS = (re.compile(p) for p in (r"-[ \t]*\r?\n[ \t]*", QUOTES, DASHES, r"\s+"))


def fold_quote(s: str) -> str:
    """normalize_quote() of plain Python text."""
    return _BLANKS.sub(" ", _DASHES.sub("-", _QUOTES.sub('"', _JOIN.sub("", s))).lower()).strip()
