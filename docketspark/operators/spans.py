"""Selections over spans and positions, as folds over bounded arrays, and dictionary matching."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DICTIONARY_BYTES = 32 << 20


def greedy_spans(spans: Column) -> Column:
    """Spans (start, end, ...) left to right, of equal starts the longest; later overlapping ones dropped.

    ``spans`` is one text's array; the fold carries the chosen ones, so no pair of spans is made.
    """
    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).when(a["end"] != b["end"], F.when(a["end"] > b["end"], -1).otherwise(1)).otherwise(0))
    return F.aggregate(ordered, F.slice(ordered, 1, 0), lambda kept, s: F.when((F.size(kept) == 0) | (s["start"] >= F.element_at(kept, -1)["end"]), F.concat(kept, F.array(s))).otherwise(kept))


def reaching_spans(spans: Column) -> Column:
    """Left to right by start; a later overlapping span that reaches further takes the place of the one before."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).when(a["end"] != b["end"], F.when(a["end"] > b["end"], -1).otherwise(1)).otherwise(0))

    def step(kept: Column, s: Column) -> Column:
        last = F.element_at(kept, -1)
        return (
            F.when((F.size(kept) == 0) | (s["start"] >= last["end"]), F.concat(kept, F.array(s)))
            .when(s["end"] > last["end"], F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(s)))
            .otherwise(kept)
        )

    return F.aggregate(ordered, F.slice(ordered, 1, 0), step)


def nearest_occurrence(positions: Column, hint: Column, occurrence: Column) -> Column:
    """The occurrence asked for if there is such a one, else the position nearest the hint (the earlier on
    ties), else the first; null without positions."""
    asked = F.when((occurrence >= 0) & (occurrence < F.size(positions)), positions[occurrence])
    near = F.array_min(F.transform(positions, lambda p: F.struct(F.abs(p - hint).alias("d"), p.alias("p"))))["p"]
    return F.coalesce(asked, F.when(hint.isNotNull(), near), F.when(F.size(positions) > 0, positions[0]))


def occurrences(text: Column, needle: Column) -> Column:
    """Start positions (from 0) of the non-overlapping occurrences of ``needle``; empty for an empty needle.

    Lengths of what lies between the occurrences give the positions: one split, one fold.
    """
    parts = F.split(text, F.concat(F.lit(r"\Q"), needle, F.lit(r"\E")), -1)
    step = F.aggregate(
        F.slice(parts, F.lit(1), F.size(parts) - 1), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, p: F.struct((acc["at"] + F.length(p) + F.length(needle)).alias("at"), F.concat(acc["out"], F.array(acc["at"] + F.length(p))).alias("out")),
        lambda acc: acc["out"],
    )
    return F.when(F.length(needle) > 0, step).otherwise(F.array().cast("array<int>"))


def match_dictionary(df: DataFrame, id_col: str, text_col: str, terms: list[tuple[str, str, bool]]) -> DataFrame:
    """id, label, term, start, end of every occurrence of every term, overlaps kept.

    ``terms``: (term, label, case-sensitive); the list is sent to the tasks, so its size is checked.
    One pass of an automaton over each text; case-insensitive terms are matched in lower case.
    """
    if sum(len(t.encode()) for t, _, _ in terms) > MAX_DICTIONARY_BYTES:
        raise ValueError("the dictionary is too large to send with each task")
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_text IS NOT NULL")
    kind = rows.schema["_id"].dataType.simpleString()

    def automata():
        import ahocorasick

        out = []
        for exact in (True, False):
            a, by = ahocorasick.Automaton(), {}
            for t, label, sensitive in terms:
                if t and sensitive == exact:
                    by.setdefault(t if exact else t.lower(), []).append((t, label))
            for k, v in by.items():
                a.add_word(k, (len(k), v))
            if by:
                a.make_automaton()
                out.append((exact, a))
        return out

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automata()
        for b in it:
            cols: list[list] = [[], [], [], [], []]
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                low = text.lower()
                same = len(low) == len(text)
                for exact, a in found:
                    body = text if exact else low if same else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
                    for end, (n, hits) in a.iter(body):
                        for term, label in hits:
                            for c, x in zip(cols, (i, label, term, end + 1 - n, end + 1)):
                                c.append(x)
            kinds = [b.column(0).type, pa.string(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["_id", "label", "term", "start", "end"])

    return rows.mapInArrow(run, f"_id {kind}, label string, term string, start int, end int").withColumnRenamed("_id", id_col)


def anchor(passage: Column, source: Column) -> Column:
    """struct(anchor, start, stop, note): the first place of a passage in its source.

    note: 'no_source' without a source, 'normalised' where the passage does not stand there verbatim, 'ambiguous'
    where it stands there more than once; else null.
    """
    has = source.isNotNull()
    at = F.when(has & (passage != ""), F.call_function("locate", passage, source)).otherwise(0)
    more = F.when(at > 0, F.call_function("locate", passage, source, at + F.length(passage))).otherwise(0)
    found = at > 0
    return F.struct(
        F.when(found, "exact").otherwise("none").alias("anchor"), F.when(found, (at - 1).cast("long")).alias("start"), F.when(found, (at - 1 + F.length(passage)).cast("long")).alias("stop"),
        F.when(~has, "no_source").when(~found, "normalised").when(more > 0, "ambiguous").alias("note"),
    )
