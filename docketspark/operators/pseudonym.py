"""Reversible pseudonyms shared over a conversation, without gathering a conversation.

Mentions are found by the entity rules; each distinct value of a (conversation, category) gets its number
by the order in which it first occurs - a distributed running count.  A value that is found once is
replaced wherever it stands in the conversation: the rows meet the conversation's values in parts of
bounded size, and one automaton a part runs over the texts.  The map stays a table, so the way back is a join.

Rows without a conversation are conversations of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketspark.operators.entities import RULES, Rule, detect
from docketspark.operators.ordered import line_up, with_running_sum
from docketspark.session import cut, shuffle_parallelism

#: Entity kinds that are pseudonymised, and the categories their tokens name.
CATEGORIES = {"PESEL": "PESEL", "NIP": "NIP", "REGON": "REGON", "KRS": "KRS", "EMAIL": "EMAIL", "PHONE": "PHONE", "OSOBA": "PERSON", "FIRMA": "ORG", "ADRES": "ADDRESS"}

#: The rules whose values are pseudonymised.
PRIVATE: tuple[Rule, ...] = tuple(r for r in RULES if r.kind in CATEGORIES)


def _own(conv: str = "conv_id") -> Column:
    """The conversation, or the row itself where it has none."""
    return F.coalesce(F.col(conv), F.concat(F.lit("\u0001"), "row_id"))


def token_map(messages: DataFrame, rules: tuple[Rule, ...] = PRIVATE) -> DataFrame:
    """_c, kind, value (normal form), raw (as written), token.  ``messages``: conv_id, row_id, seq, text, with row_id unique.

    _c is the conversation, or a key of the row's own where conv_id is null.  A value written in several ways
    has a row for each, with one token.
    """
    keyed = messages.select(F.struct("row_id", _own().alias("conv_id"), "seq").alias("k"), "text")
    category = F.create_map(*(F.lit(x) for kv in CATEGORIES.items() for x in kv))[F.col("kind")]
    hits = detect(keyed, "k", "text", rules).select(F.col("k.conv_id").alias("_c"), "k.row_id", "k.seq", "start", F.coalesce(category, "kind").alias("kind"), F.col("value_normalized").alias("value"), F.col("value").alias("raw"))
    mentions = cut(hits)
    first = mentions.groupBy("_c", "kind", "value").agg(F.min(F.struct("seq", "row_id", "start")).alias("at"))
    numbered = first.withColumn("_g", F.concat_ws("\u0001", "_c", "kind")).withColumn("_one", F.lit(1).cast("long"))
    counted = with_running_sum(line_up(numbered, "_g", ["at", "value"]), "_g", ["at", "value"], "_one", "_no")
    token = F.concat(F.lit("["), "kind", F.lit("_"), F.col("_no").cast("string"), F.lit("]"))
    return mentions.select("_c", "kind", "value", "raw").distinct().join(counted.select("_c", "kind", "value", token.alias("token")), ["_c", "kind", "value"])


def _matches(text: str, automaton: ahocorasick.Automaton) -> Iterator[tuple[int, int, str]]:
    """Values that stand in a text as whole words: leftmost first, of these the longest, without overlaps."""
    found = sorted((end - len(raw) + 1, -len(raw), token) for end, (raw, token) in automaton.iter(text) if not (raw[0].isalnum() and text[end - len(raw) : end - len(raw) + 1].isalnum() and end >= len(raw)) and not (raw[-1].isalnum() and text[end + 1 : end + 2].isalnum()))
    at = 0
    for start, less, token in found:
        if start >= at:
            at = start - less
            yield start, at, token


def _in_parts(rows: DataFrame, tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with _c and _part: a conversation of more than its share of all rows is cut in parts, and its values go to each."""
    total = rows.count()
    share = max(1, total // (4 * shuffle_parallelism(rows.sparkSession)))
    hot = rows.groupBy("_c").agg(F.count("*").alias("_n")).where(F.col("_n") > share)  # at most 4 x parallelism conversations
    parts = F.broadcast(hot.select("_c", F.ceil(F.col("_n") / share).cast("int").alias("_parts")))
    a = rows.join(parts, "_c", "left").withColumn("_part", F.pmod(F.xxhash64("row_id"), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    b = tokens.join(parts, "_c", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return a, b


def _scan(messages: DataFrame, tokens: DataFrame, schema: str, each) -> DataFrame:
    """``each(row, matches)`` for every message that its conversation's values meet, in one pass a part."""
    a, b = _in_parts(messages.withColumn("_c", _own()).select("_c", "row_id", "conv_id", "text"), tokens)

    def run(rows: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        automaton = ahocorasick.Automaton()
        for raw, token in zip(values["raw"], values["token"]):
            if raw:
                automaton.add_word(raw, (raw, token))
        automaton.make_automaton()
        out = []
        for r in rows.itertuples(index=False):
            known = isinstance(r.text, str) and len(automaton)
            out += each(r, list(_matches(r.text, automaton)) if known else [])
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return a.groupBy("_c", "_part").cogroup(b.groupBy("_c", "_part")).applyInPandas(run, schema)


def wrap(messages: DataFrame, rules: tuple[Rule, ...] = PRIVATE) -> tuple[DataFrame, DataFrame]:
    """(row_id, conv_id, text) with tokens in place of values, and the map of token_map().

    Every place of a value in its conversation is replaced, not only those the rules find; null texts stay null.
    """
    tokens = cut(token_map(messages, rules))

    def splice(r, found: list) -> list[tuple]:
        text, at, out = r.text, 0, []
        for start, end, token in found:
            out += [text[at:start], token]
            at = end
        return [(r.row_id, r.conv_id, "".join([*out, text[at:]]) if isinstance(text, str) else None)]

    return _scan(messages, tokens, "row_id string, conv_id string, text string", splice), tokens


def residue(wrapped: DataFrame, tokens: DataFrame) -> DataFrame:
    """row_id, value: originals of the conversation still present in a wrapped text; none is expected."""
    return _scan(wrapped, tokens, "row_id string, value string", lambda r, found: [(r.row_id, r.text[a:z]) for a, z, _ in found])
