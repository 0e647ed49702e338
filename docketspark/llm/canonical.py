"""One consistent form for texts that look the same but are written in different characters.

The quick-check idea of Unicode normalization: a character that maps to itself, is no
combining mark and cannot compose with what stands before it is stable, and a text of stable
characters is in canonical form already.  One regex pass isolates the unstable runs; a run is
normalised together with the one character before it (its boundary context: nothing further
left can change, nothing right of the run can compose with it) and spliced back.  Unchanged
text is never rebuilt, and repeated runs are looked up.

Brought together: width forms, ligatures and one-character Roman numerals with their letters;
composed and decomposed accents; kinds of blank and of line end; invisible characters (dropped);
look-alike letters of the Latin, Cyrillic and Greek scripts.  Kept apart: case, missing accents,
other digits, punctuation, raised and plain digits.
"""

from __future__ import annotations

import re
import unicodedata as ud
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketspark.session import cut, shuffle_parallelism, spread

#: Letters of other scripts and the letters they look like.
CYRILLIC = "АВЕЅІЈКМНОРСТУХҮԌԚԜӀѴаеорсухѕіјһԁԛԝӏүѵ"
CYRILLIC_LOOKS = "ABESIJKMHOPCTYXYGQWIVaeopcyxsijhdqwlyv"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿϒοαινρυγϲϳΓΠΦκ"
GREEK_LOOKS = "ABEZHIKMNOPTYXCJYoaivpuycjГПФк"
LATIN = "ɑɡ"
LATIN_LOOKS = "ag"

_LOOKS = dict(zip(CYRILLIC + GREEK + LATIN, CYRILLIC_LOOKS + GREEK_LOOKS + LATIN_LOOKS, strict=True))
_IGNORABLE = regex.compile(r"[\p{DI}\p{Cf}\p{Cc}--[\t\n\x0b\x0c\r\x85\u0600-\u0605\u06dd\u070f\u0890\u0891\u08e2\U000110bd\U000110cd]]", regex.V1)
_LINE_ENDS = regex.compile("\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
_NOTHING = regex.compile(r"[\s\p{Z}\p{Cc}\p{Cf}\p{DI}]*")


def _letter(c: str) -> str:
    """What one character of a decomposed text stands for; '' for an invisible one."""
    if _IGNORABLE.match(c):
        return ""
    if c == "\t" or ud.category(c) == "Zs":
        return " "
    kind, _, rest = ud.decomposition(c).partition(" ")
    point = ord(c)
    if kind in ("<wide>", "<narrow>") or (kind == "<compat>" and (0x2160 <= point <= 0x217F or 0xFB00 <= point <= 0xFB17 or point in (0x132, 0x133) or 0x1C4 <= point <= 0x1CC or 0x1F1 <= point <= 0x1F3)):
        return "".join(_letters(chr(int(x, 16))) for x in rest.split())
    return _LOOKS.get(c, c)


def _letters(s: str) -> str:
    return "".join(map(_letter_of, ud.normalize("NFD", s)))


@lru_cache(1 << 16)
def _letter_of(c: str) -> str:
    return _letter(c)


def normalise(s: str) -> str:
    """Canonical form of a whole string, without the quick check."""
    return ud.normalize("NFC", _LINE_ENDS.sub("\n", _letters(s)))


@lru_cache(1)
def _unstable_run() -> re.Pattern:
    """A run of unstable characters, each with the \\n after it (that of a \\r\\n)."""
    points, seconds = [], set()
    spans = ((0, 0x3400), (0xA000, 0xAC00), (0xD7B0, 0xD800), (0xE000, 0x20000), (0x2F800, 0x2FA20), (0xE0000, 0xE1000))
    for lo, hi in spans:
        for p in range(lo, hi):
            c = chr(p)
            d = ud.decomposition(c)
            if d and d[0] != "<" and " " in d:
                seconds.add(int(d.split()[1], 16))
            if p < 0x80 and p not in (9, 11, 12, 13, 127) and p >= 32 or p == 10:
                continue
            if ud.combining(c) or normalise(c) != c:
                points.append(p)
    points = sorted(set(points) | seconds | set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3)))
    parts, i = [], 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        parts.append(f"\\U{points[i]:08x}-\\U{points[j]:08x}")
        i = j + 1
    return re.compile(f"(?:[{''.join(parts)}]+\n?)+")


@lru_cache(1 << 16)
def _segment(s: str) -> str:
    return normalise(s)


def canonical_text(text: str) -> str:
    """Canonical form: only the unstable runs are normalised and spliced into the unchanged rest."""
    if text.isascii() and text.isprintable():
        return text
    out, at = [], 0
    for m in _unstable_run().finditer(text):
        start, end = m.span()
        if start > at:
            start -= 1  # the character before is the boundary context
            out.append(text[at:start])
        run = text[start:end]
        out.append(_segment(run) if end - start <= 64 else normalise(run))
        at = end
    if not at:
        return text
    out.append(text[at:])
    return "".join(out)


def nothing_to_see(text: str) -> bool:
    return _NOTHING.fullmatch(text) is not None


def canonical_column(df: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """``df`` with the canonical form of ``text_col`` as ``out_col``; null stays null."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = [t if t is None else canonical_text(t) for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, out_col])

    if out_col in df.columns:
        raise ValueError(f"{out_col} is there already")
    return spread(df).mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out_col, T.StringType())]))


def look_digests(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, look, raw): digests of the canonical and of the given text; texts with nothing to see are left out."""
    rows = spread(df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_text IS NOT NULL"))
    kind = rows.schema["_id"].dataType.simpleString()

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids, looks, raws = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if nothing_to_see(t):
                    continue
                c, raw = canonical_text(t), t.encode()
                ids.append(i)
                raws.append(blake2b(raw, digest_size=16).digest())
                looks.append(raws[-1] if c == t else blake2b(c.encode(), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(looks, pa.binary()), pa.array(raws, pa.binary())], ["_id", "look", "raw"])

    return rows.mapInArrow(run, f"_id {kind}, look binary, raw binary").withColumnRenamed("_id", id_col)


def look_alike_classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document with something to see: id, class_id (smallest id that looks the same), variants, links.

    ``variants`` is the number of different texts in the class, ``links`` how many of them differ
    from this document's.  Only digests are shuffled, folded before the shuffle.  Documents of a class that
    holds more than its share of all are not shuffled by class: there are at most 4 x parallelism such classes,
    and they are broadcast.
    """
    d = cut(look_digests(df, id_col, text_col))
    share = max(1, d.count() // (4 * shuffle_parallelism(df.sparkSession)))
    per = d.groupBy("look", "raw").agg(F.min(id_col).alias("_m"), F.count("*").alias("_n"))
    cls = cut(per.groupBy("look").agg(F.min("_m").alias("class_id"), F.count("*").alias("variants"), F.sum("_n").alias("_n")))
    hot = F.broadcast(cls.where(F.col("_n") > share))
    rest = d.join(hot.select("look"), "look", "left_anti").join(cls.where(F.col("_n") <= share), "look")
    return d.join(hot, "look").unionByName(rest).select(id_col, "class_id", "variants", (F.col("variants") - 1).alias("links"))


def look_alike_pairs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_a, id_b), the smaller first: documents whose texts differ in characters but look the same.

    Classes of one variant - exact copies included - are dropped first.  Then different variants of a
    class are linked with each other, and only these links are filled with their documents: copies of
    one text never meet, so nothing is made that is not in the result.
    """
    d = cut(look_digests(df, id_col, text_col))  # the texts are read once; both sides below read the digests
    mixed = d.groupBy("look").agg(F.min("raw").alias("_lo"), F.max("raw").alias("_hi")).where("_lo != _hi").select("look")
    few = d.join(mixed, "look", "left_semi").distinct()
    variants = few.select("look", "raw").distinct()
    other = variants.select("look", F.col("raw").alias("_raw_b"))
    links = variants.join(other, "look").where(F.col("raw") < F.col("_raw_b")).select(F.col("raw").alias("_raw_a"), "_raw_b")
    docs = few.select("raw", F.col(id_col).alias("_id"))
    a, b = docs.select(F.col("raw").alias("_raw_a"), F.col("_id").alias("_a")), docs.select(F.col("raw").alias("_raw_b"), F.col("_id").alias("_b"))
    pairs = links.join(a, "_raw_a").join(b, "_raw_b").where(F.col("_a") != F.col("_b"))
    return pairs.select(F.least("_a", "_b").alias(f"{id_col}_a"), F.greatest("_a", "_b").alias(f"{id_col}_b")).distinct()
