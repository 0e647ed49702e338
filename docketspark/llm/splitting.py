"""Splitting oversized items at natural boundaries, by ranges.

A text (a table cell or a file) is looked at in ranges of fixed size, each with a halo of one
piece length on both sides, so no worker needs the whole of it.  A range first gets a boundary
table: where white space ends, and whether that is the end of a paragraph, a sentence or a word.
Where a piece ends depends on where it starts, so a range cannot be cut before the ranges to its
left; but only starts within one limit of its left edge can be the first start inside it.  For each
of these the table says where the chain of pieces leaves the range and how many pieces it has on
the way (starts that share both stand together).  Stitching the tables in order gives each range
its entry and, as a prefix sum of counts, its first piece number; then every range emits its own
pieces by offset.  The result is exactly the left-to-right split of the whole text.

Paragraph and word lengths fold in the same way: each range has a summary, and summaries of
neighbours combine associatively.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import astuple, dataclass, fields
from functools import lru_cache, reduce
from itertools import chain, groupby, islice
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docketspark.operators.ordered import PID, line_up, with_running_sum
from docketspark.session import cut, shuffle_parallelism

CELL_RANGE = 1 << 12  # code points of a range of a table cell
FILE_RANGE = 8 << 20  # bytes of a range of a file
GROUP = 256  # boundary tables stitched in one task

#: Unicode white space, and the line ends among it (\r\n is one).
SPACE = "\u0009\u000a\u000b\u000c\u000d\u0020\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_S = "[" + SPACE + "]"
_RUNS = regex.compile(_S + "+")
_LINE_END = regex.compile("\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")


# ---------------------------------------------------------------- summaries


@dataclass(frozen=True)
class Summary:
    """What a stretch of text must remember to be joined with its neighbours.

    ``lead`` and ``tail`` are its outer white space; words and paragraphs at its edges may go on
    next door.  ``one_word`` / ``one_par``: the stretch has no white space / separator inside.
    Lengths count a line end once.
    """

    lead: str = ""
    tail: str = ""
    first_word: int = 0
    last_word: int = 0
    one_word: bool = True
    max_word: int = 0
    first_par: int = 0
    last_par: int = 0
    one_par: bool = True
    max_par: int = 0

    @property
    def blank(self) -> bool:
        return not self.max_word


def _gap(run: str) -> tuple[int, int]:
    """Length of a run of white space with \\r\\n as one, and its line ends."""
    return len(run) - run.count("\r\n"), len(_LINE_END.findall(run))


def summarise(text: str) -> Summary:
    first = _RUNS.match(text)
    at = first.end() if first else 0
    if at == len(text):
        return Summary(lead=text)
    lead, pos, par, words, pars = text[:at], at, 0, [], []
    tail = ""
    for m in _RUNS.finditer(text, at):
        words.append(m.start() - pos)
        par += m.start() - pos
        if m.end() == len(text):
            tail, pos = m.group(), m.end()
            break
        length, ends = _gap(m.group())
        if ends > 1:
            pars.append(par)
            par = 0
        else:
            par += length
        pos = m.end()
    if pos < len(text):
        words.append(len(text) - pos)
        par += len(text) - pos
    pars.append(par)
    return Summary(lead, tail, words[0], words[-1], len(words) == 1, max(words), pars[0], pars[-1], len(pars) == 1, max(pars))


def combine(a: Summary, b: Summary) -> Summary:
    if a.blank:
        if b.blank:
            return Summary(lead=a.lead + b.lead)
        return Summary(a.lead + b.lead, b.tail, b.first_word, b.last_word, b.one_word, b.max_word, b.first_par, b.last_par, b.one_par, b.max_par)
    if b.blank:
        return Summary(a.lead, a.tail + b.lead, a.first_word, a.last_word, a.one_word, a.max_word, a.first_par, a.last_par, a.one_par, a.max_par)
    run = a.tail + b.lead
    length, ends = _gap(run)
    glued, joined = not run, ends < 2
    word = a.last_word + b.first_word
    par = a.last_par + length + b.first_par
    return Summary(
        a.lead,
        b.tail,
        word if glued and a.one_word else a.first_word,
        word if glued and b.one_word else b.last_word,
        glued and a.one_word and b.one_word,
        max(a.max_word, b.max_word, word if glued else 0),
        par if joined and a.one_par else a.first_par,
        par if joined and b.one_par else b.last_par,
        joined and a.one_par and b.one_par,
        max(a.max_par, b.max_par, par if joined else 0),
    )


def boundary_kind(s: Summary, limit: int) -> str:
    return "paragraph" if s.max_par <= limit else "word" if s.max_word <= limit else "hard"


# ---------------------------------------------------------------- cutting

#: Line ends, what ends a sentence, and what may close after it.
_ENDS = "\n\x0b\x0c\r\x85\u2028\u2029"
_STOPS = ".!?…;:"
_CLOSERS = "'\"”»)]"
_LOOK = 8  # characters looked at before a run of white space, and after the room's end
_IS_SPACE, _IS_MARK, _IS_END, _IS_CLOSER, _IS_STOP = 1, 2, 4, 8, 16


@lru_cache(1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Bits of every code point, and of every byte of UTF-8, where continuation bytes are marks."""
    points = np.zeros(0x110000, dtype=np.uint8)
    for bit, chars in ((_IS_SPACE, SPACE), (_IS_END, _ENDS), (_IS_CLOSER, _CLOSERS), (_IS_STOP, _STOPS)):
        points[[ord(c) for c in chars]] |= bit
    points[[c for c in range(0x300, 0x110000) if unicodedata.category(chr(c))[0] == "M"] + [0x200D]] |= _IS_MARK
    octets = points[:256].copy()
    octets[0x80:] = 0
    octets[0x80:0xC0] = _IS_MARK
    return points, octets


def text_codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


class Boundaries:
    """The boundary table of one window: where a piece may end, and what kind of end that is.

    ``base`` is the window's offset in the whole.  The end of a run of white space is a paragraph break
    (kind 2) if the run has more than one line end, a sentence end (1) if it has one or follows closing
    punctuation, else a word end (0).  All of this is read from the ``limit`` characters before the
    boundary at most, so a window with a halo of ``limit`` on each side knows it as the whole text does.
    Windows are code points, or bytes, of which continuation bytes are marks.
    """

    def __init__(self, codes: np.ndarray, base: int, total: int, limit: int, overlap: int):
        if not 0 <= overlap < limit:
            raise ValueError("the overlap must be below the limit")
        self.base, self.total, self.limit, self.overlap = base, total, limit, overlap
        n = self.n = len(codes)
        bits = _classes()[codes.dtype == np.uint8][codes]
        space, mark, ends = ((bits & k) != 0 for k in (_IS_SPACE, _IS_MARK, _IS_END))
        ends[1:] &= ~((codes[1:] == 0x0A) & (codes[:-1] == 0x0D))
        line_ends = np.concatenate([[0], np.cumsum(ends)])
        at = np.arange(n + 1)
        edge = np.diff(np.concatenate([[False], space, [False]]).astype(np.int8))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        # where a sentence ends: punctuation, then closers only
        solid = np.maximum.accumulate(np.where(bits & _IS_CLOSER, -1, at[:-1])) if n else at[:0]
        stop = (bits & _IS_STOP) != 0

        def sentence(q: np.ndarray) -> np.ndarray:
            j = solid[np.maximum(q - 1, 0)]
            return (q > 0) & (j >= 0) & (j >= q - _LOOK) & stop[np.maximum(j, 0)]

        def kinds(q: np.ndarray, count: np.ndarray) -> np.ndarray:
            return np.where(count > 1, 2, np.where((count == 1) | sentence(q), 1, 0))

        self.after = np.full(n + 1, -1, dtype=np.int8)  # kind of the boundary where white space ends
        whole = last < n
        p, q = last[whole], np.maximum(first[whole], last[whole] - limit)
        self.after[p] = kinds(q, line_ends[p] - line_ends[q])
        self.before = np.full(n + 1, -1, dtype=np.int8)  # kind where white space starts, if the room ends there
        inner = first > 0
        q = first[inner]
        self.before[q] = kinds(q, line_ends[np.minimum(last[inner], q + _LOOK)] - line_ends[q])
        self.latest = [np.maximum.accumulate(np.where(self.after >= k, at, -1)) for k in (0, 1, 2)]
        self.solid = np.maximum.accumulate(np.where(np.concatenate([mark, [False]]), -1, at))

    def ends(self, start: np.ndarray) -> np.ndarray:
        """Ends of the pieces that start at ``start``: the last paragraph break in the second half of the
        room, else the last sentence end there, else the last word end, else the limit (before a
        combining mark's base)."""
        s = start - self.base
        z = np.minimum(s + self.limit, self.n)
        low, half = s + self.overlap, s + max(self.overlap, self.limit // 2)
        word, sentence, par = (np.where(self.before[z] >= k, z, self.latest[k][z]) for k in (0, 1, 2))
        hard = np.maximum(self.solid[z], low + 1)
        cut_at = np.where(par > half, par, np.where(sentence > half, sentence, np.where(word > low, word, hard)))
        return np.where(start + self.limit >= self.total, self.total, cut_at + self.base)


    def end(self, start: int) -> int:
        """ends() of one start."""
        if start + self.limit >= self.total:
            return self.total
        s = start - self.base
        z, low, half = s + self.limit, s + self.overlap, s + max(self.overlap, self.limit // 2)
        before = self.before[z]
        for k, least in ((2, half), (1, half), (0, low)):
            p = z if before >= k else self.latest[k][z]
            if p > least:
                return int(p) + self.base
        return max(int(self.solid[z]), low + 1) + self.base

    def next(self, start: int) -> int:
        e = self.end(start)
        return e if e >= self.total else e - self.overlap


#: A boundary table's chains: of the starts from entry[i] on (up to entry[i + 1]), where the chain of
#: pieces leaves the range and how many pieces it has on the way.
Chains = tuple[list[int], list[int], list[int]]


def range_chains(b: Boundaries | None, offset: int, stop: int, total: int, limit: int, overlap: int) -> Chains:
    """Chains for every start that may come first in the range: within ``limit`` of its left edge.

    The first step is made for all of these at once; after it few starts are left, and what two chains share is
    followed once.  Without boundaries the whole is one piece.
    """
    if b is None or not total:
        return [0], [total], [1]
    first = np.arange(offset, offset + (1 if offset == 0 else min(limit, stop - offset)))
    ends = b.ends(first)
    leave = np.where(ends >= total, total, ends - overlap)
    memo: dict[int, tuple[int, int]] = {}
    for p in np.unique(leave).tolist():
        chain_, q = [], p
        while q < stop and q not in memo:
            chain_.append(q)
            q = b.next(q)
        out, n = memo.get(q, (q, 0))
        for q in reversed(chain_):
            n += 1
            memo[q] = (out, n)
        memo.setdefault(p, (p, 0))
    exits = [memo[p] for p in leave.tolist()]
    change = [0, *(i for i in range(1, len(exits)) if exits[i] != exits[i - 1])]
    return [i + offset for i in change], [exits[i][0] for i in change], [exits[i][1] + 1 for i in change]


def range_pieces(b: Boundaries | None, stop: int, total: int, overlap: int, entry: int, first: int) -> Iterator[tuple[int, int, int]]:
    """(piece, start, end) of the pieces that start in the range."""
    if b is None or not total:
        yield 0, 0, total
        return
    p = entry
    while p < stop:
        e = b.end(p)
        yield first, p, e
        p, first = (e if e >= total else e - overlap), first + 1


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a whole text, left to right; the plain form that the ranges reproduce."""
    n = len(text)
    if n <= limit:
        return [(0, n)]
    b, out, s = Boundaries(text_codes(text), 0, n, limit, overlap), [], 0
    while True:
        e = b.end(s)
        out.append((s, e))
        if e >= n:
            return out
        s = e - overlap


# ---------------------------------------------------------------- stitching

CHAINS = "no long, stop long, entry array<bigint>, leave array<bigint>, n array<bigint>"


def _streamed(df: DataFrame, keys: list[str], order: str, step: Callable[[list, Iterator[dict]], Iterator[tuple]], schema: str) -> DataFrame:
    """``step`` over the rows of each key in order; a key is read as a stream, never held as a whole."""
    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    names, types = out.names, to_arrow_schema(out).types

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in it for r in b.to_pylist())
        found = (x for key, group in groupby(rows, lambda r: [r[k] for k in keys]) for x in step(key, group))
        while part := list(islice(found, 4096)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), types)], names)

    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, schema)


def _follow(rows: Iterable[dict], at: int, n: int) -> Iterator[tuple]:
    """(row, entry, pieces before, pieces in it) of the ranges the chain from ``at`` starts pieces in."""
    for r in rows:
        if at < r["stop"]:  # else a short last range that no piece starts in
            k = bisect_right(r["entry"], at) - 1
            yield r, at, n, r["n"][k]
            at, n = r["leave"][k], n + r["n"][k]


def stitch_chains(found: DataFrame, most: int) -> DataFrame:
    """(_key, no, entry, first, n): where the chain enters each range, how many pieces stand before it and start in it.

    The tables of GROUP neighbouring ranges compose to one table; the composed tables are stitched the
    same way, and their entries go back down, so a file of any number of ranges spreads over tasks.
    """
    kind = found.schema["_key"].dataType.simpleString()

    def walk(key: list, rows: Iterator[dict]) -> Iterator[tuple]:
        r0 = next(rows)
        for r, at, n, own in _follow(chain([r0], rows), r0.get("at", 0), r0.get("before", 0)):
            yield key[0], r["no"], at, n, own

    def compose(key: list, rows: Iterator[dict]) -> Iterator[tuple]:
        ends: list[tuple[int, int]] = []
        entry: list[int] = []
        stop = 0
        for r in rows:
            if not ends:
                entry, ends = r["entry"], list(zip(r["leave"], r["n"]))
            else:
                ends = [x if x[0] >= r["stop"] else (r["leave"][k := bisect_right(r["entry"], x[0]) - 1], x[1] + r["n"][k]) for x in ends]
            stop = r["stop"]
        yield key[0], key[1], stop, entry, [x[0] for x in ends], [x[1] for x in ends]

    out = f"_key {kind}, no long, entry long, first long, n long"
    if most <= GROUP:
        return _streamed(found, ["_key"], "no", walk, out)
    grouped = found.withColumn("_g", F.floor(F.col("no") / GROUP))
    above = stitch_chains(_streamed(grouped, ["_key", "_g"], "no", compose, f"_key {kind}, {CHAINS}"), -(-most // GROUP))
    starts = above.select("_key", F.col("no").alias("_g"), F.col("entry").alias("at"), F.col("first").alias("before"))
    return _streamed(grouped.join(starts, ["_key", "_g"]), ["_key", "_g"], "no", walk, out)


SUMMARY = "no long, lead string, tail string, first_word long, last_word long, one_word boolean, max_word long, first_par long, last_par long, one_par boolean, max_par long"


def stitch_summaries(found: DataFrame, most: int) -> DataFrame:
    """One summary a key, from those of its ranges in order; GROUP neighbours at a time."""
    kind = found.schema["_key"].dataType.simpleString()

    def fold(key: list, rows: Iterator[dict]) -> Iterator[tuple]:
        s = reduce(combine, (Summary(*(r[f.name] for f in fields(Summary))) for r in rows))
        yield key[0], key[1], *astuple(s)

    while True:
        found = _streamed(found.withColumn("_g", F.floor(F.col("no") / GROUP)), ["_key", "_g"], "no", fold, f"_key {kind}, {SUMMARY}")
        most = -(-most // GROUP)
        if most <= 1:
            return found


# ---------------------------------------------------------------- table cells


def _cells(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_key, _text): one row an id; of rows that repeat an id the greatest text holds, and rows without one are no items."""
    return df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_key")).agg(F.max(text_col).alias("_text")).where("_text IS NOT NULL")


def _range_rows(rows: DataFrame, size: int, of_range: Callable[[str, int, int, int], tuple], schema: str) -> DataFrame:
    """``of_range(text, no, offset, stop)`` of every range of every text, one row each, in one Arrow pass."""
    kind = rows.schema["_key"].dataType.simpleString()
    out = T._parse_datatype_string(f"_key {kind}, {schema}")
    names, types = out.names, to_arrow_schema(out).types

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = (
                (key, *of_range(text, k, s, min(s + size, len(text))))
                for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist())
                for k, s in enumerate(range(0, max(1, len(text)), size))
            )
            while part := list(islice(found, 4096)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), types)], names)

    return rows.mapInArrow(run, f"_key {kind}, {schema}")


def _most(found: DataFrame) -> int:
    return (found.agg(F.max("no")).first()[0] or 0) + 1


def classify_texts(df: DataFrame, id_col: str, text_col: str, limit: int, size: int = CELL_RANGE) -> DataFrame:
    """(id, boundary) of each text of more than ``limit`` code points that is not all white space.

    'paragraph' if every paragraph fits the limit, else 'word' if every run without white space
    does, else 'hard'.  Each range is summarised by itself, and the summaries of a text are stitched in
    order.  Null, short and blank texts and rows without an id have no row; of rows that repeat an id the greatest text holds.
    """
    rows = _cells(df.where(F.length(text_col) > limit), id_col, text_col)

    def of_range(text: str, no: int, offset: int, stop: int) -> tuple:
        return no, *astuple(summarise(text[offset:stop]))

    found = cut(_range_rows(rows, size, of_range, SUMMARY))
    whole = stitch_summaries(found, _most(found)).where("max_word > 0")
    kind = F.when(F.col("max_par") <= limit, "paragraph").when(F.col("max_word") <= limit, "word").otherwise("hard")
    return whole.select(F.col("_key").alias(id_col), kind.alias("boundary"))


@dataclass
class SplitPlan:
    """Texts and the stitched entries of their ranges; the pieces are emitted from both."""

    rows: DataFrame  # _key, _text
    entries: DataFrame  # _key, no, entry, first, n
    limit: int
    overlap: int
    size: int

    def counts(self) -> DataFrame:
        """(_key, pieces): how many pieces each text has."""
        return self.entries.groupBy("_key").agg(F.sum("n").alias("pieces"))

    def pieces(self, extra: DataFrame | None = None) -> DataFrame:
        """_key, the columns of ``extra`` (one row a _key; texts without one have no pieces), piece, piece_start, piece_end, piece_text.

        Texts meet the entries of their ranges, which are small; a range's window is read again where it is cut.
        """
        limit, overlap, size = self.limit, self.overlap, self.size
        per = self.entries.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("no", "entry", "first"))).alias("_at"))
        rows = self.rows.join(per, "_key")
        more = [c for c in extra.columns if c != "_key"] if extra is not None else []
        rows = rows.join(extra, "_key") if extra is not None else rows
        rows = rows.select("_key", *more, "_at", "_text")
        schema = T.StructType([*(rows.schema[c] for c in ["_key", *more]), T.StructField("piece", T.LongType()), T.StructField("piece_start", T.LongType()), T.StructField("piece_end", T.LongType()), T.StructField("piece_text", T.StringType())])
        names, types = schema.names, to_arrow_schema(schema).types

        def cut_row(r: dict) -> Iterator[tuple]:
            text = r.pop("_text")
            at, total, kept = r.pop("_at"), len(text), tuple(r.values())
            for x in at:
                offset = x["no"] * size
                stop = min(offset + size, total)
                b = cell_boundaries(text, offset, stop, limit, overlap)
                for n, s, e in range_pieces(b, stop, total, overlap, x["entry"], x["first"]):
                    yield *kept, n, s, e, text[s:e]

        def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                found = (p for r in b.to_pylist() for p in cut_row(r))
                while part := list(islice(found, 4096)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), types)], names)

        return rows.mapInArrow(run, schema)


def cell_boundaries(text: str, offset: int, stop: int, limit: int, overlap: int) -> Boundaries | None:
    """The boundary table of one range of a cell, read from its window; null where the text is one piece."""
    if len(text) <= limit:
        return None
    base = max(0, offset - limit - _LOOK)
    return Boundaries(text_codes(text[base : stop + limit + _LOOK]), base, len(text), limit, overlap)


def plan_split(df: DataFrame, id_col: str, text_col: str, limit: int, overlap: int, size: int = CELL_RANGE) -> SplitPlan:
    """Boundary tables of all ranges of all texts, written once, and their stitched entries."""
    size = max(size, limit)
    rows = _cells(df, id_col, text_col)

    def of_range(text: str, no: int, offset: int, stop: int) -> tuple:
        b = cell_boundaries(text, offset, stop, limit, overlap)
        return no, max(stop, 1), *range_chains(b, offset, stop, len(text), limit, overlap)

    tables = cut(_range_rows(rows, size, of_range, CHAINS))
    return SplitPlan(rows, stitch_chains(tables, _most(tables)), limit, overlap, size)


def split_items(df: DataFrame, id_col: str, text_col: str, limit: int, overlap: int, size: int = CELL_RANGE) -> DataFrame:
    """Pieces of each text: id, piece, piece_start, piece_end, piece_text.

    A text within the limit is one piece; a longer one is cut as Boundaries.ends says, each piece
    starting ``overlap`` code points before the end of the one before it.  Null texts and rows
    without an id have no piece, an empty text one empty piece.  Rows that repeat an id are one item, with the
    greatest of their texts.
    """
    return plan_split(df, id_col, text_col, limit, overlap, size).pieces().withColumnRenamed("_key", id_col)


def running_numbers(df: DataFrame, key: str, order: list[str], count_col: str, partitions: int | None = None) -> DataFrame:
    """Exclusive running sum of ``count_col`` within ``key`` in ``order``, as column ``before``; a hot key is spread."""
    return with_running_sum(line_up(df, key, order, partitions), key, order, count_col, "before", inclusive=False).drop(PID)


# ---------------------------------------------------------------- files


def _open(path: str):
    from pyarrow import fs

    if "://" in path:
        system, name = fs.FileSystem.from_uri(path)
    else:
        system, name = fs.LocalFileSystem(), re.sub("^file:", "", path)
    return system.open_input_file(name)


def split_files(spark, paths: list[str], limit: int, overlap: int, size: int = FILE_RANGE) -> DataFrame:
    """Pieces of UTF-8 files by byte ranges: path, piece, byte_start, byte_end, piece_text.

    ``paths`` are files, folders or globs; Spark lists them, and ranges are made on the workers from
    (path, length).  ``limit``, ``overlap`` and offsets count bytes.  A worker opens a file at its range and
    reads the range and its halos, once for the boundary table and once when it emits; between the two only
    tables and entries are shuffled, never file contents.  Boundaries are those of the text split, read on
    bytes (white space of one byte); no piece starts or ends inside a character, so an overlap may be up to
    three bytes shorter.  An empty file has one empty piece.
    """
    size = max(size, limit)
    found = spark.read.format("binaryFile").load(paths)  # its rows leave empty files out, its listing does not
    listed = spark.createDataFrame([(re.sub("^file:/+", "file:/", unquote(p)),) for p in found.inputFiles()], "_key string")
    files = listed.join(found.select(F.col("path").alias("_key"), "length"), "_key", "left").select("_key", F.coalesce("length", F.lit(0)).alias("total"))
    count = F.greatest(F.ceil(F.col("total") / size), F.lit(1))
    wide = 16 * shuffle_parallelism(spark)
    each = files.withColumn("no", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))

    def window(path: str, no: int, total: int) -> tuple[np.ndarray, int, int, int, Boundaries | None]:
        """(bytes, base, offset, stop, boundary table) of one range."""
        offset = no * size
        stop = min(offset + size, total)
        base = max(0, offset - limit - _LOOK)
        with _open(path) as f:
            raw = np.frombuffer(f.read_at(min(stop + limit + _LOOK, total) - base, base), dtype=np.uint8)
        return raw, base, offset, stop, Boundaries(raw, base, total, limit, overlap) if total > limit else None

    def tables(it: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for path, total, no in pdf.itertuples(index=False):
                _, _, offset, stop, b = window(path, no, total)
                e, leave, n = range_chains(b, offset, stop, total, limit, overlap)
                yield pd.DataFrame({"_key": [path], "no": [no], "stop": [max(stop, 1)], "entry": [e], "leave": [leave], "n": [n]})

    found = cut(each.repartition(wide, "_key", "no").mapInPandas(tables, f"_key string, {CHAINS}"))
    entries = stitch_chains(found, _most(found))

    def emit(it: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for path, total, no, entry, first in pdf.itertuples(index=False):
                raw, base, _, stop, b = window(path, no, total)
                out, held = [], raw.tobytes()
                for n, s, e in range_pieces(b, stop, total, overlap, entry, first):
                    piece = held[s - base : e - base]
                    skip = next((i for i, x in enumerate(piece[:4]) if x & 0xC0 != 0x80), 0)
                    out.append((path, n, s + skip, e, piece[skip:].decode("utf-8", "replace")))
                yield pd.DataFrame(out, columns=["path", "piece", "byte_start", "byte_end", "piece_text"])

    rows = each.join(entries.drop("n"), ["_key", "no"]).select("_key", "total", "no", "entry", "first").repartition(wide, "_key", "no")
    return rows.mapInPandas(emit, "path string, piece long, byte_start long, byte_end long, piece_text string")
