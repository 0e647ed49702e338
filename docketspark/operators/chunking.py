"""Paragraph chunks with raw source offsets."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketspark.session import spread

LIMIT, LEAST, FULL = 900, 200, 720

CHUNK = "chunk_index int, page_no int, content string, source_start int, source_end int"
_PAGE = re.compile(r"\[Page (\d+)\]")
_BREAK = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")


def _pieces(text: str, base: int) -> Iterator[tuple[int, int, str]]:
    """(start, end, content) of the chunks of one page: paragraphs gathered up to the limit.

    A paragraph above the limit is cut in slices of the limit; a buffer goes out when the next
    paragraph does not fit, or once it is FULL long.
    """
    spans, at = [], 0
    for m in [*_BREAK.finditer(text), None]:
        a, z = at, m.start() if m else len(text)
        while a < z and text[a].isspace():
            a += 1
        while z > a and text[z - 1].isspace():
            z -= 1
        if a < z:
            spans.append((a, z))
        at = m.end() if m else z
    buffer: list[tuple[int, int, str]] = []

    def flush() -> Iterator[tuple[int, int, str]]:
        if buffer:
            yield base + buffer[0][0], base + buffer[-1][1], " ".join(b[2] for b in buffer)
            buffer.clear()

    for a, z in spans:
        content = " ".join(text[a:z].split())
        if len(content) > LIMIT:
            yield from flush()
            for s in range(a, z, LIMIT):
                if part := " ".join(text[s : min(s + LIMIT, z)].split()):
                    yield base + s, base + min(s + LIMIT, z), part
            continue
        size = sum(len(b[2]) + 1 for b in buffer)
        if buffer and size + len(content) > LIMIT:
            yield from flush()
            size = 0
        buffer.append((a, z, content))
        size += len(content)
        if size >= FULL:
            yield from flush()
    yield from flush()


def chunks(text: str) -> Iterator[tuple[int, int | None, str, int, int]]:
    """(chunk_index, page_no, content, source_start, source_end); '[Page N]' marks open pages."""
    text = text.replace("\r\n", " \n")  # the same length, so that offsets hold
    marks = [(m.start(), m.end(), int(m.group(1))) for m in _PAGE.finditer(text)]
    pages = [(0, marks[0][0] if marks else len(text), None)]
    pages += [(z, marks[i + 1][0] if i + 1 < len(marks) else len(text), n) for i, (_, z, n) in enumerate(marks)]
    index = 0
    for a, z, page in pages:
        for s, e, content in _pieces(text[a:z], a):
            yield index, page, content, s, e
            index += 1


# ---- fixed values: headings, in any case, with or without diacritics
_A, _E, _L, _O, _Z = "[aą]", "[eę]", "[lł]", "[oó]", "[zżź]"

#: Headings that open a section of a ruling, and editorial units: either turns the section chunker on.
STRONG = (
    r"Sygn\.?\s*akt\b", r"W\s*Y\s*R\s*O\s*K\b", r"POSTANOWIENIE\b", r"UZASADNIENIE\b",
    rf"S{_A}d\s+ustali{_L}\b", rf"S{_A}d\s+zwa{_Z}y{_L},?\s+co\s+nast{_E}puje\b",
)
UNITS = (rf"Art(?:yku{_L})?\.?\s*\d", r"(?:Par\.|§)\s*\d", r"ust\.?\s*\d", r"pkt\.?\s*\d", r"lit\.?\s*[a-z]\b")

#: Phrases that are headings where they stand alone on a line, a colon aside.
WEAK = (
    rf"{_Z}{_A}danie", r"Wnioski", r"Wniosek", r"Stan\s+faktyczny", r"Ustalenia\s+faktyczne", r"Ocena\s+prawna", rf"Rozwa{_Z}ania\s+prawne", rf"Rozwa{_Z}ania", r"Sentencja",
    rf"Rozstrzygni{_E}cie", r"orzeka", r"przeciwko\b.*", rf"(?:w\s+sprawie\s+)?z\s+pow{_O}dztwa\b.*",
)

_STRONG = re.compile(rf"^[^\S\n]*(?:{'|'.join(STRONG)})", re.M | re.I)
_UNIT = re.compile(rf"^[^\S\n]*(?:{'|'.join(UNITS)})", re.M | re.I)
_WEAK = re.compile(rf"^[^\S\n]*(?:{'|'.join(WEAK)})[^\S\n]*(?::|$)", re.M | re.I)


def sections(text: str) -> list[tuple[int, int]]:
    """Blocks between headings; one block where no strong heading and no editorial unit occurs."""
    if not (_STRONG.search(text) or _UNIT.search(text)):
        return [(0, len(text))]
    starts = sorted({m.start() for rx in (_STRONG, _UNIT, _WEAK) for m in rx.finditer(text)})
    edges = sorted({0, *starts, len(text)})
    return [(a, z) for a, z in zip(edges, edges[1:]) if text[a:z].strip()]


def with_overlap(pieces: list[str], most: int = 120) -> list[str]:
    """Each piece after the tail of the one before it: at most ``most`` characters and what room there is,
    from the first white space of the tail on; full pieces get none."""
    out = pieces[:1]
    for before, piece in zip(pieces, pieces[1:]):
        room = min(most, LIMIT - len(piece) - 1, len(before))
        tail = before[len(before) - room :] if room > 0 else ""
        if room < len(before):
            cut = re.search(r"\s", tail)
            tail = tail[cut.end() :] if cut else ""
        out.append(f"{tail} {piece}" if tail.strip() else piece)
    return out


def legal_chunks(text: str) -> Iterator[tuple[int, int | None, str, int, int]]:
    """As chunks(), with section headings as boundaries and overlap inside a section only."""
    index = 0
    for a, z in sections(text.replace("\r\n", " \n")):
        block = list(chunks(text[a:z]))
        for content, (_, page, _, s, e) in zip(with_overlap([c[2] for c in block]), block):
            yield index, page, content, a + s, a + e
            index += 1


def chunk_documents(df: DataFrame, id_col: str, text_col: str, legal: bool = False) -> DataFrame:
    """One row a chunk; null and blank texts have none.  Rows are independent."""
    cut = legal_chunks if legal else chunks
    rows = spread(df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_text IS NOT NULL"))
    kind = rows.schema["_id"].dataType.simpleString()
    names = ["_id", *(p.split()[0] for p in CHUNK.split(", "))]

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out: list[list] = [[] for _ in names]
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for c in cut(text):
                    for col, x in zip(out, (i, *c)):
                        col.append(x)
            kinds = [b.column(0).type, pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    return rows.mapInArrow(run, f"_id {kind}, {CHUNK}").withColumnRenamed("_id", id_col)
