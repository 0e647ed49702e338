"""Deeply nested records to related flat tables, by Merkle subtree identities.

Every object is canonicalised (keys sorted, nested objects and lists replaced by their own
identities) and hashed bottom-up, so equal subtrees have equal identities wherever they
occur.  Three related tables come out:

* ``objects``      one row per distinct object: object_id, body (canonical JSON, nested objects
                   as {"$ref": id}); identical objects are stored once;
* ``occurrences``  one row per place an object stands: src, row_id, occ_no, parent_no, path, name,
                   ordinals, in_list, object_id - the bridge from child to parent.  (src, row_id, occ_no)
                   is its key and (src, row_id, parent_no) its parent's; path text is for reading only, as
                   names may hold dots and brackets;
* ``links``        the distinct (parent_id, child_id, name, ordinals) edges between objects.

``ordinals`` are the positions in all lists between the parent object and the child, outermost first.

The walk runs inside one Arrow pass per partition, with a stack of its own, so rows are
independent and nothing is shuffled to parse; only ``objects`` and ``links`` fold, with
partial aggregation first (a batch emits each distinct object once), so a record that is
repeated in a third of all rows leaves each task once per batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import blake2b
from json.encoder import encode_basestring
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketspark.functions.ids import clean_id
from docketspark.functions.jsontext import read_json
from docketspark.session import spread

OCCURRENCE = "src string, row_id string, occ_no int, parent_no int, path string, name string, ordinals array<int>, in_list boolean, object_id string"
OBJECT = "object_id string, body string"
LINK = "parent_id string, child_id string, name string, ordinals array<int>"


@dataclass(frozen=True)
class Shape:
    """Where lists belong: at the root, and under these names; a lone object there is element 0."""

    root_is_list: bool = False
    list_names: frozenset[str] = frozenset()


def _scalar(v) -> str:
    if v is None:
        return "null"
    if v is True:
        return "true"
    if v is False:
        return "false"
    return encode_basestring(v) if isinstance(v, str) else repr(v)


def _id(body: str) -> str:
    return blake2b(body.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


class Place(NamedTuple):
    """Where an object stands.  ``parent_no`` and ``name`` are null where no object is above; the numbers are unique in a row."""

    occ_no: int
    parent_no: int | None
    path: str
    name: str | None
    ordinals: tuple[int, ...]
    in_list: bool
    object_id: str
    body: str


class Walker:
    """Visits one JSON value bottom-up."""

    def __init__(self, shape: Shape):
        self.shape = shape

    def walk(self, value) -> list[Place]:
        """Every object of ``value``.  The root has path '' and, if it is an object, number 0."""
        if self.shape.root_is_list and isinstance(value, dict):
            value = [value]
        names = self.shape.list_names
        out: list[Place] = []
        done: dict[int, str] = {}  # frame number -> canonical text of the value, for its parent
        # frame: (number, value, path, number of the object above, name, positions in lists, whether seen before)
        stack: list[tuple] = [(0, value, "", None, None, (), False)]
        children: dict[int, list] = {}
        n = 0
        while stack:
            k, v, path, above, name, at, back = stack.pop()
            if back:
                if isinstance(v, dict):
                    parts = ",".join(f"{encode_basestring(key)}:{done.pop(c) if type(c) is int else c}" for key, c in sorted(children.pop(k)))
                    body = "{" + parts + "}"
                    oid = _id(body)
                    out.append(Place(k, above, path, name, at, bool(at), oid, body))
                    done[k] = '{"$ref":"' + oid + '"}'
                else:
                    done[k] = "[" + ",".join(done.pop(c) if type(c) is int else c for c in children.pop(k)) + "]"
                continue
            mine: list = []
            children[k] = mine
            stack.append((k, v, path, above, name, at, True))
            if isinstance(v, dict):
                for key, x in v.items():
                    if isinstance(x, dict):
                        if key in names:
                            x = [x]
                    elif not isinstance(x, list):
                        mine.append((key, _scalar(x)))
                        continue
                    n += 1
                    mine.append((key, n))
                    stack.append((n, x, f"{path}.{key}" if path else key, k, key, (), False))
            elif isinstance(v, list):
                for i, x in enumerate(v):
                    if isinstance(x, (dict, list)):
                        n += 1
                        mine.append(n)
                        stack.append((n, x, f"{path}[{i}]", above, name, (*at, i), False))
                    else:
                        mine.append(_scalar(x))
        return out


def _batches(shape: Shape, emit: str):
    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker = Walker(shape)
        for batch in it:
            srcs, ids, texts = (c.to_pylist() for c in batch.columns)
            if emit == "occurrences":
                cols: list[list] = [[] for _ in range(9)]
                for src, row, text in zip(srcs, ids, texts):
                    ok, value = read_json(text)
                    if ok:
                        for p in walker.walk(value):
                            for c, x in zip(cols, (src, row, *p[:7])):
                                c.append(x)
                kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.bool_(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(_clean(c), k) for c, k in zip(cols, kinds)], [f.split()[0] for f in OCCURRENCE.split(", ")])
            elif emit == "objects":
                bodies = {}
                for text in texts:
                    ok, value = read_json(text)
                    if ok:
                        bodies.update((p.object_id, p.body) for p in walker.walk(value))
                yield pa.RecordBatch.from_arrays([pa.array(list(bodies), pa.string()), pa.array(_clean(bodies.values()), pa.string())], ["object_id", "body"])
            else:
                links = {}
                for text in texts:
                    ok, value = read_json(text)
                    if ok:
                        found = walker.walk(value)
                        at = {p.occ_no: p.object_id for p in found}
                        links.update(((at[p.parent_no], p.object_id, p.name, p.ordinals), None) for p in found if p.parent_no is not None)
                rows = list(zip(*links)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(_clean(c), k) for c, k in zip(rows, [pa.string()] * 3 + [pa.list_(pa.int32())])], ["parent_id", "child_id", "name", "ordinals"])

    return run


def _clean(values: Iterable) -> list:
    """Lone surrogates, which JSON escapes can make, do not fit Arrow strings: each becomes U+FFFD."""
    return [v if not isinstance(v, str) or v.isascii() or not any("\ud800" <= c <= "\udfff" for c in v) else "".join("�" if "\ud800" <= c <= "\udfff" else c for c in v) for v in values]


@dataclass
class NestedTables:
    """The related tables of one JSON column; each is a plan of its own over the same scan."""

    rows: DataFrame
    shape: Shape

    def occurrences(self) -> DataFrame:
        return self.rows.mapInArrow(_batches(self.shape, "occurrences"), OCCURRENCE)

    def objects(self) -> DataFrame:
        each = self.rows.mapInArrow(_batches(self.shape, "objects"), OBJECT)
        return each.groupBy("object_id").agg(F.first("body").alias("body"))

    def links(self) -> DataFrame:
        return self.rows.mapInArrow(_batches(self.shape, "links"), LINK).distinct()


def nested_tables(df: DataFrame, src: str, id_col: str, json_col: str, shape: Shape = Shape()) -> NestedTables:
    """Flat tables of ``json_col``; ``src`` names the table and ``id_col`` gives row_id in clean form.

    Null, blank, cut-off and plain text has no rows; JSON encoded twice counts as if once.
    Repeated source rows give repeated occurrences (the caller takes distinct rows where the
    source may repeat), never repeated objects.  Other columns are not read.
    """
    rows = spread(df.select(F.lit(src).alias("src"), clean_id(id_col).alias("row_id"), F.col(json_col).alias("_json")).where("_json IS NOT NULL"))
    return NestedTables(rows, shape)
