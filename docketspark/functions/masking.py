"""Masks for values in logs: identifiers, e-mail addresses, long texts, payloads."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mask_digits(c: Column, head: int, tail: int) -> Column:
    """First and last digits kept, the rest starred; other characters dropped."""
    d = F.regexp_replace(c, r"\D", "")
    n = F.length(d)
    return F.when(n > head + tail, F.concat(F.substring(d, 1, head), F.repeat(F.lit("*"), n - head - tail), F.substring(d, n - tail + 1, F.lit(tail)))).otherwise(d)


def mask_email(c: Column) -> Column:
    """Three characters of the local part, stars, the domain; a local part of three or less stays."""
    local, domain = F.substring_index(c, "@", 1), F.substring_index(c, "@", -1)
    return F.when(~c.contains("@") | (F.length(local) <= 3), c).otherwise(F.concat(F.substring(local, 1, 3), F.lit("***@"), domain))


def mask_window(c: Column, head: int = 100, tail: int = 100, mark: str = "[...]") -> Column:
    """Head and tail of texts longer than both and the mark; shorter ones stay."""
    n = F.length(c)
    return F.when(n > head + tail + len(mark), F.concat(F.substring(c, 1, head), F.lit(mark), F.substring(c, n - tail + 1, F.lit(tail)))).otherwise(c)


def mask_value(c: Column) -> Column:
    """By shape: 11 digits 4/3, 10 and 9 digits 3/3, 14 digits 3/3, e-mail, else the text window."""
    d = F.regexp_replace(c, r"[\s-]", "")
    return (
        F.when(d.rlike(r"^\d{11}$"), mask_digits(c, 4, 4)).when(d.rlike(r"^\d{9}$|^\d{10}$|^\d{14}$"), mask_digits(c, 3, 3))
        .when(c.rlike(r"^[^@\s]+@[^@\s]+$"), mask_email(c)).otherwise(mask_window(c))
    )


def _digits(d: str, head: int, tail: int) -> str:
    return d if len(d) <= head + tail else d[:head] + "*" * (len(d) - head - tail) + d[-tail:]


def mask_text(s: str) -> str:
    """mask_value() of plain Python text."""
    d = re.sub(r"[\s-]", "", s)
    if re.fullmatch("[0-9]{11}", d):
        return _digits(d, 4, 4)
    if re.fullmatch("[0-9]{9}|[0-9]{10}|[0-9]{14}", d):
        return _digits(d, 3, 3)
    if re.fullmatch(r"[^@\s]+@[^@\s]+", s):
        local, _, domain = s.rpartition("@")
        return s if len(local.split("@")[0]) <= 3 else f"{s[:3]}***@{domain}"
    return s if len(s) <= 205 else f"{s[:100]}[...]{s[-100:]}"


def mask_tree(v):
    """A JSON value with every string in it masked, at any depth; names and other values stay."""
    if isinstance(v, str):
        return mask_text(v)
    if isinstance(v, list):
        return [mask_tree(x) for x in v]
    return {k: mask_tree(x) for k, x in v.items()} if isinstance(v, dict) else v


def mask_payloads(df: DataFrame, id_col: str, json_col: str, out_col: str) -> DataFrame:
    """(id, out_col): JSON payloads with their strings masked, sorted names; text that is no JSON is masked as one string."""
    from docketspark.functions.jsontext import read_json

    rows = df.select(F.col(id_col).alias("_id"), F.col(json_col).alias("_json"))
    kind = rows.schema["_id"].dataType.simpleString()

    def one(t: str | None) -> str | None:
        ok, v = read_json(t)
        return json.dumps(mask_tree(v), ensure_ascii=False, sort_keys=True, separators=(",", ":")) if ok else None if t is None else mask_text(t)

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([one(t) for t in b.column(1).to_pylist()], pa.string())], ["_id", out_col])

    return rows.mapInArrow(run, f"_id {kind}, `{out_col}` string").withColumnRenamed("_id", id_col)
