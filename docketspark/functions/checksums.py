"""Check digits of identity numbers, as native array expressions and as plain functions of digit strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the check digits.
PESEL = (1, 3, 7, 9, 1, 3, 7, 9, 1, 3)
NIP = (6, 5, 7, 2, 3, 4, 5, 6, 7)
REGON9 = (8, 9, 2, 3, 4, 5, 6, 7)
REGON14 = (2, 4, 8, 5, 0, 9, 7, 3, 6, 1, 2, 4, 8)


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[\s-]", "")


def _weighted(d: Column, weights: tuple[int, ...]) -> Column:
    each = F.transform(F.split(F.substring(d, 1, len(weights)), ""), lambda x: x.cast("int"))
    products = F.zip_with(each, F.array(*map(F.lit, weights)), lambda a, b: a * b)
    return F.aggregate(products, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def _last(d: Column) -> Column:
    return F.right(d, F.lit(1)).cast("int")


def pesel_ok(c: Column) -> Column:
    d = digits(c)
    return F.when(d.rlike(r"^\d{11}$"), (10 - _weighted(d, PESEL) % 10) % 10 == _last(d)).otherwise(False)


def nip_ok(c: Column) -> Column:
    d = digits(c)
    return F.when(d.rlike(r"^\d{10}$"), _weighted(d, NIP) % 11 == _last(d)).otherwise(False)


def regon_ok(c: Column) -> Column:
    d = digits(c)
    nine = _weighted(d, REGON9) % 11 % 10 == F.substring(d, 9, 1).cast("int")
    all14 = nine & (_weighted(d, REGON14) % 11 % 10 == _last(d))
    return F.when(d.rlike(r"^\d{9}$"), nine).when(d.rlike(r"^\d{14}$"), all14).otherwise(False)


def _total(weights: tuple[int, ...], d: str) -> int:
    return sum(w * int(x) for w, x in zip(weights, d))


def is_pesel(d: str) -> bool:
    return len(d) == 11 and -_total(PESEL, d) % 10 == int(d[10])


def is_nip(d: str) -> bool:
    return len(d) == 10 and _total(NIP, d) % 11 == int(d[9])


def is_regon(d: str) -> bool:
    nine = len(d) in (9, 14) and _total(REGON9, d) % 11 % 10 == int(d[8])
    return nine and (len(d) == 9 or _total(REGON14, d) % 11 % 10 == int(d[13]))
