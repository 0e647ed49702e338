"""Phrases, windows, marks, quotations, verdicts, sharing and dates on small fixtures."""

from pyspark.sql import functions as F

from docketspark.functions import markup as mk
from docketspark.functions import text as tx
from docketspark.operators import grounding, spans
from docketspark.operators.query import clamp_limit, may_open
from docketspark.sources.tables import log_line, stamp, write_lines


def one(spark, *columns, **row):
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in row.items()))
    return df.select(*columns).first()


def test_find_phrase(spark):
    t = "W  Dniu x, w\ndniu y; w dniu z"
    got = one(spark, tx.find_phrase(F.col("t"), "w dniu", 2, 3).alias("f"), t=t).f
    assert (got.total, got.truncated) == (3, True)
    assert [(h["index"], h.start, h.excerpt, h.context) for h in got.hits] == [(0, 0, "W  Dniu", "W Dniu x,…"), (1, 11, "w\ndniu", "…x, w dniu y;…")]
    assert all(t[h.start : h.start + len(h.excerpt)] == h.excerpt for h in got.hits)
    for text in ("", "nic"):
        f = one(spark, tx.find_phrase(F.col("t"), "w dniu").alias("f"), t=text).f
        assert (f.total, f.truncated, f.hits) == (0, False, [])


def test_text_window(spark):
    def w(text, offset, limit):
        x = one(spark, tx.text_window(F.col("t"), F.col("o"), F.col("l")).alias("w"), t=text, o=offset, l=limit).w
        return x.text, x.offset, x.limit, x.total, x.next_offset, x.truncated

    assert w("abcdef", 2, 3) == ("cde", 2, 3, 6, 5, True)
    assert w("abcdef", -4, 99) == ("abcdef", 0, 99, 6, None, False)
    assert w("abcdef", 9, 0) == ("", 6, 1, 6, None, True)
    assert w("", 0, 5) == ("", 0, 5, 0, None, False)


def test_marks(spark):
    r = one(spark, mk.pill_segments(F.col("t")).alias("p"), mk.placeholders(F.col("c")).alias("c"), mk.label_value(F.col("l")).alias("l"), t="a [[x]] b[[y]]", c="A[[page:1||quote:q]]B[[page:2||quote:r]]", l='a"b\\c\nd')
    assert [(s.text, s.pill) for s in r.p] == [("a ", "x"), (" b", "y"), ("", None)]
    assert r.c == "A§0§B§1§" and r.l == 'a\\"b\\\\c\\nd'


def test_claims(spark):
    long = "p" * 400
    text = f"first line\n{long} claim [2] tail {long}\nthird [3] x<CITATIONS>[4]"

    def claim(ref):
        return one(spark, mk.claim(F.col("t"), F.lit(ref)).alias("c"), t=text).c

    at = text.index("[2]")
    assert claim(2) == text[at - 250 : at + 3 + 250].strip() and claim(3) == "third [3] x" and claim(4) == "" and claim(9) == ""


def test_citation_block_and_judge(spark):
    block = '''x <CITATIONS> [{"ref":1,"doc_id":"d","page":"3-4","quote":"q"},{"marker":"[2]","doc_id":"e","page":"7a","text":"t"},{"doc_id":"f","quote":"q"},{"ref":3,"doc_id":"g","quote":""},{"ref":4,"doc_id":"h","quote":"z"}] </CITATIONS>'''
    r = one(spark, mk.citation_block(F.col("a")).alias("a"), mk.citation_block(F.col("b")).alias("b"), mk.citation_block(F.col("c")).alias("c"), a=block, b="none", c="<CITATIONS>[{</CITATIONS>")
    assert [tuple(x) for x in r.a] == [(1, "d", "3-4", "q"), (2, "e", "7", "t"), (4, "h", "1", "z")] and r.b == [] and r.c == []
    good = '```json\n{"verdict":"tak","confidence":"wysoka"}\n```'
    j = one(spark, mk.judge_reply(F.col("a")).alias("a"), mk.judge_reply(F.col("b")).alias("b"), mk.judge_reply(F.col("c")).alias("c"), a=good, b='{"verdict":"maybe","confidence":"wysoka"}', c="{")
    assert tuple(j.a) == ("tak", "wysoka", "") and j.b is None and j.c is None


def test_quotations(spark):
    text = "> **Pierwsza** linia cytatu\n> i druga\nOn mówi „to jest dość długi cytat w tekście” oraz „krótki”.\n> dwa słowa\n\n<CITATIONS>„nie ten cytat bo jest w bloku cytowań”</CITATIONS>"
    assert mk.quoted_spans(text, grounding.fold_quote) == [("Pierwsza linia cytatu i druga", "blockquote"), ("to jest dość długi cytat w tekście", "inline")]
    assert mk.quoted_spans(None, grounding.fold_quote) == mk.quoted_spans("", grounding.fold_quote) == []
    twice = "„ten sam cytat, który jest dość długi” i „Ten sam cytat, który jest  dość długi”"
    assert len(mk.quoted_spans(twice, grounding.fold_quote)) == 1
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string")
    assert [(r.id, r.n, r.kind) for r in grounding.find_quotations(df, "id", "t").orderBy("n").collect()] == [(1, 0, "blockquote"), (1, 1, "inline")]


def test_verdicts(spark):
    rows = [("verified", None), ("verified", "nie"), ("modified", "tak"), ("unverified", "czesciowo"), ("no_source", "tak"), ("verified", "tak")]
    df = spark.createDataFrame(rows, "s string, j string")
    got = df.select(grounding.verdict(F.col("s"), F.col("j")).alias("v"), grounding.decision(F.col("s")).alias("d"), grounding.needs_judgment(F.col("s"), F.lit("teza"), F.col("j")).alias("n")).collect()
    assert [r.v for r in got] == ["green", "red", "yellow", "yellow", "red", "green"]
    assert [r.d for r in got] == ["verified", "verified", "unverified", "blocked", "blocked", "verified"]
    assert [r.n for r in got] == [True, False, False, False, False, False]
    c = spark.createDataFrame([("verified", None), ("modified", 0.1), ("unverified", None)], "s string, r double").select(grounding.confidence(F.col("s"), F.col("r")).alias("c")).collect()
    assert [r.c for r in c] == [1.0, 0.9, 0.0]
    colour, reason = grounding.card_verdict(F.col("g"), F.col("y"), F.col("r"), F.col("t"))
    cards = spark.createDataFrame([(0, 0, 1, True), (1, 0, 1, True), (0, 1, 0, True), (0, 0, 0, True), (1, 0, 0, False)], "g int, y int, r int, t boolean").select(colour.alias("c"), reason.alias("r")).collect()
    assert [tuple(r) for r in cards] == [("red", "quote_not_found"), ("green", "quote_found"), ("yellow", "quote_modified"), ("yellow", "no_quote"), ("yellow", "no_source")]


def test_cells_roll_up(spark):
    df = spark.createDataFrame([("a", "verified"), ("a", "modified"), ("b", "unverified"), ("c", "no_source"), ("d", "verified")], "id string, status string")
    cells = grounding.cell_grounding(df, "id")
    assert {r.id: r.status for r in cells.collect()} == {"a": "modified", "b": "unverified", "c": "needs_review", "d": "verified"}
    assert tuple(grounding.grounding_totals(cells).first()) == (4, 1, 1, 5, 2, 1, 1, 1)
    assert tuple(grounding.grounding_totals(cells.limit(0)).first()) == (0,) * 8


def test_anchor(spark):
    cases = [("bc", "abcd", ("exact", 1, 3, None)), ("a", "a-a", ("exact", 0, 1, "ambiguous")), ("x", "abc", ("none", None, None, "normalised")), ("x", None, ("none", None, None, "no_source")), ("", "abc", ("none", None, None, "normalised"))]
    df = spark.createDataFrame([c[:2] for c in cases], "p string, s string")
    assert [tuple(r.a) for r in df.select(spans.anchor(F.col("p"), F.col("s")).alias("a")).collect()] == [c[2] for c in cases]


def test_sharing_and_limits(spark):
    df = spark.createDataFrame([(1, ["A@x.pl"]), (2, []), (3, None), (None, ["b@x.pl", None])], "o int, s array<string>")
    assert [r.m for r in df.select(may_open(F.col("o"), F.col("s"), F.lit(2), F.lit("a@X.PL")).alias("m")).collect()] == [True, True, False, False]
    assert [r.m for r in df.select(may_open(F.col("o"), F.col("s"), F.lit(9), F.lit("")).alias("m")).collect()] == [False] * 4
    assert [clamp_limit(n) for n in (None, 0, 7, 500)] == [50, 1, 7, 100]


def test_dates(spark):
    df = spark.createDataFrame([("2020-02-29T10:00:00Z",), ("2021-02-29",), ("x",), (None,)], "t string")
    assert [r.i for r in df.select(tx.is_iso_date(F.col("t")).alias("i")).collect()] == [True, False, False, False]
    assert one(spark, tx.suspect_dates(F.col("t"), F.lit(2020)).alias("s"), t="1.1.1899, 2.2.2021, 3.3.2022, 3.3.2022").s == ["1.1.1899", "3.3.2022"]
    a = F.lit("2020-01-02 00:00:00").cast("timestamp")
    ages = spark.createDataFrame([("2020-01-01 23:59:58.5",), ("2019-12-31 00:00:00",)], "t string").select(tx.age_seconds(F.col("t").cast("timestamp"), a).alias("s"), tx.within_last(F.col("t").cast("timestamp"), a, "24 HOURS").alias("w")).collect()
    assert [tuple(r) for r in ages] == [(1, True), (172800, False)]
    assert one(spark, tx.worded_date(F.col("t")).alias("d"), t="dnia 5 wrzesnia 2021").d == "2021-09-05"


def test_lines_and_stamps(spark, tmp_path):
    df = spark.createDataFrame([("t1", "e", "a", None), ("t2", "f", None, None)], "ts string, ev string, a string, b string")
    lines = df.select(log_line("ts", "ev", {"actor": "a", "doc": "b"}).alias("line"))
    write_lines(lines, str(tmp_path / "log"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "log")).collect()) == ["t1 | e | actor=a", "t2 | f"]
    kv = spark.createDataFrame([("version", "3"), ("other", "x")], "k string, v string")
    assert stamp(kv, "k", "v", ["version", "edition", "built"], {"edition": "full"}).first().asDict() == {"version": "3", "edition": "full", "built": None}
