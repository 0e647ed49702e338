"""Span selections, occurrences, dictionary matching and legal chunks against plain Python."""

import random
import re

from pyspark.sql import functions as F

from docketspark.operators import chunking, spans


def test_span_policies(spark):
    r = random.Random(3)
    rows = [(i, [(s, s + r.randrange(1, 8), "x") for s in (r.randrange(30) for _ in range(r.randrange(0, 12)))]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, s array<struct<start: int, end: int, rule_id: string>>")
    got = {x.id: ([tuple(v)[:2] for v in x.g], [tuple(v)[:2] for v in x.r]) for x in df.select("id", spans.greedy_spans(F.col("s")).alias("g"), spans.reaching_spans(F.col("s")).alias("r")).collect()}
    for i, s in rows:
        greedy, reach = [], []
        for a, z, _ in sorted(s, key=lambda x: (x[0], -x[1])):
            if not greedy or a >= greedy[-1][1]:
                greedy.append((a, z))
            if not reach or a >= reach[-1][1]:
                reach.append((a, z))
            elif z > reach[-1][1]:
                reach[-1] = (a, z)
        assert got[i] == (greedy, reach)


def test_occurrences_and_nearest(spark):
    df = spark.createDataFrame([("abcabxab", "ab"), ("", "a"), ("aaa", "aa"), ("a.b", "."), ("x", "")], "t string, n string")
    got = [x[0] for x in df.select(spans.occurrences(F.col("t"), F.col("n"))).collect()]
    assert got == [[0, 3, 6], [], [0], [1], []]
    near = spark.createDataFrame([([3, 9, 15], 11, -1), ([3, 9, 15], 12, -1), ([3, 9, 15], None, 1), ([3], None, 7), ([], 4, 0)], "p array<int>, h int, o int")
    assert [x[0] for x in near.select(spans.nearest_occurrence(F.col("p"), F.col("h"), F.col("o"))).collect()] == [9, 9, 9, 3, None]


def test_dictionary(spark):
    terms = [("ab", "L1", True), ("b", "L2", False), ("abc", "L1", True), ("ŻÓŁW", "L3", False), ("ab", "L4", True), ("", "L5", True)]
    texts = [(1, "xabcAB b"), (2, "żółw İ Żółw"), (3, None), (4, "")]
    got = sorted(map(tuple, spans.match_dictionary(spark.createDataFrame(texts, "id int, t string"), "id", "t", terms).collect()))
    want = []
    for i, t in texts:
        for term, label, exact in terms:
            if term:
                rx = re.compile(f"(?={re.escape(term)})", 0 if exact else re.I)
                want += [(i, label, term, m.start(), m.start() + len(term)) for m in rx.finditer(t or "")]
    assert got == sorted(want)


def test_legal_chunks():
    t = "WYROK\nSąd orzeka.\n\nUZASADNIENIE\n" + "Zdanie pierwsze jest tu. " * 60 + "\n\n§ 5 Przepis.\n"
    got = list(chunking.legal_chunks(t))
    assert got[0][2] == "WYROK Sąd orzeka." and got[-1][2] == "§ 5 Przepis." and [g[0] for g in got] == list(range(len(got)))
    assert all(len(c) <= 900 for _, _, c, _, _ in got)
    assert chunking.sections("zwykły tekst\n1. punkt") == [(0, 21)]
    assert chunking.with_overlap(["aaa bbb", "ccc"], 5) == ["aaa bbb", "bbb ccc"]
    assert chunking.with_overlap(["x" * 900, "y" * 900]) == ["x" * 900, "y" * 900]
