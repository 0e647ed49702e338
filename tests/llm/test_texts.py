"""Splitting, canonical form, personal information: brute force, round trips, held-out accuracy."""

import json
import random
import re
import unicodedata as ud
from functools import reduce

from pyspark.sql import functions as F

from docketspark.llm import canonical, pii, pii_train, splitting
from docketspark.llm.pii_weights import WEIGHTS


def brute_kind(t, limit):
    lines = re.sub("[\r\x0b\x0c\x85\u2028\u2029]", "\n", t.replace("\r\n", "\n"))
    ws = splitting.SPACE
    if all(len(p.strip(ws)) <= limit for p in re.split(f"\n[{ws}]*\n", lines)):
        return "paragraph"
    return "word" if all(len(w) <= limit for w in re.split(f"[{ws}]+", t)) else "hard"


def test_summaries_combine():
    r = random.Random(5)
    for _ in range(6000):
        t = "".join(r.choice("ab.  \n\r\u2028 \t") for _ in range(r.randrange(1, 60)))
        limit = r.randrange(2, 12)
        for size in (1, 3, 7, 100):
            s = reduce(splitting.combine, (splitting.summarise(t[p : p + size]) for p in range(0, len(t), size)))
            assert s.blank if not t.strip(splitting.SPACE) else splitting.boundary_kind(s, limit) == brute_kind(t, limit)


def test_split_rules():
    r = random.Random(6)
    for _ in range(4000):
        t = "".join(r.choice("abcd.  \n\u0301") for _ in range(r.randrange(1, 120)))
        limit = r.randrange(4, 20)
        overlap = r.randrange(0, limit // 2)
        ps = splitting.split_text(t, limit, overlap)
        assert ps[0][0] == 0 and ps[-1][1] == len(t) and all(0 < e - s <= limit for s, e in ps)
        assert all(b[0] == a[1] - overlap for a, b in zip(ps, ps[1:]))
    assert splitting.split_text("", 9, 2) == [(0, 0)]
    assert splitting.split_text("aaa bbb\n\nccc ddd eee", 12, 0) == [(0, 9), (9, 20)]


def brute_pieces(t, limit, overlap):
    """The split by its definition: of the runs of white space in the room, the last of the best kind."""
    line_end = "\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]"

    def kind(run, q):
        ends = len(re.findall(line_end, run))
        return 2 if ends > 1 else 1 if ends or re.search(r"[.!?…;:]['\"”»)\]]*$", t[max(0, q - 8) : q]) else 0

    runs = [(m.start(), m.end(), m.group()) for m in re.finditer(f"[{splitting.SPACE}]+", t)]
    after = {e: kind(x[-limit:], max(s, e - limit)) for s, e, x in runs if e < len(t)}
    before = {s: kind(x[:8], s) for s, e, x in runs if s}
    out, s = [], 0
    while len(t) > limit and s + limit < len(t):
        z, low, half = s + limit, s + overlap, s + max(overlap, limit // 2)
        at = dict(p for p in after.items() if p[0] <= z) | ({z: max(before[z], after.get(z, -1))} if z in before else {})
        fits = [max((p for p, k in at.items() if k >= want and p > least), default=0) for want, least in ((2, half), (1, half), (0, low))]
        e = next((p for p in fits if p), 0)
        if not e:
            e = z
            while e > low + 1 and ud.category(t[e])[0] == "M":
                e -= 1
        out.append((s, e))
        s = e - overlap
    return [*out, (s, len(t))]


def test_split_is_the_defined_one():
    r = random.Random(16)
    for _ in range(4000):
        t = "".join(r.choice("abcd.!”  \n\r\u0301\u2028") for _ in range(r.randrange(1, 200)))
        limit = r.randrange(4, 40)
        overlap = r.randrange(0, limit // 2)
        assert splitting.split_text(t, limit, overlap) == brute_pieces(t, limit, overlap)


def test_repeated_ids_are_one_item(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, None), (None, "x"), (2, "")], "hit_id long, text string")
    got = sorted((p.hit_id, p.piece, p.piece_text) for p in splitting.split_items(df, "hit_id", "text", 10, 2).collect())
    assert got == [(1, 0, "a b"), (2, 0, "")]


def test_ranges_give_the_whole_split(spark, monkeypatch):
    monkeypatch.setattr(splitting, "GROUP", 3)
    r = random.Random(7)
    texts = [(i, "".join(r.choice("abcd.  \n\u00a0") for _ in range(n))) for i, n in enumerate([0, 5, 90, 400, 1500, 3000])]
    texts += [(6, "x" * 1000), (7, None), (8, " " * 700)]
    df = spark.createDataFrame(texts, "hit_id long, body string").withColumn("piece", F.lit("clash"))
    got = splitting.split_items(df, "hit_id", "body", 60, 13, size=100).orderBy("hit_id", "piece").collect()
    for i, t in texts:
        mine = [(p.piece_start, p.piece_end, p.piece_text) for p in got if p.hit_id == i]
        assert mine == ([] if t is None else [(s, e, t[s:e]) for s, e in splitting.split_text(t, 60, 13)])
        assert [p.piece for p in got if p.hit_id == i] == list(range(len(mine)))
    assert splitting.split_items(df.limit(0), "hit_id", "body", 60, 13).count() == 0


def test_files_are_split_without_loading_them(spark, tmp_path):
    r = random.Random(8)
    t = "".join(r.choice("abcde żółw.  \n") for _ in range(9000)) + "\n\nkoniec"
    (tmp_path / "a.txt").write_bytes(t.encode())
    (tmp_path / "b.txt").write_bytes(b"")
    (tmp_path / "c.txt").write_bytes(("ż" * 700).encode())
    got = splitting.split_files(spark, [str(tmp_path)], 200, 20, size=1000).orderBy("piece").collect()
    a = [p for p in got if p.path.endswith("a.txt")]
    assert [p.piece for p in a] == list(range(len(a)))
    raw = t.encode()
    assert a[0].byte_start == 0 and a[-1].byte_end == len(raw)
    assert all(raw[p.byte_start : p.byte_end].decode() == p.piece_text and len(p.piece_text.encode()) <= 200 for p in a)
    assert all(x.byte_end >= y.byte_start >= x.byte_end - 20 - 3 for x, y in zip(a, a[1:]))
    assert [(p.piece, p.byte_start, p.byte_end, p.piece_text) for p in got if p.path.endswith("b.txt")] == [(0, 0, 0, "")]
    c = [p for p in got if p.path.endswith("c.txt")]
    assert c[-1].byte_end == 1400 and all(set(p.piece_text) == {"ż"} for p in c)


def test_classify(spark):
    rows = [(1, "a" * 950), (2, "a " * 500), (3, ("a" * 400 + "\n\n") * 4), (4, " " * 2000), (5, None), (6, "short"), (2, "a " * 500), (7, "a\u00a0" * 500)]
    df = spark.createDataFrame(rows, "hit_id long, text string").withColumn("boundary", F.lit(1))
    got = sorted(map(tuple, splitting.classify_texts(df, "hit_id", "text", 900).collect()))
    assert got == [(1, "hard"), (2, "word"), (3, "paragraph"), (7, "word")]
    assert splitting.classify_texts(df.limit(0), "hit_id", "text", 900).count() == 0


def test_running_numbers(spark):
    df = spark.createDataFrame([("d", i, i % 3) for i in range(100)] + [(None, 1, 5), (None, 2, 7)], "k string, o int, n int")
    got = {(x.k, x.o): x.before for x in splitting.running_numbers(df, "k", ["o"], "n", 7).collect()}
    assert all(got["d", i] == sum(j % 3 for j in range(i)) for i in range(100)) and got[None, 2] == 5


def test_segments_equal_the_whole():
    r = random.Random(2)
    pool = [0x301, 0x328, 0x308, 0x200B, 0xFEFF, 0x61, 0x430, 0x435, 0x7A, 13, 10, 9, 11, 32, 0xA0, 0x2009, 0xFB01, 0x2166, 0xFF21, 0x1161, 0x1100, 0xAC00, 0x9BE, 0x9C7, 0x345, 0xE0100, 0xB2, 0x457, 0]
    for _ in range(15000):
        t = "".join(chr(r.choice(pool) if r.random() < 0.85 else r.choice([r.randrange(32, 0xD800), r.randrange(0xE000, 0x20000)])) for _ in range(r.randrange(1, 16)))
        a = canonical.canonical_text(t)
        assert a == canonical.normalise(t) and canonical.canonical_text(a) == a and ud.is_normalized("NFC", a)


ALIKE = [("ｆｉ", "ﬁ"), ("Ⅻ", "XII"), ("e\u0301", "é"), ("е\u0301", "é"), ("a\u00a0b", "a b"), ("zażółć", "zażół\u200bć"), ("Кот", "Koт"), ("ａ１！", "a1!"), ("ΑΝΝΑ", "ANNA"), ("a\r\nb", "a\nb")]
APART = [("m²", "m2"), ("a", "A"), ("ż", "z"), ("٣", "3"), ("“", '"'), ("①", "1"), ("a.", "a,"), ("½", "1/2")]


def test_what_looks_alike():
    assert all(canonical.canonical_text(a) == canonical.canonical_text(b) for a, b in ALIKE)
    assert all(canonical.canonical_text(a) != canonical.canonical_text(b) for a, b in APART)


def test_pairs_and_classes(spark):
    rows = [(1, "Kot"), (2, "Кot"), (3, "Kot"), (4, "kot"), (5, None), (6, ""), (7, "\u200b \u00a0"), (8, " "), (9, "x\u0301" * 3000), (10, "x\u0301" * 3000 + "\u200b"), (1, "Kot")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("raw", F.lit(1)).withColumn("look", F.lit(2))
    assert sorted(map(tuple, canonical.look_alike_pairs(df, "doc_id", "text").collect())) == [(1, 2), (2, 3), (9, 10)]
    got = {(r.doc_id, r.class_id, r.variants, r.links) for r in canonical.look_alike_classes(df, "doc_id", "text").collect()}
    assert got == {(1, 1, 2, 1), (2, 1, 2, 1), (3, 1, 2, 1), (4, 4, 1, 0), (9, 9, 2, 1), (10, 9, 2, 1)}
    assert canonical.look_alike_pairs(df.limit(0), "doc_id", "text").count() == 0
    out = {r.doc_id: r.c for r in canonical.canonical_column(df.where("doc_id < 6"), "text", "c").collect()}
    assert out[2] == "Kot" and out[5] is None


def test_field_on_held_out_texts():
    precision, recall = pii_train.held_out(WEIGHTS, seed=4242)
    assert precision > 0.97 and recall > 0.97


def test_names_of_no_list():
    precision, recall = pii_train.held_out_names(WEIGHTS, seed=4243)
    assert precision > 0.9 and recall > 0.88
    for text, name in [
        ("Umowę zawarł Hans Müller z Berlina.", "Hans Müller"), ("John Smith called us.", "John Smith"), ("Oleksandr Shevchenko nie przyszedł.", "Oleksandr Shevchenko"),
        ("Wczoraj Mia Fischer podpisała.", "Mia Fischer"), ("Herr Klaus Weber war da.", "Klaus Weber"), ("Oskar Wrona złożył pismo.", "Oskar Wrona"), ("Свідок Тарас Кравчук пояснив.", "Тарас Кравчук"),
    ]:
        assert [(s.kind, s.value) for s in pii.find(text)] == [("name", name)]


def test_leaving_out_hopeless_names_changes_nothing():
    for text, _ in pii_train.sample(400, 31) + pii_train.sample(200, 32, pii_train.HELD_FRAMES, True):
        every = pii.candidates(text)
        for s in every:
            s.score = pii.score(s, WEIGHTS)
        assert [(s.start, s.end, s.kind) for s in pii.best_segments(every)] == [(s.start, s.end, s.kind) for s in pii.find(text)]
        assert not pii.find(pii.mask(text))


def test_training_learns():
    w = pii_train.train(pii_train.sample(300, 5), rounds=25)
    precision, recall = pii_train.held_out(w)
    assert precision > 0.93 and recall > 0.93


def test_marginals_are_the_brute_force_ones():
    import itertools
    import math

    found = pii.candidates("Pan Jan Kowalski, ul. Jana Matejki 5 m. 2, tel. 600 100 200")
    w = {k: v * 0.3 for k, v in WEIGHTS.items()}
    assert 4 < len(found) < 18
    total, each, best = 0.0, [0.0] * len(found), (-1.0, None)
    for pick in itertools.product((0, 1), repeat=len(found)):
        on = sorted((found[i] for i in range(len(found)) if pick[i]), key=lambda s: s.start)
        if any(a.end > b.start for a, b in zip(on, on[1:])):
            continue
        s = sum(pii.score(x, w) for x in on)
        total += math.exp(s)
        if s > best[0]:
            best = (s, on)
        for i, p in enumerate(pick):
            each[i] += p * math.exp(s)
    z, p = pii_train.expectation(found, w)
    assert abs(z - math.log(total)) < 1e-9 and all(abs(a - b / total) < 1e-9 for a, b in zip(p, each))
    for s in found:
        s.score = pii.score(s, w)
    assert sum(s.score for s in pii.best_segments(found)) - best[0] > -1e-9


KNOWN = [
    ("Pisz na Jan.Nowak+x@Poczta.Test!", {("email", "jan.nowak+x@poczta.test")}),
    ("biuro [at] firma [dot] example", {("email", "biuro@firma.example")}),
    ("wersja redakcja@2.1 i @zespol-umow", set()),
    ("tel.: 600\u00a0100\u00a0200, (22) 123 45 67", {("phone", "600100200"), ("phone", "221234567")}),
    ("Numer to +48600100200.", {("phone", "600100200")}),
    ("Kwota 600 100 200 zł i rachunek 43 2717 5750 9668 0300 8239 5736", set()),
    ("PESEL 440514-01359, dalej 44051401358", {("identity", "44051401359")}),
    ("NIP PL5260001246", {("identity", "5260001246")}),
    ("dow. os. abc 123 456, paszport ZS-1234567", {("identity", "ABC123456"), ("identity", "ZS1234567")}),
    ("zam. Nowinki, ul. Jana Nowakowskiego 15a/3, 00-123 Nowinki", {("address", "Jana Nowakowskiego 15a")}),
    ("Korespondencję kierować: Nad Wisłą 7 m. 2, 00-123 Nowinki", {("address", "Nad Wisłą 7")}),
    ("Zustellung an Hauptstraße 8, 12345 Neustadt", {("address", "Hauptstraße 8")}),
    ("Rozmawiałem z mec. Nowakowska i panem Adamem\nKowalskim-Zielińskim", {("name", "Nowakowska"), ("name", "Adamem Kowalskim-Zielińskim")}),
    ("Podpisali: KOWALSKA EWA, M. Zielińska", {("name", "KOWALSKA EWA"), ("name", "M. Zielińska")}),
    ("Sąd Okręgowy w Nowinkach, Zagrodex sp. z o.o., wyrok XX Ca 1092/10", set()),
    ("", set()),
]


def test_known_texts():
    for text, want in KNOWN:
        assert {(s.kind, s.value) for s in pii.find(text)} == want, text
        masked = pii.mask(text)
        assert {(s.kind, s.value) for s in pii.find(masked)} == set()
        if not want:
            assert masked == text


def test_messages_and_masks(spark):
    events = [{"type": "content", "text": "Pan Jan "}, {"type": "content", "text": "Kowalski, tel. 600 100 200"}, {"type": "doc_read", "filename": "a@b.pl", "document_id": "44051401359"}]
    plain = json.dumps(events)
    rows = [("A ", plain, "x"), ("b", json.dumps(plain), "x"), ("c", "tel. 600 100 200", None), ("d", None, None), ("e", "  ", None), ("c", "tel. 600 100 200", None), ("f", "słowo " * 3000 + "a@b.pl", "y")]
    df = spark.createDataFrame(rows, "id string, content string, kind string")
    got = sorted((r.row_id, r.kind, r.found_value) for r in pii.find_pii(df, "s", "id", "content", True).collect())
    both = [("name", "Jan Kowalski"), ("phone", "600100200")]
    assert got == sorted([*(("a", *x) for x in both), *(("b", *x) for x in both), ("c", "phone", "600100200"), ("f", "email", "a@b.pl")])
    masked = {r.id: r.m for r in pii.mask_pii(df, "id", "content", "m", True).collect()}
    assert json.loads(masked["A "])[2] == events[2] and "[PHONE]" in masked["A "] and json.loads(json.loads(masked["b"]))[2] == events[2]
    assert masked["c"] == "tel. [PHONE]" and masked["d"] is None and masked["e"] == "  " and masked["f"].endswith(" [EMAIL]")
    assert pii.find_pii(df.limit(0), "s", "id", "content", True).count() == 0


def test_masks_what_is_found_over_adjoining_events():
    texts = ["Pan Jan ", "Kowalski, tel. 600 1", "00 2", "00, e-mail jan@pocz", "ta.example \\ \"ok\""]
    events = [{"type": "content", "text": t, "n": [1, {"x": None}]} for t in texts]
    cut = [{"type": "content", "text": "Pan Adam "}, {"type": "reasoning", "text": "Nowak \u017c"}, {"text": "tel. 600 200 300", "type": "content"}, [{"id": "x"}, "Pan Jan Nowak"]]
    for value in (events, {"id": "a@b.pl", "list": events, "note": "c@d.pl"}, cut, {"type": "content", "text": "Pan Jan Nowak"}):
        for raw in (json.dumps(value), json.dumps(value, ensure_ascii=False, indent=1), json.dumps(json.dumps(value))):
            found = pii.find_in_content(raw, True)
            masked = pii.mask_content(raw, True)
            assert found and pii.find_in_content(masked, True) == []
    one = json.loads(pii.mask_content(json.dumps(events), True))
    assert [e["text"] for e in one] == ["Pan [NAME]", ", tel. [PHONE]", "", ", e-mail [EMAIL]", " \\ \"ok\""]
    assert [e["n"] for e in one] == [e["n"] for e in events]
