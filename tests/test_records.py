"""Edges, purges, reasons, attribution, chained appends, requests and payload masks on small fixtures."""

import json
from datetime import UTC, datetime
from hashlib import sha256

from pyspark.sql import functions as F

from docketspark.functions.masking import mask_payloads, mask_tree
from docketspark.operators import ledger, records
from docketspark.sources import requests as rq
from docketspark.streaming.windows import stream_table

NOW = datetime(2024, 5, 10, 12, tzinfo=UTC)


def test_edges(spark):
    rows = [(1, "cites", "run1"), (2, "Cites", "run1"), (3, "ok_2", "  "), (4, None, "run2"), (5, "x" * 65, None), (6, "about", "run2")]
    p = records.propose_edges(spark.createDataFrame(rows, "id int, label string, run string"))
    assert {(r.id, r.run, r.status) for r in p.collect()} == {(1, "run1", "proposed"), (3, None, "proposed"), (6, "run2", "proposed")}
    r = records.ratify_edges(p, F.col("id") == 6, F.lit("human"))
    assert {x.id for x in records.visible_edges(r, "run1").collect()} == {1, 3, 6} and {x.id for x in records.visible_edges(p, None).collect()} == {3}
    again = records.ratify_edges(p, F.col("id") == 6, F.lit("model"))
    assert {x.status for x in again.collect()} == {"proposed"}


def test_purge_and_anonymise(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, v string")
    b = spark.createDataFrame([(1,), (1,), (3,)], "k int")
    kept, report = records.purge({"a": (a, "k"), "b": (b, "k")}, spark.createDataFrame([(1,), (1,), (9,)], "gone int"))
    assert {r.v for r in kept["a"].collect()} == {"y", "z"} and kept["b"].count() == 1
    assert {tuple(r) for r in report.collect()} == {("a", 1, 2), ("b", 2, 1)}
    _, none = records.purge({"a": (a.limit(0), "k")}, spark.createDataFrame([], "gone int"))
    assert tuple(none.first()) == ("a", 0, 0)
    assert {r.v for r in records.anonymise(a, "v", "x").collect()} == {None, "y", "z"}
    assert a.select(records.receipt(F.lit("u")).alias("r")).first().r == sha256(b"u").hexdigest()[:16]


def test_reasons(spark):
    df = spark.createDataFrame([(1,), (5,), (20,), (None,)], "n int")
    got = records.split_by_reason(df, {"big": F.col("n") > 10, "more than 3": F.col("n") > 3}).collect()
    assert {r.n: r.reason for r in got} == {1: None, 5: "more than 3", 20: "big", None: None}


def test_attribution(spark):
    src = "first title ... quote one; second title ... quote two"
    rows = [(m, src, src.index(q) + 1, k, p, "no") for m, q in ((1, "quote one"), (2, "quote two")) for k, p in (("a", "first title"), ("b", "second title"))]
    rows += [(3, src, 1, "a", "first title", None), (3, src, 1, "b", "xx", None), (4, src, 1, "only", "", None)]
    df = spark.createDataFrame(rows, "m int, s string, at int, key string, p string, q string")
    assert {r.m: r.key for r in records.attribute(df, ["m"], "s", "at", "key", ["p", "q"]).collect()} == {1: "a", 2: "b", 4: "only"}


def test_chained_appends(spark, tmp_path):
    src, log = str(tmp_path / "src"), str(tmp_path / "log")
    spark.createDataFrame([(2, "b"), (1, "a"), (3, None)], "id long, body string").coalesce(1).write.parquet(src)
    for _ in range(2):  # the second run, over a new checkpoint, gives all rows again and adds none
        q = records.append_chained(stream_table(spark, src), log, "id", "body", str(tmp_path / f"c{_}")).trigger(availableNow=True).start()
        q.awaitTermination()
    spark.createDataFrame([(4, "d")], "id long, body string").coalesce(1).write.mode("append").parquet(src)
    q = records.append_chained(stream_table(spark, src), log, "id", "body", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(log).orderBy("id").collect()
    assert [r.id for r in rows] == [1, 2, 3, 4] and rows[0].prev_hash == ledger.GENESIS
    assert all(a.hash == b.prev_hash for a, b in zip(rows, rows[1:])) and rows[3].hash == sha256((rows[2].hash + "d").encode()).hexdigest()
    assert ledger.check_links(spark.read.parquet(log)).where("NOT link_ok").count() == 0


def test_requests(spark):
    ok = rq.parse_log_request({"event_type": "all", "since": "2024-05-01", "limit": "2", "cursor": "9"}, {"a"}, NOW)
    assert (ok.event_type, ok.limit, ok.cursor, ok.until) == (None, 2, 9, NOW)
    for params, error in (({"event_type": "zz"}, "event_type"), ({"actor_user_id": "x"}, "actor"), ({"since": "2024-02-30"}, "since"), ({"until": "x"}, "until"), ({"limit": "0"}, "limit"), ({"limit": "201"}, "limit"), ({"cursor": "-1"}, "cursor")):
        assert error in rq.parse_log_request(params, {"a"}, NOW)
    assert rq.parse_log_request({}, set(), NOW).limit == 50
    log = spark.createDataFrame([(i, f"2024-05-{i:02d}T00:00:00Z", None, "a") for i in range(1, 13)], "id long, ts string, actor_user_id string, event_type string")
    assert [r.id for r in ok.apply(log).collect()] == [8, 7]
    assert rq.parse_window("2024-01-01", "bad", NOW) == (datetime(2024, 1, 1, tzinfo=UTC), NOW)
    assert [rq.hours_to_ms(x, 7) for x in ("1.5", "0", "x", None, "-2", "1e1h")] == [5_400_000, 7, 7, 7, 7, 36_000_000]
    assert [rq.positive_int(x, 3) for x in ("12", "12ab", "0", "-1", "", None)] == [12, 12, 3, 3, 3, 3]


def test_payload_masks(spark):
    v = {"p": "44051401359", "m": ["janina@x.pl", {"t": "a" * 300, "n": 5}], "s": "ok"}
    masked = mask_tree(v)
    assert masked == {"p": "4405***1359", "m": ["jan***@x.pl", {"t": "a" * 100 + "[...]" + "a" * 100, "n": 5}], "s": "ok"}
    df = spark.createDataFrame([(1, json.dumps(v)), (2, json.dumps(json.dumps(v))), (3, None), (4, "44051401359"), (5, "{cut")], "id int, j string")
    got = {r.id: r.masked for r in mask_payloads(df, "id", "j", "masked").collect()}
    assert json.loads(got[1]) == json.loads(got[2]) == masked and got[3] is None and got[4] == "4405***1359" and got[5] == "{cut"


def test_headings():
    from docketspark.operators.chunking import sections

    for head in ("W Y R O K", "Sygn. akt I C 1/20", "Sąd ustalił następujący stan", "Sad zwazyl, co nastepuje", "UZASADNIENIE"):
        text = f"wstęp\n{head}\ntreść\nStan faktyczny:\ndalej"
        assert [text[a:z].split("\n")[0] for a, z in sections(text)] == ["wstęp", head, "Stan faktyczny:"]
    assert len(sections("wstęp\nStan faktyczny:\ndalej")) == 1 and len(sections("a\nart. 5 x\n§ 2 y\nlit. b z")) == 4
