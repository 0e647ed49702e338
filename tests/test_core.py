"""Query builder, ordered computations, sinks, ledger, grounding, retrieval, streams."""

import random
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketspark.functions import checksums, masking, text
from docketspark.operators import chunking, grounding, ledger, retrieval
from docketspark.operators.ordered import line_up, with_lag, with_last_seen, with_lead, with_preceding, with_running_sum
from docketspark.operators.pseudonym import residue, wrap
from docketspark.operators.query import Query, QueryError, parse_or
from docketspark.sources import tables as src
from docketspark.streaming import windows


def test_query_builder(spark):
    df = spark.createDataFrame([(1, "a", ["x", "y"]), (2, None, None), (3, "B", ["x"])], "id int, s string, tags array<string>")
    q = Query(df)
    ids = lambda q: sorted(r.id for r in q.frame().collect())
    assert ids(q.neq("s", "a")) == [3] and ids(q.is_("s", None)) == [2] and ids(q.not_is("s", None)) == [1, 3]
    assert ids(q.in_("id", [])) == [] and ids(q.cs("tags", "x")) == [1, 3] and ids(q.cs("tags", [])) == [1, 2, 3]
    assert ids(q.ilike("s", "b")) == [3] and ids(q.or_("id.eq.1,s.is.null,junk")) == [1, 2] and ids(q.or_("junk")) == [1, 2, 3]
    assert q.range(0, 0).count() == 3 and q.optional("id", "eq", None).count() == 3
    assert q.eq("id", 9).maybe_single() is None and q.eq("id", 1).single().s == "a"
    for bad in (lambda: q.single(), lambda: q.maybe_single(), lambda: q.select("nope"), lambda: q.filter("id", "regex", 1), lambda: q.eq("id", 9).single()):
        with pytest.raises(QueryError):
            bad()
    assert parse_or("") is None
    plan = q.eq("id", 1).select("s").frame()._jdf.queryExecution().toString()
    assert "Filter" in plan


@pytest.mark.parametrize("key", ["k", None])
def test_ordered_over_partition_edges(spark, key):
    r = random.Random(4)
    data = [(r.choice(["a", "a", "a", "b", "c"]), i, r.randrange(5), r.choice([None, i])) for i in range(400)]
    df = spark.createDataFrame(data, "k string, t int, v int, w int")
    lined = line_up(df, key, ["t"], 7)
    out = with_running_sum(lined, key, ["t"], "v", "s")
    out = with_last_seen(with_lag(out, key, ["t"], F.col("v"), "l"), key, ["t"], F.col("w"), "seen")
    out = with_preceding(with_lead(out, key, ["t"], F.col("w"), "n"), key, ["t"], F.col("v"), 3, "p")
    rows = out.collect()
    got = {(x.k, x.t): (x.s, x.l, x.seen) for x in rows}
    groups: dict = {}
    for k, t, v, w in sorted(data, key=lambda x: x[1]):
        groups.setdefault(k if key else 0, []).append((k, t, v, w))
    after = {(g[i][0], g[i][1]): (g[i + 1][3] if i + 1 < len(g) else None, [x[2] for x in g[max(0, i - 3) : i]]) for g in groups.values() for i in range(len(g))}
    assert {(x.k, x.t): (x.n, x.p) for x in rows} == after
    state: dict = {}
    for k, t, v, w in sorted(data, key=lambda x: x[1]):
        g = k if key else 0
        s, last, seen = state.get(g, (0, None, None))
        state[g] = (s + v, v, w if w is not None else seen)
        assert got[k, t] == (s + v, last, state[g][2])
    assert len(got) == 400
    assert with_running_sum(line_up(df.limit(0), key, ["t"], 3), key, ["t"], "v", "s").count() == 0


def test_sinks(spark):
    a = spark.createDataFrame([(1, "x", 10), (2, "y", 20)], "id int, s string, made int")
    b = spark.createDataFrame([(2, "z", 99), (3, "n", 30)], "id int, s string, made int")
    assert sorted(src.upsert_rows(a, b, ["id"], keep=("made",)).collect()) == [(1, "x", 10), (2, "z", 20), (3, "n", 30)]
    assert sorted(src.insert_rows(a, spark.createDataFrame([(5, 1)], "id int, junk int"), {"made": F.lit(7)}).collect(), key=str)[-1] == (5, None, 7)
    assert src.delete_rows(a).count() == 0 and src.delete_rows(a, F.col("id") == 1).count() == 1
    assert sorted(src.update_rows(a, F.col("id") == 1, {"s": F.lit("q"), "no": F.lit(1)}).collect()) == [(1, "q", 10), (2, "y", 20)]


def test_sources(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ntitle: T\nk : v\n---\nbody\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.TXT").write_text("x" * 600)
    files = src.read_documents(spark, str(tmp_path))
    assert {r.suffix for r in files.select("suffix").collect()} == {"md", "txt"}
    meta = src.front_matter(files.where("suffix = 'md'").select(F.decode("content", "UTF-8").alias("t")), "t").first()
    assert meta.meta == {"title": "T", "k": "v"} and meta.body == "body\n"
    d = src.block_digests(files.where("suffix = 'txt'"), "path", "content", 256).collect()
    assert sorted((x.first_offset, x.digest) for x in d) == [(0, sha256(b"x" * 256).hexdigest()), (512, sha256(b"x" * 88).hexdigest())]


def test_merkle(spark):
    hs = [sha256(str(i).encode()).hexdigest() for i in range(2600)]
    for n in (1, 2, 3, 7, 8, 1024, 1025, 2600):
        log = spark.createDataFrame([("b", i, h) for i, h in enumerate(hs[:n])], "b string, id int, h string")
        assert ledger.merkle_roots(log, "b", "id", "h").first().root == ledger.subtree(hs[:n])
    for n, i in ((1, 0), (5, 4), (8, 3)):
        p = ledger.merkle_proof(hs[:n], i)
        row = spark.createDataFrame([(hs[i], p)], "leaf string, proof array<struct<side: string, hash: string>>")
        assert row.select(ledger.verify_proof(F.col("leaf"), F.col("proof"))).first()[0] == ledger.subtree(hs[:n])


def test_chain_breaks(spark):
    rows, prev = [], ledger.GENESIS
    for i in range(300):
        h = sha256(f"{prev}{i}".encode()).hexdigest()
        rows.append((i, prev, h))
        prev = h
    rows[57] = (57, rows[57][1], "tampered")
    del rows[200]
    bad = ledger.check_links(spark.createDataFrame(rows, "id int, prev_hash string, hash string")).where("NOT link_ok").collect()
    assert sorted(r.id for r in bad) == [58, 201]


def test_grounding(spark):
    source = 'Umowa "najmu" została roz-\nwiązana – przed   terminem. Strony zawarły nową umowę.'
    data = [(1, "umowa «najmu» została rozwiązana", source), (2, "umowa [...] nową", source), (3, "nową ... umowa „najmu”", source), (4, "strony zawarly nowa umowe", source), (5, "zupełnie inny tekst bez związku", source), (6, " ", source), (7, "x", None)]
    df = spark.createDataFrame(data, "id int, q string, s string")
    r = grounding.check_exact(df, "q", "s")
    got = {x.id: x.status for x in r.collect()}
    assert got == {1: "verified", 2: "verified", 3: None, 4: None, 5: None, 6: "no_source", 7: "no_source"}
    fuzzy = {x.id: x.status for x in grounding.check_fuzzy(r.where("status IS NULL"), ["id"]).collect()}
    assert fuzzy[5] == "unverified" and fuzzy[3] == "modified"
    assert grounding.window_ratio("abcdef", "bxd") == pytest.approx(1 / 3) and grounding.window_ratio("", "a") == 1.0


def test_nearest_and_index_recall(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 8)).astype("float32")
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, v array<float>")
    q = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "v")
    exact = {(r.query_id, r.id) for r in retrieval.nearest(v, q, 10, 8, row_block=200, query_block=5).collect()}
    for i in range(0, 900, 50):
        d = ((x.astype(float) - x[i].astype(float)) ** 2).sum(1)
        d[i] = np.inf
        assert {b for a, b in exact if a == i} == set(np.argsort(d)[:10])
    c = retrieval.fit_centroids(v, 12)
    found = {(r.query_id, r.id) for r in retrieval.nearest_indexed(v, q, 10, c, 8).collect()}
    assert len(found & exact) / len(exact) >= 0.9


def test_index_recall_on_the_tables(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    q = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "v")
    exact = {(r.query_id, r.id) for r in retrieval.nearest(v, q, 10, 64).collect()}
    scales = retrieval.fit_scales(v)
    index = retrieval.encode_vectors(v, scales)
    assert index.count() == v.count() and {len(r.code) for r in index.collect()} == {64}
    found = {(r.query_id, r.id) for r in retrieval.nearest_encoded(index, v, q, 10, scales, row_block=100, query_block=3).collect()}
    assert len(found & exact) / len(exact) >= 0.98


def test_lists_of_clustered_vectors_need_few_probes(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16)) * 4
    x = (centres[rng.integers(0, 30, 1200)] + rng.normal(size=(1200, 16)) * 0.5).astype("float32")
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<float>")
    q = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "v")
    exact = {(r.query_id, r.id) for r in retrieval.nearest(v, q, 10, 16).collect()}
    found = {(r.query_id, r.id) for r in retrieval.nearest_indexed(v, q, 10, retrieval.fit_centroids(v), 4).collect()}
    assert len(found & exact) / len(exact) >= 0.9


def test_resident_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 8)).astype("float32")
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<float>")
    held = retrieval.Resident(v)
    for i in (0, 7, 399):
        d = np.sqrt(((x.astype(float) - x[i]) ** 2).sum(1))
        assert [a for a, _ in held.nearest(x[i], 5)] == np.argsort(d)[:5].tolist()
    assert retrieval.Resident(v.limit(0)).nearest(x[0], 5) == []
    with pytest.raises(ValueError):
        retrieval.Resident(v, most=10)


def test_covering_blocks(spark):
    import random

    from docketspark.operators import ledger

    r = random.Random(8)
    blocks = [(a := r.randrange(200), a + r.randrange(60), r.randrange(9), f"b{i:03d}") for i in range(80)] + [(500, 499, 9, "none")]
    df = spark.createDataFrame(blocks, "block_start long, block_end long, computed_at int, block_id string")
    got = {x.id: x.block_id for x in ledger.covering_block(spark.range(-5, 300), "id", df).collect()}
    want = {i: max((c, b) for a, z, c, b in blocks if a <= i <= z)[1] for i in range(-5, 300) if any(a <= i <= z for a, z, _, _ in blocks)}
    assert got == want and ledger.covering_block(spark.range(5), "id", df.limit(0)).count() == 0
    assert ledger.next_block(0, 5, 0, 0, 100, 100) == (1, 5) and ledger.next_block(5, 5, 0, 0, 1, 1) is None
    assert ledger.next_block(5, 8, 50, 0, 100, 100) is None and ledger.next_block(5, 8, 200, 0, 100, 100) == (6, 8)


def test_scalars(spark):
    df = spark.createDataFrame([("44051401359", "526-000-12-46", "123456785", "abcd@x.pl", "a" * 300)], "p string, n string, r string, e string, t string")
    r = df.select(
        checksums.pesel_ok(F.col("p")).alias("p"), checksums.nip_ok(F.col("n")).alias("n"), checksums.regon_ok(F.col("r")).alias("r"), masking.mask_value(F.col("e")).alias("e"), F.length(masking.mask_window(F.col("t"))).alias("t"),
        masking.mask_value(F.col("p")).alias("mp"), text.clip(F.col("t"), 3).alias("c"), text.count_of(F.lit("abab"), "ab").alias("k"), text.slug(F.lit("Zażółć X!")).alias("sl"), text.suffix(F.lit("a.PDF")).alias("sx"),
    ).first()
    assert (r.p, r.n, r.r) == (True, True, True) and r.e == "abc***@x.pl" and r.t == 205 and r.mp == "4405***1359" and r.c == "aaa…" and r.k == 2 and r.sl == "za-x" and r.sx == "pdf"


def test_chunks():
    t = "A" * 300 + "\r\n\r\n" + "B" * 500 + "\n \n" + "C" * 300 + "\n\n[Page 4]\n" + "D" * 2000
    got = list(chunking.chunks(t))
    assert [(p, len(c)) for _, p, c, _, _ in got] == [(None, 801), (None, 300), (4, 900), (4, 900), (4, 200)]
    assert all(len(c) <= 900 and "".join(t[s:e].split()) == "".join(c.split()) for _, _, c, s, e in got)
    assert list(chunking.chunks("")) == [] and list(chunking.chunks(" \n\n ")) == []


def test_pseudonyms(spark):
    rows = [("1", "c", 1, "mail a@x.pl i b@x.pl"), ("2", "c", 2, "znów A@x.pl, +48 600 100 200"), ("3", "d", 1, "b@x.pl"), ("4", "d", 2, None), ("5", None, 1, "z@x.pl")]
    wrapped, tokens = wrap(spark.createDataFrame(rows, "row_id string, conv_id string, seq int, text string"))
    got = {r.row_id: r.text for r in wrapped.collect()}
    assert got["1"] == "mail [EMAIL_1] i [EMAIL_2]" and got["2"] == "znów [EMAIL_1], [PHONE_1]" and got["3"] == "[EMAIL_1]" and got["4"] is None
    assert got["5"] == "[EMAIL_1]"
    assert residue(wrapped, tokens).count() == 0
    plain = wrapped.withColumn("text", F.when(F.col("row_id") == "5", "z@x.pl").otherwise(F.col("text")))
    assert [(r.row_id, r.value) for r in residue(plain, tokens).collect()] == [("5", "z@x.pl")]


def test_pseudonyms_cover_every_place_and_hot_conversations(spark):
    rows = [("0", "c", 0, "świadek Jan Nowak, ul. Długa 5"), ("9", "c", 0, "firma ABC s.a."), ("1", "c", 1, "Jan Nowak znów; Jan Nowakowski nie; ABC s.a."), ("2", "d", 1, "Jan Nowak")]
    rows += [(f"h{i}", "hot", i, "pan Adam Lis" if i == 0 else "Adam Lis i 5") for i in range(300)]
    wrapped, tokens = wrap(spark.createDataFrame(rows, "row_id string, conv_id string, seq int, text string"))
    got = {r.row_id: r.text for r in wrapped.collect()}
    assert got["0"] == "świadek [PERSON_1], [ADDRESS_1]" and got["9"] == "firma [ORG_1]" and got["1"] == "[PERSON_1] znów; Jan Nowakowski nie; [ORG_1]"
    assert got["2"] == "Jan Nowak" and got["h0"] == "pan [PERSON_1]" and {got[f"h{i}"] for i in range(1, 300)} == {"[PERSON_1] i 5"}
    assert residue(wrapped, tokens).count() == 0 and wrap(spark.createDataFrame(rows, "row_id string, conv_id string, seq int, text string").limit(0))[0].count() == 0


def test_stream_unmask(spark, tmp_path):
    rows = [("c", 1, "Pan [NAME", False), ("c", 2, "_1] i [NAME_10", False), ("c", 3, "] x [y", True), ("d", 1, "bez", True)]
    path = str(tmp_path / "deltas")
    for r in rows:
        spark.createDataFrame([r], "conv_id string, seq long, delta string, last boolean").coalesce(1).write.mode("append").parquet(path)
    stream = windows.unmask_stream(windows.stream_table(spark, path, max_files=1000), {"[NAME_1]": "Jan", "[NAME_10]": "Ewa"})
    out = windows.run_to_end(stream, "unmask", "append").orderBy("conv_id", "seq").collect()
    assert "".join(r.text for r in out if r.conv_id == "c") == "Pan Jan i Ewa x [y" and out[-1].text == "bez"


def test_fuzzy_aligns_the_whole_source(spark):
    import random

    from docketspark.operators import grounding

    def brute(source, part):
        prev = list(range(len(part) + 1))
        best = len(part)
        for ch in source:
            cur = [0]
            for j, c in enumerate(part, 1):
                cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (c != ch)))
            prev, best = cur, min(best, cur[-1])
        return best / len(part)

    r = random.Random(5)
    for _ in range(200):
        source = "".join(r.choice("abc ") for _ in range(r.randrange(1, 90)))
        part = "".join(r.choice("abc ") for _ in range(r.randrange(1, 70)))
        assert grounding.window_ratio(source, part) == brute(source, part)
    far = "koszty procesu w łącznej kwocie obciążają powoda. " + "x" * 300
    rows = [
        ("no anchor whole", "abcdefghi_klmnopqrs_uvwxyz0123", "zz abcdefghijklmnopqrstuvwxyz0123 zz"),
        ("anchor earlier", "koszty procesu w łącznej kwocie 32 obciąża stronę", far + " koszty procesu w łącznej kwocie 32 obciążają stronę"),
        ("other text", "zupełnie inne słowa o niczym", "0123456789" * 5),
    ]
    df = spark.createDataFrame(rows, "name string, _q string, _s string")
    got = {x.name: (round(x.ratio, 6), x.status) for x in grounding.check_fuzzy(df, ["name"], beyond=True).collect()}
    assert got["no anchor whole"] == (round(2 / 30, 6), "modified")
    assert got["anchor earlier"] == (round(2 / 49, 6), "modified")
    assert got["other text"][1] == "unverified"


def test_only_hopeless_windows_are_left_out(spark):
    import random

    from docketspark.operators import grounding

    r = random.Random(6)
    for _ in range(1500):
        source = "".join(r.choice("abcdef ") for _ in range(r.randrange(1, 200)))
        if r.random() < 0.8 and len(source) > 12:  # a window of the source with a few edits
            a = r.randrange(len(source) - 10)
            part = list(source[a : a + r.randrange(8, 80)])
            for _ in range(r.randrange(0, max(1, len(part) // 5))):
                k = r.randrange(len(part))
                part[k : k + r.randrange(2)] = r.choice(["", "x", "ab"])
            part = "".join(part) or "a"
        else:
            part = "".join(r.choice("abcdef ") for _ in range(r.randrange(1, 60)))
        whole = grounding.window_ratio(source, part)
        assert grounding.Source(source).ratio(part, 0.15) == (whole if whole <= 0.15 else None)
    df = spark.createDataFrame([(1, "koszty procesu w kwocie 32", "zasądza koszty procesu w kwocie 33 zł"), (2, "zupełnie inne słowa", "0123456789"), (3, "", "x")], "id int, _q string, _s string")
    assert {x.id: (x.ratio, x.status) for x in grounding.check_fuzzy(df, ["id"]).collect()} == {1: (1 / 26, "modified"), 2: (None, "unverified"), 3: (None, "unverified")}


def test_nearest_name_takes_every_mention(spark, tmp_path):
    from docketspark.plans.search import QUERIES

    spark.createDataFrame([("Sąd Rejonowy w Nowinkach i Sąd Okręgowy w Zagrodzie",), ("nic",), (None,)], "text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("Sąd Rejonowy w Nowinkach",), ("Sąd Okręgowy w Zagrodach",)], "name string").write.parquet(f"{tmp_path}/courts.parquet")
    got = {(r.mention, r.nearest, r.dist) for r in QUERIES["nearest_name"](spark, str(tmp_path)).collect()}
    assert got == {("Sąd Rejonowy w Nowinkach", "Sąd Rejonowy w Nowinkach", 0), ("Sąd Okręgowy w Zagrodzie", "Sąd Okręgowy w Zagrodach", 3)}


def test_lone_citations_are_lists_of_one(spark, tmp_path):
    import json

    from docketspark.plans.search import QUERIES

    one = json.dumps({"quote": "Ala ma kota"})
    cells = [("a", "d", one), ("b", "d", json.dumps(one)), ("c", "d", f" [{one}, {one}] "), ("e", "d", " " + one), ("f", "d", None), ("g", "d", "{")]
    spark.createDataFrame(cells, "id string, document_id string, citations string").write.parquet(f"{tmp_path}/tabular_cells.parquet")
    spark.createDataFrame([("d", "Dziś Ala ma kota.")], "document_id string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.cell, r.ref, r.status) for r in QUERIES["quote_exact"](spark, str(tmp_path)).collect())
    assert got == [(c, i, "verified") for c, i in [("a", 0), ("b", 0), ("c", 0), ("c", 1), ("e", 0)]]
