"""Line assembly, validated rows and block roots over micro-batches; entity rules with triggers."""

from hashlib import sha256

from pyspark.sql import functions as F

from docketspark.operators import entities, ledger

from docketspark.streaming import windows


def test_lines_and_rows(spark, tmp_path):
    path = str(tmp_path / "d")
    rows = [("c", 1, '{"column_index": 1, "sum', False), ("c", 2, 'mary": "x"}\n{"column_index"', False), ("c", 3, ': 9}\nnot json\n{"column_index": 2, "flag": "red"}', True), ("d", 1, "rest", False)]
    for r in rows:
        spark.createDataFrame([r], "conv_id string, seq long, delta string, last boolean").coalesce(1).write.mode("append").parquet(path)
    lines = windows.run_to_end(windows.assemble_lines(windows.stream_table(spark, path, 1000)), "lines", "append")
    assert sorted(r.line for r in lines.collect()) == sorted(['{"column_index": 1, "summary": "x"}', '{"column_index": 9}', "not json", '{"column_index": 2, "flag": "red"}'])
    known = spark.createDataFrame([(1,), (2,)], "column_index int")
    assert sorted(map(tuple, windows.valid_rows(lines, known).collect())) == [("c", 1, "x", "grey"), ("c", 2, "", "red")]


def test_block_roots(spark, tmp_path):
    path, out = str(tmp_path / "log"), str(tmp_path / "roots")
    hashes = [sha256(str(i).encode()).hexdigest() for i in range(25)]
    for a, z in ((0, 10), (10, 25)):
        spark.createDataFrame([(i, hashes[i]) for i in range(a, z)], "id long, hash string").coalesce(1).write.mode("append").parquet(path)
    windows.block_roots(windows.stream_table(spark, path, 1), out)
    got = sorted((r.block_start, r.block_end, r.n, r.root) for r in spark.read.parquet(out).collect())
    assert got == [(0, 9, 10, ledger.subtree(hashes[:10])), (10, 24, 15, ledger.subtree(hashes[10:]))]


ENTITY_CASES = {
    "signature-sn": {"III CZP 11/13": "III CZP 11/13", "III CZP 11/2013": "III CZP 11/2013"},
    "signature-nsa": {"II FSK 1234/22": "II FSK 1234/22", "I FSW 2/2021": "I FSW 2/2021"},
    "signature-wsa": {"II SA/Wa 1234/24": "II SA/Wa 1234/24"},
    "signature-kio": {"KIO 1234/24": "KIO 1234/24", "KIO/UZP 56/23": "KIO/UZP 56/23"},
    "signature-tk": {"SK 5/22": "SK 5/22", "Kpt 1/19": "Kpt 1/19"},
    "signature-sad-powszechny": {"I Nc 5/22": "I Nc 5/22", "XXV C 1500/23": "XXV C 1500/23", "I ACa 12/2019": "I ACa 12/2019"},
    "eli-pl-act": {"zob. eli/sejm/ustawy/1964/16/93": "eli/sejm/ustawy/1964/16/93"},
    "celex-eu-act": {"32024R1689": "32024R1689"},
    "firma-z-forma-prawna": {"ABC s.a. w": "ABC s.a.", "Łódzkie Zakłady SP.K.": "Łódzkie Zakłady SP.K.", "Nowa spółka cywilna": "Nowa spółka cywilna"},
    "osoba-z-markerem": {"oskarżony Jan Nowak": "Jan Nowak", "Biegła Ewa Lis-Kowal": "Ewa Lis-Kowal", "r. pr. Adam Żak": "Adam Żak"},
    "copy-kwota-pl": {"kwota 1 200,50 zł.": "1200,50zł", "1.234.567 EUR": "1234567EUR"},
    "copy-data-slowna": {"dnia 3 wrzesnia 2021 r.": "2021-09-03", "12 października 2020 roku": "2020-10-12"},
    "copy-data-kropka": {"z 5.3.2020": "2020-03-05"},
    "act": {"o Zachowek i": "zachowek", "dzial spadku": "dzial spadku"},
    "krs-with-prefix": {"KRS: 0000123456": "0000123456"},
    "street": {"ul. Długa 5/7": "ul. Długa 5/7"},
}


def test_entity_rules(spark):
    texts = [(f"{rule}|{value}", text) for rule, cases in ENTITY_CASES.items() for text, value in cases.items()]
    df = spark.createDataFrame([*texts, ("n", None), ("e", "")], "id string, t string")
    got = entities.detect(df, "id", "t").collect()
    by_id = dict(texts)
    assert all(by_id[r.id][r.start : r.end] == r.value for r in got)
    assert {i for i, _ in texts} == {i for i, _ in texts if any(r.id == i and f"{r.rule_id}|{r.value_normalized}" == i for r in got)}
    sure = {r.value: r.confidence for r in entities.detect(spark.createDataFrame([(1, "wyrok IV CSK 11/20, potem V CSK 12/20 i daleko dalej bez słowa VI CSK 13/20")], "id int, t string"), "id", "t", known_prefixes=frozenset({"VI CSK"})).collect()}
    assert round(sure["IV CSK 11/20"], 2) == 1.0 and round(sure["VI CSK 13/20"], 2) == 0.95
    none = "II SA Wa 1/20, IC 5/22, eli/inne/x/1/2, spółka, pan jan, KRS 123, 31.13.2020, 12 foo 2020"
    assert not entities.detect(spark.createDataFrame([(1, none)], "id int, t string"), "id", "t").where("kind NOT IN ('CZYN')").count()


def test_signature_prefixes_and_edges(spark):
    cases = {"II SA/Wa 1/24": "II SA/Wa", "KIO/UZP 5/23": "KIO/UZP", "KIO 5/23": "KIO", "III CZP 1/13": "III CZP", "Kpt 1/19": "Kpt", "I ACa 1/23": "I ACa", " XXV C 5/23": "XXV C", "foo": None, None: None}
    got = spark.createDataFrame([(v,) for v in cases], "v string").select("v", entities.signature_prefix(F.col("v")).alias("p")).collect()
    assert {r.v: r.p for r in got} == cases
    cities = spark.createDataFrame([("Wa", "wsa-w", "Warszawa")], "code string, court string, city string")
    meta = entities.signature_metadata(spark.createDataFrame([("II SA/Wa 1/24",), ("III CZP 1/13",)], "v string"), "v", spark.createDataFrame([("III CZP", "sn")], "prefix string, court string"), cities).collect()
    assert {(m.prefix, m.court, m.city) for m in meta} == {("II SA/Wa", "wsa-w", "Warszawa"), ("III CZP", "sn", None)}
    hits = entities.detect(spark.createDataFrame([(1, "SK 5/22 oraz e@x.pl i ABC s.a.")], "id int, t string"), "id", "t")
    assert {(e.relation, e.value) for e in entities.edges(hits, "id").collect()} == {("cytuje_orzeczenie", "SK 5/22"), ("wspomina_firme", "ABC s.a.")}
