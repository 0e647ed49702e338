"""Re-ranking on a small corpus with traps: analogues in other words, distractors in the query's words."""

import pytest
from pyspark.sql import functions as F

from docketspark.functions.text import stem, terms
from docketspark.operators import graph, rerank, retrieval

CORPUS = [
    (1, "Spór o zapłatę kary umownej za opóźnienie robót. Sygn. IV CSK 11/20, art. 484."),
    (2, "Wykonawca nie ukończył obiektu w terminie, naliczono karę. IV CSK 11/20, art. 484."),
    (3, "Inwestor potrącił należność wskutek zwłoki. IV CSK 11/20, art. 484."),
    (4, "Kara umowna za opóźnienie, lecz chodzi o inną sprawę: II CR 99/01."),
    (5, "Zadośćuczynienie za krzywdę doznaną w wypadku. I ACa 22/19, art. 445."),
    (6, "Poszkodowany domagał się świadczenia po kolizji. I ACa 22/19, art. 445."),
    (7, "Ból i cierpienie pieszego ocenił biegły. I ACa 22/19, art. 445."),
    (8, "Zadośćuczynienie za krzywdę, ale sygnatura inna: V KK 7/18."),
    (9, "Protokół posiedzenia rady nadzorczej."),
]
GOLD = {1: ("kara umowna za opóźnienie robót", {1, 2, 3}), 2: ("zadośćuczynienie za krzywdę w wypadku", {5, 6, 7})}
SIG = r"([IVX]+ [A-Z][A-Za-z]{1,3} \d+/\d{2})"


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame(CORPUS, "id long, text string")
    post = retrieval.postings(docs, "id", "text")
    asked = spark.createDataFrame([(q, t) for q, (t, _) in GOLD.items()], "query_id int, t string").select("query_id", F.explode(terms(F.col("t"))).alias("w"))
    scores = retrieval.bm25(post, asked.select("query_id", stem(F.col("w")).alias("term")), 9, 11.0)
    edges = docs.select(F.col("id").alias("doc_id"), F.explode(F.regexp_extract_all("text", F.lit(SIG), 1)).alias("value"))
    # analogues share few words with the query: every document is a candidate, most with no text score
    everything = docs.select("id", F.explode(F.array(*map(F.lit, GOLD))).alias("query_id"))
    candidates = everything.join(scores, ["query_id", "id"], "left").select("query_id", "id", F.coalesce("score", F.lit(0.0)).alias("score"))
    profiles = edges.groupBy(F.col("doc_id").alias("id")).agg(F.collect_set("value").alias("profile"))
    gold = spark.createDataFrame([(q, i) for q, (_, ids) in GOLD.items() for i in ids], "query_id int, id long")
    return candidates, profiles, gold


def ndcg(scored, gold):
    m = retrieval.ranking_metrics(retrieval.top_k(scored, 5), gold, 5)
    return m.agg(F.avg("ndcg")).first()[0]


def test_structure_lifts_analogues(corpus):
    candidates, profiles, gold = corpus
    base = ndcg(candidates, gold)
    assert ndcg(rerank.dual_rerank(candidates, profiles), gold) > base
    assert ndcg(rerank.dual_rerank(candidates, profiles, alpha=1.0), gold) == pytest.approx(base, abs=1e-6)
    assert ndcg(rerank.dual_rerank(candidates, profiles.limit(0)), gold) == pytest.approx(base, abs=1e-6)


def test_event_frames(spark):
    c = spark.createDataFrame([(1, 1, 3.0), (1, 2, 2.0), (1, 3, 1.0), (2, 9, 1.0)], "query_id int, id long, score double")
    frames = spark.createDataFrame([(1, ["x"], ["p"]), (3, ["x"], ["p"]), (2, ["p"], ["x"])], "id long, basis array<string>, party array<string>")
    got = {(r.query_id, r.id): round(r.score, 6) for r in rerank.event_rerank(c, frames, ["basis", "party"]).collect()}
    assert got == {(1, 1): 1.0, (1, 2): 0.3, (1, 3): 0.4, (2, 9): 1.0}


def test_similarities(spark):
    r = spark.createDataFrame([(["a", "b"], ["b", "c"], [], [])], "a array<string>, b array<string>, e array<string>, f array<string>")
    x = r.select(graph.jaccard(F.col("a"), F.col("b")).alias("j"), graph.jaccard(F.col("e"), F.col("f")).alias("z"), graph.frame_similarity({"p": F.col("a"), "q": F.col("e")}, {"p": F.col("b"), "q": F.col("f")}).alias("m")).first()
    assert (round(x.j, 6), x.z, round(x.m, 6)) == (0.333333, 0.0, 0.333333)


def test_event_frames_by_distance(spark):
    hits = [("d", "date", "x", 0), ("d", "basis", "y", 100), ("d", "basis", "y", 261), ("d", "amount", "z", 300), ("d", "amount", "z", 900), ("e", "date", "q", 5)]
    df = spark.createDataFrame(hits, "doc string, role string, value string, position int")
    got = sorted((r.doc, r.span_start, r.span_end, r.n_hits) for r in graph.event_frames(df.unionByName(df), "doc").collect())
    assert got == [("d", 0, 100, 2), ("d", 261, 300, 2)]


def test_unique_owner_and_centrality(spark):
    e = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "b"), (6, "c"), (1, "a")], "doc_id int, value string")
    got = {(r.doc_id, r.value): r.to_doc_id for r in graph.unique_owner(e, e).collect()}
    assert got == {(1, "a"): 2, (2, "a"): 1, (3, "b"): None, (4, "b"): None, (5, "b"): None, (6, "c"): None}
    assert {(r.doc_id, r.score) for r in graph.document_centrality(e).collect()} == {(1, 2), (2, 2), (3, 3), (4, 3), (5, 3), (6, 1)}


@pytest.mark.parametrize("often", [1, 400])
def test_bm25_top_equals_bm25(spark, often):
    import random

    r = random.Random(3)
    texts = [(i, " ".join(r.choice(["w", "spraw", "umowa"]) if r.random() < 0.3 else f"s{r.randrange(often)}" for _ in range(40))) for i in range(120)]
    docs = spark.createDataFrame(texts, "id long, text string")
    post = retrieval.postings(docs, "id", "text")
    asked = docs.where("id % 7 = 0").select(F.col("id").alias("query_id"), F.explode(terms(F.col("text"))).alias("w")).select("query_id", stem(F.col("w")).alias("term"))
    want = retrieval.top_k(retrieval.bm25(post, asked, 120, 40.0).withColumn("score", F.round("score", 6)), 5)
    got = retrieval.bm25_top(post, asked, 120, 40.0, 5, row_block=50, query_block=9)
    assert sorted((x.query_id, x.id, x.rank, x.score) for x in got.collect()) == sorted((x.query_id, x.id, x.rank, x.score) for x in want.collect())


def test_query_texts_are_whole(spark, tmp_path):
    from docketspark.plans.search import QUERIES

    rows = [(0, "Sygn. akt: kara umowna"), (1, "naliczono, że kara umowna"), (2, "Sygn. inna"), (3, "nic"), (4, "nic")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.id for r in QUERIES["bm25_topk"](spark, str(tmp_path)).collect()} == {0, 1, 2}


def test_long_query_terms_are_prefixes(spark):
    rows = [(1, "umowie umowa umow9"), (2, "zapłatach zapłata zapłacono"), (3, "zapłat"), (4, "zapła zapłaty2"), (5, "sprawa"), (6, "spraw")]
    docs = spark.createDataFrame(rows, "id long, text string")
    asked = spark.createDataFrame([("zapłata",), ("zapłatach",), ("spraw",), ("umow9",)], "w string")
    got = {(r.term, r.id): (r.tf, r.len) for r in retrieval.query_postings(docs, "id", "text", asked).collect()}
    assert got == {("zapła*", 2): (3, 3), ("zapła*", 3): (1, 1), ("zapła*", 4): (2, 2), ("zapłat*", 2): (2, 3), ("zapłat*", 3): (1, 1), ("zapłat*", 4): (1, 2), ("spraw", 6): (1, 1), ("umow9", 1): (1, 3)}
