"""Retrieval, graph, frame and grounding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketspark.functions.ids import clean_id
from docketspark.functions.jsoncols import json_text
from docketspark.functions.text import normalize_quote
from docketspark.operators import entities, graph, grounding, rerank, retrieval, spans
from docketspark.plans import entity_sql
from docketspark.plans.registry import Registry, long, small_list, table
from docketspark.session import cut

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle


def _vectors(spark, d):
    v = table(spark, d, "embeddings")
    return v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def _queries(v):
    return v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "v")


_KNN = """d AS (SELECT q.vec_id AS query_id, q.label AS qlabel, r.vec_id AS id, r.label, round(sqrt(list_sum(list_transform(list_zip(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])), lambda z: (z[1] - z[2]) ** 2))), 9) AS distance
FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d)"""


@R.add(f"WITH {_KNN} SELECT query_id, id, round(distance, 5) AS distance, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 10")
def knn_topk(spark, d):
    v = _vectors(spark, d)
    return retrieval.nearest(v, _queries(v), 10, 64).withColumn("distance", F.round("distance", 5))


@R.add(f"WITH {_KNN} SELECT query_id, round(avg(CASE WHEN label = qlabel THEN 1.0 ELSE 0.0 END), 6) AS label_precision FROM k WHERE rank <= 10 GROUP BY 1")
def knn_label_recall(spark, d):
    v = _vectors(spark, d)
    near = retrieval.nearest(v, _queries(v), 10, 64)
    lab = v.select("id", "label")
    j = near.join(lab, "id").join(lab.select(F.col("id").alias("query_id"), F.col("label").alias("ql")), "query_id")
    return j.groupBy("query_id").agg(F.round(F.avg((F.col("label") == F.col("ql")).cast("double")), 6).alias("label_precision"))


@R.add(
    f"""WITH {_KNN}, rel AS (SELECT DISTINCT query_id, id FROM d WHERE label = qlabel), t AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1),
g AS (SELECT k.query_id, sum(CASE WHEN rel.id IS NULL THEN 0 ELSE 1.0 / log2(rank + 1) END) AS dcg, sum(CASE WHEN rel.id IS NULL THEN 0 ELSE 1 END) AS hits FROM k LEFT JOIN rel USING (query_id, id) WHERE rank <= 5 GROUP BY 1)
SELECT query_id, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1.0 / log2(i + 1))), 6) AS ndcg, round(coalesce(hits, 0) / n, 6) AS recall FROM t LEFT JOIN g USING (query_id)"""
)
def ndcg_at_5(spark, d):
    v = _vectors(spark, d)
    near = retrieval.nearest(v, _queries(v), 5, 64)
    m = retrieval.label_metrics(near, v.select("id", "label"), 5)
    return m.select("query_id", F.round("ndcg", 6).alias("ndcg"), F.round("recall", 6).alias("recall"))


@R.add()
def knn_indexed(spark, d):
    """Index of one byte a dimension over every row, exact distances for its best; recall is measured in the tests."""
    v = _vectors(spark, d).select("id", "v")
    scales = retrieval.fit_scales(v)
    return retrieval.nearest_encoded(retrieval.encode_vectors(v, scales), v, _queries(v), 10, scales)


_TERM = "CASE WHEN length(w) >= 7 AND regexp_full_match(w, '\\p{L}+') THEN substring(w, 1, length(w) - least(3, length(w) - 5)) || '*' ELSE w END"
_BM25 = f"""w AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS w FROM documents WHERE text IS NOT NULL),
ln AS (SELECT id, count(*) AS len FROM w GROUP BY 1), st AS (SELECT count(*) AS n, avg(len) AS m FROM ln),
q AS (SELECT DISTINCT id AS query_id, {_TERM} AS term FROM w WHERE id % 50 = 0), tr AS (SELECT DISTINCT term FROM q), vo AS (SELECT DISTINCT w FROM w),
me AS (SELECT w, term FROM vo JOIN tr ON term = w UNION ALL SELECT w, term FROM vo JOIN (SELECT term, substring(term, 1, length(term) - 1) AS head FROM tr WHERE suffix(term, '*')) ON substring(w, 1, 5) = substring(head, 1, 5) AND starts_with(w, head)),
p AS (SELECT term, id, count(*) AS tf FROM w JOIN me USING (w) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
s AS (SELECT q.query_id, p.id, sum(greatest(ln((st.n - df.df + 0.5) / (df.df + 0.5)), 1e-6) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * ln.len / st.m))) AS score FROM q JOIN p USING (term) JOIN df USING (term) JOIN ln USING (id), st GROUP BY 1, 2),
b AS (SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM s)"""


def _bm25_top(spark, d, k):
    """Queries are the whole texts of every fiftieth document, against all documents."""
    docs = table(spark, d, "documents")
    tokens = retrieval.token_counts(docs, "doc_id", "text")
    n, mean = retrieval.corpus_size(tokens)
    asked = tokens.where("id % 50 = 0").select(F.col("id").alias("query_id"), "w")
    post = retrieval.query_postings(docs, "doc_id", "text", asked, tokens)
    return retrieval.bm25_top(post, asked.select("query_id", retrieval.query_term(F.col("w")).alias("term")), n, mean, k)


@R.add(f"WITH {_BM25} SELECT query_id, id, round(score, 4) AS score, CAST(rank AS INTEGER) AS rank FROM b WHERE rank <= 8")
def bm25_topk(spark, d):
    return _bm25_top(spark, d, 8).withColumn("score", F.round("score", 4))


@R.add(
    f"""WITH {_BM25}, r AS (SELECT query_id, id, rank FROM b WHERE rank <= 24), g AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY n_chars DESC, id) AS rank FROM r JOIN documents ON doc_id = id),
f AS (SELECT query_id, id, sum(1.0 / (60 + rank)) AS score FROM (SELECT * FROM r UNION ALL SELECT * FROM g) GROUP BY 1, 2) SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM f) WHERE rank <= 8"""
)
def rrf_fusion(spark, d):
    text = _bm25_top(spark, d, 24).select("query_id", "id", "rank")
    size = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    longer = retrieval.top_k(text.select("query_id", "id").join(size, "id"), 24, score="n_chars").select("query_id", "id", "rank")
    fused = retrieval.fuse(text.unionByName(longer)).withColumn("score", F.round("score", 9))
    return retrieval.top_k(fused, 8).withColumn("score", F.round("score", 6))


@R.add("SELECT doc_id, round(CASE WHEN hi = lo THEN 1.0 ELSE (n_chars - lo) / (hi - lo) END, 6) AS norm FROM (SELECT doc_id, CAST(n_chars AS DOUBLE) AS n_chars, min(n_chars) OVER (PARTITION BY source) AS lo, max(n_chars) OVER (PARTITION BY source) AS hi FROM documents WHERE n_chars IS NOT NULL)")
def minmax_norm(spark, d):
    r = table(spark, d, "documents").where("n_chars IS NOT NULL").select("doc_id", "source", F.col("n_chars").cast("double").alias("n"))
    return retrieval.min_max(r, "source", "n", "norm").select("doc_id", F.round("norm", 6).alias("norm"))


_SIG = r"[IVX]+ [A-Z][A-Za-z]{0,3} \d{1,5}/\d{2}"
_EDGES = f"e AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{_SIG}')) AS value FROM documents)"


def _edges(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"({_SIG})"), 1)).alias("value")).distinct()


@R.add(f"WITH {_EDGES}, c AS (SELECT value, count(*) AS n FROM e GROUP BY 1) SELECT doc_id, CAST(sum(n) AS BIGINT) AS score FROM e JOIN c USING (value) GROUP BY 1")
def centrality(spark, d):
    return graph.document_centrality(_edges(spark, d))


@R.add(f"WITH {_EDGES} SELECT a.doc_id, a.value, CASE WHEN count(DISTINCT b.doc_id) = 1 THEN min(b.doc_id) END AS to_doc_id FROM e a LEFT JOIN e b ON a.value = b.value AND a.doc_id <> b.doc_id GROUP BY 1, 2")
def unique_owner(spark, d):
    e = _edges(spark, d)
    return graph.unique_owner(e, e)


@R.add(
    f"""WITH {_EDGES}, p AS (SELECT doc_id, list(value) AS v FROM e GROUP BY 1), c AS (SELECT DISTINCT a.doc_id AS query_id, b.doc_id AS id FROM e a JOIN e b ON a.value = b.value AND a.doc_id <> b.doc_id WHERE a.doc_id % 50 = 0)
SELECT query_id, id, round(CAST(len(list_intersect(x.v, y.v)) AS DOUBLE) / len(list_distinct(list_concat(x.v, y.v))), 6) AS jaccard FROM c JOIN p x ON x.doc_id = query_id JOIN p y ON y.doc_id = id"""
)
def profile_jaccard(spark, d):
    """Structural overlap of every fiftieth document with all documents that share a signature: counts, no pair of profiles."""
    e = _edges(spark, d)
    size = e.groupBy("doc_id").agg(F.count("*").alias("n"))
    asked = e.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "value")
    both = asked.join(e.withColumnRenamed("doc_id", "id"), "value").where("id != query_id").groupBy("query_id", "id").agg(F.count("*").alias("both"))
    j = both.join(size.withColumnRenamed("doc_id", "id"), "id").join(size.select(F.col("doc_id").alias("query_id"), F.col("n").alias("m")), "query_id")
    return j.select("query_id", "id", F.round(F.col("both") / (F.col("n") + F.col("m") - F.col("both")), 6).alias("jaccard"))


#: Entity kinds and the event roles they fill.
ROLES = {"SYGNATURA_ORZECZENIA": "basis", "SYGNATURA_AKTU": "basis", "DATA": "date", "KWOTA": "amount", "PRZEPIS": "basis", "FIRMA": "party", "OSOBA": "party", "CZYN": "act"}


def _role_hits(spark, d):
    hits = entities.detect(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    role = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))[F.col("kind")]
    return hits.select("doc_id", role.alias("role"), F.col("value_normalized").alias("value"), F.col("start").alias("position")).where("role IS NOT NULL")


@R.add()
def entity_hits(spark, d):
    return entities.detect(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


@R.add(f"SELECT doc_id, rule_id, CAST(n AS BIGINT) AS n FROM ({entity_sql.counts('documents', 'doc_id', 'text')}) WHERE n > 0")
def entity_counts(spark, d):
    """Hits of every rule by document."""
    hits = entities.detect(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    return hits.groupBy("doc_id", "rule_id").agg(F.count("*").alias("n"))


@R.add(
    f"""WITH e AS ({entity_sql.matches('documents', 'doc_id', 'text', entity_sql.SIGNATURES)}), v AS (SELECT DISTINCT trim(value, ' ') AS value FROM e)
SELECT value, {entity_sql.PREFIX.format(v='value')} AS prefix FROM v"""
)
def signature_prefixes(spark, d):
    """Every distinct case signature with what opens it."""
    hits = entities.detect(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", tuple(r for r in entities.RULES if r.kind == "SYGNATURA_ORZECZENIA"))
    return hits.select("value").distinct().select("value", entities.signature_prefix(F.col("value")).alias("prefix"))


@R.add(
    f"""WITH e AS ({entity_sql.matches('documents', 'doc_id', 'text', entity_sql.RELATED)}) SELECT relation, CAST(count(*) AS BIGINT) AS edges, CAST(count(DISTINCT doc_id) AS BIGINT) AS docs
FROM (SELECT *, {entity_sql.RELATION} AS relation FROM e) GROUP BY 1"""
)
def relation_edges(spark, d):
    """Citation edges of the corpus by relation: hits of kinds with a relation, confidence 0.6 and more."""
    e = entities.edges(entities.detect(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text"), "doc_id")
    per = e.groupBy("relation", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("relation").agg(F.sum("n").alias("edges"), F.count("*").alias("docs"))


@R.add()
def event_frames(spark, d):
    return graph.event_frames(_role_hits(spark, d), "doc_id")


@R.add()
def frame_similarity(spark, d):
    """Every fiftieth document's roles against the documents that share a basis with it."""
    roles = sorted(set(ROLES.values()))
    hits = _role_hits(spark, d)
    f = graph.role_frames(hits, "doc_id", roles)
    basis = hits.where("role = 'basis'").select("doc_id", "value").distinct()
    asked = basis.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "value")
    pairs = asked.join(basis.withColumnRenamed("doc_id", "id"), "value").where("id != query_id").select("query_id", "id").distinct()
    a = f.select(F.col("doc_id").alias("query_id"), *(F.col(r).alias(f"a_{r}") for r in roles))
    b = f.select(F.col("doc_id").alias("id"), *(F.col(r).alias(f"b_{r}") for r in roles))
    sim = graph.frame_similarity({r: F.col(f"a_{r}") for r in roles}, {r: F.col(f"b_{r}") for r in roles})
    return pairs.join(a, "query_id").join(b, "id").select("query_id", "id", F.round(sim, 6).alias("similarity"))


def _citations(spark, d):
    c = table(spark, d, "tabular_cells").select(clean_id("id").alias("cell"), clean_id("document_id").alias("document_id"), json_text(F.col("citations")).alias("j")).distinct()
    j = F.regexp_replace("j", r"^\s+|\s+$", "")
    whole = F.when(j.startswith("["), j).when(j.startswith("{"), F.concat(F.lit("["), j, F.lit("]")))  # a lone citation is a list of one
    parsed = F.from_json(whole, "array<struct<quote string>>")
    docs = table(spark, d, "documents").select(clean_id("document_id").alias("document_id"), normalize_quote(F.col("text")).alias("source"))  # normalised once a document
    quotes = c.select("cell", "document_id", F.posexplode(parsed).alias("ref", "x")).select("cell", "document_id", "ref", F.col("x.quote").alias("quote"))
    return quotes.join(docs, "document_id", "left")


_NQ = "trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace({0}, '-[ \\t]*\\r?\\n[ \\t]*', '', 'g'), '[“”„‟«»‘’‚‛'']', '\"', 'g'), '[‐‑‒–—―−]', '-', 'g')), '[\\s\\x{{00a0}}]+', ' ', 'g'))"


@R.add(
    f"""WITH c AS (SELECT DISTINCT lower(trim(id, ' \t')) AS cell, lower(trim(document_id, ' \t')) AS document_id, CASE WHEN json_valid(citations) THEN citations::JSON ->> '$' END AS p FROM tabular_cells),
l AS (SELECT cell, document_id, CASE json_type(p) WHEN 'ARRAY' THEN p WHEN 'OBJECT' THEN '[' || p || ']' END AS p FROM c WHERE json_valid(p)),
x AS (SELECT cell, document_id, CAST(i AS INTEGER) AS ref, j ->> ('$[' || i || '].quote') AS quote FROM (SELECT cell, document_id, p::JSON AS j, unnest(range(0, CAST(json_array_length(p) AS BIGINT))) AS i FROM l WHERE p IS NOT NULL)),
y AS (SELECT x.*, {_NQ.format('quote')} AS q, {_NQ.format('text')} AS s FROM x LEFT JOIN (SELECT lower(trim(document_id, ' \t')) AS document_id, text FROM documents) USING (document_id))
SELECT cell, ref, CASE WHEN coalesce(q = '', true) OR coalesce(s = '', true) THEN 'no_source' WHEN contains(s, q) THEN 'verified' ELSE 'open' END AS status FROM y"""
)
def quote_exact(spark, d):
    r = grounding.check_exact(_citations(spark, d), "quote", "source", True)
    return r.select("cell", "ref", F.coalesce("status", F.lit("open")).alias("status"))


@R.add()
def quote_fuzzy(spark, d):
    """Exact stage natively; only what is left is aligned."""
    r = grounding.check_exact(_citations(spark, d), "quote", "source", True)
    return grounding.check_fuzzy(r.where("status IS NULL"), ["cell", "ref"])


@R.add()
def chunk_counts(spark, d):
    """Paragraph chunks of every document, with their spans."""
    from docketspark.operators.chunking import chunk_documents

    return chunk_documents(table(spark, d, "documents"), "doc_id", "text")


@R.add("SELECT DISTINCT hit_id, CAST(len(regexp_extract_all(text, '\\[Page \\d+\\]')) AS BIGINT) AS pages FROM feed_passage_hits WHERE contains(text, '[Page ')")
def page_marks(spark, d):
    r = table(spark, d, "feed_passage_hits").where(F.col("text").contains("[Page "))
    return r.select("hit_id", long(F.regexp_count("text", F.lit(r"\[Page \d+\]"))).alias("pages")).distinct()


@R.add()
def legal_chunk_counts(spark, d):
    """Section-aware chunks with overlap."""
    from docketspark.operators.chunking import chunk_documents

    return chunk_documents(table(spark, d, "documents"), "doc_id", "text", legal=True).select("doc_id", "chunk_index", "page_no", F.length("content").alias("n"), "source_start", "source_end")


@R.add(
    """SELECT doc_id, name AS term, CAST((length(text) - length(replace(text, name, ''))) / length(name) AS BIGINT) AS n FROM documents, (SELECT DISTINCT name FROM courts) WHERE contains(text, name)"""
)
def dictionary_counts(spark, d):
    """Occurrences of the gazetteer's names; the gazetteer is a small dimension, its size is checked."""
    names = [(n, "court", True) for n in small_list(table(spark, d, "courts"), "name")]
    hits = spans.match_dictionary(table(spark, d, "documents"), "doc_id", "text", names)
    return hits.groupBy("doc_id", "term").agg(F.count("*").alias("n"))


@R.add(
    """WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, 'Sąd (?:Rejonowy|Okręgowy|Apelacyjny) w [A-ZŁŚŻĆ][a-ząćęłńóśźż]+')) AS mention FROM documents)
SELECT mention, c.id AS court_id, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT doc_id) AS BIGINT) AS docs FROM m LEFT JOIN (SELECT lower(name) AS key, min(lower(trim(id, ' \t'))) AS id FROM courts GROUP BY 1) c ON c.key = lower(mention) GROUP BY 1, 2"""
)
def court_mentions(spark, d):
    """Court mentions resolved through the gazetteer by lower-case name."""
    rx = "(Sąd (?:Rejonowy|Okręgowy|Apelacyjny) w [A-ZŁŚŻĆ][a-ząćęłńóśźż]+)"
    m = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(rx), 1)).alias("mention"))
    per = m.groupBy("mention", "doc_id").agg(F.count("*").alias("n")).groupBy("mention").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))
    courts = table(spark, d, "courts").groupBy(F.lower("name").alias("key")).agg(F.min(clean_id("id")).alias("court_id"))
    return per.join(courts, F.lower("mention") == F.col("key"), "left").select("mention", "court_id", "n", "docs")


@R.add()
def greedy_entities(spark, d):
    """Entity hits of a document without overlaps, in both policies."""
    h = entities.detect(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    per = h.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "rule_id")).alias("s"))
    return per.select("doc_id", F.size("s").alias("hits"), F.size(spans.greedy_spans(F.col("s"))).alias("greedy"), F.size(spans.reaching_spans(F.col("s"))).alias("reaching"))


@R.add(
    """SELECT doc_id, CAST(strpos(text, 'umow') - 1 AS BIGINT) AS first_at, CAST((length(text) - length(replace(text, 'umow', ''))) / 4 AS BIGINT) AS n, CAST(length(text) - 3 - strpos(reverse(text), 'womu') AS BIGINT) AS last_at FROM documents WHERE contains(text, 'umow')"""
)
def word_positions(spark, d):
    rows = table(spark, d, "documents").where(F.col("text").contains("umow"))
    at = spans.occurrences(F.col("text"), F.lit("umow"))
    return rows.select("doc_id", at.alias("at")).select("doc_id", long(F.col("at")[0]).alias("first_at"), long(F.size("at")).alias("n"), long(F.element_at("at", -1)).alias("last_at"))


@R.add(
    """WITH x AS (SELECT DISTINCT lower(trim(id, ' \t')) AS id, CASE WHEN json_valid(content) THEN content::JSON ->> '$' END AS p, content FROM tabular_cells)
SELECT id, CASE WHEN json_valid(p) THEN p ->> '$.summary' ELSE content END AS summary, CASE WHEN json_valid(p) THEN coalesce(p ->> '$.flag', 'grey') ELSE 'grey' END AS flag FROM x"""
)
def cell_fields(spark, d):
    """Tolerant reading of cell content: fields where it is JSON, else the raw text and a grey flag."""
    c = table(spark, d, "tabular_cells").select(clean_id("id").alias("id"), "content").distinct().withColumn("p", json_text(F.col("content")))
    ok = F.col("p").isNotNull()
    flag = F.when(ok, F.coalesce(F.get_json_object("p", "$.flag"), F.lit("grey"))).otherwise("grey")
    return c.select("id", F.when(ok, F.get_json_object("p", "$.summary")).otherwise(F.col("content")).alias("summary"), flag.alias("flag"))


@R.add(
    f"""WITH {_BM25}, r AS (SELECT query_id, id, score FROM b WHERE rank <= 24), {_EDGES}, pr AS (SELECT doc_id, list(value) AS v FROM e GROUP BY 1),
tp AS (SELECT query_id, id AS best FROM b WHERE rank = 1), x AS (SELECT r.query_id, r.id, r.score, coalesce(own.v, []) AS own, coalesce(ref.v, []) AS ref FROM r JOIN tp USING (query_id) LEFT JOIN pr own ON own.doc_id = r.id LEFT JOIN pr ref ON ref.doc_id = tp.best),
j AS (SELECT *, CASE WHEN len(list_distinct(list_concat(own, ref))) = 0 THEN 0.0 ELSE CAST(len(list_intersect(own, ref)) AS DOUBLE) / len(list_distinct(list_concat(own, ref))) END AS raw, min(score) OVER q AS lo, max(score) OVER q AS hi, count(*) OVER q AS n FROM x WINDOW q AS (PARTITION BY query_id)),
k AS (SELECT *, CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END AS content, min(raw) OVER q AS rl, max(raw) OVER q AS rh FROM j WINDOW q AS (PARTITION BY query_id)),
f AS (SELECT query_id, id, round(CASE WHEN n < 2 OR len(ref) = 0 THEN content ELSE 0.6 * content + 0.4 * CASE WHEN rh = rl THEN 1.0 ELSE (raw - rl) / (rh - rl) END END, 6) AS score FROM k)
SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 8"""
)
def dual_rerank(spark, d):
    """Text hits re-ranked by the overlap of their cited signatures with those of the best hit."""
    text = cut(_bm25_top(spark, d, 24).select("query_id", "id", "score"))
    profile = _edges(spark, d).groupBy(F.col("doc_id").alias("id")).agg(F.collect_set("value").alias("profile"))
    return retrieval.top_k(rerank.dual_rerank(text, profile).withColumn("score", F.round("score", 6)), 8)


@R.add()
def hybrid_search(spark, d):
    """Vector, text and citation-graph lists fused, re-ranked by citation profile and then by event roles, cut to 8 at the end.

    A document's vector is the one of its number; a query without a vector keeps its text and graph lists.
    """
    text = _bm25_top(spark, d, 24).select("query_id", "id", "rank")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    v = _vectors(spark, d).select("id", "v").join(docs, "id", "left_semi")
    near = retrieval.nearest(v, _queries(v), 24, 64).select("query_id", "id", "rank")
    lists = cut(text.unionByName(near))
    edges = _edges(spark, d)
    central = graph.document_centrality(edges).select(F.col("doc_id").alias("id"), F.col("score").alias("c"))
    ranked = retrieval.top_k(lists.select("query_id", "id").distinct().join(central, "id"), 48, score="c").select("query_id", "id", "rank")
    fused = cut(retrieval.fuse(lists.unionByName(ranked)).withColumn("score", F.round("score", 9)))  # a few rows a query, used several times
    profile = edges.groupBy(F.col("doc_id").alias("id")).agg(F.collect_set("value").alias("profile"))
    dual = cut(rerank.dual_rerank(fused, profile).withColumn("score", F.round("score", 9)))
    roles = sorted(set(ROLES.values()))
    frames = graph.role_frames(_role_hits(spark, d), "doc_id", roles).withColumnRenamed("doc_id", "id")
    final = rerank.event_rerank(dual, frames, roles)
    return retrieval.top_k(final.withColumn("score", F.round("score", 9)), 8)


@R.add()
def nearest_name(spark, d):
    """Nearest approved name of each mention by edit distance; the approved names are one small array a row, no pairs.

    No twin: DuckDB counts edits in bytes.
    """
    rx = "(Sąd (?:Rejonowy|Okręgowy|Apelacyjny) w [A-ZŁŚŻĆ][a-ząćęłńóśźż]+)"
    m = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(rx), 1)).alias("mention")).distinct()
    names = F.array(*map(F.lit, small_list(table(spark, d, "courts"), "name")))
    best = F.array_min(F.transform(names, lambda n: F.struct(F.levenshtein(F.lower("mention"), F.lower(n)).alias("dist"), n.alias("name"))))
    return m.select("mention", best.alias("b")).select("mention", F.col("b.name").alias("nearest"), long(F.col("b.dist")).alias("dist"))


@R.add(
    """WITH c AS (SELECT DISTINCT lower(trim(id, ' \\t')) AS id, CASE WHEN json_valid(content) THEN content::JSON ->> '$' END AS p FROM chat_messages WHERE content LIKE '%annotations%'),
ev AS (SELECT id, CAST(i AS INTEGER) AS event_no, p -> ('$[' || i || '].annotations') AS a FROM (SELECT id, p, unnest(range(0, CAST(json_array_length(p) AS BIGINT))) AS i FROM c WHERE json_valid(p) AND p[1] = '[')),
an AS (SELECT id, event_no, CAST(k AS INTEGER) AS pos, a ->> ('$[' || k || '].edit_id') AS edit_id, a ->> ('$[' || k || '].status') AS status FROM (SELECT id, event_no, a, unnest(range(0, CAST(json_array_length(a) AS BIGINT))) AS k FROM ev WHERE json_type(a) = 'ARRAY')),
lg AS (SELECT id, ts, CASE WHEN json_valid(payload) THEN payload::JSON ->> '$' END AS p FROM audit_log WHERE event_type = 'document.edit_resolved'),
le AS (SELECT id, ts, p -> '$.edits' AS e FROM lg WHERE json_valid(p)),
st AS (SELECT edit_id, arg_max(status, ts || lpad(CAST(id AS VARCHAR), 20, '0')) AS now FROM (SELECT id, ts, e ->> ('$[' || k || '].edit_id') AS edit_id, e ->> ('$[' || k || '].status') AS status FROM (SELECT id, ts, e, unnest(range(0, CAST(json_array_length(e) AS BIGINT))) AS k FROM le WHERE json_type(e) = 'ARRAY')) WHERE edit_id IS NOT NULL GROUP BY 1)
SELECT an.id, event_no, pos, an.edit_id, coalesce(st.now, an.status) AS status FROM an LEFT JOIN st USING (edit_id) WHERE an.edit_id IS NOT NULL"""
)
def annotation_status(spark, d):
    """Statuses nested in message events, refreshed from the log: exploded, joined once, with their places kept."""
    c = table(spark, d, "chat_messages").where(F.col("content").contains("annotations")).select(clean_id("id").alias("id"), json_text(F.col("content")).alias("p")).distinct()
    events = F.from_json(F.when(F.trim("p").startswith("["), F.col("p")), "array<struct<annotations:string>>")
    per = c.select("id", F.posexplode(events).alias("event_no", "e")).select("id", "event_no", F.from_json(F.when(F.col("e.annotations").startswith("["), F.col("e.annotations")), "array<struct<edit_id:string,status:string>>").alias("a"))
    ann = per.select("id", "event_no", F.posexplode("a").alias("pos", "x")).select("id", "event_no", "pos", "x.edit_id", "x.status").where("edit_id IS NOT NULL")
    log = table(spark, d, "audit_log").where("event_type = 'document.edit_resolved'").select("id", "ts", F.get_json_object(json_text(F.col("payload")), "$.edits").alias("e"))
    edits = log.select("id", "ts", F.explode(F.from_json(F.when(F.col("e").startswith("["), F.col("e")), "array<struct<edit_id:string,status:string>>")).alias("x"))
    now = edits.groupBy(F.col("x.edit_id").alias("edit_id")).agg(F.max_by("x.status", F.struct("ts", "id")).alias("now"))
    return ann.join(now, "edit_id", "left").select("id", "event_no", "pos", "edit_id", F.coalesce("now", "status").alias("status"))
