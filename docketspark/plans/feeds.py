"""Feeds and reports: phrases and windows in documents, anchored hits, grounding of cells, marks, sharing, log lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketspark.functions import markup as mk
from docketspark.functions import text as tx
from docketspark.functions.ids import clean_id
from docketspark.functions.jsoncols import json_text
from docketspark.operators import entities, grounding, spans
from docketspark.plans.registry import Registry, long, table

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle

_RX = tx.folded_pattern("w dniu").replace("(?iu)", "(?i)")


@R.add(
    f"""WITH m AS (SELECT doc_id, text, string_split_regex(text, '{_RX}') AS p, regexp_extract_all(text, '{_RX}') AS x FROM documents WHERE regexp_matches(text, '{_RX}')),
h AS (SELECT doc_id, text, len(x) AS total, unnest(range(0, least(len(x), 3))) AS i, p, x FROM m),
s AS (SELECT doc_id, text, total, CAST(i AS INTEGER) AS i, CAST(coalesce(list_sum(list_transform(p[1:i + 1], lambda v: length(v))), 0) + coalesce(list_sum(list_transform(x[1:i], lambda v: length(v))), 0) AS INTEGER) AS start, x[i + 1] AS excerpt FROM h)
SELECT doc_id, i AS hit, start, excerpt, CAST(total AS INTEGER) AS total, total > 3 AS truncated,
CASE WHEN start > 30 THEN '…' ELSE '' END || trim(regexp_replace(substring(text, greatest(start - 30, 0) + 1, least(start + length(excerpt) + 30, length(text)) - greatest(start - 30, 0)), '[\\s\\p{{Z}}]+', ' ', 'g')) || CASE WHEN start + length(excerpt) + 30 < length(text) THEN '…' ELSE '' END AS seen FROM s"""
)
def find_in_document(spark, d):
    """The first three places of a phrase in each document, whatever its case and blanks, with the number of all."""
    rows = table(spark, d, "documents").select("doc_id", tx.find_phrase(F.col("text"), "w dniu", 3, 30).alias("f")).where("f.total > 0")
    return rows.select("doc_id", "f.total", "f.truncated", F.explode("f.hits").alias("h")).select("doc_id", F.col("h.index").alias("hit"), "h.start", "h.excerpt", "total", "truncated", F.col("h.context").alias("seen"))


@R.add("SELECT doc_id, least(500, length(text)) AS start, length(text) AS total, CASE WHEN length(text) > 1500 THEN 1500 END AS next_offset, length(text) > 0 AS truncated, md5(substring(text, 501, 1000)) AS seen FROM documents WHERE text IS NOT NULL")
def text_windows(spark, d):
    """One bounded window of every document."""
    w = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", tx.text_window(F.col("text"), F.lit(500), F.lit(1000)).alias("w"))
    return w.select("doc_id", F.col("w.offset").alias("start"), "w.total", "w.next_offset", "w.truncated", F.md5("w.text").alias("seen"))


@R.add(
    """WITH h AS (SELECT DISTINCT hit_id, lower(trim(document_id, ' \t')) AS document_id, text FROM feed_passage_hits WHERE text IS NOT NULL), j AS (SELECT h.hit_id, h.text AS q, d.document_id IS NOT NULL AND d.text IS NOT NULL AS has, d.text AS s FROM h LEFT JOIN (SELECT lower(trim(document_id, ' \t')) AS document_id, text FROM documents) d USING (document_id)),
k AS (SELECT hit_id, has, length(q) AS n, CASE WHEN has AND q <> '' THEN strpos(s, q) ELSE 0 END AS p, CASE WHEN has AND q <> '' THEN strpos(substring(s, strpos(s, q) + length(q)), q) ELSE 0 END AS p2 FROM j)
SELECT hit_id, CASE WHEN p > 0 THEN 'exact' ELSE 'none' END AS anchor, CASE WHEN p > 0 THEN CAST(p - 1 AS BIGINT) END AS start, CASE WHEN p > 0 THEN CAST(p - 1 + n AS BIGINT) END AS stop, CASE WHEN NOT has THEN 'no_source' WHEN p = 0 THEN 'normalised' WHEN p2 > 0 THEN 'ambiguous' END AS note FROM k"""
)
def search_feed(spark, d):
    """Hits anchored in their sources: where the passage stands, or why no place can be told."""
    hits = table(spark, d, "feed_passage_hits").where("text IS NOT NULL").select("hit_id", clean_id("document_id").alias("document_id"), "text").distinct()
    docs = table(spark, d, "documents").select(clean_id("document_id").alias("document_id"), F.col("text").alias("source"))
    return grounding_feed(hits.join(docs, "document_id", "left"))


def grounding_feed(pairs):
    a = spans.anchor(F.col("text"), F.col("source"))
    return pairs.select("hit_id", a.alias("a")).select("hit_id", "a.anchor", "a.start", "a.stop", "a.note")


def _cell_quotes(spark, d):
    """(id, n, quote, source): inline citations of cell contents with their normalised sources."""
    cells = table(spark, d, "tabular_cells").select(clean_id("id").alias("id"), clean_id("document_id").alias("document_id"), "content").distinct()
    quotes = cells.select("id", "document_id", F.posexplode(tx.inline_citations(F.col("content"))).alias("n", "c")).select("id", "document_id", "n", "c.quote")
    docs = table(spark, d, "documents").select(clean_id("document_id").alias("document_id"), tx.normalize_quote(F.col("text")).alias("source"))
    return quotes.join(docs, "document_id", "left")


@R.add()
def cell_grounding(spark, d):
    """Checks of the inline citations of every cell, rolled up by cell; both stages."""
    return grounding.cell_grounding(grounding.check_quotes(_cell_quotes(spark, d), "quote", "source", ["id", "n"]), "id")


_NQ = "trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace({0}, '-[ \\t]*\\r?\\n[ \\t]*', '', 'g'), '[“”„‟«»‘’‚‛'']', '\"', 'g'), '[‐‑‒–—―−]', '-', 'g')), '[\\s\\x{{00a0}}]+', ' ', 'g'))"


@R.add(
    f"""WITH c AS (SELECT DISTINCT lower(trim(id, ' \t')) AS id, lower(trim(document_id, ' \t')) AS document_id, content FROM tabular_cells),
m AS (SELECT id, document_id, unnest(regexp_extract_all(content, '\\[\\[page:[^|\\]]*\\|\\|quote:([^\\]]*)\\]\\]', 1)) AS quote FROM c), q AS (SELECT id, document_id, {_NQ.format("trim(quote, ' ')")} AS q FROM m WHERE trim(quote, ' ') <> ''),
j AS (SELECT q.id, q, {_NQ.format('text')} AS s FROM q LEFT JOIN (SELECT lower(trim(document_id, ' \t')) AS document_id, text FROM documents) USING (document_id)),
k AS (SELECT id, CASE WHEN coalesce(s = '', true) OR q = '' THEN 'no_source' WHEN contains(s, q) THEN 'verified' ELSE 'open' END AS status FROM j)
SELECT id, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (status = 'verified') AS BIGINT) AS verified, CAST(count(*) FILTER (status = 'no_source') AS BIGINT) AS needs_review FROM k GROUP BY 1"""
)
def cell_grounding_exact(spark, d):
    """The exact stage of cell_grounding alone."""
    r = grounding.check_exact(_cell_quotes(spark, d), "quote", "source", True)
    return r.groupBy("id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "verified").alias("verified"), F.count_if(F.col("status") == "no_source").alias("needs_review"))


@R.add()
def grounding_totals(spark, d):
    """One row over all cells."""
    return grounding.grounding_totals(cell_grounding(spark, d))


@R.add()
def citation_report(spark, d):
    """Citations of all cells by status, decision, colour and provenance; blocked if any is unverified or sourceless."""
    from docketspark.plans.search import _citations

    c = _citations(spark, d)
    r = grounding.check_quotes(c.withColumn("pinpoint", entities.has_pinpoint(F.col("quote"))), "quote", "source", ["cell", "ref", "pinpoint"])
    tag, label = grounding.provenance(F.lit("client-doc"), F.col("pinpoint"))
    by = r.groupBy("status", grounding.decision(F.col("status")).alias("decision"), grounding.verdict(F.col("status")).alias("colour"), tag.alias("tag"), label.alias("label"))
    return by.agg(F.count("*").alias("n"))


@R.add("SELECT doc_id, regexp_matches(text, '(?i)\\bart\\.?\\s*\\d|\\bust\\.?\\s*\\d|§\\s*\\d|\\bpkt\\s*\\d|\\bCELEX') AS pinpoint FROM documents WHERE text IS NOT NULL")
def pinpoints(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", entities.has_pinpoint(F.col("text")).alias("pinpoint"))


@R.add(
    r"""WITH c AS (SELECT DISTINCT lower(trim(id, ' 	')) AS id, content FROM tabular_cells WHERE contains(content, '[[')), s AS (SELECT id, string_split_regex(content, '\[\[.*?\]\]') AS t, regexp_extract_all(content, '\[\[(.*?)\]\]', 1) AS p FROM c)
SELECT id, CAST(i AS INTEGER) AS pos, t[i + 1] AS text, p[i + 1] AS pill FROM (SELECT id, t, p, unnest(range(0, len(t))) AS i FROM s)"""
)
def pill_segments(spark, d):
    c = table(spark, d, "tabular_cells").where(F.contains("content", F.lit("[["))).select(clean_id("id").alias("id"), "content").distinct()
    return c.select("id", F.posexplode(mk.pill_segments(F.col("content"))).alias("pos", "x")).select("id", "pos", "x.text", "x.pill")


@R.add(
    r"""WITH c AS (SELECT DISTINCT lower(trim(id, ' 	')) AS id, content FROM tabular_cells WHERE contains(content, '[[page:')), s AS (SELECT id, string_split_regex(content, '\[\[page:[^|\]]*\|\|quote:[^\]]*\]\]') AS t FROM c)
SELECT id, array_to_string(list_transform(range(1, len(t) + 1), lambda i: t[i] || CASE WHEN i < len(t) THEN '§' || (i - 1) || '§' ELSE '' END), '') AS shown FROM s"""
)
def citation_placeholders(spark, d):
    c = table(spark, d, "tabular_cells").where(F.contains("content", F.lit("[[page:"))).select(clean_id("id").alias("id"), "content").distinct()
    return c.select("id", mk.placeholders(F.col("content")).alias("shown"))


@R.add(
    """WITH m AS (SELECT DISTINCT lower(trim(id, ' \t')) AS id, CASE WHEN json_valid(content) AND json_type(content) = 'OBJECT' THEN json_extract_string(content, '$.summary') ELSE content END AS x FROM tabular_cells WHERE content IS NOT NULL)
SELECT id, replace(replace(replace(x, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n') AS label FROM m WHERE x IS NOT NULL"""
)
def label_values(spark, d):
    whole = F.when(F.trim("content").startswith("{"), F.try_parse_json("content"))
    x = F.when(whole.isNotNull(), F.get_json_object("content", "$.summary")).otherwise(F.col("content"))
    c = table(spark, d, "tabular_cells").where("content IS NOT NULL").select(clean_id("id").alias("id"), x.alias("x")).where("x IS NOT NULL").distinct()
    return c.select("id", mk.label_value(F.col("x")).alias("label"))


@R.add()
def quoted_spans(spark, d):
    """Quotations in the answers of the log of messages."""
    from docketspark.operators.grounding import find_quotations

    c = table(spark, d, "chat_messages").where("content IS NOT NULL").select(clean_id("id").alias("id"), "content").distinct()
    return find_quotations(c, "id", "content")


_SHARED = "list_transform(range(0, c_custkey % 4), lambda i: CASE WHEN i % 2 = 0 THEN 'U' ELSE 'u' END || CAST((c_custkey + i * 3) % 25 AS VARCHAR) || '@Firma.example')"


def _projects(spark, d):
    """Customers as projects: owner, and the e-mail addresses they are shared with, in any case."""
    mail = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.concat(F.when(i % 2 == 0, "U").otherwise("u"), ((F.col("c_custkey") + i * 3) % 25).cast("string"), F.lit("@Firma.example")))
    return table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("owner"), F.slice(mail, F.lit(1), (F.col("c_custkey") % 4).cast("int")).alias("shared_with"))


@R.add(f"SELECT c_custkey, c_nationkey = 7 AS is_owner FROM customer WHERE c_nationkey = 7 OR list_contains(list_transform({_SHARED}, lambda x: lower(x)), 'u7@firma.example')")
def share_lookup(spark, d):
    """Projects a user may open: owned, or shared with the user's e-mail address in any case."""
    from docketspark.operators.query import may_open

    return _projects(spark, d).where(may_open(F.col("owner"), F.col("shared_with"), F.lit(7), F.lit("U7@firma.example"))).select("c_custkey", (F.col("owner") == 7).alias("is_owner"))


@R.add(
    f"""WITH m AS (SELECT c_custkey, lower(unnest({_SHARED})) AS email FROM customer), u AS (SELECT n_nationkey AS id, 'u' || n_nationkey || '@firma.example' AS email, n_regionkey FROM nation WHERE n_nationkey <> 3)
SELECT DISTINCT c_custkey, m.email, u.id AS user_id, r_name AS display_name FROM m LEFT JOIN u ON u.email = m.email LEFT JOIN region ON r_regionkey = u.n_regionkey AND r_regionkey > 0"""
)
def people_directory(spark, d):
    """Members of every project: address to user, user to profile; unknown addresses stay."""
    m = _projects(spark, d).select("c_custkey", F.explode(F.transform("shared_with", F.lower)).alias("email")).distinct()
    u = table(spark, d, "nation").where("n_nationkey != 3").select(F.col("n_nationkey").alias("user_id"), F.concat(F.lit("u"), F.col("n_nationkey").cast("string"), F.lit("@firma.example")).alias("email"), "n_regionkey")
    p = table(spark, d, "region").where("r_regionkey > 0").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("display_name"))
    return m.join(u, "email", "left").join(p, "n_regionkey", "left").select("c_custkey", "email", "user_id", "display_name")


@R.add(
    """SELECT DISTINCT id, ts || ' | ' || event_type || CASE WHEN actor_user_id IS NULL THEN '' ELSE ' | actor=' || actor_user_id END || CASE WHEN chat_id IS NULL THEN '' ELSE ' | chat=' || chat_id END || CASE WHEN document_id IS NULL THEN '' ELSE ' | doc=' || document_id END AS line FROM audit_log WHERE ts IS NOT NULL AND event_type IS NOT NULL"""
)
def log_lines(spark, d):
    """Events as lines: time, event, then the fields that are set, in a fixed order."""
    from docketspark.sources.tables import log_line

    line = log_line("ts", "event_type", {"actor": "actor_user_id", "chat": "chat_id", "doc": "document_id"})
    return table(spark, d, "audit_log").where("ts IS NOT NULL AND event_type IS NOT NULL").select("id", line.alias("line")).distinct()


@R.add("SELECT DISTINCT id, substring(sha256(actor_user_id), 1, 16) AS actor, sha256(coalesce(payload, '')) AS payload_sha FROM audit_log WHERE actor_user_id IS NOT NULL")
def id_hashes(spark, d):
    """Receipts name users by the first 16 hex digits of a digest, and contents by the whole one."""
    r = table(spark, d, "audit_log").where("actor_user_id IS NOT NULL")
    return r.select("id", F.left(F.sha2("actor_user_id", 256), F.lit(16)).alias("actor"), F.sha2(F.coalesce("payload", F.lit("")), 256).alias("payload_sha")).distinct()


@R.add(
    """WITH l AS (SELECT DISTINCT id, ts FROM audit_log), a AS (SELECT max(CAST(ts AS TIMESTAMP)) AS m FROM l)
SELECT id, CAST(floor((epoch_us(a.m) - epoch_us(CAST(ts AS TIMESTAMP))) / 1000000.0) AS BIGINT) AS age_s, CAST(ts AS TIMESTAMP) > a.m - INTERVAL 24 HOURS AS last_day, CAST(ts AS TIMESTAMP) > a.m - INTERVAL 30 DAYS AS last_month, regexp_matches(ts, '^\\d{4}-\\d{2}-\\d{2}T') AS iso FROM l, a"""
)
def event_ages(spark, d):
    """Age of every event at the newest one, and whether it is in the rolling windows before that."""
    rows = table(spark, d, "audit_log").select("id", "ts", F.col("ts").cast("timestamp").alias("at")).distinct()
    newest = rows.agg(F.max("at")).first()[0]
    anchor = F.lit(newest)
    return rows.select("id", tx.age_seconds(F.col("at"), anchor).alias("age_s"), tx.within_last(F.col("at"), anchor, "24 HOURS").alias("last_day"), tx.within_last(F.col("at"), anchor, "30 DAYS").alias("last_month"), tx.is_iso_date(F.col("ts")).alias("iso"))


@R.add()
def heuristic_citations(spark, d):
    """Citations a reader would mark, without overlaps."""
    h = entities.detect(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", entities.CITATION_RULES)
    per = h.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "rule_id", "value_normalized")).alias("s"))
    return per.select("doc_id", F.explode(spans.greedy_spans(F.col("s"))).alias("x")).select("doc_id", F.col("x.rule_id").alias("kind"), F.col("x.value_normalized").alias("citation"), F.col("x.start").alias("at"))


@R.add(
    """WITH c AS (SELECT DISTINCT lower(trim(id, ' \t')) AS id, CASE WHEN json_valid(citations) THEN citations::JSON ->> '$' END AS p FROM tabular_cells), l AS (SELECT id, CASE json_type(p) WHEN 'ARRAY' THEN p END AS p FROM c WHERE json_valid(p))
SELECT id, CAST(coalesce(max(CASE WHEN json_type(p, '$[' || i || '].page') IN ('BIGINT', 'UBIGINT') THEN 1 ELSE 0 END), 0) AS BIGINT) AS paged, CAST(count(i) AS BIGINT) AS n FROM (SELECT id, p, unnest(range(0, CAST(json_array_length(p) AS BIGINT))) AS i FROM l WHERE p IS NOT NULL) GROUP BY 1"""
)
def citation_pages(spark, d):
    """Citations of every cell, and whether any names a page by number."""
    c = table(spark, d, "tabular_cells").select(clean_id("id").alias("id"), json_text(F.col("citations")).alias("p")).distinct().where(F.trim("p").startswith("["))
    raw = c.select("id", F.posexplode(F.from_json("p", "array<string>")).alias("i", "x"))
    paged = F.get_json_object("x", "$.page").rlike(r"^\d+$") & ~F.col("x").rlike(r'"page"\s*:\s*"')
    return raw.groupBy("id").agg(F.max(F.coalesce(paged.cast("long"), F.lit(0))).alias("paged"), F.count("*").alias("n"))
