"""Line offsets, last turns, alias lookups, signature parts, company mentions, fingerprints, scopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketspark.functions.ids import clean_id
from docketspark.functions.jsoncols import json_text
from docketspark.functions.text import trim_common
from docketspark.plans.registry import Registry, long, table

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle


@R.add(
    """SELECT doc_id, CAST(i AS INTEGER) AS line, CAST(i - 1 + list_sum(list_transform(parts[1:i - 1], lambda p: length(p))) AS BIGINT) AS start FROM (SELECT doc_id, string_split(text, chr(10)) AS parts, unnest(range(2, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)
UNION ALL SELECT doc_id, 1, 0 FROM documents WHERE text IS NOT NULL"""
)
def line_offsets(spark, d):
    """Start of every line: one fold over a text's line lengths."""
    parts = F.split("text", "\n", -1)
    starts = F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(F.lit(0).cast("long")), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(p) + 1)))
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(starts).alias("pos", "start"))
    return rows.select("doc_id", (F.col("pos") + 1).alias("line"), "start")


@R.add(
    """SELECT lower(trim(chat_id, ' \t')) AS chat_id, arg_max(lower(trim(id, ' \t')), strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') || lower(trim(id, ' \t'))) AS last_id, CAST(count(DISTINCT lower(trim(id, ' \t'))) AS BIGINT) AS n FROM chat_messages WHERE lower(trim(role, ' \t')) IN ('assistant', 'asystent', 'ai', 'bot') AND chat_id IS NOT NULL AND created_at IS NOT NULL GROUP BY 1"""
)
def last_assistant_turn(spark, d):
    c = table(spark, d, "chat_messages").select(clean_id("chat_id").alias("chat_id"), clean_id("id").alias("id"), clean_id("role").alias("role"), "created_at")
    mine = c.where("role IN ('assistant', 'asystent', 'ai', 'bot') AND chat_id IS NOT NULL AND created_at IS NOT NULL")
    return mine.groupBy("chat_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("last_id"), F.countDistinct("id").alias("n"))


@R.add(
    """WITH k AS (SELECT DISTINCT lower(trim(parent, ' \t')) AS wanted FROM courts WHERE trim(parent, ' \t') <> ''), c AS (SELECT DISTINCT lower(trim(id, ' \t')) AS id, aliases, name FROM courts)
SELECT wanted, coalesce(min(CASE WHEN c.id = wanted THEN c.id END), min(c.id)) AS court_id FROM k LEFT JOIN c ON c.id = wanted OR lower(c.name) = wanted OR list_contains(list_transform(c.aliases, lambda a: lower(trim(a, ' \t'))), wanted) GROUP BY 1"""
)
def alias_lookup(spark, d):
    """Names to ids: by id, name or alias as one exploded key, an exact id first."""
    c = table(spark, d, "courts").select(clean_id("id").alias("court_id"), "name", "aliases").distinct()
    keys = F.array(F.struct(F.col("court_id").alias("key"), F.lit(0).alias("how")), F.struct(clean_id("name").alias("key"), F.lit(1).alias("how")))
    more = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(clean_id(a).alias("key"), F.lit(1).alias("how")))
    dictionary = c.select("court_id", F.explode(F.concat(keys, more)).alias("k")).groupBy("k.key").agg(F.min(F.struct("k.how", "court_id")).alias("m"))
    wanted = table(spark, d, "courts").select(clean_id("parent").alias("wanted")).where("wanted IS NOT NULL").distinct()
    return wanted.join(dictionary, F.col("wanted") == F.col("key"), "left").select("wanted", F.col("m.court_id").alias("court_id"))


_SIG = r"([IVX]+) ([A-Z][A-Za-z]{0,3}) (\d{1,5})/(\d{2})"
_KIND = {"C": "civil", "Ca": "civil appeal", "K": "criminal", "P": "labour", "U": "insurance", "Ns": "non-contentious", "GC": "commercial"}
_KINDS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KIND.items())


@R.add(
    f"""WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '[IVX]+ [A-Z][A-Za-z]{{0,3}} \\d{{1,5}}/\\d{{2}}')) AS v FROM documents)
SELECT regexp_extract(v, '{_SIG}', 2) AS repertory, coalesce(CASE regexp_extract(v, '{_SIG}', 2) {_KINDS} END, 'other') AS kind, CAST(2000 + CAST(regexp_extract(v, '{_SIG}', 4) AS INTEGER) AS BIGINT) AS year, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT v) AS BIGINT) AS cases FROM s GROUP BY 1, 2, 3"""
)
def signature_parts(spark, d):
    """Case signatures taken apart and classed by repertory."""
    full = r"([IVX]+ [A-Z][A-Za-z]{0,3} \d{1,5}/\d{2})"
    v = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(full), 1)).alias("v"))
    kind = F.create_map(*(F.lit(x) for kv in _KIND.items() for x in kv))
    part = lambda i: F.regexp_extract("v", _SIG, i)
    rows = v.groupBy("v").agg(F.count("*").alias("c")).select(part(2).alias("repertory"), long(part(4).cast("int") + 2000).alias("year"), "c")
    out = rows.groupBy("repertory", "year").agg(F.sum("c").alias("n"), F.count("*").alias("cases"))
    return out.select("repertory", F.coalesce(kind[F.col("repertory")], F.lit("other")).alias("kind"), "year", "n", "cases")


_FORM = r"(?:[sS]p\. z o\.o\.|S\.A\.|sp\. k\.|sp\. j\.|spółdzielnia)"


@R.add(
    f"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-ZŁŚŻĆ][a-ząćęłńóśźż]{{2,}} {_FORM}')) AS v FROM documents)
SELECT regexp_extract(v, '^(\\S+)', 1) AS company, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT doc_id) AS BIGINT) AS docs FROM m GROUP BY 1"""
)
def company_mentions(spark, d):
    rx = f"([A-ZŁŚŻĆ][a-ząćęłńóśźż]{{2,}} {_FORM})"
    m = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(rx), 1)).alias("v"))
    per = m.groupBy(F.regexp_extract("v", r"^(\S+)", 1).alias("company"), "doc_id").agg(F.count("*").alias("c"))
    return per.groupBy("company").agg(F.sum("c").alias("n"), F.count("*").alias("docs"))


@R.add("SELECT r_name, sha256(r_name || '|' || string_agg(n_name, '|' ORDER BY n_name)) AS fingerprint FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def fingerprints(spark, d):
    """Fingerprint of a definition: its name and the ordered names of its parts."""
    j = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    parts = j.groupBy("r_name").agg(F.sort_array(F.collect_list("n_name")).alias("p"))
    return parts.select("r_name", F.sha2(F.concat_ws("|", "r_name", F.array_join("p", "|")), 256).alias("fingerprint"))


@R.add(
    """WITH s AS (SELECT doc_id, text FROM documents WHERE folder_id IN (SELECT lower(trim(id, ' \t')) FROM project_subfolders WHERE name LIKE 'Umowy%'))
SELECT h.hit_id, d.doc_id FROM (SELECT DISTINCT hit_id, lower(trim(document_id, ' \t')) AS document_id FROM feed_passage_hits) h JOIN (SELECT doc_id, lower(trim(document_id, ' \t')) AS document_id FROM documents) d USING (document_id) WHERE d.doc_id IN (SELECT doc_id FROM s)"""
)
def scoped_hits(spark, d):
    """Hits within a scope of folders: the scope is a semi-join key set, applied before anything is ranked."""
    scope = table(spark, d, "project_subfolders").where("name LIKE 'Umowy%'").select(clean_id("id").alias("folder_id")).distinct()
    docs = table(spark, d, "documents").join(scope, "folder_id", "left_semi").select("doc_id", clean_id("document_id").alias("document_id"))
    hits = table(spark, d, "feed_passage_hits").select("hit_id", clean_id("document_id").alias("document_id")).distinct()
    return hits.join(docs, "document_id").select("hit_id", "doc_id")


@R.add(
    """SELECT doc_id, CAST(len(regexp_extract_all(text, '[\\x{0300}-\\x{036f}]{2,}')) AS BIGINT) AS stacks, regexp_matches(text, '[\\x{e0000}-\\x{e007f}]') AS tags, CAST(len(regexp_extract_all(text, '(?:^|[^A-Za-z0-9+/=])[A-Za-z0-9+/]{60,}')) AS BIGINT) AS encoded
FROM documents WHERE text IS NOT NULL AND (regexp_matches(text, '[\\x{0300}-\\x{036f}]{2,}|[\\x{e0000}-\\x{e007f}]') OR regexp_matches(text, '(?:^|[^A-Za-z0-9+/=])[A-Za-z0-9+/]{60,}'))"""
)
def evasion_signals(spark, d):
    c = F.col("text")
    stacks = long(F.regexp_count(c, F.lit(r"[\u0300-\u036f]{2,}")))
    tags = c.rlike(r"[\x{e0000}-\x{e007f}]")
    encoded = long(F.regexp_count(c, F.lit(r"(?:^|[^A-Za-z0-9+/=])[A-Za-z0-9+/]{60,}")))
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", stacks.alias("stacks"), tags.alias("tags"), encoded.alias("encoded"))
    return rows.where("stacks > 0 OR tags OR encoded > 0")


@R.add(
    """WITH c AS (SELECT DISTINCT lower(trim(id, ' \t')) AS id, CASE WHEN json_valid(content) THEN content::JSON ->> '$' END AS p FROM chat_messages WHERE content LIKE '%inserted_text%'),
ev AS (SELECT p -> ('$[' || i || '].annotations') AS a FROM (SELECT p, unnest(range(0, CAST(json_array_length(p) AS BIGINT))) AS i FROM c WHERE json_valid(p) AND p[1] = '[')),
an AS (SELECT DISTINCT a ->> ('$[' || k || '].edit_id') AS edit_id, a ->> ('$[' || k || '].deleted_text') AS x, a ->> ('$[' || k || '].inserted_text') AS y FROM (SELECT a, unnest(range(0, CAST(json_array_length(a) AS BIGINT))) AS k FROM ev WHERE json_type(a) = 'ARRAY')),
h AS (SELECT *, coalesce(list_position(list_transform(range(1, least(length(x), length(y)) + 1), lambda i: x[i] = y[i]), false) - 1, least(length(x), length(y))) AS n FROM an WHERE x IS NOT NULL AND y IS NOT NULL),
r AS (SELECT edit_id, n, substring(x, n + 1) AS rx, substring(y, n + 1) AS ry FROM h),
s AS (SELECT *, coalesce(list_position(list_transform(range(1, least(length(rx), length(ry)) + 1), lambda i: reverse(rx)[i] = reverse(ry)[i]), false) - 1, least(length(rx), length(ry))) AS m FROM r)
SELECT edit_id, substring(rx, 1, length(rx) - m) AS deleted, substring(ry, 1, length(ry) - m) AS inserted FROM s"""
)
def edit_diffs(spark, d):
    """What an edit really changes: its deleted and inserted text without their common start and end."""
    c = table(spark, d, "chat_messages").where(F.col("content").contains("inserted_text")).select(json_text(F.col("content")).alias("p"))
    events = F.from_json(F.when(F.trim("p").startswith("["), F.col("p")), "array<struct<annotations:string>>")
    per = c.select(F.explode(events).alias("e")).select(F.from_json(F.when(F.col("e.annotations").startswith("["), F.col("e.annotations")), "array<struct<edit_id:string,deleted_text:string,inserted_text:string>>").alias("a"))
    x = per.select(F.explode("a").alias("x")).select("x.*").where("deleted_text IS NOT NULL AND inserted_text IS NOT NULL").distinct()
    deleted, inserted = trim_common(F.col("deleted_text"), F.col("inserted_text"))
    return x.select("edit_id", deleted.alias("deleted"), inserted.alias("inserted"))


@R.add(
    """WITH f AS (SELECT r_regionkey, sha256(r_name || '|' || string_agg(n_name, '|' ORDER BY n_name)) AS now FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name),
b AS (SELECT r_regionkey, CASE WHEN r_regionkey = 1 THEN 'old' ELSE now END AS base FROM f WHERE r_regionkey <> 0) SELECT f.r_regionkey, CASE WHEN base IS NULL THEN 'no baseline' WHEN base = now THEN 'same' ELSE 'changed' END AS drift FROM f LEFT JOIN b USING (r_regionkey)"""
)
def fingerprint_drift(spark, d):
    """Definitions whose fingerprint differs from the recorded one."""
    j = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    now = j.groupBy("r_regionkey", "r_name").agg(F.sort_array(F.collect_list("n_name")).alias("p"))
    now = now.select("r_regionkey", F.sha2(F.concat_ws("|", "r_name", F.array_join("p", "|")), 256).alias("now"))
    base = now.where("r_regionkey != 0").select("r_regionkey", F.when(F.col("r_regionkey") == 1, "old").otherwise(F.col("now")).alias("base"))
    drift = F.when(F.col("base").isNull(), "no baseline").when(F.col("base") == F.col("now"), "same").otherwise("changed")
    return now.join(base, "r_regionkey", "left").select("r_regionkey", drift.alias("drift"))
