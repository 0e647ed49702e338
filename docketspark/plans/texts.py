"""Text, date, masking, checksum and risk-signal queries over the document tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketspark.functions import checksums as ck
from docketspark.functions import masking as mk
from docketspark.functions import text as tx
from docketspark.plans.registry import Registry, long, table

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle

_Q = "[“”„‟«»‘’‚‛'']"
_D = "[‐‑‒–—―−]"
_NORM = "trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace({0}, '-[ \\t]*\\r?\\n[ \\t]*', '', 'g'), '" + _Q + "', '\"', 'g'), '" + _D + "', '-', 'g')), '[\\s\\x{{00a0}}]+', ' ', 'g'))"


@R.add(f"SELECT hit_id, md5({_NORM.format('text')}) AS norm FROM (SELECT DISTINCT hit_id, text FROM feed_passage_hits)")
def norm_quote(spark, d):
    return table(spark, d, "feed_passage_hits").select("hit_id", "text").distinct().select("hit_id", F.md5(tx.normalize_quote(F.col("text"))).alias("norm"))


@R.add("SELECT doc_id, unnest(list_filter(list_transform(string_split_regex(text, '\\[\\.\\.\\.\\]|\\.\\.\\.'), lambda x: trim(x, ' ')), lambda x: x <> '')) AS part FROM documents")
def gap_parts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(tx.split_gaps(F.col("text"))).alias("part"))


@R.add("SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS BIGINT) AS n_terms, CAST(len(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))) AS BIGINT) AS n_distinct FROM documents WHERE text IS NOT NULL")
def fts_terms(spark, d):
    terms = tx.terms(F.col("text"))
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", long(F.size(terms)).alias("n_terms"), long(F.size(F.array_distinct(terms))).alias("n_distinct"))


@R.add(
    """SELECT stem, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT doc_id) AS BIGINT) AS docs FROM (SELECT doc_id, CASE WHEN length(w) >= 7 AND regexp_full_match(w, '\\p{L}+') THEN substring(w, 1, length(w) - least(3, length(w) - 5)) ELSE w END AS stem
FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM documents)) GROUP BY 1"""
)
def term_stems(spark, d):
    w = table(spark, d, "documents").select("doc_id", F.explode(tx.terms(F.col("text"))).alias("w"))
    per = w.select("doc_id", tx.stem(F.col("w")).alias("stem")).groupBy("stem", "doc_id").agg(F.count("*").alias("tf"))
    return per.groupBy("stem").agg(F.sum("tf").alias("n"), F.count("*").alias("docs"))


@R.add("SELECT hit_id, round(CASE WHEN length(regexp_replace(text, '\\s', '', 'g')) < 20 THEN 0.0 ELSE CAST(length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) AS DOUBLE) / length(regexp_replace(text, '\\s', '', 'g')) END, 6) AS quality FROM (SELECT DISTINCT hit_id, text FROM feed_passage_hits) WHERE text IS NOT NULL")
def ocr_quality(spark, d):
    rows = table(spark, d, "feed_passage_hits").select("hit_id", "text").distinct().where("text IS NOT NULL")
    return rows.select("hit_id", F.round(tx.ocr_quality(F.col("text")), 6).alias("quality"))


_MONTHS = "|".join(tx.MONTHS)
_CASE = " ".join(f"WHEN '{m}' THEN '{i:02d}'" for m, i in tx.MONTHS.items())


@R.add(
    f"""SELECT doc_id, CASE WHEN y1 = '' THEN '' ELSE y1 || '-' || lpad(m1, 2, '0') || '-' || lpad(d1, 2, '0') END AS dotted, CASE WHEN y2 = '' THEN '' ELSE y2 || '-' || CASE m2 {_CASE} END || '-' || lpad(d2, 2, '0') END AS worded
FROM (SELECT doc_id, regexp_extract(text, '\\b(\\d{{1,2}})\\.(\\d{{1,2}})\\.(\\d{{4}})\\b', 1) d1, regexp_extract(text, '\\b(\\d{{1,2}})\\.(\\d{{1,2}})\\.(\\d{{4}})\\b', 2) m1, regexp_extract(text, '\\b(\\d{{1,2}})\\.(\\d{{1,2}})\\.(\\d{{4}})\\b', 3) y1,
regexp_extract(text, '\\b(\\d{{1,2}}) ({_MONTHS}) (\\d{{4}})\\b', 1) d2, regexp_extract(text, '\\b(\\d{{1,2}}) ({_MONTHS}) (\\d{{4}})\\b', 2) m2, regexp_extract(text, '\\b(\\d{{1,2}}) ({_MONTHS}) (\\d{{4}})\\b', 3) y2 FROM documents WHERE text IS NOT NULL)"""
)
def first_dates(spark, d):
    rows = table(spark, d, "documents").where("text IS NOT NULL")
    return rows.select("doc_id", tx.dotted_date(F.col("text")).alias("dotted"), tx.worded_date(F.col("text")).alias("worded"))


@R.add(
    r"""WITH a AS (SELECT CAST(year(max(created_at)) AS INTEGER) AS y FROM documents), f AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\b\d{1,2}\.\d{1,2}\.\d{4}\b')) AS found FROM documents)
SELECT doc_id, found FROM f, a WHERE CAST(right(found, 4) AS INTEGER) < 1900 OR CAST(right(found, 4) AS INTEGER) > a.y + 1"""
)
def suspect_dates(spark, d):
    """Dates of documents before 1900 or after the year that follows the newest document's."""
    docs = table(spark, d, "documents")
    year = docs.agg(F.year(F.max("created_at"))).first()[0] or 0
    return docs.select("doc_id", F.explode(tx.suspect_dates(F.col("text"), F.lit(year))).alias("found"))


_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
_MASKED = "CASE WHEN length(split_part(e, '@', 1)) <= 3 THEN e ELSE substring(e, 1, 3) || '***@' || split_part(e, '@', 2) END"


@R.add(f"SELECT DISTINCT hit_id, {_MASKED} AS masked FROM (SELECT hit_id, unnest(regexp_extract_all(text, '{_EMAIL}')) AS e FROM feed_passage_hits)")
def mask_email(spark, d):
    e = table(spark, d, "feed_passage_hits").select("hit_id", F.explode(F.regexp_extract_all("text", F.lit(f"({_EMAIL})"), 1)).alias("e"))
    return e.select("hit_id", mk.mask_email(F.col("e")).alias("masked")).distinct()


@R.add("SELECT DISTINCT hit_id, CASE WHEN length(text) > 205 THEN substring(text, 1, 100) || '[...]' || substring(text, length(text) - 99, 100) ELSE text END AS shown FROM feed_passage_hits WHERE text IS NOT NULL")
def mask_window(spark, d):
    return table(spark, d, "feed_passage_hits").where("text IS NOT NULL").select("hit_id", mk.mask_window(F.col("text")).alias("shown")).distinct()


def _sum(weights, col="x"):
    return " + ".join(f"{w} * CAST(substring({col}, {i}, 1) AS INTEGER)" for i, w in enumerate(weights, 1))


@R.add(
    f"""WITH n AS (SELECT DISTINCT hit_id, unnest(regexp_extract_all(text, '\\b\\d{{9,11}}\\b')) AS x FROM feed_passage_hits)
SELECT hit_id, x, CASE WHEN length(x) = 11 THEN (10 - ({_sum(ck.PESEL)}) % 10) % 10 = CAST(right(x, 1) AS INTEGER) WHEN length(x) = 10 THEN ({_sum(ck.NIP)}) % 11 = CAST(right(x, 1) AS INTEGER) ELSE ({_sum(ck.REGON9)}) % 11 % 10 = CAST(right(x, 1) AS INTEGER) END AS ok,
CASE WHEN length(x) = 11 THEN substring(x, 1, 4) || '***' || substring(x, 8, 4) WHEN length(x) = 10 THEN substring(x, 1, 3) || '****' || substring(x, 8, 3) ELSE substring(x, 1, 3) || '***' || substring(x, 7, 3) END AS masked FROM n"""
)
def identity_numbers(spark, d):
    x = table(spark, d, "feed_passage_hits").select("hit_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b(\d{9,11})\b"), 1)).alias("x")).distinct()
    n = F.length("x")
    ok = F.when(n == 11, ck.pesel_ok(F.col("x"))).when(n == 10, ck.nip_ok(F.col("x"))).otherwise(ck.regon_ok(F.col("x")))
    return x.select("hit_id", "x", ok.alias("ok"), mk.mask_value(F.col("x")).alias("masked"))


@R.add("SELECT doc_id, round(1 - CAST(len(list_distinct(list_transform(s, lambda x: lower(x)))) AS DOUBLE) / len(s), 6) AS ratio FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[.!?\\n]+'), lambda x: trim(x, ' ')), lambda x: length(x) > 10) AS s FROM documents WHERE text IS NOT NULL) WHERE len(s) >= 100")
def repetition(spark, d):
    r = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.round(tx.repetition_ratio(F.col("text")), 6).alias("ratio"))
    return r.where("ratio IS NOT NULL")


@R.add("SELECT doc_id, n FROM (SELECT doc_id, CAST(len(regexp_extract_all(text, '[\\x{200b}\\x{200c}\\x{200d}\\x{2060}\\x{feff}\\x{00ad}]')) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL) WHERE n > 0")
def zero_width(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", tx.zero_width_count(F.col("text")).alias("n")).where("n > 0")


@R.add("SELECT doc_id, n FROM (SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '[^\\p{L}]+'), lambda w: length(w) > 1 AND regexp_matches(w, '[A-Za-z]') AND regexp_matches(w, '[\\x{0370}-\\x{03ff}\\x{0400}-\\x{04ff}]'))) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL) WHERE n > 0")
def homoglyph(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", tx.mixed_script_words(F.col("text")).alias("n")).where("n > 0")


_RISK = {  # signal: (severity weight, confidence, condition in Spark and DuckDB)
    "zero_width": (20, 80),
    "homoglyph": (40, 70),
    "bidi": (100, 90),
    "spaced_word": (8, 60),
    "override": (100, 95),
}


@R.add(
    r"""WITH s AS (SELECT doc_id, len(regexp_extract_all(text, '[\x{200b}\x{200c}\x{200d}\x{2060}\x{feff}\x{00ad}]')) AS zw,
len(list_filter(string_split_regex(text, '[^\p{L}]+'), lambda w: length(w) > 1 AND regexp_matches(w, '[A-Za-z]') AND regexp_matches(w, '[\x{0370}-\x{03ff}\x{0400}-\x{04ff}]'))) AS hg,
regexp_matches(text, '[\x{202a}-\x{202e}\x{2066}-\x{2069}]') AS bidi, regexp_matches(text, '(^|[^\p{L}])(\p{L} ){4,}\p{L}([^\p{L}]|$)') AS spaced, regexp_matches(lower(text), 'ignore (all )?previous|zignoruj (wszystkie )?poprzednie') AS ovr FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, least(100, CAST(round(CASE WHEN zw > 0 THEN 20 * 0.8 ELSE 0 END + CASE WHEN hg > 0 THEN 40 * 0.7 ELSE 0 END + CASE WHEN bidi THEN 100 * 0.9 ELSE 0 END + CASE WHEN spaced THEN 8 * 0.6 ELSE 0 END + CASE WHEN ovr THEN 100 * 0.95 ELSE 0 END) AS BIGINT)) AS score FROM s)
SELECT doc_id, score, CASE WHEN score >= 60 THEN 'high' WHEN score >= 25 THEN 'medium' ELSE 'low' END AS level FROM r WHERE score > 0"""
)
def risk_score(spark, d):
    c = F.col("text")
    signals = {
        "zero_width": tx.zero_width_count(c) > 0,
        "homoglyph": tx.mixed_script_words(c) > 0,
        "bidi": c.rlike(r"[\u202a-\u202e\u2066-\u2069]"),
        "spaced_word": c.rlike(r"(^|[^\p{L}])(\p{L} ){4,}\p{L}([^\p{L}]|$)"),
        "override": F.lower(c).rlike(r"ignore (all )?previous|zignoruj (wszystkie )?poprzednie"),
    }
    total = sum((F.when(signals[k], w * conf / 100).otherwise(0.0) for k, (w, conf) in _RISK.items()), F.lit(0.0))
    score = F.least(F.lit(100), F.round(total)).cast("long")
    level = F.when(F.col("score") >= 60, "high").when(F.col("score") >= 25, "medium").otherwise("low")
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", score.alias("score")).where("score > 0").withColumn("level", level)


@R.add("SELECT DISTINCT id, trim(regexp_extract(m, 'page:([^|\\]]*)', 1), ' ') AS page, trim(regexp_extract(m, 'quote:([^\\]]*)', 1), ' ') AS quote FROM (SELECT lower(trim(id, ' \t')) AS id, unnest(regexp_extract_all(content, '\\[\\[page:[^|\\]]*\\|\\|quote:[^\\]]*\\]\\]')) AS m FROM tabular_cells) WHERE trim(regexp_extract(m, 'quote:([^\\]]*)', 1), ' ') <> ''")
def inline_citations(spark, d):
    from docketspark.functions.ids import clean_id

    x = table(spark, d, "tabular_cells").select(clean_id("id").alias("id"), F.explode(tx.inline_citations(F.col("content"))).alias("x"))
    return x.select("id", "x.page", "x.quote").distinct()


@R.add("SELECT doc_id, CASE WHEN p = 0 THEN NULL ELSE CASE WHEN p > 41 THEN '…' ELSE '' END || trim(regexp_replace(substring(text, greatest(p - 40, 1), least(p + 45, length(text) + 1) - greatest(p - 40, 1)), '[\\s\\p{Z}]+', ' ', 'g')) || CASE WHEN p + 45 <= length(text) THEN '…' ELSE '' END END AS seen FROM (SELECT doc_id, text, strpos(text, 'umowa') AS p FROM documents WHERE text IS NOT NULL) WHERE p > 0")
def keyword_excerpt(spark, d):
    p = F.locate("umowa", F.col("text"))
    rows = table(spark, d, "documents").where("text IS NOT NULL").withColumn("p", p).where("p > 0")
    return rows.select("doc_id", tx.excerpt(F.col("text"), F.col("p") - 1, F.lit(5), 40).alias("seen"))


@R.add("SELECT DISTINCT nid AS id, coalesce(nullif(substring(regexp_replace(regexp_replace(lower(name), '[^a-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80), ''), 'note') AS slug FROM (SELECT lower(trim(id, ' \t')) AS nid, name FROM project_subfolders)")
def name_slugs(spark, d):
    from docketspark.functions.ids import clean_id

    return table(spark, d, "project_subfolders").select(clean_id("id").alias("id"), tx.slug(F.col("name")).alias("slug")).distinct()


@R.add(
    r"""WITH d AS (SELECT doc_id, doc_type, source, regexp_replace(regexp_replace(text, '[^A-Za-z0-9 ]+', ' ', 'g'), '^ +| +$', '', 'g') AS body FROM documents WHERE text IS NOT NULL AND doc_type IS NOT NULL AND source IS NOT NULL)
SELECT doc_id, '## ' || doc_type || chr(10) || body || CASE WHEN body = '' THEN '' ELSE chr(10) END || chr(10) || '- ' || source || chr(10) || '- **' || doc_id || '** & <x>' AS md FROM d"""
)
def html_to_markdown(spark, d):
    """Pages made of every document's words and labels, read back as markdown."""
    body = F.regexp_replace(F.regexp_replace("text", "[^A-Za-z0-9 ]+", " "), "^ +| +$", "")
    rows = table(spark, d, "documents").where("text IS NOT NULL AND doc_type IS NOT NULL AND source IS NOT NULL").select("doc_id", "doc_type", "source", body.alias("body"))
    page = F.concat(F.lit('<html><h2 class="x">'), "doc_type", F.lit("</h2><p>"), "body", F.lit("</p><ul><li>"), "source", F.lit("</li><li><b>"), F.col("doc_id").cast("string"), F.lit("</b> &amp; &lt;x&gt;&nbsp;</li></ul></html>"))
    return rows.select("doc_id", tx.html_to_markdown(page).alias("md"))


@R.add("SELECT s_suppkey, CAST(CASE WHEN abs(length(s_name) - length(n_name)) > 40 THEN greatest(length(s_name), length(n_name)) ELSE levenshtein(s_name, n_name) END AS BIGINT) AS dist FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def edit_distance(spark, d):
    j = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return j.select("s_suppkey", long(tx.banded_distance(F.col("s_name"), F.col("n_name"))).alias("dist"))
