"""Scans of texts and connectors for manipulation."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from docketspark.functions.ids import clean_id
from docketspark.functions.jsoncols import json_text
from docketspark.operators import scans
from docketspark.plans.registry import Registry, long, table

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle


def _re2(pattern: str) -> str:
    """The same pattern without look-around, for DuckDB."""
    p = pattern.replace("(?iu)", "(?i)").replace(r"(?<!\p{L})", r"(?:^|[^\p{L}])").replace(r"(?!\p{L})", r"(?:$|[^\p{L}])")
    p = re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", p)
    return p.replace("'", "''")


_WORDS = r"len(list_filter(string_split_regex(text, '[^\p{L}]+'), lambda w: length(w) > 1 AND regexp_matches(w, '[A-Za-z]') AND regexp_matches(w, '[\x{0370}-\x{03ff}\x{0400}-\x{04ff}]')))"
_SENTENCES = r"list_filter(list_transform(string_split_regex(text, '[.!?\n]+'), lambda x: lower(trim(x, ' '))), lambda x: length(x) > 10)"
_RUN = rf"regexp_extract(text, '{scans.BASE64}', 1)"
_B64 = f"coalesce(TRY(regexp_matches(decode(from_base64(left({_RUN}, CAST(floor(length({_RUN}) / 4) AS INTEGER) * 4))), '[a-zA-Ząćęłńóśźż]{{4,}}')), false)"


def _rows() -> str:
    """One select a signal: doc_id, technique, severity, confidence, n."""
    out = []
    for s in (*scans.ADVERSARIAL, *scans.EVASION):
        severity = f"CASE WHEN n > {s.many} THEN 'high' ELSE '{s.severity}' END" if s.many else f"'{s.severity}'"
        out.append(f"SELECT doc_id, '{s.technique}' AS technique, {severity} AS severity, least({s.base} + {s.step} * n, {s.cap if s.step else s.base}) AS confidence, n FROM (SELECT doc_id, len(regexp_extract_all(text, '{_re2(s.pattern)}')) AS n FROM documents)")
    out.append(f"SELECT doc_id, 'homoglyph-mixed-script', CASE WHEN n > 3 THEN 'high' ELSE 'medium' END, least(60 + 10 * n, 95), n FROM (SELECT doc_id, {_WORDS} AS n FROM documents)")
    out.append(f"SELECT doc_id, 'base64-readable', 'medium', 65, n FROM (SELECT doc_id, CASE WHEN {_B64} THEN 1 ELSE 0 END AS n FROM documents)")
    out.append(f"SELECT doc_id, 'context-stuffing', 'medium', 75, n FROM (SELECT doc_id, CASE WHEN len(s) >= 100 AND 1 - len(list_distinct(s)) / len(s) > 0.3 THEN 1 ELSE 0 END AS n FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents))")
    return " UNION ALL ".join(out)


_FOUND = f"f AS (SELECT doc_id, technique, severity, CAST(confidence AS INTEGER) AS confidence, CAST(n AS BIGINT) AS n FROM ({_rows()}) WHERE n > 0)"


@R.add(f"WITH {_FOUND} SELECT * FROM f")
def scan_findings(spark, d):
    """One row a document and signal found in it."""
    s = scans.scan(table(spark, d, "documents").select("doc_id", "text"), "text")
    return s.select("doc_id", F.explode("findings").alias("x")).select("doc_id", "x.technique", "x.severity", "x.confidence", "x.n")


@R.add(
    f"""WITH {_FOUND}, g AS (SELECT doc_id, CAST(least(100, round(sum(CASE severity WHEN 'low' THEN 8 WHEN 'medium' THEN 20 WHEN 'high' THEN 40 ELSE 100 END * confidence / 100.0))) AS BIGINT) AS score, max(list_position(['low', 'medium', 'high', 'critical'], severity)) AS worst FROM f GROUP BY 1),
l AS (SELECT d.doc_id, coalesce(score, 0) AS score, ['low', 'medium', 'high', 'critical'][greatest(coalesce(worst, 1), CASE WHEN score >= 60 THEN 3 WHEN score >= 25 THEN 2 ELSE 1 END)] AS level FROM documents d LEFT JOIN g USING (doc_id))
SELECT doc_id, score, level, CASE level WHEN 'low' THEN 'allowed' WHEN 'medium' THEN 'quarantined' WHEN 'high' THEN 'human_review' ELSE 'blocked' END AS action FROM l"""
)
def scan_actions(spark, d):
    """Score, level and action of every document."""
    return scans.scan(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "score", "level", "action")


def _label_sql(patterns) -> str:
    return " UNION ALL ".join(f"SELECT id, '{label}' AS label, '{severity}' AS severity FROM m WHERE regexp_matches(content, '{_re2(p)}')" for label, severity, p in patterns)


_MESSAGES = "m AS (SELECT DISTINCT lower(trim(id, ' \t')) AS id, content FROM chat_messages WHERE content IS NOT NULL)"


@R.add(f"WITH {_MESSAGES}, x AS ({_label_sql(scans.HIDDEN_INSTRUCTIONS + scans.TOOL_POISONING)}) SELECT DISTINCT * FROM x")
def instruction_scan(spark, d):
    """Hidden instructions and widened permissions in messages, by pattern."""
    m = table(spark, d, "chat_messages").where("content IS NOT NULL").select(clean_id("id").alias("id"), "content")
    return scans.match_patterns(m, "content", scans.HIDDEN_INSTRUCTIONS + scans.TOOL_POISONING).select("id", "label", "severity").distinct()


_GATE = """l AS (SELECT id, CASE WHEN json_valid(p1) THEN p1 END AS p FROM (SELECT id, CASE WHEN json_valid(payload) THEN payload::JSON ->> '$' END AS p1 FROM (SELECT DISTINCT id, payload, event_type FROM audit_log) WHERE event_type = 'mcp_security.gateway')),
g AS (SELECT id, p ->> '$.server_name' AS server, CASE json_type(p, '$.findings') WHEN 'ARRAY' THEN list_transform(range(0, CAST(json_array_length(p, '$.findings') AS BIGINT)), lambda i: p ->> ('$.findings[' || i || '].severity')) ELSE [] END AS s FROM l WHERE p IS NOT NULL),
r AS (SELECT id, server, CAST(coalesce(list_sum(list_transform(s, lambda x: CASE x WHEN 'low' THEN 1 WHEN 'medium' THEN 4 WHEN 'high' THEN 10 WHEN 'critical' THEN 30 ELSE 0 END)), 0) AS BIGINT) AS score, len(s) AS n, coalesce(list_max(list_transform(s, lambda x: CASE x WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 ELSE 0 END)), 0) AS w FROM g),
t AS (SELECT id, server, score, ['low', 'medium', 'high', 'critical'][greatest(w, 1)] AS worst, CASE WHEN n = 0 THEN 'allowed' WHEN w >= 4 THEN 'denied' WHEN w >= 2 THEN 'human_review' ELSE 'audit' END AS action FROM r)"""


def _gateway(spark, d):
    """Connector checks of the log: id, server, and the severities of the findings."""
    rows = table(spark, d, "audit_log").where("event_type = 'mcp_security.gateway'").select("id", json_text(F.col("payload")).alias("p")).where(F.col("p").startswith("{")).distinct()
    listed = F.get_json_object("p", "$.findings")
    severities = F.from_json(F.when(listed.startswith("["), listed), "array<struct<severity:string>>")["severity"]
    g = rows.select("id", F.get_json_object("p", "$.server_name").alias("server"), F.coalesce(severities, F.array().cast("array<string>")).alias("s"))
    score, worst, act = scans.connector_risk(F.col("s"))
    return g.select("id", "server", long(score).alias("score"), worst.alias("worst"), act.alias("action"))


@R.add(f"WITH {_GATE} SELECT * FROM t")
def connector_risk(spark, d):
    return _gateway(spark, d)


@R.add(f"WITH {_GATE} SELECT server, CAST(count(*) AS BIGINT) AS checks, max(score) AS highest, ['allowed', 'audit', 'human_review', 'denied'][max(list_position(['allowed', 'audit', 'human_review', 'denied'], action))] AS action FROM t GROUP BY 1")
def connector_actions(spark, d):
    """The gravest action by connector."""
    return _gateway(spark, d).groupBy("server").agg(F.count("*").alias("checks"), F.max("score").alias("highest"), scans.worst_action(F.col("action")).alias("action"))


@R.add(
    """WITH l AS (SELECT DISTINCT CASE WHEN json_valid(payload) THEN payload::JSON ->> '$' END AS p FROM audit_log WHERE event_type = 'mcp_security.gateway'), n AS (SELECT DISTINCT p ->> '$.server_name' AS name FROM l WHERE json_valid(p) AND p ->> '$.server_name' IS NOT NULL),
a AS (SELECT DISTINCT n_name AS approved FROM nation), m AS (SELECT name, levenshtein(name, lower(approved)) AS dist, approved FROM n, a), b AS (SELECT name, min(dist) AS dist, arg_min(approved, dist || '|' || approved) AS x FROM m GROUP BY 1)
SELECT name, CAST(dist AS INTEGER) AS dist, CASE WHEN dist = 0 THEN NULL WHEN dist <= 2 THEN 'critical' WHEN dist <= 4 THEN 'high' ELSE 'low' END AS severity FROM b"""
)
def typosquat(spark, d):
    """Connector names by their distance to the nearest approved name; the approved names are one small array."""
    from docketspark.plans.registry import small_list

    names = table(spark, d, "audit_log").where("event_type = 'mcp_security.gateway'").select(F.get_json_object(json_text(F.col("payload")), "$.server_name").alias("name")).where("name IS NOT NULL").distinct()
    approved = F.array(*(F.lit(x.lower()) for x in small_list(table(spark, d, "nation"), "n_name")))
    dist = F.array_min(F.transform(approved, lambda a: F.levenshtein("name", a)))
    return names.select("name", dist.alias("dist")).withColumn("severity", scans.name_risk(F.col("dist")))
