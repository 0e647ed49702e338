"""Usage, metrics, ledger, review-grid and event-window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketspark.functions.ids import clean_id
from docketspark.functions.jsoncols import field, json_text
from docketspark.operators import ledger
from docketspark.operators.ordered import line_up, with_last_seen, with_running_sum
from docketspark.plans.registry import Registry, long, table

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle

_LOG = """l AS (SELECT id, ts, actor_user_id AS actor, event_type, prev_hash, hash, CASE WHEN json_valid(p1) THEN p1 END AS p
FROM (SELECT *, CASE WHEN json_valid(payload) THEN payload::JSON ->> '$' END AS p1 FROM (SELECT DISTINCT * FROM audit_log)))"""


def log(spark, d, *names):
    """Events once each, with the columns asked for; ``p`` is the payload opened, which is shuffled only if asked for."""
    source = {"actor": "actor_user_id", "p": "payload"}
    cols = [source.get(c, c) for c in names]
    rows = ledger.distinct_log(table(spark, d, "audit_log"), "id", cols)
    return rows.select("id", *(json_text(F.col("payload")).alias("p") if c == "p" else F.col(source.get(c, c)).alias(c) for c in names))


def _calls(spark, d):
    r = log(spark, d, "ts", "actor", "event_type", "p").where("event_type = 'llm_route' AND p IS NOT NULL")
    num = lambda path: F.coalesce(field(F.col("p"), path).try_cast("double"), F.lit(0.0))
    return r.select("ts", "actor", F.coalesce(field(F.col("p"), "$.model"), F.lit("-")).alias("model"), num("$.prompt_tokens").alias("pt"), num("$.completion_tokens").alias("ct"), field(F.col("p"), "$.cost_usd").try_cast("double").alias("cost"))


_CALLS = "c AS (SELECT ts, actor, coalesce(p ->> '$.model', '-') AS model, coalesce(TRY_CAST(p ->> '$.prompt_tokens' AS DOUBLE), 0) AS pt, coalesce(TRY_CAST(p ->> '$.completion_tokens' AS DOUBLE), 0) AS ct, TRY_CAST(p ->> '$.cost_usd' AS DOUBLE) AS cost FROM l WHERE event_type = 'llm_route' AND p IS NOT NULL)"
_SUMS = "CAST(count(*) AS BIGINT) AS calls, CAST(sum(pt) AS BIGINT) AS prompt_tokens, CAST(sum(ct) AS BIGINT) AS completion_tokens, round(coalesce(sum(cost), 0), 6) AS cost, CAST(sum(CASE WHEN cost IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unpriced"


def _sums(df):
    return df.agg(
        F.count("*").alias("calls"), long(F.sum("pt")).alias("prompt_tokens"), long(F.sum("ct")).alias("completion_tokens"),
        F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("cost"), F.count_if(F.col("cost").isNull()).alias("unpriced"),
    )


@R.add(f"WITH {_LOG}, {_CALLS} SELECT model, {_SUMS} FROM c GROUP BY model")
def usage_by_model(spark, d):
    return _sums(_calls(spark, d).groupBy("model"))


@R.add(f"WITH {_LOG}, {_CALLS} SELECT actor, {_SUMS} FROM c GROUP BY actor")
def usage_by_actor(spark, d):
    return _sums(_calls(spark, d).groupBy("actor"))


@R.add(
    f"""WITH l0 AS (SELECT DISTINCT id, ts, actor_user_id AS actor, event_type, chat_id, CASE WHEN json_valid(payload) THEN payload::JSON ->> '$' END AS p1 FROM audit_log), l AS (SELECT *, CASE WHEN json_valid(p1) THEN p1 END AS p FROM l0),
{_CALLS.replace("SELECT ts, actor,", "SELECT coalesce(chat_id, '(none)') AS place, actor,")} SELECT place, {_SUMS} FROM c GROUP BY 1"""
)
def usage_by_case(spark, d):
    """Calls by the case they were made in; those without one together."""
    r = log(spark, d, "chat_id", "event_type", "p").where("event_type = 'llm_route' AND p IS NOT NULL")
    num = lambda path: F.coalesce(field(F.col("p"), path).try_cast("double"), F.lit(0.0))
    calls = r.select(F.coalesce("chat_id", F.lit("(none)")).alias("place"), num("$.prompt_tokens").alias("pt"), num("$.completion_tokens").alias("ct"), field(F.col("p"), "$.cost_usd").try_cast("double").alias("cost"))
    return _sums(calls.groupBy("place"))


@R.add(f"WITH {_LOG}, {_CALLS} SELECT substring(ts, 1, 10) AS day, {_SUMS} FROM c GROUP BY 1")
def usage_daily(spark, d):
    return _sums(_calls(spark, d).groupBy(F.substring("ts", 1, 10).alias("day")))


@R.add(f"WITH {_LOG}, k AS (SELECT unnest(['llm_route', 'cost_cap', 'document.deleted', 'chat.message.user']) AS event_type) SELECT k.event_type, CAST(count(l.id) AS BIGINT) AS n FROM k LEFT JOIN l USING (event_type) GROUP BY 1")
def counts_zero_filled(spark, d):
    kinds = spark.createDataFrame([(k,) for k in ("llm_route", "cost_cap", "document.deleted", "chat.message.user")], "event_type string")
    n = log(spark, d, "event_type").groupBy("event_type").agg(F.count("*").alias("n"))
    return kinds.join(n, "event_type", "left").select("event_type", F.coalesce("n", F.lit(0)).alias("n"))


@R.add(f"WITH {_LOG} SELECT event_type, p ->> '$.decision' AS decision, CAST(count(*) AS BIGINT) AS n FROM l WHERE p ->> '$.decision' IS NOT NULL GROUP BY 1, 2")
def action_counts(spark, d):
    r = log(spark, d, "event_type", "p").select("event_type", field(F.col("p"), "$.decision").alias("decision")).where("decision IS NOT NULL")
    return r.groupBy("event_type", "decision").agg(F.count("*").alias("n"))


@R.add("SELECT strftime(time_bucket(INTERVAL 5 MINUTES, ts), '%Y-%m-%d %H:%M:%S') AS bucket, event_type, round(count(*) / 300.0, 6) AS per_second FROM events GROUP BY 1, 2")
def rate_5m(spark, d):
    e = table(spark, d, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "5 minutes").alias("w"), "event_type").agg((F.count("*") / 300).alias("r"))
    return e.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("bucket"), "event_type", F.round("r", 6).alias("per_second"))


@R.add(f"WITH {_LOG} SELECT id, coalesce(prev_hash = coalesce(lag(hash) OVER (ORDER BY id), repeat('0', 64)), false) AS link_ok FROM l")
def chain_links(spark, d):
    return ledger.check_links(log(spark, d, "prev_hash", "hash"))


@R.add(
    f"""WITH {_LOG} SELECT id, sha256(prev_hash || '{{"actor":' || CASE WHEN actor IS NULL THEN 'null' ELSE '"' || actor || '"' END || ',"event_type":"' || event_type || '","ts":"' || ts || '"}}') AS digest FROM l"""
)
def row_digests(spark, d):
    r = log(spark, d, "ts", "actor", "event_type", "prev_hash")
    return r.select("id", ledger.row_digest(F.col("prev_hash"), actor=F.col("actor"), event_type=F.col("event_type"), ts=F.col("ts")).alias("digest"))


@R.add(
    """WITH l AS (SELECT DISTINCT id FROM audit_log), b AS (SELECT min(id) AS block_start, max(id) AS block_end, max(id) % 5 AS computed_at, 'd' || substring(ts, 1, 10) AS block_id FROM audit_log GROUP BY substring(ts, 1, 10))
SELECT id, block_id FROM (SELECT l.id, b.block_id, row_number() OVER (PARTITION BY l.id ORDER BY b.computed_at DESC, b.block_id DESC) AS rn FROM l JOIN b ON l.id BETWEEN b.block_start AND b.block_end) WHERE rn = 1"""
)
def covering_blocks(spark, d):
    rows = table(spark, d, "audit_log").select("id", F.substring("ts", 1, 10).alias("day"))
    b = rows.groupBy("day").agg(F.min("id").alias("block_start"), F.max("id").alias("block_end"))
    b = b.select("block_start", "block_end", (F.col("block_end") % 5).alias("computed_at"), F.concat(F.lit("d"), "day").alias("block_id"))
    return ledger.covering_block(rows.select("id").distinct(), "id", b)


_CELLS = "x AS (SELECT DISTINCT lower(trim(id, ' \t')) AS id, lower(trim(review_id, ' \t')) AS review_id, lower(trim(document_id, ' \t')) AS document_id, column_index, status, created_at FROM tabular_cells)"


def cells(spark, d):
    c = table(spark, d, "tabular_cells")
    return c.select(*(clean_id(k).alias(k) for k in ("id", "review_id", "document_id")), "column_index", "status", "created_at").distinct()


@R.add(f"WITH {_CELLS} SELECT review_id, CAST(count(DISTINCT document_id) AS BIGINT) AS documents, CAST(count(DISTINCT column_index) AS BIGINT) AS cols, CAST(count(*) AS BIGINT) AS cells, CAST(sum(CASE WHEN status = 'done' THEN 1 ELSE 0 END) AS BIGINT) AS done FROM x GROUP BY 1")
def review_counts(spark, d):
    return cells(spark, d).groupBy("review_id").agg(F.countDistinct("document_id").alias("documents"), F.countDistinct("column_index").alias("cols"), F.count("*").alias("cells"), F.count_if(F.col("status") == "done").alias("done"))


@R.add(
    f"""WITH {_CELLS}, y AS (SELECT *, row_number() OVER (PARTITION BY review_id, document_id, column_index ORDER BY created_at DESC NULLS LAST, id DESC) AS rn FROM x)
SELECT review_id, document_id, {', '.join(f"coalesce(max(CASE WHEN column_index = {i} THEN status END), '') AS c{i}" for i in range(9))} FROM y WHERE rn = 1 GROUP BY 1, 2"""
)
def review_grid(spark, d):
    last = cells(spark, d).groupBy("review_id", "document_id", "column_index").agg(F.max(F.struct("created_at", "id", "status")).alias("m"))
    p = last.groupBy("review_id", "document_id").pivot("column_index", list(range(9))).agg(F.first("m.status"))
    return p.select("review_id", "document_id", *(F.coalesce(F.col(str(i)), F.lit("")).alias(f"c{i}") for i in range(9)))


_COLUMNS = range(9)
_SHOWN = "CASE WHEN status IS NULL OR status IN ('pending', 'generating') THEN '(pending)' WHEN status = 'error' THEN '(error)' ELSE CASE WHEN length(x) > 400 THEN substring(x, 1, 400) || '…' ELSE x END END"


@R.add(
    f"""WITH x AS (SELECT DISTINCT lower(trim(id, ' \t')) AS id, lower(trim(review_id, ' \t')) AS review_id, lower(trim(document_id, ' \t')) AS document_id, column_index, status, content, created_at FROM tabular_cells),
y AS (SELECT *, row_number() OVER (PARTITION BY review_id, document_id, column_index ORDER BY created_at DESC NULLS LAST, id DESC) AS rn FROM x),
z AS (SELECT review_id, document_id, column_index, status, coalesce(nullif(trim(CASE WHEN json_valid(content) AND json_type(content) = 'OBJECT' THEN content ->> '$.summary' END, ' '), ''), '(not yet generated)') AS x FROM y WHERE rn = 1),
n AS (SELECT review_id, document_id, row_number() OVER (PARTITION BY review_id ORDER BY document_id) - 1 AS i FROM (SELECT DISTINCT review_id, document_id FROM z))
SELECT review_id, CAST(i AS BIGINT) AS row_no, '| ROW:' || i || ' ' || document_id || ' | ' || {" || ' | ' || ".join(f"coalesce((SELECT max({_SHOWN}) FROM z WHERE z.review_id = n.review_id AND z.document_id = n.document_id AND column_index = {i}), '(pending)') || ' [[COL:{i}||ROW:' || i || ']]'" for i in _COLUMNS)} || ' |' AS line FROM n
UNION ALL SELECT DISTINCT review_id, -2, '| Document | {" | ".join(f"C{i}" for i in _COLUMNS)} |' FROM z UNION ALL SELECT DISTINCT review_id, -1, '|---|{"|".join(["---"] * 9)}|' FROM z"""
)
def markdown_grid(spark, d):
    """Every review as a markdown table with addressed cells: header, rule, and a line a document, numbered over partition edges."""
    c = table(spark, d, "tabular_cells").select(*(clean_id(k).alias(k) for k in ("id", "review_id", "document_id")), "column_index", "status", "content", "created_at")
    last = c.groupBy("review_id", "document_id", "column_index").agg(F.max(F.struct("created_at", "id", "status", "content")).alias("m"))
    whole = F.when(F.trim("m.content").startswith("{"), F.when(F.try_parse_json("m.content").isNotNull(), F.get_json_object("m.content", "$.summary")))
    x = F.coalesce(F.nullif(F.trim(whole), F.lit("")), F.lit("(not yet generated)"))
    shown = F.when(F.col("m.status").isNull() | F.col("m.status").isin("pending", "generating"), "(pending)").when(F.col("m.status") == "error", "(error)").otherwise(F.when(F.length(x) > 400, F.concat(F.left(x, F.lit(400)), F.lit("…"))).otherwise(x))
    p = last.select("review_id", "document_id", "column_index", shown.alias("s")).groupBy("review_id", "document_id").pivot("column_index", list(_COLUMNS)).agg(F.first("s"))
    order = ["document_id"]
    rows = with_running_sum(line_up(p.withColumn("_one", F.lit(1).cast("long")), "review_id", order), "review_id", order, "_one", "row_no", inclusive=False)
    at = F.col("row_no").cast("string")
    cells_ = [F.concat(F.coalesce(F.col(str(i)), F.lit("(pending)")), F.lit(f" [[COL:{i}||ROW:"), at, F.lit("]]")) for i in _COLUMNS]
    lines = rows.select("review_id", "row_no", F.concat(F.lit("| ROW:"), at, F.lit(" "), "document_id", F.lit(" | "), F.concat_ws(" | ", *cells_), F.lit(" |")).alias("line"))
    reviews = p.select("review_id").distinct()
    heads = [reviews.select("review_id", F.lit(n).cast("long").alias("row_no"), F.lit(text).alias("line")) for n, text in ((-2, "| Document | " + " | ".join(f"C{i}" for i in _COLUMNS) + " |"), (-1, "|---|" + "|".join(["---"] * 9) + "|"))]
    return lines.unionByName(heads[0]).unionByName(heads[1])


@R.add()
def payload_masks(spark, d):
    """Payloads of the log with every string in them masked."""
    from docketspark.functions.masking import mask_payloads

    return mask_payloads(table(spark, d, "audit_log").select("id", "payload").distinct(), "id", "payload", "masked").distinct()


@R.add(
    """WITH RECURSIVE d AS (SELECT substring(ts, 1, 10) AS block, list(hash ORDER BY id) AS h FROM (SELECT DISTINCT id, ts, hash FROM audit_log) GROUP BY 1),
m AS (SELECT block, len(h) AS n, h FROM d UNION ALL SELECT block, n, list_transform(range(1, CAST((len(h) + 1) // 2 AS BIGINT) + 1), lambda i: sha256(h[2 * i - 1] || coalesce(h[2 * i], h[2 * i - 1]))) FROM m WHERE len(h) > 1)
SELECT block, CAST(n AS BIGINT) AS n, h[1] AS root FROM m WHERE len(h) = 1"""
)
def merkle_day_roots(spark, d):
    return ledger.merkle_roots(log(spark, d, "ts", "hash").withColumn("day", F.substring("ts", 1, 10)), "day", "id", "hash")


@R.add(
    """SELECT lang, list_aggregate(list_sort(list(DISTINCT doc_type)), 'string_agg', ',') AS kinds, CAST(count(*) AS BIGINT) AS n, round(avg(n_chars), 4) AS mean_chars FROM (SELECT lower(substring(lang, 1, 2)) AS lang, doc_type, n_chars FROM documents WHERE doc_type IS NOT NULL) GROUP BY lang"""
)
def corpus_profile(spark, d):
    r = table(spark, d, "documents").where("doc_type IS NOT NULL").select(F.lower(F.substring("lang", 1, 2)).alias("lang"), "doc_type", "n_chars")
    return r.groupBy("lang").agg(F.array_join(F.sort_array(F.collect_set("doc_type")), ",").alias("kinds"), F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


@R.add(
    """WITH h AS (SELECT DISTINCT hit_id, lower(trim(document_id, ' \t')) AS document_id, score FROM feed_passage_hits)
SELECT h.hit_id, d.doc_id, coalesce(d.doc_type, '-') AS label, coalesce(f.name, '-') AS folder FROM h LEFT JOIN (SELECT lower(trim(document_id, ' \t')) AS document_id, doc_id, doc_type, folder_id FROM documents) d USING (document_id)
LEFT JOIN (SELECT id, name FROM (SELECT lower(trim(id, ' \t')) AS id, name, row_number() OVER (PARTITION BY lower(trim(id, ' \t')) ORDER BY updated_at DESC, name DESC) rn FROM project_subfolders) WHERE rn = 1) f ON f.id = d.folder_id"""
)
def hit_enrichment(spark, d):
    folders = table(spark, d, "project_subfolders").groupBy(clean_id("id").alias("folder_id")).agg(F.max(F.struct("updated_at", "name")).alias("m")).select("folder_id", "m.name")
    docs = table(spark, d, "documents").select(clean_id("document_id").alias("document_id"), "doc_id", "doc_type", "folder_id").join(folders, "folder_id", "left")
    hits = table(spark, d, "feed_passage_hits").select("hit_id", clean_id("document_id").alias("document_id"), "score").distinct()
    return hits.join(docs, "document_id", "left").select("hit_id", "doc_id", F.coalesce("doc_type", F.lit("-")).alias("label"), F.coalesce("name", F.lit("-")).alias("folder"))


@R.add("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_1h(spark, d):
    w = table(spark, d, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n", "total")


@R.add("SELECT strftime(b - to_minutes(15 * k), '%Y-%m-%d %H:%M:%S') AS start, CAST(count(*) AS BIGINT) AS n FROM (SELECT time_bucket(INTERVAL 15 MINUTES, ts) AS b, unnest([0, 1, 2, 3]) AS k FROM events) GROUP BY 1")
def sliding_1h_15m(spark, d):
    w = table(spark, d, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour", "15 minutes").alias("w")).agg(F.count("*").alias("n"))
    return w.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@R.add(
    """WITH s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS no FROM (SELECT user_id, ts, event_id, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events))
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, no"""
)
def session_30m(spark, d):
    w = table(spark, d, "events").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return w.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("started"), "n")


@R.add("SELECT event_id, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_error FROM events")
def last_error_before(spark, d):
    order = ["ts", "event_id"]
    lined = line_up(table(spark, d, "events").select("event_type", *order), None, order)
    return with_last_seen(lined, None, order, F.when(F.col("event_type") == "error", F.col("event_id")), "last_error").select("event_id", "last_error")


@R.add("SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, CAST(count(DISTINCT user_id) AS BIGINT) AS users FROM events GROUP BY 1")
def value_stats(spark, d):
    e = table(spark, d, "events").groupBy("event_type")
    return e.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd"), F.countDistinct("user_id").alias("users"))


@R.add("SELECT event_type, sorted[CAST(floor(len(sorted) * 0.95) AS BIGINT) + 1] AS p95 FROM (SELECT event_type, list_sort(list(value)) AS sorted FROM events GROUP BY 1)")
def latency_p95(spark, d):
    """Value at position floor(n * 0.95) of the sorted values: counts by value, then a running sum, no list per key."""
    e = table(spark, d, "events").select("event_type", "value").where("value IS NOT NULL")
    per = e.groupBy("event_type", "value").agg(F.count("*").alias("c"))
    n = e.groupBy("event_type").agg(F.floor(F.count("*") * 0.95).alias("at"))
    upto = with_running_sum(line_up(per, "event_type", ["value"]), "event_type", ["value"], "c", "upto")
    reached = upto.join(n, "event_type").where("upto > at")
    return reached.groupBy("event_type").agg(F.min("value").alias("p95"))


@R.add("SELECT 'events_total{type=\"' || event_type || '\"} ' || CAST(count(*) AS VARCHAR) AS line FROM events GROUP BY event_type")
def metrics_text(spark, d):
    n = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return n.select(F.format_string('events_total{type="%s"} %d', "event_type", "n").alias("line"))
