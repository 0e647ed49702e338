"""The pN_ queries of the text problems over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketspark.functions.ids import clean_id
from docketspark.llm.canonical import canonical_column, look_alike_classes, look_alike_pairs
from docketspark.llm.conversations import ASSISTANT_NAMES, OTHER_NAMES, USER_NAMES, conversations, fold_events, question_replies, with_text
from docketspark.llm.packing import pack
from docketspark.llm.pii import count_leaks, find_pii, mask_pii
from docketspark.llm.splitting import classify_texts, plan_split, running_numbers, split_files
from docketspark.llm.tokenizer import count_tokens, decode_ids, encode_corpus
from docketspark.session import cut, scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _limit(spark: SparkSession, sf_dir: str, name: str) -> tuple[int, int]:
    """(capacity, overlap) of a named limit; the table has one row a name."""
    row = _table(spark, sf_dir, "size_limits").where(F.col("limit_name") == name).select("capacity", "overlap").first()
    return row[0], row[1]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chat, feed = _table(spark, sf_dir, "chat_messages"), _table(spark, sf_dir, "feed_passage_hits")
    return find_pii(chat, "chat_messages", "id", "content", True).unionByName(find_pii(feed, "feed_passage_hits", "hit_id", "text"))


def p2_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    chat = mask_pii(_table(spark, sf_dir, "chat_messages"), "id", "content", "masked", True).withColumn("src", F.lit("chat_messages"))
    feed = mask_pii(_table(spark, sf_dir, "feed_passage_hits"), "hit_id", "text", "masked").withColumn("src", F.lit("feed_passage_hits"))
    return chat.select("src", clean_id("id").alias("row_id"), "masked").unionByName(feed.select("src", clean_id("hit_id").alias("row_id"), "masked"))


def p2_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that are left in the masked texts of each table, split and twice encoded ones included."""
    masked = p2_masked(spark, sf_dir)
    parts = (count_leaks(masked.where(F.col("src") == src), "masked", is_message).withColumn("src", F.lit(src)) for src, is_message in (("chat_messages", True), ("feed_passage_hits", False)))
    a, b = parts
    return a.unionByName(b)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacity, _ = _limit(spark, sf_dir, "passage")
    return classify_texts(_table(spark, sf_dir, "feed_passage_hits"), "hit_id", "text", capacity)


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every passage, numbered on within a document in chunk_index order."""
    capacity, overlap = _limit(spark, sf_dir, "passage")
    hits = _table(spark, sf_dir, "feed_passage_hits")
    plan = plan_split(hits, "hit_id", "text", capacity, overlap)
    places = hits.groupBy("hit_id").agg(F.max(F.struct(clean_id("document_id").alias("document_id"), "chunk_index")).alias("p"))
    per = places.join(plan.counts().withColumnRenamed("_key", "hit_id"), "hit_id").select("p.*", "hit_id", "pieces")
    numbers = running_numbers(per, "document_id", ["chunk_index", "hit_id"], "pieces").select(F.col("hit_id").alias("_key"), "document_id", "chunk_index", "before")
    return plan.pieces(numbers).select(
        "document_id", "chunk_index", F.col("_key").alias("hit_id"), (F.col("before") + F.col("piece")).alias("piece_no"), "piece_start", "piece_end", "piece_text"
    )


def p3_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of text files, by byte ranges: the corpus is written as files first, one a partition."""
    capacity, overlap = _limit(spark, sf_dir, "passage")
    path = scratch(spark, "files")
    _table(spark, sf_dir, "documents").where("text IS NOT NULL").select("text").write.text(path)
    pieces = split_files(spark, [path], capacity, overlap, size=1 << 18)
    return pieces.select(F.regexp_extract("path", r"part-(\d+)", 1).alias("file"), "piece", "byte_start", "byte_end", "piece_text")


def p5_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(fold_events(_table(spark, sf_dir, "chat_messages")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return question_replies(p5_turns(spark, sf_dir))


def p5_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of kept conversations with their texts."""
    messages = _table(spark, sf_dir, "chat_messages")
    return with_text(conversations(fold_events(messages)), messages).select("chat_id", "message_id", "speaker", "text")


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each text as its ids give it back."""
    return decode_ids(p6_ids(spark, sf_dir), "ids", "text").select("doc_id", F.md5("text").alias("digest"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(_table(spark, sf_dir, "documents"), ["doc_id"])


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = count_tokens(_table(spark, sf_dir, "documents"), ["doc_id"])
    capacity, _ = _limit(spark, sf_dir, "context")
    return pack(sizes, "n_tokens", ["doc_id"], capacity)


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a packing must hold to: every item whole or rightly divided, no container over, no overlap, and near the lower bound."""
    capacity, _ = _limit(spark, sf_dir, "context")
    sizes = cut(count_tokens(_table(spark, sf_dir, "documents"), ["doc_id"]))
    placed = cut(pack(sizes, "n_tokens", ["doc_id"], capacity))
    per = placed.groupBy("doc_id").agg(F.sum("piece_size").alias("got"), F.count("*").alias("pieces"))
    items = sizes.join(per, "doc_id", "left").agg(
        F.count("*").alias("items"), F.count_if(F.coalesce(F.col("got"), F.lit(-1)) != F.col("n_tokens")).alias("lost"), F.count_if((F.col("pieces") > 1) & (F.col("n_tokens") <= capacity)).alias("divided"), F.sum("n_tokens").alias("tokens")
    )
    fill = placed.where("container_id IS NOT NULL").groupBy("container_id").agg(F.sum("piece_size").alias("fill"), F.max(F.col("container_offset") + F.col("piece_size")).alias("reach"))
    full = fill.agg(F.count_if(F.col("fill") > capacity).alias("over"), F.count_if(F.col("fill") != F.col("reach")).alias("overlapping"), F.count("*").alias("containers"))
    close = F.col("containers") <= F.ceil(F.col("tokens") / capacity) * 1.01 + 1
    return items.join(full).select("items", "lost", "over", "divided", "overlapping", F.coalesce(close, F.lit(True)).alias("close"))


def p8_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_column(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "canonical").drop("text")


def p8_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_alike_classes(_table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_alike_pairs(_table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p2_found, p2_masked, p2_leaks, p3_found, p3_pieces, p3_files, p5_found, p5_turns, p5_texts, p6_ids, p6_decoded, p7_pack, p7_checks, p8_found, p8_classes, p8_canonical)}

_WS = r"\x{0009}-\x{000d}\x{0020}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_ID = "nullif(lower(regexp_replace(CAST({0} AS VARCHAR), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), '')"

_LE = r"\r\n|[\x{000a}-\x{000d}\x{0085}\x{2028}\x{2029}]"


def _last(kind: int, least: int) -> str:
    """The last boundary of at least this kind in the room of the piece after (…, e), beyond e + least; 0 if none."""
    return f"greatest(coalesce(list_max(list_filter(a{kind}, lambda v: v > e + {least} AND v <= e + 780)), 0), CASE WHEN list_contains(b{kind}, e + 780) THEN e + 780 ELSE 0 END)"


def _names(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


#: The left-to-right split as a recursive walk over lists of boundaries: paragraph (2), sentence (1) and word ends (0).
_PIECES = rf"""WITH RECURSIVE h AS (SELECT hit_id, max(text) AS t, length(max(text)) AS n FROM feed_passage_hits WHERE hit_id IS NOT NULL GROUP BY 1 HAVING max(text) IS NOT NULL),
k0 AS (SELECT hit_id, t, n, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM (SELECT *, regexp_extract_all(t, '[{_WS}]+|[^{_WS}]+') AS w FROM h WHERE n > 900)),
k1 AS (SELECT *, CAST(sum(length(x)) OVER (PARTITION BY hit_id ORDER BY i) AS BIGINT) AS p FROM k0),
k2 AS (SELECT hit_id, n, p, p - length(x) AS q, len(regexp_extract_all(right(x, 900), '{_LE}')) AS nl, len(regexp_extract_all(left(x, 8), '{_LE}')) AS nb, regexp_matches(substring(t, greatest(p - length(x) - 7, 1), least(8, p - length(x))), '[.!?…;:][''"”»)\]]*$') AS dot FROM k1 WHERE regexp_full_match(x, '[{_WS}]+')),
k3 AS (SELECT *, CASE WHEN nl > 1 THEN 2 WHEN nl = 1 OR dot AND p - q <= 900 THEN 1 ELSE 0 END AS ka, CASE WHEN nb > 1 THEN 2 WHEN nb = 1 OR dot THEN 1 ELSE 0 END AS kb FROM k2),
b AS (SELECT hit_id, {", ".join(f"list(p) FILTER (ka >= {k} AND p < n) AS a{k}, list(q) FILTER (kb >= {k} AND q > 0) AS b{k}" for k in range(3))} FROM k3 GROUP BY 1),
g AS (SELECT h.*, a0, a1, a2, b0, b1, b2 FROM h LEFT JOIN b USING (hit_id)),
r AS (SELECT hit_id, t, n, a0, a1, a2, b0, b1, b2, CAST(-1 AS BIGINT) AS piece, CAST(0 AS BIGINT) AS s, CAST(120 AS BIGINT) AS e FROM g
UNION ALL SELECT hit_id, t, n, a0, a1, a2, b0, b1, b2, piece + 1, e - 120, CASE WHEN e + 780 >= n THEN n
  WHEN {_last(2, 330)} > 0 THEN {_last(2, 330)} WHEN {_last(1, 330)} > 0 THEN {_last(1, 330)} WHEN {_last(0, 0)} > 0 THEN {_last(0, 0)}
  ELSE greatest(e + 780 - length(regexp_extract(substring(t, e + 2, 780), '\p{{M}}*$')), e + 1) END FROM r WHERE piece < 0 OR e < n),
c AS (SELECT hit_id, piece, s, e, substring(t, s + 1, e - s) AS x FROM r WHERE piece >= 0),
o AS (SELECT hit_id, max(struct_pack(d := {_ID.format('document_id')}, i := chunk_index)) AS m FROM feed_passage_hits GROUP BY 1),
m AS (SELECT hit_id, m.d AS document_id, m.i AS chunk_index, coalesce(sum(pieces) OVER (PARTITION BY m.d ORDER BY m.i NULLS FIRST, hit_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o JOIN (SELECT hit_id, count(*) AS pieces FROM c GROUP BY 1) USING (hit_id))
SELECT document_id, chunk_index, hit_id, CAST(before + piece AS BIGINT) AS piece_no, s AS piece_start, e AS piece_end, x AS piece_text FROM c JOIN m USING (hit_id)"""

#: Readable messages in order, without repeats (k), and the conversations worth keeping (g).
_P5 = rf"""WITH r AS (SELECT {_ID.format('id')} AS id, {_ID.format('chat_id')} AS chat, {_ID.format('role')} AS role, content, created_at FROM chat_messages),
a AS (SELECT DISTINCT id, chat, CASE WHEN role IN ({_names(USER_NAMES)}) THEN 'user' WHEN role IN ({_names(ASSISTANT_NAMES)}) THEN 'assistant' WHEN role IN ({_names(OTHER_NAMES)}) THEN 'other' END AS who, content, created_at,
  regexp_matches(content, '^\s*("\s*)?(\[\s*(\\n\s*)?(\{{|\]|\[|null|\\?"|$)|\{{\s*(\\n\s*)?(\\?"|\}}|$))') AS js FROM r WHERE chat IS NOT NULL AND id IS NOT NULL),
b AS (SELECT *, CASE WHEN js AND json_valid(content) THEN content::JSON ->> '$' END AS p1 FROM a WHERE who IS DISTINCT FROM 'other'),
c AS (SELECT *, CASE WHEN json_valid(p1) THEN CASE WHEN json_type(p1) = 'OBJECT' THEN '[' || p1 || ']' ELSE p1 END END AS p FROM b),
e AS (SELECT id, CAST(i AS BIGINT) AS i, p ->> ('$[' || i || '].text') AS x FROM (SELECT id, p, unnest(range(0, CAST(json_array_length(p) AS BIGINT))) AS i FROM c WHERE p IS NOT NULL) WHERE p ->> ('$[' || i || '].type') = 'content' AND json_type(p, '$[' || i || '].text') = 'VARCHAR'),
j AS (SELECT id, string_agg(x, '' ORDER BY i) AS x FROM e GROUP BY id),
m AS (SELECT c.id, chat, who, created_at AS tm, CASE WHEN NOT js THEN content WHEN p IS NOT NULL THEN coalesce(j.x, '') END AS t FROM c LEFT JOIN j ON j.id = c.id),
o AS (SELECT *, coalesce(lag(who || ':' || coalesce(t, '')) OVER w = who || ':' || coalesce(t, ''), false) AS again FROM m WINDOW w AS (PARTITION BY chat ORDER BY tm NULLS FIRST, CASE who WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END, id)),
k AS (SELECT *, lag(id) OVER w AS pid, lag(who) OVER w AS pwho FROM o WHERE NOT again WINDOW w AS (PARTITION BY chat ORDER BY tm NULLS FIRST, CASE who WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END, id)),
g AS (SELECT chat FROM k GROUP BY chat HAVING bool_and(tm IS NOT NULL AND who IS NOT NULL AND coalesce(regexp_matches(t, '[^\s\p{{Z}}\p{{Cc}}\p{{Cf}}]'), false)) AND bool_and(coalesce(CASE WHEN pid IS NULL THEN who = 'user' ELSE who <> pwho END, false)) AND count(*) % 2 = 0)
"""

ORACLE: dict[str, str] = {
    "p5_turns": _P5 + "SELECT chat AS chat_id, CAST(count(*) OVER (PARTITION BY chat) AS BIGINT) AS n_turns, id AS message_id, who AS speaker, tm AT TIME ZONE 'UTC' AS created_at, pid AS previous_id, pwho AS previous_speaker FROM k WHERE chat IN (SELECT chat FROM g)",
    "p5_texts": _P5 + "SELECT chat AS chat_id, id AS message_id, who AS speaker, t AS text FROM k WHERE chat IN (SELECT chat FROM g)",
    "p6_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
    "p7_checks": "SELECT CAST(count(*) AS BIGINT) AS items, CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS over, CAST(0 AS BIGINT) AS divided, CAST(0 AS BIGINT) AS overlapping, true AS close FROM documents",
    "p2_leaks": "SELECT 'chat_messages' AS src, CAST(count(content) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS leaks FROM chat_messages UNION ALL SELECT 'feed_passage_hits', CAST(count(text) AS BIGINT), CAST(0 AS BIGINT) FROM feed_passage_hits",
    "p3_pieces": _PIECES,
    "p3_found": rf"""WITH h AS (SELECT DISTINCT hit_id, text FROM feed_passage_hits WHERE length(text) > 900 AND regexp_matches(text, '[^{_WS}]')),
s AS (SELECT hit_id, text, regexp_replace(regexp_replace(text, '\r\n', chr(10), 'g'), '[\x{{000b}}-\x{{000d}}\x{{0085}}\x{{2028}}\x{{2029}}]', chr(10), 'g') AS t FROM h),
m AS (SELECT hit_id, list_max(list_transform(string_split_regex(t, '\n[{_WS}]*\n'), lambda p: length(regexp_replace(p, '^[{_WS}]+|[{_WS}]+$', '', 'g')))) AS par,
list_max(list_transform(string_split_regex(text, '[{_WS}]+'), lambda w: length(w))) AS word FROM s)
SELECT DISTINCT hit_id, CASE WHEN par <= 900 THEN 'paragraph' WHEN word <= 900 THEN 'word' ELSE 'hard' END AS boundary FROM m""",
    "p5_found": _P5
    + """SELECT chat AS chat_id, least(id, pid) AS message_id_a, greatest(id, pid) AS message_id_b FROM k WHERE chat IN (SELECT chat FROM g) AND who = 'assistant'""",
}
