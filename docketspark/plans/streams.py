"""Structured-streaming twins of window queries, and pseudonyms over conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketspark.functions.ids import clean_id
from docketspark.operators.pseudonym import residue, wrap
from docketspark.plans.registry import Registry, table
from docketspark.session import cut
from docketspark.streaming import windows as st

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle


@R.add("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def stream_tumbling_1h(spark, d):
    out = st.run_to_end(st.windowed(st.stream_table(spark, f"{d}/events.parquet"), "ts", ["event_type"], "1 hour"), "tumbling")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@R.add("SELECT strftime(b - to_minutes(15 * k), '%Y-%m-%d %H:%M:%S') AS start, CAST(count(*) AS BIGINT) AS n FROM (SELECT time_bucket(INTERVAL 15 MINUTES, ts) AS b, unnest([0, 1, 2, 3]) AS k FROM events) GROUP BY 1")
def stream_sliding_1h_15m(spark, d):
    out = st.run_to_end(st.windowed(st.stream_table(spark, f"{d}/events.parquet"), "ts", [], "1 hour", "15 minutes"), "sliding")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@R.add("SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT user_id) AS BIGINT) AS users FROM (SELECT DISTINCT event_id, user_id, event_type FROM events) GROUP BY 1")
def stream_dedup(spark, d):
    out = st.run_to_end(st.first_seen(st.stream_table(spark, f"{d}/events.parquet"), "ts", ["event_id"]).select("event_id", "user_id", "event_type"), "dedup", "append")
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@R.add("SELECT CAST(n_regionkey AS INTEGER) AS n_regionkey, CAST(count(*) AS BIGINT) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def stream_static_join(spark, d):
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    joined = st.enrich(st.stream_table(spark, f"{d}/customer.parquet"), nation, "c_nationkey")
    return st.run_to_end(joined.groupBy("n_regionkey").agg(F.count("*").alias("n")), "join")


def _messages(spark, d):
    c = table(spark, d, "chat_messages").where("content IS NOT NULL")
    rows = c.groupBy(clean_id("id").alias("row_id")).agg(F.max(F.struct(clean_id("chat_id").alias("conv_id"), F.col("created_at").alias("seq"), F.col("content").alias("text"))).alias("m"))
    return rows.select("row_id", "m.conv_id", "m.seq", "m.text")


@R.add()
def pseudonymised_chats(spark, d):
    """Messages with the private values of their conversations replaced by tokens."""
    return wrap(_messages(spark, d))[0]


@R.add("SELECT CAST(count(DISTINCT lower(trim(id, ' \t'))) AS BIGINT) AS rows, CAST(count(DISTINCT CASE WHEN chat_id IS NULL THEN lower(trim(id, ' \t')) END) AS BIGINT) AS alone, CAST(0 AS BIGINT) AS leaks FROM chat_messages WHERE content IS NOT NULL")
def pseudonym_leaks(spark, d):
    """Originals that are left in the pseudonymised messages; rows without a conversation are counted apart."""
    wrapped, tokens = wrap(_messages(spark, d))
    wrapped = cut(wrapped)
    left = residue(wrapped, tokens).count()
    return wrapped.agg(F.count("*").alias("rows"), F.count_if(F.col("conv_id").isNull()).alias("alone"), F.lit(left).cast("long").alias("leaks"))
