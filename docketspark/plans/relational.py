"""Query-builder, join, aggregate, window, set and sink coverage over the star schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketspark.operators.ordered import line_up, with_lag, with_last_seen, with_lead, with_preceding, with_running_sum
from docketspark.operators.query import Query, union_first
from docketspark.operators.records import anonymise, propose_edges, purge, ratify_edges, receipt, split_by_reason, visible_edges
from docketspark.plans.registry import small_list
from docketspark.sources.tables import delete_rows, insert_rows, pivot_grid, update_rows, upsert_rows

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long(c) -> F.Column:
    return c.cast("long")


@register(
    """SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders
WHERE o_orderstatus <> 'P' AND o_totalprice >= 1000 AND o_totalprice < 200000 AND o_orderpriority IN ('1-URGENT', '2-HIGH', 'HIGH', 'URGENT', '5-LOW')
  AND o_orderdate IS NOT NULL AND o_orderpriority ILIKE '%-%'"""
)
def qb_filters(spark, d):
    q = Query(t(spark, d, "orders")).select("o_orderkey, o_custkey, o_totalprice, o_orderpriority")
    q = q.neq("o_orderstatus", "P").gte("o_totalprice", 1000).lt("o_totalprice", 200000)
    return q.in_("o_orderpriority", ["1-URGENT", "2-HIGH", "HIGH", "URGENT", "5-LOW"]).not_is("o_orderdate", None).ilike("o_orderpriority", "%-%").frame()


@register("SELECT c_custkey, c_mktsegment FROM customer WHERE c_nationkey >= 5 AND (c_mktsegment = 'BUILDING' OR c_mktsegment IN ('MACHINERY', 'FURNITURE') OR c_name IS NULL)")
def qb_or_expr(spark, d):
    return Query(t(spark, d, "customer")).select("c_custkey", "c_mktsegment").gte("c_nationkey", 5).or_("c_mktsegment.eq.BUILDING,c_mktsegment.in.(MACHINERY,FURNITURE),c_name.is.null,bad").frame()


@register("SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1 HAVING bool_or(event_type = 'click') AND bool_or(event_type = 'purchase')")
def qb_contains(spark, d):
    per = t(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("types"), F.count("*").alias("n"))
    return Query(per).select("user_id", "n").cs("types", ["click", "purchase"]).frame()


@register("SELECT event_id, event_type FROM events WHERE event_id < 9000 ORDER BY event_id DESC LIMIT 50")
def qb_page_keyset(spark, d):
    return Query(t(spark, d, "events")).select("event_id", "event_type").page_after("event_id", 9000, 50).frame()


@register("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 20")
def qb_range(spark, d):
    return Query(t(spark, d, "orders")).select("o_orderkey", "o_totalprice").order("o_totalprice", False).order("o_orderkey").range(20, 39).frame()


@register("SELECT CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 10")
def qb_count(spark, d):
    return Query(t(spark, d, "lineitem")).eq("l_returnflag", "R").gt("l_quantity", 10).matching().agg(F.count("*").alias("n"))


@register("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), '7') OR contains(lower(p_type), 'steel')")
def qb_text_search(spark, d):
    return Query(t(spark, d, "part")).select("p_partkey", "p_name").search(" STEEL", "p_type").frame().unionByName(
        Query(t(spark, d, "part")).select("p_partkey", "p_name").search("7", "p_name").frame()
    ).distinct()


@register("""WITH u AS (SELECT s_nationkey AS k, 0 AS src, s_name AS name FROM supplier UNION ALL SELECT c_nationkey, 1, c_name FROM customer),
r AS (SELECT k, name, row_number() OVER (PARTITION BY k ORDER BY src, name) AS rn FROM u) SELECT k AS nationkey, name FROM r WHERE rn = 1""")
def union_distinct_first(spark, d):
    a = t(spark, d, "supplier").select(F.col("s_nationkey").alias("nationkey"), F.col("s_name").alias("name"))
    b = t(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey"), F.col("c_name").alias("name"))
    return union_first([a, b], "nationkey")


@register("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_pending(spark, d):
    return t(spark, d, "customer").join(t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@register("SELECT text, CAST(count(*) AS BIGINT) AS n, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def dup_keys(spark, d):
    # only digests are shuffled; the text of a group is read again from its first row
    docs = t(spark, d, "documents").where("text IS NOT NULL")
    groups = docs.groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")
    return groups.join(docs.select(F.col("doc_id").alias("first_doc"), "text"), "first_doc").select("text", "n", "first_doc")


@register(
    """SELECT c.c_custkey, CAST(coalesce(o.n, 0) AS BIGINT) AS n_orders, CAST(coalesce(l.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(s.n, 0) AS BIGINT) AS n_local_suppliers
FROM customer c LEFT JOIN (SELECT o_custkey, count(*) n FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey
LEFT JOIN (SELECT o_custkey, count(*) n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) l ON l.o_custkey = c.c_custkey
LEFT JOIN (SELECT s_nationkey, count(*) n FROM supplier GROUP BY 1) s ON s.s_nationkey = c.c_nationkey"""
)
def child_counts(spark, d):
    # lines are counted per order first, so the big table shuffles once and one row an order goes on
    lines = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))
    per = t(spark, d, "orders").select("o_orderkey", "o_custkey").join(lines, "o_orderkey", "left").groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.coalesce(F.sum("lines"), F.lit(0)).alias("n_lines"))
    near = t(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n_local_suppliers"))
    c = t(spark, d, "customer").select("c_custkey", "c_nationkey")
    return (
        c.join(per, c.c_custkey == per.o_custkey, "left").join(near, c.c_nationkey == near.s_nationkey, "left")
        .select("c_custkey", *(long(F.coalesce(x, F.lit(0))).alias(x) for x in ("n_orders", "n_lines", "n_local_suppliers")))
    )


@register("SELECT s_suppkey, s_name, coalesce(n_name, '-') AS nation, coalesce(r_name, '-') AS region, r_name IS NULL AS unplaced FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_regionkey > 0 LEFT JOIN region ON r_regionkey = n_regionkey")
def left_enrich(spark, d):
    n = t(spark, d, "nation").where("n_regionkey > 0").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return t(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(
        "s_suppkey", "s_name", F.coalesce("n_name", F.lit("-")).alias("nation"), F.coalesce("r_name", F.lit("-")).alias("region"), F.col("r_name").isNull().alias("unplaced")
    )


@register("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_per_key(spark, d):
    # max over a struct is a partial aggregate: no sort, and a hot user folds before the shuffle
    best = t(spark, d, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type", "value")).alias("m"))
    return best.select("user_id", "m.event_id", "m.event_type", "m.value")


@register(
    """SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_custkey IN (SELECT c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2)"""
)
def access_semi_or(spark, d):
    shared = t(spark, d, "customer").join(t(spark, d, "nation").where("n_regionkey = 2"), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("open"))
    return t(spark, d, "orders").join(shared, "o_custkey", "left").where("o_orderstatus = 'F' OR open").select("o_orderkey")


@register(
    """WITH RECURSIVE e AS (SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS parent, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name FROM supplier),
w AS (SELECT id, name AS path, 0 AS depth FROM e WHERE parent IS NULL UNION ALL SELECT e.id, w.path || ' / ' || e.name, depth + 1 FROM w JOIN e ON e.parent = w.id) SELECT id, path, CAST(depth AS INTEGER) AS depth FROM w"""
)
def tree_path(spark, d):
    from docketspark.operators.hierarchy import build_hierarchy

    def tag(df, p, key, q, parent, name):
        up = F.concat(F.lit(q), F.col(parent)) if parent else F.lit(None).cast("string")
        return df.select(F.concat(F.lit(p), F.col(key)).alias("node_id"), up.alias("parent_id"), F.col(name).alias("name"))

    nodes = tag(t(spark, d, "region"), "r", "r_regionkey", "", None, "r_name").unionByName(tag(t(spark, d, "nation"), "n", "n_nationkey", "r", "n_regionkey", "n_name")).unionByName(tag(t(spark, d, "supplier"), "s", "s_suppkey", "n", "s_nationkey", "s_name"))
    h = build_hierarchy(nodes.select("node_id", "parent_id")).nodes
    steps = h.select("node_id", "depth", F.posexplode("path").alias("pos", "step")).join(nodes.select(F.col("node_id").alias("step"), "name"), "step")
    named = steps.groupBy("node_id", "depth").agg(F.sort_array(F.collect_list(F.struct("pos", "name"))).alias("p"))
    return named.select(F.col("node_id").alias("id"), F.array_join(F.col("p.name"), " / ").alias("path"), "depth")


@register("SELECT n_nationkey, r_regionkey, n_regionkey = r_regionkey AS own FROM nation CROSS JOIN region")
def grid_cross(spark, d):
    # the columns of a grid are a small configuration: one array, exploded per row, instead of a product of tables
    columns = F.array(*map(F.lit, small_list(t(spark, d, "region"), "r_regionkey")))
    grid = t(spark, d, "nation").select("n_nationkey", "n_regionkey", F.explode(columns).alias("r_regionkey"))
    return grid.select("n_nationkey", "r_regionkey", (F.col("n_regionkey") == F.col("r_regionkey")).alias("own"))


@register("SELECT l_returnflag, CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS f, CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS o FROM lineitem GROUP BY 1")
def pivot_status(spark, d):
    p = pivot_grid(t(spark, d, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"], F.count(F.lit(1)))
    return p.select("l_returnflag", long(F.coalesce("F", F.lit(0))).alias("f"), long(F.coalesce("O", F.lit(0))).alias("o"))


_ROLL = "round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY "


def _sales(df):
    return df.agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@register("SELECT l_returnflag, l_linestatus, " + _ROLL + "ROLLUP (l_returnflag, l_linestatus)")
def rollup_sales(spark, d):
    return _sales(t(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus"))


@register("SELECT l_returnflag, l_linestatus, " + _ROLL + "CUBE (l_returnflag, l_linestatus)")
def cube_sales(spark, d):
    return _sales(t(spark, d, "lineitem").cube("l_returnflag", "l_linestatus"))


@register("SELECT l_returnflag, l_linestatus, l_linenumber, " + _ROLL + "GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber))")
def grouping_sets(spark, d):
    sets = t(spark, d, "lineitem").groupingSets([["l_returnflag", "l_linestatus"], ["l_linenumber"]], "l_returnflag", "l_linestatus", "l_linenumber")
    return _sales(sets)


@register(
    """SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER p AS BIGINT) AS rk, CAST(dense_rank() OVER p AS BIGINT) AS dr, CAST(ntile(4) OVER w AS BIGINT) AS q, round(percent_rank() OVER p, 6) AS pr
FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey), p AS (PARTITION BY o_orderpriority ORDER BY o_orderstatus)"""
)
def rank_family(spark, d):
    """Ranks from counts: one running count over partition edges, and the small table of counts by (key, value)."""
    o = t(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", (-F.col("o_totalprice")).alias("neg"), F.lit(1).cast("long").alias("one"))
    order = ["neg", "o_orderkey"]
    counted = with_running_sum(line_up(o, "o_orderpriority", order), "o_orderpriority", order, "one", "rn")
    per = o.groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("c"))
    up = Window.partitionBy("o_orderpriority").orderBy("o_orderstatus")
    whole = Window.partitionBy("o_orderpriority")
    ranks = per.select("o_orderpriority", "o_orderstatus", (F.sum("c").over(up) - F.col("c") + 1).alias("rk"), long(F.row_number().over(up)).alias("dr"), F.sum("c").over(whole).alias("n"))
    j = counted.join(ranks, ["o_orderpriority", "o_orderstatus"])
    b, r = F.floor(F.col("n") / 4), F.col("n") % 4
    wide = r * (b + 1)
    tile = F.when(F.col("rn") <= wide, F.floor((F.col("rn") - 1) / (b + 1)) + 1).otherwise(r + F.floor((F.col("rn") - 1 - wide) / F.greatest(b, F.lit(1))) + 1)
    pr = F.when(F.col("n") == 1, 0.0).otherwise((F.col("rk") - 1) / (F.col("n") - 1))
    return j.select("o_orderkey", long(F.col("rn")).alias("rn"), long(F.col("rk")).alias("rk"), "dr", long(tile).alias("q"), F.round(pr, 6).alias("pr"))


@register(
    """SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS moving, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS running,
lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_type FROM events"""
)
def rows_frame(spark, d):
    order = ["ts", "event_id"]
    lined = line_up(t(spark, d, "events").select("user_id", "value", "event_type", *order), "user_id", order)
    out = with_preceding(lined, "user_id", order, F.col("value"), 3, "three")
    out = with_lead(with_running_sum(out, "user_id", order, "value", "running"), "user_id", order, F.col("event_type"), "next_type")
    all4 = F.concat("three", F.filter(F.array("value"), lambda x: x.isNotNull()))
    mean = F.aggregate(all4, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(all4), F.lit(0))
    return out.select("event_id", F.round(mean, 6).alias("moving"), F.round("running", 4).alias("running"), "next_type")


@register("SELECT event_id, CAST(count(*) OVER (PARTITION BY event_type ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS BIGINT) AS last_hour FROM (SELECT event_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)")
def range_frame(spark, d):
    """Events of the type in the hour before: counted by second first, so the window meets seconds, not events."""
    secs = F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp")))
    e = t(spark, d, "events").select("event_id", "event_type", secs.alias("secs"))
    per = e.groupBy("event_type", "secs").agg(F.count("*").alias("c"))
    w = Window.partitionBy("event_type").orderBy("secs").rangeBetween(-3600, 0)
    return e.join(per.select("event_type", "secs", F.sum("c").over(w).alias("last_hour")), ["event_type", "secs"]).select("event_id", "last_hour")


@register(
    """(SELECT c_nationkey AS k, 'both' AS kind FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier)
UNION ALL (SELECT o_custkey, 'idle' FROM (SELECT c_custkey AS o_custkey FROM customer EXCEPT SELECT o_custkey FROM orders))"""
)
def intersect_except(spark, d):
    both = t(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(t(spark, d, "supplier").select("s_nationkey"))
    idle = t(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(t(spark, d, "orders").select("o_custkey"))
    return both.select(long(F.col("k")).alias("k"), F.lit("both").alias("kind")).unionByName(idle.select("k", F.lit("idle").alias("kind")))


@register(
    """SELECT p.event_id, b.event_id AS click_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY 1, 2) b ON p.user_id = b.user_id AND p.ts >= b.ts"""
)
def asof_prev_event(spark, d):
    # as-of join without a range join: both sides in one sorted pass, the last click carried forward
    e = t(spark, d, "events").where("event_type IN ('click', 'purchase')").withColumn("side", F.when(F.col("event_type") == "click", 0).otherwise(1))
    order = ["ts", "side", "event_id"]
    lined = line_up(e.select("user_id", *order), "user_id", order)
    seen = with_last_seen(lined, "user_id", order, F.when(F.col("side") == 0, F.col("event_id")), "click_id")
    return seen.where("side = 1").select("event_id", "click_id")


@register(
    """WITH s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS no FROM (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= ts - INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events))
SELECT user_id, CAST(no AS BIGINT) AS no, CAST(count(*) AS BIGINT) AS n, min(event_id) AS first_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started FROM s GROUP BY 1, 2"""
)
def gap_sessions(spark, d):
    order = ["ts", "event_id"]
    lined = with_lag(line_up(t(spark, d, "events").select("user_id", *order), "user_id", order), "user_id", order, F.col("ts"), "before")
    new = F.when(F.col("before") >= F.col("ts") - F.expr("INTERVAL 6 HOURS"), 0).otherwise(1)
    s = with_running_sum(lined.withColumn("new", new), "user_id", order, "new", "no")
    return s.groupBy("user_id", "no").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("started"))


@register("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey <> 1 AND n_nationkey NOT IN (3, 4) UNION ALL SELECT n_nationkey, upper(n_name), 9 FROM nation WHERE n_nationkey IN (3, 4) UNION ALL SELECT 100 + r_regionkey, r_name, NULL FROM region")
def sink_dml(spark, d):
    n = t(spark, d, "nation")
    kept = delete_rows(n, (F.col("n_regionkey") == 1) & ~F.col("n_nationkey").isin(3, 4))
    moved = update_rows(kept, F.col("n_nationkey").isin(3, 4), {"n_regionkey": F.lit(9), "n_name": F.upper("n_name")})
    return insert_rows(moved, t(spark, d, "region").select((F.col("r_regionkey") + 100).alias("n_nationkey"), F.col("r_name").alias("n_name"), F.lit(1).alias("extra")))


@register(
    """SELECT coalesce(s_suppkey, c_custkey) AS s_suppkey, coalesce(s_name, c_name) AS s_name, CASE WHEN c_custkey IS NOT NULL THEN c_nationkey ELSE s_nationkey END AS s_nationkey
FROM supplier FULL OUTER JOIN customer ON c_custkey = s_suppkey"""
)
def sink_upsert(spark, d):
    new = t(spark, d, "customer").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_name").alias("s_name"), F.col("c_nationkey").alias("s_nationkey"))
    return upsert_rows(t(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), new, ["s_suppkey"], keep=("s_name",))


@register(
    """WITH gone AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal < 0), o AS (SELECT o_orderkey AS k FROM orders WHERE o_custkey IN (SELECT k FROM gone)),
x AS (SELECT 'lineitem' AS kind, l_orderkey IN (SELECT k FROM o) AS g FROM lineitem UNION ALL SELECT 'orders', o_custkey IN (SELECT k FROM gone) FROM orders UNION ALL SELECT 'customer', c_custkey IN (SELECT k FROM gone) FROM customer)
SELECT kind, CAST(count(*) FILTER (NOT g) AS BIGINT) AS kept, CAST(count(*) FILTER (g) AS BIGINT) AS purged, CAST(count(*) FILTER (NOT g) AS BIGINT) AS after FROM x GROUP BY kind"""
)
def case_purge(spark, d):
    """Customers in debt are purged with their orders and lines; the report is held against what the purged tables hold."""
    gone = t(spark, d, "customer").where("c_acctbal < 0").select("c_custkey")
    orders, lines, customers = t(spark, d, "orders"), t(spark, d, "lineitem"), t(spark, d, "customer")
    orders_gone = orders.join(gone, orders.o_custkey == gone.c_custkey, "left_semi").select("o_orderkey")
    a, first = purge({"lineitem": (lines.select("l_orderkey", "l_linenumber"), "l_orderkey")}, orders_gone)
    b, second = purge({"orders": (orders.select("o_orderkey", "o_custkey"), "o_custkey"), "customer": (customers.select("c_custkey"), "c_custkey")}, gone)
    left = [df.agg(F.count("*").alias("after")).select(F.lit(n).alias("kind"), "after") for n, df in {**a, **b}.items()]
    return first.unionByName(second).join(reduce(DataFrame.unionByName, left), "kind").select("kind", "kept", "purged", "after")


@register(
    """SELECT o_custkey AS subject, 'orders' AS section, '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}' AS record FROM orders
UNION ALL SELECT o_custkey, 'lines', '{"l_orderkey":' || l_orderkey || ',"l_linenumber":' || l_linenumber || ',"l_returnflag":"' || l_returnflag || '"}' FROM lineitem JOIN orders ON o_orderkey = l_orderkey
UNION ALL SELECT c_custkey, 'profile', '{"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}' FROM customer"""
)
def subject_export(spark, d):
    """Everything held about each subject, a record a row; a subject's rows make its pack, whatever their number."""
    o = t(spark, d, "orders")
    parts = [
        o.select(F.col("o_custkey").alias("subject"), F.lit("orders").alias("section"), F.to_json(F.struct("o_orderkey", "o_orderstatus")).alias("record")),
        t(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("subject"), F.lit("lines").alias("section"), F.to_json(F.struct("l_orderkey", "l_linenumber", "l_returnflag")).alias("record")),
        t(spark, d, "customer").select(F.col("c_custkey").alias("subject"), F.lit("profile").alias("section"), F.to_json(F.struct("c_name", "c_nationkey")).alias("record")),
    ]
    return reduce(DataFrame.unionByName, parts)


@register(
    """WITH u AS (SELECT max(actor_user_id) AS u FROM audit_log), l AS (SELECT DISTINCT id, actor_user_id, event_type FROM audit_log)
SELECT event_type, CAST(count(*) AS BIGINT) AS events, CAST(count(*) FILTER (actor_user_id = u.u) AS BIGINT) AS erased, CAST(count(*) FILTER (actor_user_id IS NULL OR actor_user_id = u.u) AS BIGINT) AS nobody, max(substring(sha256(u.u), 1, 16)) AS receipt FROM l, u GROUP BY 1"""
)
def subject_erasure(spark, d):
    """The log without one user: its rows stay, and the receipt names the user by a digest."""
    log = t(spark, d, "audit_log").select("id", "actor_user_id", "event_type").distinct()
    user = log.agg(F.max("actor_user_id")).first()[0]
    both = log.withColumn("was", F.col("actor_user_id"))
    done = anonymise(both, "actor_user_id", user) if user is not None else both
    return done.groupBy("event_type").agg(F.count("*").alias("events"), F.count_if(F.col("actor_user_id").isNull() & F.col("was").isNotNull()).alias("erased"), F.count_if(F.col("actor_user_id").isNull()).alias("nobody"), F.first(receipt(F.lit(user))).alias("receipt"))


@register(
    """WITH e AS (SELECT p_partkey AS id, lower(regexp_replace(p_type, ' .*', '')) || CASE WHEN p_partkey % 11 = 0 THEN '!' ELSE '' END AS label, CASE p_partkey % 4 WHEN 0 THEN ' ' ELSE 'run' || (p_partkey % 3) END AS run FROM part)
SELECT id, label, CASE WHEN id % 5 = 0 OR id % 4 = 0 THEN NULL ELSE run END AS run, CASE WHEN id % 5 = 0 THEN 'ratified' ELSE 'proposed' END AS status FROM e WHERE regexp_full_match(label, '[a-z][a-z0-9_]{0,63}') AND (id % 5 = 0 OR id % 4 = 0 OR run = 'run1')"""
)
def edge_life(spark, d):
    """Edges proposed, some ratified by a human, and those that run1 sees."""
    label = F.concat(F.lower(F.regexp_replace("p_type", " .*", "")), F.when(F.col("p_partkey") % 11 == 0, "!").otherwise(""))
    run = F.when(F.col("p_partkey") % 4 == 0, " ").otherwise(F.concat(F.lit("run"), (F.col("p_partkey") % 3).cast("string")))
    proposed = propose_edges(t(spark, d, "part").select(F.col("p_partkey").alias("id"), label.alias("label"), run.alias("run")))
    return visible_edges(ratify_edges(proposed, F.col("id") % 5 == 0, F.lit("human")), "run1").select("id", "label", "run", "status")


@register(
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_totalprice > 300000 THEN 'too large' WHEN o_custkey % 10 = 0 THEN 'blocked customer' END AS reason FROM orders"""
)
def split_by_reasons(spark, d):
    return split_by_reason(t(spark, d, "orders"), {"pending": F.col("o_orderstatus") == "P", "too large": F.col("o_totalprice") > 300000, "blocked customer": F.col("o_custkey") % 10 == 0}).select("o_orderkey", "reason")
