"""The pN_ queries of the core problems over the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketspark.functions.ids import clean_id
from docketspark.operators.hierarchy import Hierarchy, build_hierarchy, latest_links, resolve_aliases
from docketspark.operators.nested import NestedTables, Shape, nested_tables


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SEP = "\u0001"  # between the table's name and the id, so that both tables are one forest


def forest(spark: SparkSession, sf_dir: str) -> Hierarchy:
    """Folders and courts as one forest; ids carry the name of their table."""
    folders = latest_links(_table(spark, sf_dir, "project_subfolders"), "id", "parent_folder_id", "updated_at")
    rows = _table(spark, sf_dir, "courts")
    aliases = (
        rows.select(clean_id("id").alias("node_id"), F.explode("aliases").alias("a"))
        .select(clean_id("a").alias("alias"), "node_id")
        .where("alias IS NOT NULL AND node_id IS NOT NULL")
    )
    courts = resolve_aliases(latest_links(rows, "id", "parent"), aliases)
    named = (
        links.select(*(F.concat(F.lit(src + _SEP), c).alias(c) for c in ("node_id", "parent_id"))) for src, links in (("folder", folders), ("court", courts))
    )
    return build_hierarchy(reduce(DataFrame.unionByName, named))


def _src(c: str) -> Column:
    return F.substring_index(c, _SEP, 1).alias("src")


def _plain(c: str) -> Column:
    return F.expr(f"substring({c}, instr({c}, '{_SEP}') + 1)").alias(c)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest(spark, sf_dir).nodes.select(_src("node_id"), _plain("node_id"), _plain("root_id"), "depth")


def p1_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest(spark, sf_dir).descendants().select(_src("node_id"), _plain("ancestor_id"), _plain("node_id"), "distance")


#: The names under which the data model keeps lists.
LIST_NAMES = frozenset(
    "findings evidence spans fallbacks attempts cells citations stages steps outputs edits annotations comments copies candidates".split()
)


def nested_sources(spark: SparkSession, sf_dir: str) -> list[NestedTables]:
    return [
        nested_tables(_table(spark, sf_dir, "audit_log"), "audit_log", "id", "payload", Shape(False, LIST_NAMES)),
        nested_tables(_table(spark, sf_dir, "chat_messages"), "chat_messages", "id", "content", Shape(True, LIST_NAMES)),
        nested_tables(_table(spark, sf_dir, "tabular_cells"), "tabular_cells", "id", "citations", Shape(True, LIST_NAMES)),
    ]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = (t.occurrences().where("in_list").select("src", "row_id", "path") for t in nested_sources(spark, sf_dir))
    return reduce(DataFrame.unionByName, parts).distinct()


def p4_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place an object stands, once: the bridge from child to parent."""
    return reduce(DataFrame.unionByName, (t.occurrences() for t in nested_sources(spark, sf_dir))).distinct()


def p4_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = reduce(DataFrame.unionByName, (t.objects() for t in nested_sources(spark, sf_dir)))
    return parts.groupBy("object_id").agg(F.first("body").alias("body"))


def p4_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(DataFrame.unionByName, (t.links() for t in nested_sources(spark, sf_dir))).distinct()


QUERIES = {
    "p1_found": p1_found,
    "p1_descendants": p1_descendants,
    "p4_found": p4_found,
    "p4_occurrences": p4_occurrences,
    "p4_objects": p4_objects,
    "p4_links": p4_links,
}

_CLEAN = r"nullif(lower(regexp_replace(CAST({0} AS VARCHAR), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), '')"

#: Latest rows, listed parents, the walk down from the roots, and for the rest the walk up to a repeated node.
_P1_BASE = f"""
WITH RECURSIVE f AS (
  SELECT 'folder' AS src, node_id, parent_id FROM (
    SELECT {_CLEAN.format('id')} AS node_id, {_CLEAN.format('parent_folder_id')} AS parent_id,
           row_number() OVER (PARTITION BY {_CLEAN.format('id')}
             ORDER BY updated_at DESC NULLS LAST, {_CLEAN.format('parent_folder_id')} DESC NULLS LAST) AS rn
    FROM project_subfolders) WHERE rn = 1 AND node_id IS NOT NULL),
ck AS (SELECT {_CLEAN.format('id')} AS node_id, max({_CLEAN.format('parent')}) AS parent_id FROM courts GROUP BY 1),
al AS (SELECT alias, min(node_id) AS target FROM (
    SELECT {_CLEAN.format('a')} AS alias, {_CLEAN.format('id')} AS node_id FROM (SELECT id, unnest(aliases) AS a FROM courts)) GROUP BY 1),
c AS (SELECT 'court' AS src, ck.node_id, coalesce(k2.node_id, al.target, ck.parent_id) AS parent_id
  FROM ck LEFT JOIN ck k2 ON k2.node_id = ck.parent_id LEFT JOIN al ON al.alias = ck.parent_id WHERE ck.node_id IS NOT NULL),
n AS (SELECT * FROM f UNION ALL SELECT * FROM c),
e AS (SELECT n.src, n.node_id, p.node_id AS up FROM n LEFT JOIN n p ON p.src = n.src AND p.node_id = n.parent_id),
t AS (SELECT src, node_id, node_id AS root_id, 0 AS depth, [node_id] AS path FROM e WHERE up IS NULL
  UNION ALL SELECT e.src, e.node_id, t.root_id, t.depth + 1, list_append(t.path, e.node_id) FROM t JOIN e ON e.src = t.src AND e.up = t.node_id),
"""

#: Unreached nodes, the walk up from each, the members of cycles, and the walk down from those.
_P1_LOST = """un AS (SELECT e.* FROM e ANTI JOIN t ON t.src = e.src AND t.node_id = e.node_id),
w AS (SELECT src, node_id, up AS cur FROM un UNION SELECT w.src, w.node_id, un.up FROM w JOIN un ON un.src = w.src AND un.node_id = w.cur),
mb AS (SELECT src, node_id FROM w WHERE node_id = cur)
"""

ORACLE = {
    "p4_found": f"""WITH RECURSIVE s AS (SELECT 'audit_log' AS src, {_CLEAN.format('id')} AS row_id, payload AS t FROM audit_log
  UNION SELECT 'chat_messages', {_CLEAN.format('id')}, content FROM chat_messages UNION SELECT 'tabular_cells', {_CLEAN.format('id')}, citations FROM tabular_cells),
a AS (SELECT src, row_id, CASE WHEN json_valid(t) THEN t::JSON ->> '$' END AS p FROM s), b AS (SELECT src, row_id, p::JSON AS v FROM a WHERE json_valid(p) AND json_type(p) IN ('ARRAY', 'OBJECT')),
n AS (SELECT src, row_id, CASE WHEN json_type(v) = 'OBJECT' AND src <> 'audit_log' THEN '[0]' ELSE '' END AS path, json_type(v) = 'OBJECT' AND src <> 'audit_log' AS in_list, v FROM b
  UNION ALL SELECT src, row_id, path || k, in_list, v FROM (
    SELECT src, row_id, path, CASE WHEN path = '' THEN '' ELSE '.' END || key || CASE WHEN lone THEN '[0]' ELSE '' END AS k, lone AS in_list, v FROM (
      SELECT src, row_id, path, key, v -> ('$."' || key || '"') AS v, json_type(v, '$."' || key || '"') = 'OBJECT' AND key IN ({", ".join(f"'{x}'" for x in sorted(LIST_NAMES))}) AS lone
      FROM (SELECT src, row_id, path, v, unnest(json_keys(v)) AS key FROM n WHERE json_type(v) = 'OBJECT'))
    UNION ALL SELECT src, row_id, path, '[' || i || ']', true, v -> ('$[' || i || ']') FROM (SELECT src, row_id, path, v, unnest(range(0, CAST(json_array_length(v) AS BIGINT))) AS i FROM n WHERE json_type(v) = 'ARRAY'))
  WHERE json_type(v) IN ('ARRAY', 'OBJECT'))
SELECT DISTINCT src, row_id, path FROM n WHERE in_list AND json_type(v) = 'OBJECT'""",
    "p1_found": _P1_BASE
    + _P1_LOST
    + """SELECT src, node_id, root_id, depth FROM t
UNION ALL
SELECT w.src, w.node_id, min(w.cur) AS root_id, -1 AS depth FROM w JOIN mb m ON m.src = w.src AND m.node_id = w.cur
GROUP BY 1, 2""",
    "p1_descendants": _P1_BASE
    + _P1_LOST.rstrip()
    + """,
bt AS (SELECT src, node_id, 0 AS depth, [node_id] AS path FROM mb
  UNION ALL SELECT u.src, u.node_id, bt.depth + 1, list_append(bt.path, u.node_id) FROM bt JOIN (SELECT * FROM un ANTI JOIN mb ON mb.src = un.src AND mb.node_id = un.node_id) u ON u.src = bt.src AND u.up = bt.node_id),
x AS (SELECT src, node_id, depth, path, unnest(range(0, depth)) AS pos FROM (SELECT src, node_id, depth, path FROM t UNION ALL SELECT * FROM bt) WHERE depth > 0)
SELECT src, path[pos + 1] AS ancestor_id, node_id, CAST(depth - pos AS INTEGER) AS distance FROM x""",
}
