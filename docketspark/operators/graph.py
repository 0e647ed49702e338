"""Citation edges, centrality, unique owners, structural profiles and event frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketspark.operators.ordered import line_up, with_lag, with_running_sum


def centrality(edges: DataFrame) -> DataFrame:
    """value, centrality: distinct documents that cite a value.  ``edges``: doc_id, value."""
    return edges.distinct().groupBy("value").agg(F.count("*").alias("centrality"))


def document_centrality(edges: DataFrame) -> DataFrame:
    """doc_id, score: the centralities of the distinct values a document cites, summed."""
    pairs = edges.distinct()
    return pairs.join(centrality(edges), "value").groupBy("doc_id").agg(F.sum("centrality").alias("score"))


def unique_owner(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """doc_id, value, to_doc_id: the one *other* document that owns the value, null if none or several.

    No self-join of a value's rows: the two smallest distinct owners of a value say whether exactly
    one is left once the citing document is taken out.
    """
    o = owners.distinct().groupBy("value").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    other = (
        F.when((F.col("n") == 1) & (F.col("lo") != F.col("doc_id")), F.col("lo"))
        .when((F.col("n") == 2) & (F.col("lo") == F.col("doc_id")), F.col("hi"))
        .when((F.col("n") == 2) & (F.col("hi") == F.col("doc_id")), F.col("lo"))
    )
    return edges.distinct().join(o, "value", "left").select("doc_id", "value", other.alias("to_doc_id"))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays; 0 where both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def event_frames(hits: DataFrame, doc_col: str, gap: int = 160) -> DataFrame:
    """Frames of role hits that stand close together: doc, frame, span_start, span_end, roles, n_roles.

    ``hits``: doc, role, value, position.  A hit more than ``gap`` after the one before it opens a
    frame; frames with fewer than two distinct roles are dropped.  Order and sums are carried over
    partition edges, so one long document is no single task.
    """
    order = ["position", "role", "value"]
    rows = line_up(hits.select(doc_col, *order).distinct(), doc_col, order)
    flagged = with_lag(rows, doc_col, order, F.col("position"), "_before")
    flagged = flagged.withColumn("_new", F.when(F.col("position") - F.col("_before") <= gap, 0).otherwise(1))
    framed = with_running_sum(flagged, doc_col, order, "_new", "frame")
    by = framed.groupBy(doc_col, "frame").agg(
        F.min("position").alias("span_start"), F.max("position").alias("span_end"), F.countDistinct("role").alias("n_roles"), F.count("*").alias("n_hits")
    )
    return by.where("n_roles >= 2")


def role_frames(hits: DataFrame, doc_col: str, roles: list[str]) -> DataFrame:
    """One row a document with the sorted distinct values of each role."""
    return hits.groupBy(doc_col).agg(*(F.sort_array(F.collect_set(F.when(F.col("role") == r, F.col("value")))).alias(r) for r in roles))


def frame_similarity(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Mean Jaccard over the roles present in either frame; 0 if there is none."""
    present = sum(((F.size(F.array_union(a[r], b[r])) > 0).cast("int") for r in a), F.lit(0))
    total = sum((jaccard(a[r], b[r]) for r in a), F.lit(0.0))
    return F.when(present == 0, 0.0).otherwise(total / present)
