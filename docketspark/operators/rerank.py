"""Structural re-ranking of fused candidates: citation profiles, then event frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketspark.operators.graph import frame_similarity, jaccard
from docketspark.operators.retrieval import blend, min_max

ALPHA = 0.6


def _reference(candidates: DataFrame, features: DataFrame, cols: list[str]) -> DataFrame:
    """query_id and the features of its best candidate, as ref_*; one partial aggregate, no sort."""
    best = candidates.groupBy("query_id").agg(F.max_by("id", F.struct("score", -F.col("id"))).alias("_best"))
    mine = features.select(F.col("id").alias("_best"), *(F.col(c).alias(f"ref_{c}") for c in cols))
    return best.join(mine, "_best", "left").drop("_best")


def _rerank(candidates: DataFrame, features: DataFrame, cols: list[str], similarity: Column, empty: Column, alpha: float) -> DataFrame:
    joined = candidates.join(_reference(candidates, features, cols), "query_id").join(features.select("id", *cols), "id", "left")
    normed = min_max(joined, "query_id", "score", "_content").withColumn("_raw", similarity)
    normed = min_max(normed, "query_id", "_raw", "_structure")
    alone = F.col("_n") < 2
    sized = normed.join(candidates.groupBy("query_id").agg(F.count("*").alias("_n")), "query_id")
    score = F.when(empty | alone, F.col("_content")).otherwise(blend(F.col("_content"), F.col("_structure"), alpha))
    return sized.select("query_id", "id", score.alias("score"))


def dual_rerank(candidates: DataFrame, profiles: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """query_id, id, score: content score (min-max per query) blended with the overlap of the candidate's citation
    profile with that of the query's best candidate.

    ``candidates``: query_id, id, score; ``profiles``: id, profile (array of cited values).  Queries whose best
    candidate has no profile, and queries of one candidate, keep their content order.
    """
    none = F.array().cast("array<string>")
    own, ref = F.coalesce("profile", none), F.coalesce("ref_profile", none)
    return _rerank(candidates, profiles, ["profile"], jaccard(own, ref), F.size(ref) == 0, alpha)


def event_rerank(candidates: DataFrame, frames: DataFrame, roles: list[str], alpha: float = ALPHA) -> DataFrame:
    """As dual_rerank, by mean Jaccard over the event roles of documents (``frames``: id and one array a role)."""
    none = F.array().cast("array<string>")
    own, ref = {r: F.coalesce(r, none) for r in roles}, {r: F.coalesce(f"ref_{r}", none) for r in roles}
    empty = sum((F.size(c) for c in ref.values()), F.lit(0)) == 0
    return _rerank(candidates, frames, roles, frame_similarity(own, ref), empty, alpha)
