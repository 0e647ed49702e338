"""Ordered computations whose keys may be hot: lag, running sum and last value seen.

A plain window puts all rows of a key in one task.  Here the rows are range-partitioned once over
(key, order), so a key that holds a third of all rows - or a single global order, key None -
spreads over many tasks.  Each step works inside (partition, key) and then carries one value over
the partition edges.  As rows of a key stand together, a partition shares at most two keys with
its neighbours; the table of edges has at most twice as many rows as there are partitions, so
it is bounded whatever the data and may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketspark.session import cut_in_order, shuffle_parallelism

PID = "_pid"


def line_up(df: DataFrame, key: str | None, order: list[str], partitions: int | None = None) -> DataFrame:
    """Rows sorted over partitions by (key, order), with the partition number; ``order`` must be total in a key.

    Checkpointed in this order, so that later steps and retries see the same partitions.
    """
    by = [*([key] if key else []), *order]
    n = partitions or shuffle_parallelism(df.sparkSession)
    return cut_in_order(df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn(PID, F.spark_partition_id()))


def _near(key: str | None, order: list[str]):
    return Window.partitionBy(PID, *([key] if key else [])).orderBy(*order)


def _carry(lined: DataFrame, key: str | None, value: Column, over: str) -> DataFrame:
    """(_pid, _key, _edge): what earlier partitions of the same key hand on; no row where there is none."""
    k = F.col(key) if key else F.lit(0)
    per = lined.select(PID, k.alias("_key"), *([c for c in lined.columns if c not in (PID, key)])) if key else lined.withColumn("_key", k)
    per = per.groupBy(PID, "_key").agg(value.alias("_v"))
    before = Window.partitionBy("_key").orderBy(PID)
    if over == "sum":
        edge = F.sum("_v").over(before.rowsBetween(Window.unboundedPreceding, -1))
    elif over == "next":
        edge = F.lead("_v").over(before)
    elif over == "last":
        edge = F.last("_v", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1))
    else:
        edge = F.lag("_v").over(before)
    return per.withColumn("_edge", edge).where("_edge IS NOT NULL").select(F.col(PID).alias("_epid"), F.col("_key").alias("_ekey"), "_edge")


def _joined(lined: DataFrame, key: str | None, edges: DataFrame) -> DataFrame:
    on = F.col(PID) == F.col("_epid")
    on = on & F.col(key).eqNullSafe(F.col("_ekey")) if key else on
    return lined.join(F.broadcast(edges), on, "left").drop("_epid", "_ekey")


def with_lags(lined: DataFrame, key: str | None, order: list[str], values: dict[str, Column]) -> DataFrame:
    """Each value of the row before within the key, under its name; null for the first row.

    The values are read inside the window and the edge aggregate, so no copy of them is shuffled.
    """
    near = _near(key, order)
    packed = F.struct(*(v.alias(out) for out, v in values.items()))
    joined = _joined(lined, key, _carry(lined, key, F.max_by(packed, F.struct(*order)), "lag"))
    first = F.row_number().over(near) == 1
    return joined.withColumns({out: F.when(first, F.col("_edge")[out]).otherwise(F.lag(v).over(near)) for out, v in values.items()}).drop("_edge")


def with_lag(lined: DataFrame, key: str | None, order: list[str], value: Column, out: str) -> DataFrame:
    """``value`` of the row before within the key; null for the first row."""
    return with_lags(lined, key, order, {out: value})


def with_running_sum(lined: DataFrame, key: str | None, order: list[str], value: str, out: str, inclusive: bool = True) -> DataFrame:
    """Running sum of ``value`` within the key, with or without the row itself."""
    frame = _near(key, order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    joined = _joined(lined, key, _carry(lined, key, F.sum(value), "sum"))
    total = F.coalesce(F.sum(value).over(frame), F.lit(0)) + F.coalesce("_edge", F.lit(0))
    return joined.withColumn(out, total).drop("_edge")


def with_last_seen(lined: DataFrame, key: str | None, order: list[str], value: Column, out: str) -> DataFrame:
    """The latest value that is not null, up to and with the row, within the key: an as-of carry."""
    rows = lined.withColumn("_val", value)
    filled = rows.withColumn("_ord", F.when(F.col("_val").isNotNull(), F.struct(*order)))
    joined = _joined(rows, key, _carry(filled, key, F.max_by("_val", "_ord"), "last"))
    near = _near(key, order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(out, F.coalesce(F.last("_val", ignorenulls=True).over(near), "_edge")).drop("_val", "_edge")


def with_lead(lined: DataFrame, key: str | None, order: list[str], value: Column, out: str) -> DataFrame:
    """``value`` of the row after within the key; null for the last row."""
    near = _near(key, order)
    rows = lined.withColumn("_val", value)
    edges = _carry(rows.withColumn("_ord", F.struct(*order)), key, F.min_by("_val", "_ord"), "next")
    joined = _joined(rows, key, edges).withColumn("_next", F.lead(F.struct("_val")).over(near))
    return joined.withColumn(out, F.when(F.col("_next").isNull(), F.col("_edge")).otherwise(F.col("_next._val"))).drop("_val", "_edge", "_next")


def with_preceding(lined: DataFrame, key: str | None, order: list[str], value: Column, n: int, out: str) -> DataFrame:
    """Array of the values (nulls left out) of the ``n`` rows before, oldest first; shorter at the start of a key.

    Each partition hands on the last ``n`` values of a key, so what crosses an edge is bounded by n times
    the number of partitions.
    """
    near = _near(key, order)
    rows = lined.withColumn("_val", value).withColumn("_ord", F.struct(*order))
    last = Window.partitionBy(PID, *([key] if key else [])).orderBy(*(F.col(c).desc() for c in order))
    tails = rows.withColumn("_rn", F.row_number().over(last)).where(F.col("_rn") <= n)
    k = F.col(key) if key else F.lit(0)
    ends = tails.groupBy(F.col(PID).alias("_epid"), k.alias("_ekey")).agg(F.sort_array(F.collect_list(F.struct("_ord", "_val")))["_val"].alias("_v"))
    seen = Window.partitionBy("_ekey").orderBy("_epid").rowsBetween(Window.unboundedPreceding, -1)
    edges = ends.withColumn("_edge", F.flatten(F.collect_list("_v").over(seen))).where(F.size("_edge") > 0)
    edges = edges.select("_epid", "_ekey", F.slice("_edge", F.greatest(F.size("_edge") - n + 1, F.lit(1)), F.lit(n)).alias("_edge"))
    own = F.transform(F.collect_list(F.struct("_val")).over(near.rowsBetween(-n, -1)), lambda x: x["_val"])
    joined = _joined(rows, key, edges).withColumn("_own", own)
    left = F.coalesce("_edge", F.array().cast(joined.schema["_own"].dataType))
    both = F.concat(left, "_own")
    cut = F.slice(both, F.greatest(F.size(both) - n + 1, F.lit(1)), F.lit(n))
    return joined.withColumn(out, F.filter(cut, lambda x: x.isNotNull())).drop("_val", "_ord", "_edge", "_own")
