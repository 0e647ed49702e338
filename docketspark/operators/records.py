"""Records with a life: proposed edges, erasure and purges with reports, partitions by reason, chained appends."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketspark.operators.ledger import GENESIS
from docketspark.sources.tables import update_rows

#: Fixed value: what an edge's label looks like.
LABEL = r"^[a-z][a-z0-9_]{0,63}$"


def propose_edges(edges: DataFrame, label_col: str = "label", run_col: str = "run") -> DataFrame:
    """``edges`` with status 'proposed'; labels of another form are dropped, a blank run is the global one (null)."""
    run = F.nullif(F.trim(run_col), F.lit(""))
    return edges.where(F.coalesce(F.col(label_col).rlike(LABEL), F.lit(False))).withColumn(run_col, run).withColumn("status", F.lit("proposed"))


def ratify_edges(edges: DataFrame, chosen: Column, actor_kind: Column, run_col: str = "run") -> DataFrame:
    """Proposed edges that a human chose become ratified, for all runs; every other row stays as it is."""
    return update_rows(edges, chosen & (F.col("status") == "proposed") & (actor_kind == "human"), {"status": F.lit("ratified"), run_col: F.lit(None).cast(edges.schema[run_col].dataType)})


def visible_edges(edges: DataFrame, run: str | None, run_col: str = "run") -> DataFrame:
    """Ratified and global edges, and those of the run that asks."""
    mine = F.col(run_col) == F.lit(run) if run is not None else F.lit(False)
    return edges.where((F.col("status") == "ratified") | F.col(run_col).isNull() | F.coalesce(mine, F.lit(False)))


def split_by_reason(df: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """``df`` with ``reason``: the first rule that holds, in the order given; null for rows that may go on."""
    chain = F.lit(None).cast("string")
    for name, rule in reversed(reasons.items()):
        chain = F.when(F.coalesce(rule, F.lit(False)), name).otherwise(chain)
    return df.withColumn("reason", chain)


def purge(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables without the rows of the keys in ``gone``, report of table, purged and kept rows).

    ``tables``: name -> (frame, key column), children first; ``gone`` has one column, the key.  A null key stays.
    """
    key = gone.columns[0]
    gone = gone.select(F.col(key).alias("_gone")).distinct()
    kept = {n: df.join(gone, F.col(k) == F.col("_gone"), "left_anti") for n, (df, k) in tables.items()}
    parts = []
    for n, (df, k) in tables.items():
        marked = df.select(F.col(k).alias("_k")).groupBy("_k").agg(F.count("*").alias("n")).join(gone, F.col("_k") == F.col("_gone"), "left")
        parts.append(marked.agg(F.coalesce(F.sum(F.when(F.col("_gone").isNotNull(), F.col("n"))), F.lit(0)).alias("purged"), F.coalesce(F.sum(F.when(F.col("_gone").isNull(), F.col("n"))), F.lit(0)).alias("kept")).select(F.lit(n).alias("kind"), "purged", "kept"))
    report = parts[0]
    for p in parts[1:]:
        report = report.unionByName(p)
    return kept, report


def anonymise(df: DataFrame, user_col: str, user: str) -> DataFrame:
    """Rows of a user stay, without the user."""
    return update_rows(df, F.col(user_col) == user, {user_col: F.lit(None).cast(df.schema[user_col].dataType)})


def receipt(user: Column) -> Column:
    """How an erasure names the user it was for: 16 hex digits of a digest."""
    return F.left(F.sha2(user.cast("string"), 256), F.lit(16))


def attribute(pairs: DataFrame, by: list[str], source_col: str, at_col: str, key_col: str, probes: list[str], least: int = 6) -> DataFrame:
    """``by``, key: of the candidate keys of a match the one whose probe (title, address, excerpt) stands last before it.

    ``pairs``: one row a match and candidate.  Probes shorter than ``least`` do not count; a match with one candidate
    goes to it; where no probe stands before the match there is no row.
    """
    before = F.substring(F.col(source_col), F.lit(1), F.col(at_col))

    def last(p: str) -> Column:
        found = F.call_function("locate", F.reverse(F.col(p)), F.reverse(before))
        return F.when((F.length(p) >= least) & (found > 0), F.length(before) - found - F.length(p) + 2).otherwise(0)

    at = F.greatest(*(F.coalesce(last(p), F.lit(0)) for p in probes)) if len(probes) > 1 else F.coalesce(last(probes[0]), F.lit(0))
    best = pairs.select(*by, key_col, at.alias("_at")).groupBy(*by).agg(F.max(F.struct("_at", F.col(key_col).alias("k"))).alias("_m"), F.countDistinct(key_col).alias("_n"))
    return best.where("_m._at > 0 OR _n = 1").select(*by, F.col("_m.k").alias(key_col))


def chain_rows(batch: DataFrame, id_col: str, body_col: str, last_hash: str = GENESIS) -> DataFrame:
    """id, prev_hash, hash of a bounded batch chained after ``last_hash``, in id order.

    Each hash needs the one before it, so a batch is one task by nature; its size is the caller's bound, as a
    micro-batch's is.  A hash is sha256 of the previous hash and the body, null counting as empty.
    """
    kind = batch.schema[id_col].dataType.simpleString()

    def run(it: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = last_hash
        for pdf in it:
            rows = []
            for i, body in zip(pdf[id_col], pdf[body_col]):
                h = sha256((last + (body or "")).encode()).hexdigest()
                rows.append((i, last, h))
                last = h
            yield pd.DataFrame(rows, columns=[id_col, "prev_hash", "hash"])

    return batch.select(id_col, body_col).coalesce(1).sortWithinPartitions(id_col).mapInPandas(run, f"{id_col} {kind}, prev_hash string, hash string")


def append_chained(stream: DataFrame, path: str, id_col: str, body_col: str, checkpoint: str):
    """A query that appends micro-batches to a hash-chained log at ``path``; the one writer goes on from the log's last hash.

    A batch that is given again after a failure finds its ids in the log and adds nothing.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fs = spark._jvm.org.apache.hadoop.fs.Path(path)
        there = fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs)
        last = GENESIS
        if there:
            log = spark.read.parquet(path)
            head = log.agg(F.max_by("hash", id_col), F.max(id_col)).first()
            last, newest = head[0] or GENESIS, head[1]
            batch = batch.where(F.col(id_col) > newest) if newest is not None else batch
        chain_rows(batch, id_col, body_col, last).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
