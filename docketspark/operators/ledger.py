"""Tamper-evident logs: chain links, row digests, Merkle roots and proofs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketspark.operators.ordered import line_up, with_lag, with_last_seen, with_running_sum
from docketspark.session import cut

GENESIS = "0" * 64
BLOCK = 1024  # leaves per task-side subtree; a power of two


def distinct_log(df: DataFrame, id_col: str, cols: list[str]) -> DataFrame:
    """One row an id: the greatest of those that repeat it, folded before the shuffle."""
    best = df.groupBy(id_col).agg(F.max(F.struct(*cols)).alias("_m"))
    return best.select(id_col, *(F.col(f"_m.{c}").alias(c) for c in cols))


def check_links(log: DataFrame, id_col: str = "id", prev_col: str = "prev_hash", hash_col: str = "hash") -> DataFrame:
    """id, link_ok: whether each row's previous hash is the hash of the row before it by id.

    The first row must name the genesis hash.  The order is global, yet no task sees it all: one
    range partition, and one value carried over each partition edge.
    """
    lined = with_lag(line_up(log.select(id_col, prev_col, hash_col), None, [id_col]), None, [id_col], F.col(hash_col), "_before")
    return lined.select(id_col, F.coalesce(F.col(prev_col) == F.coalesce("_before", F.lit(GENESIS)), F.lit(False)).alias("link_ok"))


def row_digest(prev: Column, **fields: Column) -> Column:
    """sha256 of the previous hash and the canonical JSON of the fields, keys sorted, nulls kept."""
    body = F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})
    return F.sha2(F.concat(prev, body), 256)


def pair_hash(a: str, b: str) -> str:
    return sha256((a + b).encode()).hexdigest()


def subtree(hashes: list[str], height: int | None = None) -> str:
    """Root of the leaves; an odd last node is paired with itself.  With a height, go on to that level."""
    level = 0
    while len(hashes) > 1 or height is not None and level < height:
        if len(hashes) % 2:
            hashes = [*hashes, hashes[-1]]
        hashes = [pair_hash(hashes[i], hashes[i + 1]) for i in range(0, len(hashes), 2)]
        level += 1
    return hashes[0]


def merkle_roots(log: DataFrame, block_col: str, id_col: str, hash_col: str) -> DataFrame:
    """block, n, root: the Merkle root over each block's hashes in id order.

    Leaves are numbered with a distributed running count and folded in groups of 1024, level by
    level: the groups are bounded, so a block of any size spreads over tasks.
    """
    lined = line_up(log.select(block_col, id_col, hash_col).withColumn("_one", F.lit(1).cast("long")), block_col, [id_col])
    leaves = with_running_sum(lined, block_col, [id_col], "_one", "_i", inclusive=False).select(F.col(block_col).alias("block"), F.col("_i").alias("i"), F.col(hash_col).alias("h"))
    sizes = leaves.groupBy("block").agg(F.count("*").alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    nodes, left, height = leaves.join(sizes, "block").select("block", "i", "h", "n", F.col("n").alias("now")), most, BLOCK.bit_length() - 1

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        alone = pdf["now"].iloc[0] <= BLOCK
        root = subtree(pdf["h"].tolist(), None if alone else height)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "i": [pdf["i"].iloc[0] // BLOCK], "h": [root], "n": [pdf["n"].iloc[0]], "now": [-(-pdf["now"].iloc[0] // BLOCK)]})

    kind = leaves.schema["block"].dataType.simpleString()
    while True:
        nodes = nodes.groupBy("block", F.floor(F.col("i") / BLOCK).alias("_g")).applyInPandas(fold, f"block {kind}, i long, h string, n long, now long")
        left = -(-left // BLOCK)
        if left <= 1:
            return nodes.select("block", "n", F.col("h").alias("root"))


def merkle_proof(hashes: list[str], index: int) -> list[tuple[str, str]]:
    """(side, sibling) from leaf to root of one bounded block."""
    proof = []
    while len(hashes) > 1:
        if len(hashes) % 2:
            hashes = [*hashes, hashes[-1]]
        proof.append(("right", hashes[index + 1]) if index % 2 == 0 else ("left", hashes[index - 1]))
        hashes = [pair_hash(hashes[i], hashes[i + 1]) for i in range(0, len(hashes), 2)]
        index //= 2
    return proof


def verify_proof(leaf: Column, proof: Column) -> Column:
    """Root that a proof (array of struct side, hash) leads to: a native fold."""
    return F.aggregate(proof, leaf, lambda acc, p: F.when(p["side"] == "right", F.sha2(F.concat(acc, p["hash"]), 256)).otherwise(F.sha2(F.concat(p["hash"], acc), 256)))


def _nodes(start: int, end: int) -> Iterator[tuple[int, int]]:
    """(level, number) of the fewest dyadic ranges that make up [start, end)."""
    level = 0
    while start < end:
        if start & 1:
            yield level, start
            start += 1
        if end & 1:
            end -= 1
            yield level, end
        start, end, level = start >> 1, end >> 1, level + 1


def covering_block(ids: DataFrame, id_col: str, blocks: DataFrame) -> DataFrame:
    """Newest block (block_start, block_end, computed_at, block_id) that covers each id; ids in no block have no row.

    The blocks' edges cut the ids into stretches in which the answer does not change.  A block is handed to the
    few dyadic ranges of stretches that make it up, each stretch takes the newest of its own ranges, and the ids
    look the stretch before them up in one ordered pass.  Nothing grows with ids times blocks.
    """
    blocks = blocks.where("block_start <= block_end")
    edges = blocks.select(F.col("block_start").alias("at")).union(blocks.select(F.col("block_end") + 1)).distinct()
    lined = line_up(edges.withColumn("_one", F.lit(1).cast("long")), None, ["at"])
    stretches = cut(with_running_sum(lined, None, ["at"], "_one", "no", inclusive=False).select("at", "no"))
    depth = max(1, int(stretches.count()).bit_length())
    a, z = (stretches.select(F.col("at").alias(c), F.col("no").alias(n)) for c, n in (("block_start", "_a"), ("_end", "_z")))
    placed = blocks.withColumn("_end", F.col("block_end") + 1).join(a, "block_start").join(z, "_end").select("_a", "_z", F.struct("computed_at", "block_id").alias("_m"))

    def split(it: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(level, n, m) for x, y, m in zip(pdf["_a"], pdf["_z"], pdf["_m"]) for level, n in _nodes(x, y)]
            yield pd.DataFrame(rows, columns=["level", "n", "_m"])

    kind = placed.schema["_m"].dataType.simpleString()
    newest = placed.mapInPandas(split, f"level int, n long, _m {kind}").groupBy("level", "n").agg(F.max("_m").alias("_m"))
    levels = stretches.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumn("n", F.expr("shiftright(no, level)"))
    best = levels.join(newest, ["level", "n"], "left").groupBy("at").agg(F.max("_m").alias("_m"))
    marks = best.select(F.col("at").alias("_at"), F.lit(0).alias("_side"), F.struct(F.col("_m").alias("m")).alias("_best"), F.lit(None).cast(ids.schema[id_col].dataType).alias("_id"))
    asked = ids.select(F.col(id_col).cast("long").alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(marks.schema["_best"].dataType).alias("_best"), F.col(id_col).alias("_id"))
    order = ["_at", "_side", "_id"]
    seen = with_last_seen(line_up(marks.unionByName(asked), None, order), None, order, F.col("_best"), "_now")
    return seen.where("_side = 1 AND _now.m IS NOT NULL").select(F.col("_id").alias(id_col), F.col("_now.m.block_id").alias("block_id"))


def next_block(last_covered: int, newest: int, now_ms: int, computed_at_ms: int, least: int, interval_ms: int) -> tuple[int, int] | None:
    """(start, end) of the block of ids to fold next: all new ones at first, then once there are ``least`` or the interval is over."""
    new = newest - last_covered
    due = new > 0 and (last_covered == 0 or new >= least or now_ms - computed_at_ms >= interval_ms)
    return (last_covered + 1, newest) if due else None
