"""Filling containers of fixed capacity, by exact-complement hashing over length counts.

Items of one length are interchangeable, so the plan is made on the histogram of lengths: at
most ``capacity`` counts, however many items there are.  The planner opens a container with
the longest length on hand and looks its gap up in hashed indexes of single lengths, pair
sums and triple sums, whose buckets are filled when their sum is first asked for; a combination
that fills the gap exactly is consumed as many times at once as the counts allow.  Where none exists, the longest length that fits goes in (best
fit) and the smaller gap is looked up again.  Each pattern uses some length up, so the plan
has about as many patterns as lengths.

Items then find their places by (length, rank among the items of that length): ranks come
from counts per (length, bucket), so a length that a third of all items share is still
numbered in parallel, and each container number is arithmetic on the plan.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketspark.session import cut, shuffle_parallelism

MAX_CAPACITY = 1 << 20


@dataclass
class Slot:
    """``copies`` items of ``length`` in each of ``times`` containers from ``container`` on, at ``offset``."""

    length: int
    start: int
    copies: int
    times: int
    container: int
    offset: int


class Stock:
    """Counts by length, and indexes from a sum to the single, pair and triple lengths that make it up.

    A bucket holds every combination of its sum whose lengths were on hand when it was filled.  Counts only
    fall, so a combination that is used up never comes back: each bucket has a cursor that passes it for
    good, and an empty bucket stays empty.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 1, dtype=np.int64)
        for length, c in counts.items():
            self.n[length] = c
        self.capacity = capacity
        self.have = np.flatnonzero(self.n)
        self.pairs: dict[int, tuple[list[int], int]] = {}  # sum -> (shorter halves, ascending; cursor)
        self.triples: dict[int, tuple[list[int], int]] = {}  # sum -> (longest members, descending; cursor)

    def refresh(self) -> None:
        self.have = self.have[self.n[self.have] > 0]

    def usable(self, combo: tuple[int, ...]) -> bool:
        return all(self.n[x] >= combo.count(x) for x in combo)

    def longest(self, limit: int) -> int:
        """The longest length on hand of at most ``limit``, or 0."""
        k = int(np.searchsorted(self.have, limit, side="right")) - 1
        while k >= 0 and not self.n[self.have[k]]:
            k -= 1
        return int(self.have[k]) if k >= 0 else 0

    def pair(self, total: int, beside: int = 0) -> tuple[int, int] | None:
        """Two lengths of this sum that are on hand, also after one of length ``beside`` is taken."""
        bucket, at = self.pairs.get(total, (None, 0))
        if bucket is None:
            half = self.have[: np.searchsorted(self.have, total // 2, side="right")]
            half = half[total - half <= self.capacity]
            bucket = half[self.n[total - half] > 0].tolist()
        while at < len(bucket) and not self.usable((total - bucket[at], bucket[at])):
            at += 1
        self.pairs[total] = (bucket, at) if at < len(bucket) else ([], 0)
        for x in bucket[at:]:
            combo = (total - x, x)
            if self.usable((beside, *combo) if beside else combo):
                return combo
        return None

    def triple(self, total: int) -> tuple[int, int, int] | None:
        bucket, at = self.triples.get(total, (None, 0))
        if bucket is None:
            lo, hi = np.searchsorted(self.have, [-(-total // 3), total])
            bucket = self.have[lo:hi][::-1].tolist()
        done = True  # whether everything up to here is used up for good
        for k in range(at, len(bucket)):
            a = bucket[k]
            if self.n[a] and (p := self.pair(total - a, a)):
                self.triples[total] = (bucket, at)
                return (a, *p)
            done = done and (not self.n[a] or not self.pairs[total - a][0])
            at = k + 1 if done else at
        self.triples[total] = (bucket, at) if at < len(bucket) else ([], 0)
        return None

    def complement(self, gap: int) -> tuple[int, ...] | None:
        if gap <= self.capacity and self.n[gap]:
            return (gap,)
        return self.pair(gap) or self.triple(gap)


def plan_containers(counts: dict[int, int], capacity: int) -> tuple[list[Slot], int]:
    """Slots for every counted item (lengths 1..capacity), and the number of containers."""
    stock = Stock({k: v for k, v in counts.items() if v and k}, capacity)
    given = np.zeros(capacity + 1, dtype=np.int64)
    slots, containers = [], 0
    while True:
        stock.refresh()
        first = stock.longest(capacity)
        if not first:
            return slots, containers
        used: list[int] = []
        gap = capacity
        take: tuple[int, ...] | None = (first,)
        while take:
            for x in take:
                stock.n[x] -= 1
                used.append(x)
            gap -= sum(take)
            if not gap:
                break
            take = stock.complement(gap)
            if not take and (x := stock.longest(gap)):
                take = (x,)  # best fit; the smaller gap is looked up again
        pattern = {x: used.count(x) for x in dict.fromkeys(used)}
        times = 1 + min(int(stock.n[x]) // c for x, c in pattern.items())
        offset = 0
        for x, c in pattern.items():
            stock.n[x] -= (times - 1) * c
            slots.append(Slot(x, int(given[x]), c, times, containers, offset))
            given[x] += c * times
            offset += c * x
        containers += times


def pack(items: DataFrame, size_col: str, keep: list[str], capacity: int, buckets: int | None = None) -> DataFrame:
    """Assign every item to a container: ``keep``, piece, piece_start, piece_size, container_id, container_offset.

    An item above the capacity is divided into whole containers and one rest piece (``piece``
    counts from 0, ``piece_start`` is its offset in the item); no other item is divided.  Items
    of size 0 or null take no room: one row with piece_size 0 and a null container.  Repeated rows
    are items of their own; buckets are drawn by place, not by key, so that repeats spread too.  The
    pieces are written to the checkpoint folder once, and everything after reads that table.
    """
    if not 0 < capacity <= MAX_CAPACITY:
        raise ValueError("the histogram of lengths is held by the driver; capacity is at most 2^20")
    spark = items.sparkSession
    buckets = buckets or 4 * shuffle_parallelism(spark)
    size = F.coalesce(F.col(size_col).cast("long"), F.lit(0))
    cap = F.lit(capacity).cast("long")
    whole = F.when(size > cap, F.floor(size / cap)).otherwise(F.lit(0)).cast("long")
    rest = F.when(size > cap, size % cap).otherwise(size)
    pieces = cut(
        items.select(*keep, size.alias("_size"), whole.alias("_whole"), rest.alias("_rest"))
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_whole") - F.when((F.col("_rest") == 0) & (F.col("_whole") > 0), 1).otherwise(0))))
        .select(
            *keep, F.col("piece").cast("int"), (F.col("piece") * cap).alias("piece_start"),
            F.when(F.col("piece") < F.col("_whole"), cap).otherwise(F.col("_rest")).alias("piece_size"),
        )
        .withColumn("_bucket", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets)).cast("int"))
    )
    per = pieces.where("piece_size > 0").groupBy("piece_size", "_bucket").agg(F.count("*").alias("_n"))
    per = cut(per)
    counts = {r[0]: r[1] for r in per.groupBy("piece_size").agg(F.sum("_n")).collect()}  # at most `capacity` rows
    slots, _ = plan_containers(counts, capacity)
    plan = pd.DataFrame([vars(s) for s in slots], columns=["length", "start", "copies", "times", "container", "offset"]).astype("int64")
    plan = plan.sort_values(["length", "start"], ignore_index=True)
    first = np.searchsorted(plan["length"], np.arange(capacity + 2))
    sent = spark.sparkContext.broadcast(({c: plan[c].to_numpy() for c in plan}, first))

    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        p, at = sent.value
        span = 1 << 41
        k = np.searchsorted(p["length"] * span + p["start"], length.to_numpy() * span + rank.to_numpy(), side="right") - 1
        r = rank.to_numpy() - p["start"][k]
        times = p["times"][k]
        return pd.DataFrame({"container_id": p["container"][k] + r % times, "container_offset": p["offset"][k] + r // times * p["length"][k]})

    place_udf = F.pandas_udf(place, "container_id long, container_offset long")
    before = Window.partitionBy("piece_size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = per.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("piece_size", "_bucket").orderBy(*keep, "piece")
    placed = (
        pieces.where("piece_size > 0")
        .withColumn("_rank", F.row_number().over(inside) - 1)
        .join(bases.hint("shuffle_hash"), ["piece_size", "_bucket"])  # partitioned as the window is; never broadcast
        .withColumn("_at", place_udf(F.col("piece_size"), F.col("_base") + F.col("_rank")))
        .select(*keep, "piece", "piece_start", "piece_size", "_at.container_id", "_at.container_offset")
    )
    none = F.lit(None).cast("long")
    empty = pieces.where("piece_size = 0").select(*keep, "piece", "piece_start", "piece_size", none.alias("container_id"), none.alias("container_offset"))
    return placed.unionByName(empty)
