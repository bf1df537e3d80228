"""Put items into containers of fixed capacity by the sum-of-squares rule."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.runtime import cut

CAPACITY = 4096
#: Items that one task packs; larger inputs are packed by more tasks side by side.
SHARD = 25_000


def sum_of_squares(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Container number of each size (0 < size <= capacity), in the given order.

    Each item goes where the sum over the gaps of (number of open containers with that gap) squared becomes smallest; among equals
    to the tightest gap. A gap of 0 is closed and doesn't count.
    """
    open_at = np.zeros(capacity + 1, dtype=np.int64)  # open containers by gap
    which: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.empty(len(sizes), dtype=np.int64)
    made = 0
    for i, s in enumerate(sizes):
        s = int(s)
        gaps = np.arange(s, capacity)
        cost = open_at[gaps - s] - open_at[gaps] + 1.0  # half the change of the sum
        if len(gaps):
            cost[0] = 0.5 - open_at[s]  # the gap closes and no other appears
            cost[open_at[gaps] == 0] = np.inf
        fresh = open_at[capacity - s] + (0.5 if s < capacity else 0)
        best = int(np.argmin(cost)) if len(gaps) else -1
        if best >= 0 and cost[best] <= fresh and open_at[gaps[best]] > 0:
            gap = int(gaps[best])
            c = heapq.heappop(which[gap])
            open_at[gap] -= 1
        else:
            gap, c = capacity, made
            made += 1
        out[i] = c
        if gap - s:
            open_at[gap - s] += 1
            heapq.heappush(which[gap - s], c)
    return out


def pack(sized: DataFrame, key: str, size: str, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """(key, part_no, container, used): a container for each item, for items above the capacity one for each part.

    Only keys and sizes move. Items are spread by a hash of the key over as many tasks as hold `shard` items each, so no task grows
    with the input; every task packs its own containers, the largest items first. Items above the capacity fill whole
    containers and their rest is packed like an item. Size 0 or null takes no room: such an item joins its task's first container.
    Equal rows are items of their own. An empty table gives no rows.
    """
    kind = sized.schema[key].dataType.simpleString()
    sizes = cut(sized.select(F.col(key).alias("k"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long").alias("n")))
    shards = max(1, -(-sizes.count() // shard))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "k"], ascending=[False, True], kind="stable")
        n = pdf["n"].to_numpy()
        full, rest = n // capacity, n % capacity
        full, rest = np.where((rest == 0) & (n > 0), full - 1, full), np.where((rest == 0) & (n > 0), capacity, rest)
        order = np.argsort(-rest, kind="stable")
        order = order[rest[order] > 0]
        home = np.zeros(len(n), dtype=np.int64)
        home[order] = sum_of_squares(rest[order], capacity)
        made = int(home.max()) + 1 if len(home) else 0
        whole = np.repeat(np.arange(len(n)), full)
        part = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
        at = int(pdf["shard"].iloc[0]) << 40
        k = pdf["k"].to_numpy()
        return pd.DataFrame(
            {
                key: np.r_[k[whole], k] if len(whole) else k,
                "part_no": np.r_[part, full].astype("int64"),
                "container": at + np.r_[made + np.arange(len(whole)), home],
                "used": np.r_[np.full(len(whole), capacity), rest].astype("int64"),
            }
        )

    spread = sizes.withColumn("shard", F.pmod(F.xxhash64("k"), F.lit(shards)))
    return spread.groupBy("shard").applyInPandas(run, f"`{key}` {kind}, part_no long, container long, used long")
