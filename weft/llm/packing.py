"""Filling containers of fixed capacity by conflict-constrained best fit.

Items come largest first. Open bins are the leaves of a tree ordered by residual and number; the
successor of the item's size is the tightest bin that could hold it, and the search goes on to the next
larger residual until a bin without a conflict is found. A bin carries bitmaps of its items' sources and
duplicate clusters, and every node the bits that all bins below it share, so that runs of bins that all
conflict are stepped over at once: a group of copies of one text takes n log n steps, not n * n. An item
larger than the capacity is split into full containers and a rest, which is packed like any other item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from weft.runtime import plain_columns

#: Items of a container group that one task packs; a larger group is packed in several shards.
SHARD = 20_000
DEFAULT_BUDGET = 8000


class _Bins:
    """Open bins by (residual, number), a tree of dictionaries: a node is its level's prefix of the key
    and holds the bits that all bins below it have in common. Missing nodes have no bins."""

    def __init__(self, capacity: int, most: int) -> None:
        self.low = max(1, most.bit_length())
        self.height = capacity.bit_length() + self.low
        self.levels: list[dict[int, tuple[int, int]]] = [{} for _ in range(self.height + 1)]

    def _refresh(self, key: int) -> None:
        for up in range(1, self.height + 1):
            below, node = self.levels[up - 1], key >> up
            a, b = below.get(2 * node), below.get(2 * node + 1)
            if a is None and b is None:
                del self.levels[up][node]
            else:
                self.levels[up][node] = a if b is None else b if a is None else (a[0] & b[0], a[1] & b[1])

    def put(self, residual: int, number: int, sources: int, clusters: int) -> None:
        key = residual << self.low | number
        self.levels[0][key] = (sources, clusters)
        self._refresh(key)

    def take(self, residual: int, number: int) -> tuple[int, int]:
        key = residual << self.low | number
        out = self.levels[0].pop(key)
        self._refresh(key)
        return out

    def tightest(self, size: int, source: int, cluster: int) -> tuple[int, int] | None:
        """(residual, number) of the bin of least residual >= size without these bits."""
        least = size << self.low
        waiting = [(self.height, 0)]
        while waiting:
            up, node = waiting.pop()
            held = self.levels[up].get(node)
            if held is None or held[0] & source or held[1] & cluster or (node + 1 << up) <= least:
                continue
            if not up:
                return node >> self.low, node & (1 << self.low) - 1
            waiting += ((up - 1, 2 * node + 1), (up - 1, 2 * node))
        return None


def best_fit(items: list[tuple[int, int, int]], capacity: int, forbid: tuple[bool, bool] = (False, True)) -> list[list[tuple[int, int, int]]]:
    """Bins for items (size, source bit, cluster bit), in the order given: for each item the list of
    (bin, part, size). ``forbid`` says whether one source, one cluster may be in a bin only once.
    Bit numbers below zero never conflict. Of bins of equal residual the first opened is taken.
    """
    opened = sum(max(1, -(-size // capacity)) for size, _, _ in items)
    bins, count, placed = _Bins(capacity, opened), 0, []
    for size, source, cluster in items:
        parts, left, part = [], size, 0
        s = 1 << source if forbid[0] and source >= 0 else 0
        c = 1 << cluster if forbid[1] and cluster >= 0 else 0
        while left > capacity:  # only items beyond the capacity are split
            parts.append((count, part, capacity))
            count, left, part = count + 1, left - capacity, part + 1
        found = bins.tightest(left, s, c)
        if found:
            residual, b = found
            sources, clusters = bins.take(residual, b)
        else:
            residual, b, sources, clusters = capacity, count, 0, 0
            count += 1
        parts.append((b, part, left))
        if residual > left:
            bins.put(residual - left, b, sources | s, clusters | c)
        placed.append(parts)
    return placed


_SHAPE = "group_id string, item_id string, capacity int, shard int, bin int, part int, size int, parts int"


def _bits(values: pd.Series) -> np.ndarray:
    """Bit numbers of values that come more than once; -1 for the others, which can't conflict."""
    shared = values.duplicated(keep=False) & values.notna()
    return pd.factorize(values.where(shared))[0]


def _pack(forbid: tuple[bool, bool]):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = plain_columns(frame).sort_values(["size", "item_id"], ascending=[False, True])
        source, cluster = _bits(frame["source"]), _bits(frame["cluster"])
        capacity = int(frame["capacity"].iloc[0])
        placed = best_fit(list(zip(frame["size"].tolist(), source.tolist(), cluster.tolist())), capacity, forbid)
        rows = [
            (group, item, capacity, shard, b, part, size, len(parts))
            for group, item, shard, parts in zip(frame["group_id"], frame["item_id"], frame["shard"], placed)
            for b, part, size in parts
        ]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _SHAPE.split(", ")])

    return run


def pack_items(items: DataFrame, shard: int = SHARD, forbid: tuple[bool, bool] = (False, True)) -> DataFrame:
    """Containers for ``items`` (group_id, item_id, size, capacity, source, cluster), group by group.

    Returns one row for each item, or each part of a split item: group_id, item_id, capacity, shard, bin
    (numbered within group and shard), part, size, parts. Rows with a null id or size, or with a size or
    capacity below 1, give nothing; of several rows of an item the least by the other columns stands; null
    sources and clusters never conflict. ``forbid`` says whether one source, one cluster may be in a
    container only once.

    A group of more than ``shard`` items is cut by hash of the item ids into shards of about that many,
    so that no task gets an unbounded group, however many of its items are copies. Shards share no
    container, so no conflict can arise between them; each leaves at most one more container less than
    half full.
    """
    items = items.select(
        F.col("group_id").cast("string").alias("group_id"), F.col("item_id").cast("string").alias("item_id"), F.col("size").cast("int").alias("size"),
        F.col("capacity").cast("int").alias("capacity"), F.col("source").cast("string").alias("source"), F.col("cluster").cast("string").alias("cluster"),
    ).filter("group_id is not null and item_id is not null and size >= 1 and capacity >= 1")
    rest = ["size", "capacity", "source", "cluster"]
    items = items.groupBy("group_id", "item_id").agg(F.min(F.struct(*rest)).alias("r")).select("group_id", "item_id", "r.*")
    sizes = items.groupBy("group_id").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"))
    spread = items.join(sizes, "group_id").withColumn("shard", F.pmod(F.xxhash64("item_id"), F.col("shards")).cast("int")).drop("shards")
    return spread.groupBy("group_id", "shard").applyInPandas(_pack(forbid), _SHAPE)


def request_items(requests: DataFrame, candidates: DataFrame, spans: DataFrame) -> DataFrame:
    """(group_id, item_id, size, capacity, source, cluster): each request's candidate spans.

    The budget of a request is its token_budget, 8000 if null. The cluster is the digest of the span's
    text, so that copies do not share a container. Spans that do not exist or have no positive
    token_count give nothing. Late rows of a span with other values: the largest token count holds.
    """
    budget = requests.filter("id is not null").groupBy(F.col("id").alias("group_id")).agg(F.max(F.coalesce("token_budget", F.lit(DEFAULT_BUDGET))).alias("capacity"))
    wanted = candidates.select(F.col("request_id").alias("group_id"), F.col("span_id").alias("item_id")).filter("item_id is not null").distinct()
    size = spans.filter("token_count > 0").groupBy(F.col("id").alias("item_id")).agg(
        F.max("token_count").alias("size"), F.max("artifact_id").alias("source"), F.max(F.when(F.col("text").isNotNull(), F.xxhash64("text"))).cast("string").alias("cluster")
    )
    return wanted.join(budget, "group_id").join(size, "item_id").select("group_id", "item_id", "size", "capacity", "source", "cluster")


def summary(packed: DataFrame) -> DataFrame:
    """(group_id, capacity, bins, used, fill): containers and the share of their space in use."""
    per = packed.groupBy("group_id").agg(
        F.first("capacity").alias("capacity"), F.countDistinct("shard", "bin").alias("bins"), F.sum("size").alias("used")
    )
    return per.withColumn("fill", F.col("used") / (F.col("capacity") * F.col("bins")))


def faults(packed: DataFrame, items: DataFrame, forbid: tuple[bool, bool] = (False, True)) -> DataFrame:
    """(group_id, items, size, overfull, clashes, cut) of each group: what is packed, the containers
    beyond their capacity, the containers that hold a forbidden pair, the items cut without need."""
    bin_key = ["group_id", "shard", "bin"]
    held = packed.join(items.select("group_id", "item_id", "source", "cluster"), ["group_id", "item_id"])
    twice = [F.count(c) > F.countDistinct(c) for c, no in zip(("source", "cluster"), forbid) if no]
    clash = twice[0] if len(twice) == 1 else twice[0] | twice[1] if twice else F.lit(False)
    bins = held.groupBy(*bin_key).agg((F.sum("size") > F.first("capacity")).cast("int").alias("over"), clash.cast("int").alias("clash"))
    bins = bins.groupBy("group_id").agg(F.sum("over").alias("overfull"), F.sum("clash").alias("clashes"))
    whole = packed.groupBy("group_id", "item_id").agg(F.sum("size").alias("size"), F.first("capacity").alias("capacity"), F.max("parts").alias("parts"))
    cut = (F.col("parts") > 1) & (F.col("size") <= F.col("capacity"))
    whole = whole.groupBy("group_id").agg(F.count("*").alias("items"), F.sum("size").alias("size"), F.sum(cut.cast("int")).alias("cut"))
    return whole.join(bins, "group_id").select("group_id", "items", "size", "overfull", "clashes", "cut")
