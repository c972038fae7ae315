"""Filling fixed-capacity containers: conflict-constrained best fit, decreasing.

Items are spread evenly over shards by hash, whatever their source or duplicate cluster, so no shard is larger than the
others and each is packed by one task. There the open bins are kept in order of their residual capacity; each carries
a bitmap of its sources and one of its duplicate clusters. An item takes the tightest bin that is large enough and
compatible: the search starts at the smallest sufficient residual and goes on to its successors. Copies of one text have
one size and come one after another, so their search goes on where the last one ended. An item that exceeds the capacity
by itself is cut into full pieces, which fill a container each, and one remainder, which is packed like any item.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items that one shard should hold.
SHARD_ITEMS = 20_000


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int, apart: dict[int, int]) -> list[int]:
    """The bin of each item; ``apart`` maps a source bit to the bits that may not share a bin with it.

    Two items of one cluster never share a bin. Items are no larger than ``capacity``.
    """
    several = {c: i for i, (c, n) in enumerate(x for x in Counter(clusters).items() if x[1] > 1)}
    out = [0] * len(sizes)
    bins: list[tuple[int, int, int, int]] = []  # (residual, number, source bits, cluster bits)
    opened = 0
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], clusters[i], sources[i]))
    at = 0
    while at < len(order):
        size, cluster = sizes[order[at]], clusters[order[at]]
        mark = 1 << several[cluster] if cluster in several else 0
        place, waiting = bisect_left(bins, (size,)), []
        before = None
        while at < len(order) and sizes[order[at]] == size and clusters[order[at]] == cluster:
            item = order[at]
            bit = 1 << sources[item]
            if bit != before:  # another source may use bins that the last one passed by
                place, before = bisect_left(bins, (size,)), bit
            barred = apart.get(bit, 0)
            while place < len(bins) and (bins[place][2] & barred or bins[place][3] & mark):
                place += 1
            if place < len(bins):
                residual, number, has_sources, has_clusters = bins.pop(place)
            else:
                residual, number, has_sources, has_clusters = capacity, opened, 0, 0
                opened += 1
            out[item] = number
            if residual > size:
                waiting.append((residual - size, number, has_sources | bit, has_clusters | mark))
            at += 1
            if not mark:
                break
        for x in waiting:
            insort(bins, x)
    return out


def packed(sized: DataFrame, containers: DataFrame, apart: tuple[tuple[str, str], ...] = (), shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(container, bin, doc_id, piece, tokens): every item of ``sized`` (doc_id, source, cluster, tokens) in a bin of
    each container size of ``containers`` (container, capacity_tokens).

    No bin exceeds its capacity or holds two items of one cluster or sources that ``apart`` names. Null sources are one
    source of their own; containers without a positive capacity are left out; repeated doc_ids are items of their own.
    """
    sizes = F.broadcast(containers.filter("container is not null and capacity_tokens > 0").groupBy("container").agg(F.max("capacity_tokens").alias("capacity")))
    pieces = sized.crossJoin(sizes).withColumn("n", F.ceil(F.col("tokens") / F.col("capacity")).cast("int"))
    pieces = pieces.withColumn("piece", F.explode(F.sequence(F.lit(1), F.col("n"))))
    pieces = pieces.withColumn("tokens", F.when(F.col("piece") < F.col("n"), F.col("capacity")).otherwise(F.col("tokens") - (F.col("n") - 1) * F.col("capacity")))
    full = pieces.filter(F.col("tokens") == F.col("capacity")).select("container", F.concat_ws("-", F.lit("full"), "doc_id", "piece").alias("bin"), "doc_id", "piece", "tokens")
    shards = max(1, -(-sized.count() // shard_items))
    rest = pieces.filter(F.col("tokens") < F.col("capacity")).withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int"))

    def pack(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        names = {s: i for i, s in enumerate(sorted(items["source"].fillna("").unique()))}
        barred: dict[int, int] = {}
        for a, b in apart:
            if a in names and b in names:
                for x, y in ((a, b), (b, a)):
                    barred[1 << names[x]] = barred.get(1 << names[x], 0) | 1 << names[y]
        got = best_fit(items["tokens"].tolist(), items["source"].fillna("").map(names).tolist(), items["cluster"].tolist(), int(items["capacity"].iloc[0]), barred)
        return pd.DataFrame({"container": items["container"], "bin": [f"{key[1]}-{b}" for b in got], "doc_id": items["doc_id"], "piece": items["piece"], "tokens": items["tokens"]})

    kind = dict(sized.dtypes)["doc_id"]
    best = rest.select("container", "capacity", "shard", "doc_id", "source", "cluster", "piece", "tokens").groupBy("container", "shard")
    return full.unionByName(best.applyInPandas(pack, f"container string, bin string, doc_id {kind}, piece int, tokens int"))


def fill_rates(bins: DataFrame, containers: DataFrame) -> DataFrame:
    """(container, bins, items, tokens, fill): how full the bins of each container are, as a share of their capacity."""
    sums = bins.groupBy("container").agg(F.count_distinct("bin").alias("bins"), F.count(F.lit(1)).alias("items"), F.sum("tokens").alias("tokens"))
    return sums.join(F.broadcast(containers.select("container", "capacity_tokens")), "container").select("container", "bins", "items", "tokens", F.round(F.col("tokens") / (F.col("bins") * F.col("capacity_tokens")), 6).alias("fill"))
