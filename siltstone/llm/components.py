"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import HOT_SHARE, discard, materialise

#: Edges that a task contracts at once. No more edges than these are settled by that alone; more of them go on in rounds.
LOCAL_EDGES = 200_000


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a task's edges (u, v): one edge for each node but the smallest of its component among these edges, to that one."""
    parent: dict = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up] = parent.setdefault(up, up)
            x = parent[x]
        return x

    schema = None
    for batch in batches:
        schema = batch.schema
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    if parent:
        found = [(x, r) for x in parent if (r := root(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], schema.field(k).type) for k in (0, 1)], names=["u", "v"])


def components(edges: DataFrame, name: str, rounds: int = 60, local: int = LOCAL_EDGES) -> DataFrame:
    """node, root (the smallest node reachable) for every node of edges(a, b).

    Tasks of at most ``local`` edges, about, contract what they have to stars. Where that took more than one task, large
    and small stars alternate until nothing changes. Only minima are gathered per node then, so a node with very many
    edges is pre-aggregated like any other. The minima are written before they meet the edges again: of nodes with over
    1/HOT_SHARE of all edges they are broadcast, HOT_SHARE at most, and no task gathers the edges of a hot node. What a
    round has written is deleted when the next has.
    """
    first = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    kind = first.schema["u"].dataType.simpleString()
    parts = max(1, -(-first.count() // local))
    # a coalesced read: the tasks take whole files, and no more than a stated number of edges in all
    now = materialise(first.coalesce(parts).mapInArrow(contracted, f"u {kind}, v {kind}"), name)
    discard(first)
    state = None
    for _ in range(rounds if parts > 1 else 0):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), name)
        large = _with_minima(both, low).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, name)
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), name)
        small = _with_minima(large, least)
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        last, now = now, materialise(small, name)
        discard(last, low, large, least)
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == state:
            break
        state = seen
    else:
        if parts > 1:
            raise RuntimeError("the components have not settled")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _with_minima(edges: DataFrame, low: DataFrame) -> DataFrame:
    """edges(u, v) with m of their u. A hot node's minimum comes by broadcast; edges of other nodes are shuffled."""
    total, most = low.agg(F.sum("n"), F.max("n")).first()
    bound = max((total or 0) // HOT_SHARE, 1000)
    if (most or 0) <= bound:
        return edges.join(low.select("u", "m"), "u")
    hot = F.broadcast(low.filter(F.col("n") > bound).select("u", F.col("m").alias("hot_m")))
    cold = low.filter(F.col("n") <= bound).select(F.col("u"), "m")
    at_hot = edges.join(hot, "u").select("u", "v", F.col("hot_m").alias("m"))
    return at_hot.unionByName(edges.join(hot, "u", "left_anti").join(cold, "u").select("u", "v", "m"))
