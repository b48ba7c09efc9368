"""Distributed connected components by contraction, and a local reduction of links to stars.

Each round points every node at the smallest of itself and its neighbours, follows these pointers to their
ends by doubling, renames both ends of every edge and drops what has become a loop. Two neighbours are never
both ends of pointers, so a round leaves at most half of the nodes: a graph of n nodes takes at most log2 n
rounds of at most log2 n doublings, and a path in the order of its ids, whatever its length, a single round.
Once the edges left are few enough for one task (``LOCAL``), that task finishes them. The rounds' maps,
applied one after another, give each node the smallest node of its component. A hub has as many edges as it
likes: minima are combined before the shuffle, and lookups of the many nodes that point at it are salted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import drop, look_up, table

#: Edges that one task takes on at the end.
LOCAL = 100_000


def components(edges: DataFrame, a: str = "a", b: str = "b", local: int = LOCAL, rounds: list[int] | None = None) -> DataFrame:
    """(node, component) for every end of an edge; component is the smallest node reachable.

    Rows with a null end and loops are ignored, so a node that has only those is not returned. Node ids
    may be of any orderable type. Repeated edges count once. ``rounds`` receives each round's number of doublings.
    """
    e = table(
        edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct(),
        "edges",
    )
    labels, left = None, e.count()
    while left > local:
        both = e.select("u", "v").union(e.select("v", "u"))
        step = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("to"))
        step, doublings = table(step, "near"), 0
        while True:
            # ends point at themselves, so they stay; other pointers get twice as long
            ahead = look_up(step, "to", step.toDF("to", "on"), "node").select("node", F.coalesce("on", "to").alias("to"), (F.col("on") != F.col("to")).alias("moved"))
            ahead = table(ahead, "near")
            moved = ahead.where("moved").limit(1).count()
            drop(step)
            step, doublings = ahead.drop("moved"), doublings + 1
            step._millrace_path = ahead._millrace_path
            if not moved:
                break
        if rounds is not None:
            rounds.append(doublings)
        half = table(look_up(e, "u", step.toDF("u", "ru"), "v"), "renamed")
        near = look_up(half, "v", step.toDF("v", "rv"), "u")
        nxt = table(near.where("ru != rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), "edges")
        drop(e, half)
        labels, e, left = _follow(labels, step), nxt, nxt.count()
    if left or labels is None:
        rest = table(e.repartition(1).mapInPandas(_finish, f"node {e.schema['u'].dataType.simpleString()}, to {e.schema['u'].dataType.simpleString()}"), "near")
        labels = _follow(labels, rest)
    drop(e)
    return labels


def _follow(labels: DataFrame | None, step: DataFrame) -> DataFrame:
    """Labels after one more round's map."""
    if labels is None:
        out = step.toDF("node", "component")
        out._millrace_path = step._millrace_path
        return out
    out = look_up(labels, "component", step.toDF("component", "to"), "node").select("node", F.coalesce("to", "component").alias("component"))
    out = table(out, "labels")
    drop(labels, step)
    return out


def _finish(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """node, to: the smallest reachable node of each end of at most ``LOCAL`` edges."""
    p = pd.concat([pd.DataFrame({"u": [], "v": []}, dtype=object), *parts], ignore_index=True).infer_objects()
    nodes, at = np.unique(np.concatenate([p["u"].to_numpy(), p["v"].to_numpy()]), return_inverse=True)
    if len(nodes):
        yield pd.DataFrame({"node": nodes, "to": nodes[local_stars(len(nodes), at[: len(p)], at[len(p) :])]})


def local_stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For ``n`` nodes and links i-j: the smallest node of each node's component, by hooking and pointer jumping."""
    root = np.arange(n)
    while len(i):
        ri, rj = root[i], root[j]
        low, high = np.minimum(ri, rj), np.maximum(ri, rj)
        open_ = low != high
        if not open_.any():
            break
        i, j, low, high = i[open_], j[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root
