"""Connected components over edge tables, with vetoed pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.joins import spread_join
from tidemark.storage import cut_counted, release

#: Edges that a task reduces to their forest at once.
LOT = 500_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the edges (a, b) without their roots' own rows; a root is the smallest node of its tree."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root, p, q = np.arange(len(nodes)), at[: len(a)], at[len(a) :]
    while True:
        x, y = root[p], root[q]
        apart = x != y
        if not apart.any():
            break
        p, q, x, y = p[apart], q[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def local_forests(edges: DataFrame) -> DataFrame:
    """Stars (v, u) that join what the edges (v, u) of each partition join, made in lots, so that a task's memory is bounded."""

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0

        def stars() -> pd.DataFrame:
            u, v = forest(*(np.concatenate([x[c].to_numpy() for x in held]) for c in "uv"))
            return pd.DataFrame({"v": v, "u": u})

        for pdf in batches:
            held.append(pdf)
            n += len(pdf)
            if n >= LOT:
                yield stars()
                held, n = [], 0
        if n:
            yield stars()

    return edges.select("v", "u").mapInPandas(reduce, "v long, u long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by alternating large-star and small-star steps: (node, root), root the smallest node of its component.

    Each partition's edges are first reduced to their own forest. Rows are linear in the edges, only (long, long) rows
    shuffle, every step is checkpointed, and a node with very many neighbours is spread over tasks. Nodes without an edge are
    absent. Self-loops and repeated edges are harmless; edges with a null end are left out.
    """
    now = edges.select(F.least(a, b).cast("long").alias("v"), F.greatest(a, b).cast("long").alias("u")).where("u <> v")
    now, n = cut_counted(local_forests(now).distinct())
    now = local_forests(now)
    while not stars_only(now):
        # Large star: every larger neighbour of a node moves to the node's least neighbour.
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = spread_join(both, least, "u", "v", "n", 2 * n).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: every smaller neighbour of a node, and the node, move to its least neighbour.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now, n = cut_counted(moved)
        now = local_forests(now)
        release(edges.sparkSession)
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return stars.unionByName(roots)


def stars_only(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u: each component is a star around its smallest node."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    seen = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def edge_keys(df: DataFrame, left: str, right: str) -> DataFrame:
    """Unordered keys a < b of distinct pairs; self-pairs and pairs with a null end are left out."""
    return df.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b")).where("a <> b").distinct()


def star_edges(df: DataFrame, node: str, shared: str) -> DataFrame:
    """Edges from every node that has a shared value to the smallest node that has it: linear in the rows."""
    hub = df.groupBy(shared).agg(F.min(node).alias("a")).where(F.col("a").isNotNull())
    linked = df.select(F.col(node).alias("b"), shared).distinct().join(hub, shared)
    return edge_keys(linked, "a", "b")


def dependency_groups(nodes: DataFrame, evidence: DataFrame, node: str, left: str, right: str, state: str, accepted: list[str], rejected: str) -> DataFrame:
    """(node, group_id, members): components over pairs in an accepted state; a rejected pair vetoes its own edges.

    Nodes without edges are groups of their own. A rejected pair that other edges still join is a contradiction: see
    contradictions().
    """
    pairs = evidence.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b"), state).where("a <> b")
    vetoed = pairs.where(F.col(state) == rejected).select("a", "b").distinct()
    edges = pairs.where(F.col(state).isin(accepted)).select("a", "b").distinct().join(vetoed, ["a", "b"], "left_anti")
    roots = components(edges)
    ids = nodes.select(F.col(node).alias("id")).distinct()
    named = ids.join(roots, ids.id == roots.node, "left").select(F.col("id").alias("node"), F.coalesce("root", "id").alias("group_id"))
    sizes = named.groupBy("group_id").agg(F.count("*").alias("members"))
    return named.join(sizes, "group_id").select("node", "group_id", "members")


def contradictions(groups: DataFrame, evidence: DataFrame, left: str, right: str, state: str, rejected: str) -> DataFrame:
    """Rejected pairs whose ends are in one group all the same: (a, b, group_id)."""
    pairs = edge_keys(evidence.where(F.col(state) == rejected), left, right)
    one = groups.select(F.col("node").alias("a"), "group_id")
    two = groups.select(F.col("node").alias("b"), F.col("group_id").alias("other"))
    return pairs.join(one, "a").join(two, "b").where("group_id = other").select("a", "b", "group_id")
