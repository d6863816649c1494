"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first to a calibrated width."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, spread_join, stored
from tidemark.llm.vectors import bounded_sample, by_length, matrix, taking_part


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of a vector to the rows of y in double precision, a row's always the same whatever the block."""
    d = y - x
    return np.sqrt(np.einsum("ij,ij->i", d, d))


@dataclass
class Tree:
    """Nodes by number: centres (k, dims) and children of inner nodes; leaf numbers of the others."""

    centres: dict[int, np.ndarray]
    children: dict[int, list[int]]
    leaf: dict[int, int]

    @classmethod
    def fit(cls, sample: np.ndarray, branch: int, size: int, seed: int = 3) -> Tree:
        """k-means with `branch` centres, again within each cluster, until a cluster has at most `size` sampled vectors."""
        rng, tree, todo, made = np.random.default_rng(seed), cls({}, {}, {}), [(0, sample)], 1
        while todo:
            node, x = todo.pop()
            c = kmeans(x, min(branch, len(x)), rng) if len(x) > size else None
            near = nearest(x, c) if c is not None else None
            if near is None or len(np.unique(near)) < 2:
                tree.leaf[node] = len(tree.leaf)
                continue
            c = c[np.unique(near)]
            near = nearest(x, c)
            tree.centres[node], tree.children[node] = c, list(range(made, made + len(c)))
            todo += [(made + i, x[near == i]) for i in range(len(c))]
            made += len(c)
        return tree

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: down the nearest centres."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if node in self.leaf:
                out[at] = self.leaf[node]
            elif len(at):
                near = nearest(x[at], self.centres[node])
                todo += [(c, at[near == i]) for i, c in enumerate(self.children[node])]
        return out

    def order(self, x: np.ndarray) -> Iterator[int]:
        """Leaves by best bin first: a queue of branches by how far the vector is beyond the border to the branch taken."""
        queue, n = [(0.0, 0, 0)], 1
        while queue:
            beyond, _, node = heapq.heappop(queue)
            while node not in self.leaf:
                d2 = ((self.centres[node] - x) ** 2).sum(axis=1)
                first = int(d2.argmin())
                apart = np.sqrt(((self.centres[node] - self.centres[node][first]) ** 2).sum(axis=1))
                border = (d2 - d2[first]) / np.maximum(2 * apart, 1e-12)
                for i, c in enumerate(self.children[node]):
                    if i != first:
                        heapq.heappush(queue, (max(beyond, float(border[i])), n, c))
                        n += 1
                node = self.children[node][first]
            yield self.leaf[node]


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(axis=1)[None, :] - 2 * x @ c.T).argmin(axis=1)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, turns: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(turns):
        near = nearest(x, c)
        c = np.stack([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
    return c


class Nearest:
    """The k nearest rows so far of each of a fixed set of queries (id, v) of one length, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.square = (x * x).sum(axis=1)
        self.limit = np.full(len(ids), np.inf)
        self.best = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)]  # query, distance, id, extra

    def add(self, ids: np.ndarray, y: np.ndarray, extra: np.ndarray, allowed: np.ndarray | None = None) -> None:
        """Rows to choose from; `allowed` says by query which ones. Single rows are measured exactly, all others ruled out by a
        bound on the rounding of the product form."""
        if not len(ids) or not len(self.ids):
            return
        square = (y * y).sum(axis=1)
        near = self.square[:, None] + square[None, :] - 2 * self.x @ y.T
        slack = 1e-12 * y.shape[1] * (self.square.max(initial=0) + square.max(initial=0))
        off = self.ids[:, None] == ids[None, :]
        near[off if allowed is None else off | ~allowed] = np.inf
        k = min(self.k, near.shape[1])
        bound = np.minimum(np.partition(near, k - 1, axis=1)[:, k - 1], self.limit) + 2 * slack
        q, j = np.nonzero((near <= bound[:, None]) & np.isfinite(near))
        d = np.empty(len(q))
        for s in range(0, len(q), 50_000):
            gap = y[j[s : s + 50_000]] - self.x[q[s : s + 50_000]]
            d[s : s + 50_000] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        q, d, i, e = (np.concatenate(c) for c in zip(self.best, (q, d, ids[j], extra[j])))
        order = np.lexsort((i, d, q))
        q, d, i, e = q[order], d[order], i[order], e[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.k
        self.best = [q[keep], d[keep], i[keep], e[keep]]
        full = self.best[0][place[keep] == self.k - 1]
        self.limit[full] = self.best[1][place[keep] == self.k - 1] ** 2


def brute(rows: DataFrame, queries: pd.DataFrame, k: int, extra: str) -> DataFrame:
    """The k nearest rows of each of a bounded set of queries (id, v), by a stream over all rows: (q, d, id, extra); q is the
    query's place in the set."""
    asked = [(at, queries["id"].to_numpy()[at], matrix(queries["v"].iloc[at])) for at in by_length(queries["v"]).values()]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = {x.shape[1]: (at, Nearest(ids, x, k)) for at, ids, x in asked}
        for pdf in batches:
            for d, own in by_length(pdf["v"]).items():
                if d in found:
                    some = pdf.iloc[own]
                    found[d][1].add(some["id"].to_numpy(), matrix(some["v"]), some[extra].to_numpy())
        for at, best in found.values():
            q, d, i, e = best.best
            yield pd.DataFrame({"q": at[q], "d": d, "id": i, extra: e})

    found = rows.select("id", "v", extra).mapInPandas(scan, f"q long, d double, id long, {extra} long")
    w = Window.partitionBy("q").orderBy("d", "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(df: DataFrame, queries: DataFrame, k: int = 10, recall: float = 0.98, vec_id: str = "vec_id", vector: str = "embedding",
           sample: int = 20_000, branch: int = 8, leaf: int = 256, probes: int = 128, block: int = 4096, lot: int = 65_536) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows of df found, by Euclidean distance in double precision.

    Vectors are compared with vectors of their own length; each length that the sample has is a tree of its own. Trees are fit
    on at most `sample` vectors and index every row. Best-bin-first visits widen until `recall` of the true neighbours of
    `probes` sampled rows of the length, found by brute force over all rows, lies in the leaves visited; that many leaves are
    visited for each query. Leaves are packed into bins of about `block` rows, a leaf with very many rows into many. A task
    holds a bin and streams the queries that visit it; a bin that very many visit is copied, once a `lot` of queries. The k
    best of each bin are merged. A query's own row (same id) is no candidate; ties go to the smaller id; query rows that share
    an id are separate, equal ones are one. Null, zero and non-finite vectors take no part.
    """
    spark = df.sparkSession
    rows = taking_part(df, vec_id, vector)
    lengths = [r.d for r in rows.groupBy(F.size("v").alias("d")).count().collect()]  # one row a length
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    seen, trees, first, at = bounded_sample(rows, sample, 17), {}, {}, 0
    for d in sorted(lengths):
        trees[d] = Tree.fit(seen[d] if d in seen else np.zeros((1, d)), branch, leaf)  # a length that the sample hasn't is one leaf
        first[d], at = at, at + len(trees[d].leaf)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = np.zeros(len(pdf), np.int64)
            for d, own in by_length(pdf["v"]).items():
                out[own] = trees[d].assign(matrix(pdf["v"].iloc[own])) + first[d]
            yield pdf.assign(leaf=out)

    kind = dict(rows.dtypes)["v"]
    indexed = stored(rows.mapInPandas(assign, f"id long, v {kind}, leaf long"), "index")
    sizes = {r.leaf: r.n for r in indexed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # one row a leaf of the trees
    width = calibrated(trees, first, indexed, k, recall, probes)
    bins = packed(sizes, block)

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A query goes once to each bin that it visits, with its leaves there."""
        names = ["id", "v", "bin", "leaves"]
        for pdf in batches:
            out = []
            for i, v in zip(pdf["id"], pdf["v"]):
                here: dict[int, list[int]] = {}
                if (d := len(v)) in trees:
                    for _, f in zip(range(width[d]), trees[d].order(np.asarray(v, np.float64))):
                        start, parts = bins.get(f + first[d], (0, 0))
                        for b in range(start, start + parts):
                            here.setdefault(b, []).append(f + first[d])
                out += [(i, v, b, fs) for b, fs in here.items()]
                if len(out) > 2000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = [bins[f][0] + h % bins[f][1] for f, h in zip(pdf["leaf"], pdf["h"])]
            yield pdf.drop(columns="h").assign(bin=np.array(at, np.int64))

    asked = taking_part(queries, vec_id, vector).distinct()
    asked = stored(asked.mapInPandas(visits, f"id long, v {kind}, bin long, leaves array<long>"), "visits")
    visited = cut(asked.groupBy("bin").agg(F.count("*").alias("n")).withColumn("lots", F.ceil(F.col("n") / lot).cast("int")))
    cells = indexed.withColumn("h", F.pmod(F.xxhash64("id"), F.lit(1 << 31))).mapInPandas(place, f"id long, v {kind}, leaf long, bin long")
    cells = cells.join(visited, "bin").withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
    cells = cells.select("bin", "lot", F.lit(0).alias("asks"), "id", "v", F.array("leaf").alias("leaves"))
    total = visited.agg(F.sum("n")).first()[0] or 0
    asked = spread_join(asked, visited, "bin", "id", "n", total).withColumn("lot", F.pmod(F.xxhash64("id", F.lit(6)), F.col("lots")).cast("int"))
    both = cells.unionByName(asked.select("bin", "lot", F.lit(1).alias("asks"), "id", "v", "leaves"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []
        for pdf in batches:
            if not len(pdf):
                continue
            key = pdf[["bin", "lot", "asks"]].to_numpy()
            ends = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1), len(pdf)]
            for s, e in zip(ends, ends[1:]):
                b, n, asks = key[s]
                if (b, n) != now:
                    now, held = (b, n), []
                if not asks:
                    held.append(pdf.iloc[s:e])
                elif held:
                    held = [pd.concat(held)] if len(held) > 1 else held
                    yield answered(pdf.iloc[s:e], held[0], k)

    laid = both.repartition("bin", "lot").sortWithinPartitions("bin", "lot", "asks")
    found = laid.mapInPandas(scan, "query_id long, form long, vec_id long, score double")
    w = Window.partitionBy("query_id", "form").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def answered(asked: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest of a bin's rows to each query, within the leaves that it visits; `form` tells vectors of one query id apart."""
    from xxhash import xxh3_64_intdigest

    ids, leaves, out = rows["id"].to_numpy(), np.array([x[0] for x in rows["leaves"]], np.int64), []
    vectors = by_length(rows["v"])
    for d, own in by_length(asked["v"]).items():
        if d not in vectors:
            continue
        at, some = vectors[d], asked.iloc[own]
        y, x = matrix(rows["v"].iloc[at]), matrix(some["v"])
        for s in range(0, len(some), 256):
            part = some.iloc[s : s + 256]
            allowed = np.stack([np.isin(leaves[at], f) for f in part["leaves"]])
            best = Nearest(part["id"].to_numpy(), x[s : s + 256], k)
            best.add(ids[at], y, ids[at], allowed)
            q, dist, i, _ = best.best
            form = np.array([xxh3_64_intdigest(v.tobytes()) >> 1 for v in x[s : s + 256]], np.int64)
            out.append(pd.DataFrame({"query_id": part["id"].to_numpy()[q], "form": form[q], "vec_id": i, "score": dist}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "form": [], "vec_id": [], "score": []})


def packed(sizes: dict[int, int], block: int) -> dict[int, tuple[int, int]]:
    """The first bin of each leaf and how many it has: neighbouring leaves share one of about `block` rows, a larger leaf has
    several of its own."""
    bins, at, held = {}, 0, 0
    for f, n in sorted(sizes.items()):
        if held and held + n > block:
            at, held = at + 1, 0
        parts = max(1, math.ceil(n / block))
        bins[f] = at, parts
        at, held = at + parts - 1, held + n if parts == 1 else block
    return bins


def calibrated(trees: dict[int, Tree], first: dict[int, int], indexed: DataFrame, k: int, recall: float, probes: int) -> dict[int, int]:
    """How many leaves of each tree to visit so that `recall` of its probes' true neighbours lie in them."""
    width = {d: len(t.leaf) for d, t in trees.items()}
    several = [d for d, n in width.items() if n > 1]
    if not several:
        return width
    w = Window.partitionBy(F.size("v")).orderBy(F.xxhash64(F.lit(29), "id"), "id")
    some = indexed.where(F.size("v").isin(several)).withColumn("place", F.row_number().over(w)).where(F.col("place") <= probes)
    asked = some.select("id", "v").toPandas()  # `probes` rows a tree
    truth = brute(indexed, asked, k, "leaf").select("q", "leaf").toPandas()
    order = [{f: n for n, f in enumerate(trees[len(v)].order(np.asarray(v, np.float64)))} for v in asked["v"]]
    size = np.array([len(v) for v in asked["v"]])
    for d in several:
        own = truth[size[truth["q"].to_numpy(int)] == d]
        need = np.sort([order[q][f - first[d]] + 1 for q, f in zip(own["q"], own["leaf"])])
        if len(need):
            width[d] = int(need[max(0, math.ceil(recall * len(need)) - 1)])
    return width
