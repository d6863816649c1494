"""Exact range join of vectors by angle: pivots make cells, the triangle inequality sets who is copied over a border."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components, cut, spread_join, stored
from tidemark.llm.vectors import bounded_sample, by_length, matrix, taking_part

#: Added to bounds that prune, never to the decision itself, so that rounding can't lose a pair.
SLACK = 1e-6
#: Pairs that are compared in the time that it takes to copy a vector to another task.
COPY = 1000


def unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1, keepdims=True)
    x = x / big
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def pivots_for(sample: np.ndarray, most: int, reach: float) -> np.ndarray:
    """Up to `most` unit pivots from a sample, each the farthest from those before it; none closer than `reach`."""
    x = unit(sample)
    chosen, far = [0], np.linalg.norm(x - x[0], axis=1)
    while len(chosen) < most and far.max() > reach:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(x - x[chosen[-1]], axis=1))
    return x[chosen]


class Cells:
    """The cells around pivots: where a unit vector is at home, and which cells may hold a partner of it at home."""

    def __init__(self, pivots: np.ndarray, r: float):
        self.pivots, self.r = pivots, r
        self.apart = np.linalg.norm(pivots[:, None] - pivots[None], axis=2)
        self.radius = np.full(len(pivots), 2.0)

    def homes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest pivot and the squared distances to all."""
        d2 = np.maximum(2 - 2 * x @ self.pivots.T, 0)
        return d2.argmin(axis=1), d2

    def reach(self, near: np.ndarray, d2: np.ndarray) -> np.ndarray:
        """Which cells before its own a vector is copied to: a pair of two cells meets in the lower one, by the triangle
        inequality through either pivot, the cell's radius, and the border between both pivots."""
        d = np.sqrt(d2)
        mine = d[np.arange(len(near)), near][:, None]
        border = (d2 - mine**2) / np.maximum(2 * self.apart[near], 1e-12)
        fine = (d <= mine + 2 * self.r + SLACK) & (d <= self.radius[None, :] + self.r + SLACK) & (border <= self.r + SLACK)
        return fine & (np.arange(len(self.pivots))[None, :] < near[:, None])


def cells_for(sample: np.ndarray, n: int, most: int, r: float, block: int) -> Cells:
    """Cells for n vectors that look like the sample, with as many of the pivots as promise the least work.

    Work is pairs compared, and COPY of them for every copy of a vector; both are counted on the sample. Without structure in the
    vectors no cell is ruled out, and few cells are then the cheapest; with it many are.
    """
    x, pivots = unit(sample), pivots_for(sample, most, r)
    best, many = None, 1
    while True:
        cells = Cells(pivots[: min(many, len(pivots))], r)
        near, d2 = cells.homes(x)
        share = n / len(x)
        home = np.bincount(near, minlength=len(cells.pivots)) * share
        copies = cells.reach(near, d2).sum(axis=0) * share
        h, k = np.ceil(home / block), np.ceil(copies / block)
        work = (home * home / 2 + home * copies + COPY * (home * (h + k) + copies * h)).sum()
        if best is None or work < best[0]:
            best = work, cells
        if many >= len(pivots):
            return best[1]
        many *= 2


def joined(df: DataFrame, cosine: float = 0.95, vec_id: str = "vec_id", vector: str = "embedding", sample: int = 8192,
           most_pivots: int = 256, block: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id): one row a distinct id.

    Two rows are linked if their vectors have one length and the cosine of both, in double precision, is `cosine` or more;
    n_links counts the other ids linked directly, and components are those of the links. Null, zero and non-finite vectors
    link with nothing. Rows without an id are left out; for an id with several rows, links to the same id don't count, and
    links of each row do.

    On unit vectors that is a range join with radius r = sqrt(2 - 2 cosine). A vector's home is the cell of its nearest pivot;
    it is copied to every lower cell where a vector within r of it can be at home: see Cells. So each pair meets in one
    cell, and both sides count it. Equal vectors are joined once, as one with a number of copies. A cell is a grid of blocks of about
    `block` rows (by default what 8 MB of numbers hold), so no task holds a whole cell, and a task returns counts and a spanning
    forest of its links, never all pairs. Blocks are compared in single precision with a margin, and what is near the
    threshold or above it in double precision. Pivots come from at most `sample` distinct vectors.
    """
    rows = df.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"))
    everyone = rows.select("id").distinct()
    # One row for each distinct vector, by 128 bits of hash: its least id stands for the ids that have it.
    hashed = taking_part(rows, "id", "v").withColumn("h", F.concat(F.hex(F.xxhash64("v")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), "v"))))
    held = cut(hashed.select("id", "h").distinct())
    shared = held.groupBy("h").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    one = hashed.groupBy("h").agg(F.first("v").alias("v"))
    reps = stored(one.join(shared, "h").withColumn("id", F.monotonically_increasing_id()), "distinct")  # once written, the number stays
    lengths = {r.d: r.n for r in reps.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}  # one row a length
    r = math.sqrt(max(0.0, 2 - 2 * cosine))
    if not lengths:
        return everyone.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    seen, cells, first, at = bounded_sample(reps, sample, 5), {}, {}, 0
    for d, n in sorted(lengths.items()):
        size = block or max(1024, (1 << 20) // d)
        # A length that the sample hasn't is rare: any one unit vector will do as its pivot.
        cells[d] = cells_for(seen[d], n, most_pivots, r, size) if d in seen else Cells(np.eye(1, d), r)
        first[d], at = at, at + len(cells[d].pivots)
    counts, copied, blocks = np.zeros(at, np.int64), np.zeros(at, np.int64), np.array([block or max(1024, (1 << 20) // d) for d in sorted(lengths) for _ in cells[d].pivots])

    def each(pdf: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]]:
        for d, own in by_length(pdf["v"]).items():
            near, d2 = cells[d].homes(unit(matrix(pdf["v"].iloc[own])))
            yield first[d], pdf.iloc[own], near, d2, cells[d]

    def homes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start, _, near, d2, _ in each(pdf):
                far = np.sqrt(d2[np.arange(len(near)), near])
                yield pd.DataFrame({"cell": near + start, "far": far, "n": 1}).groupby("cell").agg(far=("far", "max"), n=("n", "sum")).reset_index()

    sizes = reps.select("v").mapInPandas(homes, "cell long, far double, n long").groupBy("cell").agg(F.max("far").alias("far"), F.sum("n").alias("n")).collect()
    for c in cells.values():
        c.radius[:] = -math.inf
    place = {start + i: (d, i) for d, start in first.items() for i in range(len(cells[d].pivots))}
    for s in sizes:  # one row a pivot
        counts[s.cell] = s.n
        d, i = place[s.cell]
        cells[d].radius[i] = s.far

    def reached(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start, _, near, d2, own in each(pdf):
                n = own.reach(near, d2).sum(axis=0)
                hit = np.flatnonzero(n)
                yield pd.DataFrame({"cell": hit + start, "n": n[hit]})

    if at > len(cells):
        for s in reps.select("v").mapInPandas(reached, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # one row a pivot
            copied[s.cell] = s.n
    rows_of, columns_of = np.maximum(1, -(-counts // blocks)), -(-copied // blocks)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Home blocks meet each other once, and every block of copies; x is always a home block, y >= rows_of is one of copies."""
        for pdf in batches:
            for start, some, near, d2, own in each(pdf):
                slot, everybody = some["id"].to_numpy() * 0x9E3779B1 % (1 << 31), np.arange(len(some))
                home = near + start
                mine, wide = slot % rows_of[home], (rows_of + columns_of)[home]
                k = np.repeat(everybody, wide)
                other = np.arange(len(k)) - np.repeat(np.cumsum(wide) - wide, wide)
                x = np.where(other < rows_of[home[k]], np.minimum(mine[k], other), mine[k])
                y = np.where(other < rows_of[home[k]], np.maximum(mine[k], other), other)
                left = (other >= rows_of[home[k]]) | (mine[k] <= other)
                i, c = np.nonzero(own.reach(near, d2))
                c = c + start
                tall = rows_of[c]
                m = np.repeat(np.arange(len(i)), tall)
                over = np.arange(len(m)) - np.repeat(np.cumsum(tall) - tall, tall)
                column = rows_of[c[m]] + slot[i[m]] % np.maximum(columns_of[c[m]], 1)
                rows_ = np.concatenate([k, i[m]])
                out = some[["rep", "copies", "v"]].iloc[rows_].reset_index(drop=True)
                yield out.assign(cell=np.concatenate([home[k], c[m]]), x=np.concatenate([x, over]), y=np.concatenate([y, column]), left=np.concatenate([left, np.zeros(len(m), bool)]), id=some["id"].to_numpy()[rows_])

    kind = dict(reps.dtypes)["v"]
    dealt = reps.mapInPandas(deal, f"rep long, copies long, v {kind}, cell long, x long, y long, left boolean, id long")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["left"]], pdf[~pdf["left"]]
        same = pdf["x"].iloc[0] == pdf["y"].iloc[0]
        b = a if same else b
        nothing = pd.DataFrame({"id": [], "n": [], "a": [], "b": []}, dtype="Int64")
        if not len(a) or not len(b):
            return nothing
        x, own = unit(matrix(a["v"])), a["rep"].to_numpy()
        y, names = (x, own) if same else (unit(matrix(b["v"])), b["rep"].to_numpy())
        weigh, weight = a["copies"].to_numpy(float), b["copies"].to_numpy(float)
        total, count = np.zeros(len(a)), np.zeros(len(b))
        forest = Forest(np.concatenate([own, names]))
        pa, pb = forest.number(own), forest.number(names)
        near, yt = x.astype(np.float32), y.astype(np.float32).T
        margin, step = 1e-5 + 2.4e-7 * x.shape[1], max(1, 2_000_000 // len(b))  # more than single precision can be off
        for s in range(0, len(a), step):
            score = near[s : s + step] @ yt
            i, j = np.nonzero(score >= np.float32(cosine - margin))
            fine = score[i, j] >= np.float32(cosine + margin)
            i += s
            if same:
                i, j, fine = (c[i < j] for c in (i, j, fine))
            # What is near the threshold is decided by the cosine itself, in double precision.
            doubt = np.flatnonzero(~fine)
            for t in range(0, len(doubt), 50_000):
                d = doubt[t : t + 50_000]
                fine[d] = np.einsum("ij,ij->i", x[i[d]], y[j[d]]) >= cosine
            i, j = i[fine], j[fine]
            if not len(i):
                continue
            total += np.bincount(i, weight[j], len(a))
            count += np.bincount(j, weigh[i], len(b))
            one = np.unique(i, return_index=True)[1]
            forest.link(pa[i[one]], pb[j[one]])  # most links are then within one tree
            forest.link(pa[i], pb[j])
        if same:
            total, count = total + count, np.zeros(len(b))
        edges, p, q = forest.edges(), np.flatnonzero(total), np.flatnonzero(count)
        return pd.concat([
            pd.DataFrame({"id": np.concatenate([a["id"].to_numpy()[p], b["id"].to_numpy()[q]]), "n": np.concatenate([total[p], count[q]]).astype(np.int64), "a": pd.NA, "b": pd.NA}, dtype="Int64"),
            pd.DataFrame({"id": pd.NA, "n": pd.NA, "a": [e[0] for e in edges], "b": [e[1] for e in edges]}, dtype="Int64"),
        ])

    found = stored(dealt.groupBy("cell", "x", "y").applyInPandas(meet, "id long, n long, a long, b long"), "links")
    links = found.where("id is not null").groupBy("id").agg(F.sum("n").alias("n"))
    counted = reps.join(links, "id", "left").select("h", F.col("rep"), "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    # Ids with equal vectors are a component too; an id with several vectors ties theirs together. A vector may have most of the ids.
    same = cut(spread_join(held, counted, "h", "id", "copies", held.count()).select("id", "rep", "n_links"))
    edges = found.where("a is not null").select("a", "b").unionByName(same.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")))
    roots = components(edges)
    own = same.groupBy("id").agg(F.sum("n_links").alias("n_links"))
    out = everyone.join(own, "id", "left").join(roots, F.col("id") == F.col("node"), "left")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "id").alias("component_id"))


class Forest:
    """Trees over a fixed set of numbers, linked by arrays of pairs; they come out as edges to their least members."""

    def __init__(self, members: np.ndarray):
        self.members = np.unique(members)
        self.label = np.arange(len(self.members))

    def number(self, members: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.members, members)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        p, q = self.label[a], self.label[b]
        apart = np.unique(np.stack([np.minimum(p, q), np.maximum(p, q)])[:, p != q], axis=1)
        if not apart.size:
            return
        up = np.arange(len(self.label))

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        for x, y in apart.T.tolist():
            x, y = top(x), top(y)
            up[max(x, y)] = min(x, y)
        while (again := up[up] != up).any():
            up[again] = up[up[again]]
        self.label = up[self.label]

    def edges(self) -> list[tuple[int, int]]:
        least = self.members[self.label]
        moved = least != self.members
        return list(zip(self.members[moved].tolist(), least[moved].tolist()))


def sql(embeddings: str = "embeddings") -> str:
    """The query's result in DuckDB's SQL, for a table small enough to compare all pairs."""
    return f"""
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM {embeddings}),
n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS size FROM e WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND a.size > 0 AND b.size > 0 WHERE list_dot_product(a.v, b.v) / (a.size * b.size) >= 0.95),
w AS (SELECT vec_id AS n, vec_id AS r FROM e UNION SELECT l.b, w.r FROM w JOIN l ON l.a = w.n),
c AS (SELECT n, min(r) AS component_id FROM w GROUP BY n), k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM e JOIN c ON c.n = vec_id LEFT JOIN k ON k.a = vec_id"""
