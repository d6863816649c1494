"""Near-duplicates by Order MinHash: minimum occurrence-labelled word 5-mers in text order, verified by alignment."""

from __future__ import annotations

from collections.abc import Iterator
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import FEW, components, cut, cut_counted, release, small, spread_join, stored

MIX = np.uint64(0x9E3779B97F4A7C15)
#: Rows of either side of a block in which all pairs are compared, and cells of the word counts that rule pairs out, few first.
BLOCK, CELLS = 1000, (128, 1024)
#: Centres are given up when fewer than one in so many of their pairs align; the blocks then see all that is left.
FEWER = 50


def mixed(h: np.ndarray) -> np.ndarray:
    """64 bits, well spread."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(33))


class Sketcher:
    """Order MinHash of a list of words: `functions` keys, each from the `least` smallest labelled k-mers in text order."""

    def __init__(self, k: int = 5, least: int = 3, functions: int = 32, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.k, self.least = k, least
        self.seeds = rng.integers(1, 2**63, functions, dtype=np.uint64)
        self.odd = rng.integers(1, 2**63, functions, dtype=np.uint64) | np.uint64(1)
        self.salt = mixed(np.arange(1, functions + 1, dtype=np.uint64))
        self.words: dict[str, int] = {}

    def hashes(self, words: list[str]) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        known = self.words
        if len(known) > 100_000:  # memory is bounded; the cache only saves time
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxh3_64_intdigest(w.encode("utf-8", "replace"))
        return np.fromiter((known[w] for w in words), np.uint64, len(words))

    def keys(self, words: list[str]) -> np.ndarray:
        """One key a function; two texts agree in a key if the same labelled k-mers are least and stand in the same order."""
        h = self.hashes(words)
        n = max(1, len(h) - self.k + 1)
        grams = np.zeros(n, np.uint64)
        for j in range(min(self.k, len(h))):
            grams = (grams + h[j : j + n]) * MIX
        grams = mixed(grams)
        order = np.argsort(grams, kind="stable")
        same = np.zeros(n, np.uint64)
        if n > 1:  # a k-mer's occurrence number
            new = np.r_[True, grams[order][1:] != grams[order][:-1]]
            at = np.arange(n)
            same[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
        labelled = mixed(grams + same * MIX)
        most = min(self.least, n)
        out = np.empty(len(self.seeds), np.uint64)
        step = max(1, 2_000_000 // n)  # memory for very long texts
        for f in range(0, len(self.seeds), step):
            s = slice(f, f + step)
            v = (labelled[None, :] ^ self.seeds[s, None]) * self.odd[s, None]
            low, every = np.empty((len(v), most), np.int64), np.arange(len(v))
            for c in range(most):  # a few minima are found faster one by one than by partition
                low[:, c] = v.argmin(axis=1)
                v[every, low[:, c]] = np.uint64(2**64 - 1)
            low.sort(axis=1)
            key = self.salt[s].copy()
            for c in range(most):
                key = mixed(key * MIX + labelled[low[:, c]])
            out[s] = key
        return out.view(np.int64)


def sketches(docs: DataFrame, k: int, least: int, functions: int) -> DataFrame:
    """(id, digest, n, keys) of docs(id, text): the digest is of the text itself, n counts words."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_128_digest

        tool = Sketcher(k, least, functions)
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                some, rows = pdf.iloc[at : at + 1000], []
                for i, t in zip(some["id"], some["text"]):
                    t = t or ""
                    words = t.lower().split()
                    rows.append((i, xxh3_128_digest(t.encode("utf-8", "replace")), len(words), tool.keys(words) if words else []))
                yield pd.DataFrame(rows, columns=["id", "digest", "n", "keys"])

    return docs.mapInPandas(sketch, "id long, digest binary, n long, keys array<long>")


def letters(text: Column) -> Column:
    """A text's words, one code point each (20 bits of the word's hash): what the alignment compares."""

    @F.pandas_udf("string")
    def spelt(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tool = Sketcher()

        def one(t: str | None) -> str:
            h = mixed(tool.hashes((t or "").lower().split())) % np.uint64(0xF0000) + np.uint64(0x10000)
            return h.astype("<u4").tobytes().decode("utf-32-le")

        for s in batches:
            yield s.map(one, na_action=None)

    return spelt(text)


def at_most(a: np.ndarray, b: np.ndarray, grams: int = 3) -> int:
    """An alignment's edits, from runs of words that both texts have once and in the same order; at least the distance."""
    if min(len(a), len(b)) < grams:
        return max(len(a), len(b))
    g, h = (sum(x[i : len(x) - grams + 1 + i].astype(np.uint64) << np.uint64(21 * i) for i in range(grams)) for x in (a, b))
    one = lambda x: np.unique(x, return_index=True, return_counts=True)
    (u, iu, nu), (v, iv, nv) = one(g), one(h)
    _, p, q = np.intersect1d(u[nu == 1], v[nv == 1], assume_unique=True, return_indices=True)
    i, j = iu[nu == 1][p], iv[nv == 1][q]
    order = np.argsort(i)
    i, j = i[order], j[order]
    if len(j):  # those that stand in order with all others
        fine = (j == np.maximum.accumulate(j)) & (j == np.minimum.accumulate(j[::-1])[::-1])
        i, j = i[fine], j[fine]
    i, j = (np.concatenate([x + k for k in range(grams)]) for x in (i, j))
    at = np.unique(np.stack([i, j], axis=1), axis=0) if len(i) else np.zeros((0, 2), np.int64)
    keep = np.ones(len(at), bool)
    keep[1:] = (np.diff(at[:, 0]) > 0) & (np.diff(at[:, 1]) > 0)
    at = at[keep]
    ends = np.concatenate([[[-1, -1]], at, [[len(a), len(b)]]])
    return int((np.diff(ends, axis=0) - 1).max(axis=1).sum())


def banded(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether the edit distance is at most `most`: columns as bits of whole numbers (Myers), up to where it can't be any more."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return False
    if not n:
        return True
    where: dict[int, int] = {}
    for i, c in enumerate(a.tolist()):
        where[c] = where.get(c, 0) | 1 << i
    full, last = (1 << n) - 1, n - 1
    up, down, score = full, 0, n
    for left, c in zip(range(m - 1, -1, -1), b.tolist()):
        same = where.get(c, 0)
        across = (((same & up) + up) ^ up) | same
        more, less = down | full & ~(across | up), up & across
        score += (more >> last & 1) - (less >> last & 1)
        if score - left > most:
            return False
        more, less, same = more << 1 | 1, less << 1, same | down
        up, down = (less | ~(same | more)) & full, more & same & full
    return score <= most


def aligns(s: str, t: str, similarity: float) -> bool:
    """Whether two texts' letters align with at most (1 - similarity) x the longer length of edits.

    Words that the other text lacks are edits, so too many of them settle it, and so does an alignment along shared runs that
    is good enough; only what is left needs the distance.
    """
    a, b = (np.frombuffer(x.encode("utf-32-le"), "<u4").astype(np.int64) for x in (s, t))
    most = int((1 - similarity) * max(len(a), len(b)) + 1e-9)
    x, y = np.unique(a), np.unique(b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    if max(len(x), len(y)) - both > most:
        return False
    return at_most(a, b) <= most or banded(a, b, most)


def verified(pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b, s, t) that align, without their letters."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fine = [aligns(s, t, similarity) for s, t in zip(pdf["s"], pdf["t"])]
            yield pdf.loc[fine, ["a", "b"]]

    return pairs.select("a", "b", "s", "t").mapInPandas(check, "a long, b long")


def links(block: pd.DataFrame, similarity: float, up: dict[int, int]) -> Iterator[tuple[int, int]]:
    """Pairs (a, b) of a left and a right row that align, enough to join all roots that aligned pairs join; `up` is their forest.

    A pair is looked at in the bucket of the first key that it shares. Lengths and word counts by cell rule most pairs out: an
    edit changes two cells by one at most.
    """

    def top(r: int) -> int:
        while r in up:
            r = up[r]
        return r

    def cells(rows: pd.DataFrame, many: int) -> np.ndarray:
        got = np.empty((len(rows), many), np.int16)
        for i, s in enumerate(rows["s"]):
            got[i] = np.minimum(np.bincount(np.frombuffer(s.encode("utf-32-le"), "<u4") % many, minlength=many), 255)
        return got

    x, y = block[block["is_left"]], block[~block["is_left"]]
    if x.empty or y.empty:
        return
    counts = [(cells(x, many), cells(y, many)) for many in CELLS]
    ids, n, roots, twice, texts = (y[c].to_numpy() for c in ("id", "n", "root", "is_twice", "s"))
    keys, function = np.stack(y["keys"].to_numpy()), int(block["f"].iloc[0])
    for i, row in enumerate(x.itertuples()):
        own = top(row.root)
        most, gap = ((1 - similarity) * np.maximum(n, row.n) + 1e-9).astype(np.int64), np.abs(n - row.n)
        at = np.flatnonzero((roots != row.root) & (gap <= most) & (~twice | (ids > row.id)))
        for p, q in counts:
            at = at[np.abs(q[at] - p[i]).sum(axis=1) + gap[at] <= 2 * most[at]]
        if len(at):
            at = at[(keys[at] == np.asarray(row.keys)).argmax(axis=1) == function]
        for j in at:
            other = top(int(roots[j]))
            if own != other and aligns(row.s, texts[j], similarity):
                up[max(own, other)] = min(own, other)
                own = min(own, other)
                yield min(row.id, int(ids[j])), max(row.id, int(ids[j]))


def apart(now: DataFrame, reps: DataFrame, spelt: DataFrame, similarity: float, total: int) -> DataFrame:
    """Pairs (a, b) that align, enough to join all roots of now(key, f, in, id, n, root) that any aligned pair of a bucket joins.

    The members outside a bucket's largest component meet all members, in a grid of blocks; a block has about BLOCK rows
    a side at most, so a bucket of any size is many tasks, and no pair is left out.
    """
    sizes = now.groupBy("key", "root").agg(F.count("*").alias("in"))
    mixed_ = sizes.groupBy("key").agg(F.sum("in").alias("all"), F.max(F.struct("in", "root")).alias("top"), F.count("*").alias("roots")).where("roots > 1")
    grid = {"rows": F.col("all") - F.col("top.in"), "columns": F.col("all")}
    mixed_ = mixed_.select("key", "all", F.col("top.root").alias("top"), *[F.ceil(c / BLOCK).cast("int").alias(a) for a, c in grid.items()])
    some = stored(spread_join(now.drop("in"), mixed_, "key", "id", "all", total), "apart")
    texts = spelt.join(some.select("id").distinct(), "id", "left_semi").join(reps.select("id", "keys"), "id")
    every = some.join(texts, "id")
    place = lambda blocks: F.pmod(F.xxhash64("id"), F.col(blocks)).cast("int")
    span = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    twice = F.col("root") != F.col("top")
    own = ["f", "id", "n", "root", "keys", "s"]
    one = every.where(twice).select("key", place("rows").alias("i"), span("columns").alias("j"), *own, F.lit(True).alias("is_left"), F.lit(True).alias("is_twice"))
    two = every.select("key", span("rows").alias("i"), place("columns").alias("j"), *own, F.lit(False).alias("is_left"), twice.alias("is_twice"))
    at = ["key", "i", "j"]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up: dict[int, int] = {}

        def found(rows: pd.DataFrame) -> pd.DataFrame:
            block = rows[at].to_numpy()
            ends = [0, *(np.flatnonzero((block[1:] != block[:-1]).any(axis=1)) + 1), len(rows)]
            return pd.DataFrame([p for s, e in zip(ends, ends[1:]) for p in links(rows.iloc[s:e], similarity, up)], columns=["a", "b"], dtype="int64")

        held: list[pd.DataFrame] = []  # the last block may go on in the next batch
        for pdf in batches:
            if not len(pdf):
                continue
            if held and (pdf[at].iloc[-1] == held[0][at].iloc[0]).all():
                held.append(pdf)
                continue
            rows = pd.concat([*held, pdf], ignore_index=True)
            last = int((rows[at] == rows[at].iloc[-1]).all(axis=1).to_numpy().argmax())
            yield found(rows.iloc[:last])
            held = [rows.iloc[last:]]
        if held:
            yield found(pd.concat(held, ignore_index=True))

    return one.unionByName(two).repartition(*at).sortWithinPartitions(*at).mapInPandas(compare, "a long, b long").distinct()


def linked(pairs: DataFrame, n: int, spelt: DataFrame, similarity: float) -> tuple[DataFrame, int]:
    """The n pairs (a, b) whose letters align, and their number."""
    one, two = spelt.select(F.col("id").alias("a"), "s"), spelt.select(F.col("id").alias("b"), F.col("s").alias("t"))
    if n <= FEW:  # few pairs go to the letters' partitions, many are shuffled to them
        both = one.join(small(pairs, n), "a").join(two.join(small(pairs, n), "b"), ["a", "b"])
    else:  # a centre has very many pairs, any other text a few
        sizes = [pairs.groupBy(c).agg(F.count("*").alias("size")) for c in "ab"]
        both = spread_join(pairs, one.join(sizes[0], "a"), "a", "b", "size", n).drop("size")
        both = spread_join(both, two.join(sizes[1], "b"), "b", "a", "size", n)
    return cut_counted(verified(both, similarity).distinct())


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = 0.8, k: int = 5, least: int = 3,
            functions: int = 32, first_keys: int = 4, turns: int = 4) -> DataFrame:
    """(doc_id, class_id, n_copies): one row a distinct id; the class is named by its smallest id.

    Equal texts are copies and are sketched on as one; n_copies counts a text's distinct ids. Texts that share a key
    are candidates, and are linked if their words align with at most (1 - similarity) x the longer length of edits; classes
    are the connected components. Within a bucket of the first keys every text is first aligned with a centre; buckets of
    all keys that still hold several components then choose other centres, for some turns or until that hardly finds links, and
    then all pairs that are still apart are compared, so turns save work and decide nothing. Null counts as empty, and empty
    texts are copies of each other; under k words the whole text is the one k-mer. Rows without an id are left out; rows that
    share an id share its class.
    """
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    sketch = stored(sketches(rows, k, least, functions), "sketches")
    held = sketch.groupBy("digest", "id").agg(F.count("*").alias("rows"))
    copies = cut(held.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.sum("rows").alias("rows")))
    first = copies.select("digest", F.col("rep").alias("id"))
    reps = sketch.join(first, ["digest", "id"]).dropDuplicates(["digest"])  # no hot key: an id has its own texts only
    buckets = reps.select("id", "n", F.posexplode("keys").alias("f", "key"))
    shared = cut(buckets.groupBy("key").agg(F.count("*").alias("in")).where(F.col("in") > 1))
    total = shared.agg(F.sum("in")).first()[0] or 0
    members = stored(spread_join(buckets, shared, "key", "id", "in", total), "buckets")
    # Only the texts that may be aligned are needed further on.
    wanted = members.select("id").distinct()
    spelt = stored(rows.join(wanted, "id", "left_semi").select("id", letters(F.col("text")).alias("s")).distinct(), "letters")

    roots = None

    def rooted(some: DataFrame) -> DataFrame:
        if roots is None:
            return some.withColumn("root", F.col("id"))
        return some.join(roots, some.id == roots.node, "left").select("key", "f", "in", "id", "n", F.coalesce("root", "id").alias("root"))

    def joined(found: DataFrame) -> DataFrame:
        return cut(components(found if roots is None else found.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))))

    for turn in range(turns):
        # The first keys join most groups at the cost of few centres a text; all keys then see what is still apart.
        now = rooted(members if turn else members.where(F.col("f") < first_keys))
        order = F.xxhash64(F.lit(turn), "id") if turn else F.col("id")
        centre = now.groupBy("key").agg(F.min(F.struct(order.alias("o"), "id", "n", "root")).alias("c"), F.min("root").alias("x"), F.max("root").alias("y"), F.first("in").alias("in"))
        centre = centre.where("x <> y").select("key", "c", F.col("in").alias("size"))
        pairs = spread_join(now.drop("in"), centre, "key", "id", "size", total).where("root <> c.root").where(F.least("n", "c.n") >= similarity * F.greatest("n", "c.n"))
        # A text tries one centre of each other component a turn: one link is enough to join them.
        pairs = pairs.groupBy("id", "c.root").agg(F.min("c.id").alias("c"))
        pairs, n = cut_counted(pairs.select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b")).distinct())
        if not n:
            continue
        found, m = linked(pairs, n, spelt, similarity)
        if m:
            roots = joined(found)
        release(docs.sparkSession)
        if turn and m * FEWER < n:
            break

    # What centres left: all pairs of different components in a bucket.
    found, m = cut_counted(apart(rooted(members), reps, spelt, similarity, total))
    if m:
        roots = joined(found)
    release(docs.sparkSession)

    if roots is None:
        named = copies.withColumn("class", F.col("rep"))
    else:
        named = copies.join(roots, copies.rep == roots.node, "left").withColumn("class", F.coalesce("root", "rep"))
    named = named.select("digest", "copies", "rows", "class")
    got = spread_join(sketch.select("id", "digest"), named, "digest", "id", "rows", copies.agg(F.sum("rows")).first()[0] or 0)
    return got.groupBy("id").agg(F.min("class").alias("class_id"), F.max("copies").alias("n_copies")).withColumnRenamed("id", "doc_id")
