"""Mixing sources to target weights: certain whole copies first, then Pareto order sampling of the rest."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.stats import running
from tidemark.llm.common import FEW, cut, spread_join

#: What separates words: space, and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources by code point, repeated; the share of all sizes to mix; the most copies of a document.
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2
#: Bins of ranks that a pass over a source's documents counts; the bin of the cut is divided again, and then sorted.
BINS = 4096
#: Documents on either side of a cut by which it can move.
NEAR = 1024


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> dict:
    """Each source's target: its share by weight, at most `most` times its size, the excess shared again by weight until
    none is above. Sources by code point, null last. The plain form of `shared`, for a few sources."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in capped]
        level = (total - sum(most * sizes[s] for s in capped)) / sum(weight[s] for s in open_) if open_ else 0.0
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not over:
            return {s: float(most * sizes[s]) if s in capped else level * weight[s] for s in names}
        capped |= over


def shared(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources(s, n) with `target`, as targets() has it, without gathering them: ranks are running counts, and a round of the
    sharing is one sum over all sources. UTF-8 sorts by code point."""
    named = sources.withColumns({"__null": F.col("s").isNull(), "__name": F.coalesce("s", F.lit(""))})
    order = running(named, [], ["__null", "__name"], {"__place": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("__place") - 1, F.lit(len(weights))) + 1).cast("int"))
    now = cut(order.select("s", "n", weight.alias("w"), F.lit(False).alias("capped")))
    total = share * (now.agg(F.sum("n")).first()[0] or 0)
    while True:
        one = now.agg(F.sum(F.when(F.col("capped"), F.col("n") * most).otherwise(0.0)).alias("full"), F.sum(F.when(~F.col("capped"), F.col("w"))).alias("open")).first()
        level = (total - one.full) / one.open if one.open else 0.0
        over = ~F.col("capped") & (F.lit(level) * F.col("w") > F.col("n") * most)
        if now.where(over).isEmpty():
            return now.select("s", "n", F.when(F.col("capped"), F.col("n") * float(most)).otherwise(F.lit(level) * F.col("w")).alias("target"))
        now = cut(now.withColumn("capped", F.col("capped") | over))


def rank(u: Column, odds: Column) -> Column:
    """Pareto's rank, mapped to 0..1: random odds over inclusion odds, q / (1 + q)."""
    q = u / (1 - u) / odds
    return q / (1 + q)


def joined(rows: DataFrame, table: DataFrame, on: str, by: str, size: str, how: str = "inner") -> DataFrame:
    """rows with the row of a table of one row a key: broadcast if it is counted and small, else joined with hot keys dealt out."""
    sums = table.agg(F.count("*").alias("n"), F.sum(size).alias("rows")).first()
    if sums.n <= FEW:
        return rows.join(F.broadcast(table.drop(size)), on, how)
    return spread_join(rows, table, on, by, size, sums.rows, how).drop(size)


def planned(small: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (s, size, key, relative) of all documents: (name, total, target, whole, rest, docs) of each source, and (cell, of, at, last):
    the rank and key of the last document taken of each cell, the documents of a source in an octave of sizes."""
    sums = cut(small.groupBy("s").agg(F.sum("size").alias("n"), F.count("*").alias("docs")))
    goal = shared(sums.select("s", "n")).select(F.col("s").alias("t"), "target")
    each = F.when(F.col("total") > 0, F.col("target") / F.greatest("total", F.lit(1))).otherwise(0.0)
    plan = sums.withColumnRenamed("n", "total").join(goal, F.col("s").eqNullSafe(F.col("t"))).withColumn("each", each)
    whole = F.least(F.floor(F.col("each") + 1e-9), F.lit(MOST)).cast("int")
    plan = plan.select(named(F.col("s")).alias("name"), "total", "target", "docs", whole.alias("whole"), F.greatest(F.col("each") - whole, F.lit(0.0)).alias("rest"))
    plan = cut(plan)

    own = small.where("size > 0").withColumn("name", named(F.col("s"))).select("name", "key", "size", "relative")
    ranked = joined(own, plan.select("name", "rest", "docs"), "name", "key", "docs").where(F.col("rest") > 1e-12)
    ranked = cut(ranked.select("name", joint(octave(F.col("size")), F.col("name")).alias("cell"), "key", "size", "rest", rank(uniform(F.col("key")), odds(F.col("rest")) * F.col("relative")).alias("r")))
    cells = cut(ranked.groupBy("cell").agg(F.sum(F.col("rest") * F.col("size")).alias("words"), F.sum("size").alias("n"), F.count("*").alias("of")))
    ranges = cells.select("cell", "of", "words", F.lit(0.0).alias("low"), F.lit(1.0).alias("width"), F.lit(0.0).alias("before"))
    for _ in range(2):
        ranges = cut(narrowed(ranked, ranges))
    near = joined(ranked, ranges, "cell", "key", "of")
    near = near.where((F.col("r") >= F.col("low")) & (F.col("r") < F.col("low") + F.col("width")))

    def end(pdf: pd.DataFrame) -> pd.DataFrame:
        """The last document of a cell that still fits: from the few of one bin of a bin."""
        pdf = pdf.sort_values(["r", "key"])
        upto = pdf["before"].iloc[0] + pdf["size"].cumsum()
        fits = int((upto <= pdf["words"].iloc[0]).sum())
        last = (pdf["r"].iloc[fits - 1], pdf["key"].iloc[fits - 1], upto.iloc[fits - 1]) if fits else (pdf["low"].iloc[0], -(2**63), pdf["before"].iloc[0])
        return pd.DataFrame([(pdf["cell"].iloc[0], *last)], columns=["cell", "at", "last", "taken"])

    ends = near.groupBy("cell").applyInPandas(end, "cell string, at double, last long, taken double")
    ends = cells.join(ends, "cell", "left").withColumn("taken", F.coalesce("taken", F.col("n").cast("double"))).fillna({"at": 2.0, "last": 0})  # without a cut all fit
    ends = cut(ends.drop("n"))
    around = joined(ranked, ends, "cell", "key", "of")
    beyond = (F.col("r") > F.col("at")) | (F.col("r") == F.col("at")) & (F.col("key") > F.col("last"))
    w = Window.partitionBy("cell")
    after = around.where(beyond).withColumn("place", F.row_number().over(w.orderBy("r", "key")))
    before = around.where(~beyond).withColumn("place", F.row_number().over(w.orderBy(F.desc("r"), F.desc("key"))))
    columns = ["name", "cell", "words", "taken", "at", "last", "size", "key", "r"]
    sides = after.where(F.col("place") <= NEAR).select(*columns, "place").unionByName(before.where(F.col("place") <= NEAR).select(*columns, (1 - F.col("place")).alias("place")))

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        """One source, octave by octave from the largest documents: each takes over what those before it left or took too much, and
        moves its cut by at most NEAR documents to where its words come nearest."""
        out, left = [], 0.0
        cells = {c: x.sort_values("place") for c, x in pdf.groupby("cell")}
        for c in sorted(cells, key=lambda c: -int(c.partition(":")[0])):
            x = cells[c]
            left += x["words"].iloc[0]
            upto = x["taken"].iloc[0] + np.concatenate([[0], x["size"].cumsum()]) - x["size"][x["place"] <= 0].sum()
            m = int(np.abs(upto - left).argmin())
            left -= upto[m]
            last = (x["r"].iloc[m - 1], x["key"].iloc[m - 1]) if m else (-1.0, 0)
            # All documents of a cell are near its cut, or the first ones before these are taken anyway.
            if not m and upto[0] > 0:
                last = x["r"].iloc[0], x["key"].iloc[0] - 1
            out.append((c, *last))
        return pd.DataFrame(out, columns=["cell", "at", "last"])

    settled = sides.groupBy("name").applyInPandas(settle, "cell string, at double, last long")
    return plan, cut(settled.join(cells.select("cell", "of"), "cell"))


def narrowed(ranked: DataFrame, ranges: DataFrame) -> DataFrame:
    """For each cell the bin of its range of ranks in which its words run out; none if they don't."""
    own = joined(ranked.select("cell", "key", "size", "r"), ranges.select("cell", "of", "low", "width"), "cell", "key", "of")
    own = own.where((F.col("r") >= F.col("low")) & (F.col("r") < F.col("low") + F.col("width")))
    bin_ = F.least(F.floor((F.col("r") - F.col("low")) / F.col("width") * BINS), F.lit(BINS - 1))
    sums = own.groupBy("cell", bin_.alias("bin")).agg(F.sum("size").alias("n"))
    known = sums.join(ranges, "cell")

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")  # at most BINS rows
        upto = pdf["before"] + pdf["n"].cumsum()
        over = pdf[upto > pdf["words"]]
        if not len(over):
            return pdf.iloc[:0].drop(columns=["bin", "n"])
        first = over.iloc[[0]]
        width = first["width"] / BINS
        return first.assign(before=upto[first.index] - first["n"], low=first["low"] + first["bin"] * width, width=width).drop(columns=["bin", "n"])

    return known.groupBy("cell").applyInPandas(find, "cell string, of long, words double, low double, width double, before double")


def uniform(key: Column) -> Column:
    return (F.pmod(key, F.lit(1 << 52)).cast("double") + 0.5) / F.lit(float(1 << 52))


def odds(share: Column) -> Column:
    return F.greatest(share, F.lit(1e-12)) / F.greatest(1 - share, F.lit(1e-12))


def named(source: Column) -> Column:
    """A source's name as a key that isn't null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def octave(size: Column) -> Column:
    return F.floor(F.log2(F.greatest(size, F.lit(1)))).cast("int")


def joint(number: Column, name: Column) -> Column:
    return F.concat(number.cast("string"), F.lit(":"), name)


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, inclusion: Column | None = None, texts: bool = True) -> DataFrame:
    """docs with `mix`: struct<size, source_size, target, copies, taken>; without `texts` the text column is left out.

    A document of a source with target T and size S has certain whole copies floor(T / S); the rest of the target is sampled from the
    same documents without replacement. A document's inclusion odds are those of the fraction that is left over, times its
    relative odds: `inclusion`, a positive column, or one over its size, so that of two documents of a like size the shorter one
    is likelier. The documents of a source in an octave of sizes are ranked against each other, and those of least rank are taken
    until their words come nearest to the octave's share of the target. Octaves follow each other from the largest documents
    down, each taking over what those before it left, so a source ends near its target by about its smallest documents. Cuts are
    exact: bins of ranks are counted, the cut's bin is divided again, what that holds is sorted, and NEAR documents on either
    side of a cut are enough to move it.

    Null and empty texts have size 0, are worth nothing and follow the same rule. Rows with the same id and text share their
    random number. Equal runs agree. Texts are read once for the sizes, and with `texts` once more for the result; sources
    aren't gathered. A column `mix` is replaced; no documents give no rows.
    """
    size = words(F.col(text))
    key = F.xxhash64(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), text)
    relative = inclusion if inclusion is not None else 1.0 / F.greatest(F.col("__size"), F.lit(1))
    measured = docs.withColumns({"__size": size, "__key": key}).withColumn("__relative", relative)
    if not texts:
        measured = cut(measured.drop(text))
    small = measured.select(F.col(source).alias("s"), *[F.col(f"__{c}").alias(c) for c in ("size", "key", "relative")])
    plan, ends = planned(cut(small) if texts else small)
    rows = measured.withColumn("__name", named(F.col(source))).withColumn("__cell", joint(octave(F.col("__size")), F.col("__name")))
    plan = plan.select(*[F.col(c).alias(f"__{c}") for c in ("name", "total", "target", "whole", "rest", "docs")])
    rows = joined(rows, plan, "__name", "__key", "__docs")
    rows = joined(rows, ends.select(*[F.col(c).alias(f"__{c}") for c in ("cell", "of", "at", "last")]), "__cell", "__key", "__of", "left")
    r = rank(uniform(F.col("__key")), odds(F.col("__rest")) * F.col("__relative"))
    chosen = (r < F.col("__at")) | (r == F.col("__at")) & (F.col("__key") <= F.col("__last"))  # null for size 0
    copies = F.col("__whole") + F.when((F.col("__rest") > 1e-12) & chosen, 1).otherwise(0)
    result = F.struct(
        F.col("__size").alias("size"), F.col("__total").cast("long").alias("source_size"), F.col("__target").alias("target"),
        copies.cast("int").alias("copies"), (copies * F.col("__size")).cast("long").alias("taken"),
    )
    kept = [c for c in docs.columns if c != "mix" and (texts or c != text)]
    return rows.withColumn("mix", result).select(*kept, "mix")
