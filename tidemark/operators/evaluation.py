"""Detector and run evaluation: average precision, bootstrap, hierarchical means, correlations, Pareto selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import pearson, running
from tidemark.storage import cut


#: The overlaps at which a detection counts as a hit, for a mean over thresholds.
OVERLAPS = [round(0.5 + 0.05 * i, 2) for i in range(10)]


def precision_recall(detections: DataFrame, cls: str, confidence: str, hit: str, tie: str, support: DataFrame) -> DataFrame:
    """Detections with running recall and precision: by class, highest confidence first, ties by `tie`."""
    ran = running(detections, [cls], [F.desc(confidence), F.col(tie)], {"tp": F.col(hit).cast("int"), "n": F.lit(1)})
    known = ran.join(support, cls)
    return known.withColumns({"recall": F.col("tp") / F.col("support"), "precision": F.col("tp") / F.col("n")})


def average_precision(curve: DataFrame, cls: str, support: DataFrame, points: int = 101) -> DataFrame:
    """(class, support, ap) of a precision_recall table: see interpolated; null without support, 0 without detections."""
    hits = curve.groupBy(cls, F.col("tp").alias("k")).agg(F.min("n").alias("n")).where("k > 0")
    totals = support.join(curve.groupBy(cls).agg(F.max("n").alias("total")), cls, "left")
    return interpolated(hits, totals, [cls], points).select(cls, "support", "ap")


def interpolated(hits: DataFrame, totals: DataFrame, keys: list[str], points: int = 101) -> DataFrame:
    """totals(keys, support, total) with `ap`, from the hits (keys, k, n): the k-th hit is the n-th detection.

    The trapezoid integral over `points` recalls from 0 to 1 of the curve's monotone envelope, linear between its points, which
    begins at (0, 1) and closes at (1, 0). At a recall that several detections share, the last of them counts, and the way to the
    next recall ends at its first. Only the best precision between neighbouring grid points and the hits next to them are
    kept, so a class's rows are aggregated and never sorted.
    """
    step, last = 1.0 / (points - 1), points - 1
    known = totals.withColumn("total", F.coalesce("total", F.lit(0)))
    grid = known.where("support > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(last)))).withColumn("x", F.when(F.col("i") == last, 1.0).otherwise(F.col("i") * F.lit(step)))
    near = F.floor(F.col("x") * F.col("support"))
    level = F.when((near + 1) / F.col("support") <= F.col("x"), near + 1).when(near / F.col("support") > F.col("x"), near - 1).otherwise(near)
    found = hits.groupBy(*keys).agg(F.max("k").cast("long").alias("found"))
    grid = grid.join(found, keys, "left").fillna(0, ["found"]).withColumn("at", F.least(level.cast("long"), F.col("found"))).withColumn("k", F.col("at") + 1)
    # Between which grid points a hit's recall lies: the last one below it.
    scaled = hits.withColumn("k", F.col("k").cast("long")).join(totals.select(*keys, "support"), keys).where("support > 0")
    recall, below = F.col("k") / F.col("support"), F.ceil(F.col("k") / F.col("support") * last) - 1
    cell = F.when((below + 1) * F.lit(step) < recall, below + 1).when(below * F.lit(step) >= recall, below - 1).otherwise(below)
    best = scaled.groupBy(*keys, F.least(cell, F.lit(last)).cast("int").alias("i")).agg(F.max(F.col("k") / F.col("n")).alias("p"))
    after = Window.partitionBy(*keys).orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)  # one row a grid point
    grid = grid.join(best, [*keys, "i"], "left").withColumn("next_p", F.max("p").over(after))
    grid = grid.join(scaled.select(*keys, "k", "n"), [*keys, "k"], "left")
    here = (
        F.when(F.col("n").isNull(), F.when(F.col("at") > 0, F.col("at") / F.col("total")).otherwise(0.0))
        .when((F.col("at") == 0) & (F.col("n") == 1), 1.0)
        .otherwise(F.greatest(F.when(F.col("at") > 0, F.col("at") / (F.col("n") - 1)).otherwise(0.0), "next_p"))
    )
    r0 = F.col("at") / F.col("support")
    r1 = F.when(F.col("n").isNull(), 1.0).otherwise((F.col("at") + 1) / F.col("support"))
    slope = (F.coalesce("next_p", F.lit(0.0)) - F.col("here")) / (r1 - r0)
    value = F.when(F.col("i") == last, 0.0).when(F.col("x") == r0, F.col("here")).otherwise(F.col("here") + slope * (F.col("x") - r0))
    weight = F.when(F.col("i").isin(0, last), 0.5).otherwise(1.0)
    area = grid.withColumn("here", here).groupBy(*keys).agg((F.sum(value * weight) * step).alias("ap"))
    return known.join(area, keys, "left").withColumn("ap", F.when(F.col("support") > 0, F.coalesce("ap", F.lit(0.0))))


def mean_average_precision(detections: DataFrame, cls: str, confidence: str, overlap: str, tie: str, support: DataFrame, overlaps: list[float] = OVERLAPS) -> DataFrame:
    """(class, support, map50, map50_95): average precision at the first overlap, and its mean over all of them.

    A detection is a hit at each threshold that its overlap reaches. One running pass counts all thresholds' hits.
    """
    hit = [F.coalesce(F.col(overlap) >= t, F.lit(False)) for t in overlaps]
    sums = {"n": F.lit(1)} | {f"tp{i}": h.cast("int") for i, h in enumerate(hit)}
    ran = running(detections.select(cls, confidence, overlap, tie), [cls], [F.desc(confidence), F.col(tie)], sums)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col(f"tp{i}").alias("k"), h.alias("hit")) for i, h in enumerate(hit)]))
    hits = cut(ran.select(cls, "n", each.alias("h")).select(cls, "h.t", "h.k", "n", "h.hit").where("hit").drop("hit"))  # read three times
    total = detections.groupBy(cls).agg(F.count("*").alias("total"))
    steps = F.explode(F.sequence(F.lit(0), F.lit(len(overlaps) - 1))).alias("t")
    totals = support.join(total, cls, "left").select(cls, "support", "total", steps)
    got = interpolated(hits, totals, [cls, "t"])
    first = F.max(F.when(F.col("t") == 0, F.col("ap")))
    return got.groupBy(cls, "support").agg(first.alias("map50"), F.avg("ap").alias("map50_95"))


def macro(per_class: DataFrame, value: str) -> DataFrame:
    """One row: the mean over classes, null if any class has no support."""
    return per_class.agg(F.when(F.count(value) == F.count(F.lit(1)), F.avg(value)).alias("macro"), F.count("*").alias("classes"))


def poisson_weight(seed: int, replicate: str, unit: str) -> Column:
    """How often a unit is in a resample: Poisson(1) from its hash, so reruns and any partitioning agree."""
    u = (F.pmod(F.xxhash64(F.lit(seed), replicate, unit), F.lit(1 << 40)).cast("double") + 0.5) / float(1 << 40)
    weight, total, chance = F.lit(0), 0.0, 0.36787944117144233
    for k in range(1, 12):  # the inverse of Poisson(1), beyond 11 at 1e-9
        total += chance
        weight = weight + F.when(u > total, 1).otherwise(0)
        chance /= k
    return weight


def bootstrap(df: DataFrame, unit: str, value: str, by: list[str], resamples: int, level: float, seed: int) -> DataFrame:
    """Percentile interval of the mean over resampled units, each with an independent weight in each resample; no sample is ever
    gathered."""
    sums = df.groupBy(*by, unit).agg(F.sum(value).alias("__s"), F.count(value).alias("__n"))
    each = sums.withColumn("__r", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    means = each.withColumn("__w", poisson_weight(seed, "__r", unit)).groupBy(*by, "__r").agg(F.sum(F.col("__w") * F.col("__s")).alias("s"), F.sum(F.col("__w") * F.col("__n")).alias("n"))
    low, high = (1 - level) / 2, (1 + level) / 2
    point = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.countDistinct(unit).alias("units"))
    mean = F.when(F.col("n") > 0, F.col("s") / F.col("n"))
    spread = means.groupBy(*by).agg(F.percentile(mean, F.lit(low)).alias("low"), F.percentile(mean, F.lit(high)).alias("high"))
    return point.join(spread, by) if by else point.crossJoin(spread)


def bootstrap_average_precision(detections: DataFrame, targets: DataFrame, cls: str, confidence: str, hit: str, tie: str, image: str, resamples: int, level: float, seed: int) -> DataFrame:
    """(class, resamples, valid, low, high): the percentile interval of average precision over resampled images.

    Precision is taken anew from all detections of each resample, an image's as often as its weight, never as a mean over
    images. A resample without a target of the class is undefined and not counted as valid.
    """
    every = F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))
    support = targets.select(cls, image, every.alias("r")).withColumn("w", poisson_weight(seed, "r", image)).groupBy("r", cls).agg(F.sum("w").alias("support"))
    found = detections.select(cls, confidence, hit, tie, image, every.alias("r")).withColumn("w", poisson_weight(seed, "r", image)).where("w > 0")
    found = found.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("w")))).drop("w", image)
    ran = running(found, ["r", cls], [F.desc(confidence), F.col(tie), F.col("__i")], {"k": F.col(hit).cast("int"), "n": F.lit(1)})
    totals = support.join(found.groupBy("r", cls).agg(F.count("*").alias("total")), ["r", cls], "left")
    got = interpolated(ran.where(hit).select("r", cls, "k", "n"), totals, ["r", cls])
    at = lambda q: F.percentile("ap", F.lit(q))
    return got.groupBy(cls).agg(F.lit(resamples).alias("resamples"), F.count("ap").alias("valid"), at((1 - level) / 2).alias("low"), at((1 + level) / 2).alias("high"))


def hierarchical(df: DataFrame, arm: str, outer: str, inner: str, metrics: list[str], baseline: str) -> DataFrame:
    """(arm, metric, outer_n, mean, std, effect): means over inner seeds, then over outer ones; std with one degree of
    freedom, null for one; effect against the baseline arm."""
    long = df.unpivot([arm, outer, inner], metrics, "metric", "value")
    first = long.groupBy(arm, outer, "metric").agg(F.avg("value").alias("value"))
    second = first.groupBy(arm, "metric").agg(F.count("value").alias("outer_n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    base = second.where(F.col(arm) == baseline).select("metric", F.col("mean").alias("__b"))
    return second.join(base, "metric", "left").withColumn("effect", F.col("mean") - F.col("__b")).drop("__b")


def centered_correlation(df: DataFrame, strategy: str, x: str, y: str) -> Column | DataFrame:
    """One row: Pearson of all pairs, and of pairs with their strategy's means taken off; null unless both vary."""
    own = Window.partitionBy(strategy)
    off = df.withColumns({"__x": F.col(x) - F.avg(x).over(own), "__y": F.col(y) - F.avg(y).over(own)})
    return off.agg(F.count("*").alias("points"), pearson(x, y).alias("pearson"), pearson("__x", "__y").alias("centered"))


def pareto(df: DataFrame, key: str, high: list[str], low: list[str]) -> DataFrame:
    """Rows that no other row dominates: at least as good in every criterion and better in one. Rows that lack a criterion
    are left out. Each task first drops the rows that its own rows dominate; what is left of all tasks is compared in pairs,
    so the work grows with the fronts and not with the table."""
    rows = df.where(" and ".join(f"{c} is not null" for c in [*high, *low]))

    def front(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            x = np.concatenate([held[high].to_numpy(float), -held[low].to_numpy(float)], axis=1)
            order = np.argsort(-x.sum(axis=1), kind="stable")  # a row is dominated by rows of larger sums only
            keep: list[int] = []
            for i in order.tolist():
                over = x[keep]
                if not ((over >= x[i]).all(axis=1) & (over > x[i]).any(axis=1)).any():
                    keep.append(i)
            held = held.iloc[sorted(keep)]
        if held is not None:
            yield held

    rows = cut(rows.mapInPandas(front, rows.schema))
    other = rows.select(*[F.col(c).alias(f"__{c}") for c in [*high, *low]]).distinct()
    as_good = F.lit(True)
    better = F.lit(False)
    for c in high:
        as_good, better = as_good & (F.col(f"__{c}") >= F.col(c)), better | (F.col(f"__{c}") > F.col(c))
    for c in low:
        as_good, better = as_good & (F.col(f"__{c}") <= F.col(c)), better | (F.col(f"__{c}") < F.col(c))
    return rows.join(other, as_good & better, "left_anti")


def shortlist(df: DataFrame, strata: list[str], key: str, high: list[str], low: list[str], most: int) -> DataFrame:
    """The best rows of each stratum by their mean rank over the criteria, ties by key, at most `most`."""
    ranked, total = df, F.lit(0)
    for c, order in [*((c, F.desc(c)) for c in high), *((c, F.asc(c)) for c in low)]:
        ranked = ranked.withColumn(f"__{c}", F.rank().over(Window.partitionBy(*strata).orderBy(order)))
        total = total + F.col(f"__{c}")
    w = Window.partitionBy(*strata).orderBy("mean_rank", key)
    out = ranked.withColumn("mean_rank", total / (len(high) + len(low))).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    return out.drop(*[f"__{c}" for c in [*high, *low]])
