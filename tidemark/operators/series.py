"""Ordered series: islands, run lengths, gaps, baselines, change points and interval algebra."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import average_ranks


def islands(df: DataFrame, keys: list[str], order: list[str], starts: Column, out: str = "island") -> DataFrame:
    """df with a running number of islands for each key; a row begins one where `starts` holds, and the first row does."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.sum(F.when(F.coalesce(starts, F.lit(True)), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def gap_islands(df: DataFrame, keys: list[str], position: str, gap: float, tie: str) -> DataFrame:
    """Islands of positions at most `gap` apart."""
    w = Window.partitionBy(*keys).orderBy(position, tie)
    return islands(df, keys, [position, tie], F.col(position) - F.lag(position).over(w) > gap)


def runs(df: DataFrame, keys: list[str], order: list[str], label: str) -> DataFrame:
    """Run-length encoding: (keys, run, label, start, end, length) of equal labels in a row; start and end are row numbers from 0."""
    w = Window.partitionBy(*keys).orderBy(*order)
    numbered = df.withColumns({"__i": F.row_number().over(w) - 1, "__new": ~F.lag(label).over(w).eqNullSafe(F.col(label))})
    marked = numbered.withColumn("run", F.sum(F.when((F.col("__i") == 0) | F.col("__new"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "run", label).agg(F.min("__i").alias("start"), F.max("__i").alias("end"), F.count("*").alias("length"))


def transitions(encoded: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Runs with the label before, and `returned`: the label before that one is the same again (A-B-A)."""
    w = Window.partitionBy(*keys).orderBy("run")
    return encoded.withColumns({"previous": F.lag(label).over(w), "returned": F.coalesce(F.lag(label, 2).over(w) == F.col(label), F.lit(False))})


def index_gaps(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(position)
    return df.withColumn("previous", F.lag(position).over(w)).withColumn("gap", F.col(position) - F.col("previous"))


def first_long_run(df: DataFrame, keys: list[str], position: str, least: int) -> DataFrame:
    """(keys, start, end): the first run of `least` or more consecutive integer positions."""
    w = Window.partitionBy(*keys).orderBy(position)
    rows = df.select(*keys, position).distinct()
    grouped = rows.withColumn("__g", F.col(position) - F.row_number().over(w))
    spans = grouped.groupBy(*keys, "__g").agg(F.min(position).alias("start"), F.max(position).alias("end"), F.count("*").alias("n")).where(F.col("n") >= least)
    return spans.groupBy(*keys).agg(F.min(F.struct("start", "end")).alias("s")).select(*keys, "s.start", "s.end")


def missing_ranges(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """(keys, first, last, missing): ranges of integers between a key's least and greatest position that it lacks."""
    gaps = index_gaps(df.select(*keys, position).distinct(), keys, position).where("gap > 1")
    return gaps.select(*keys, (F.col("previous") + 1).alias("first"), (F.col(position) - 1).alias("last"), (F.col("gap") - 1).alias("missing"))


def percentiles(df: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    """Average-tie rank over the number of values, of values rounded to 12 digits; null for null."""
    ranked = average_ranks(df.withColumn("__v", F.round(value, 12)), "__v", by, "__rank", "__of")
    return ranked.withColumn(out, F.col("__rank") / F.col("__of")).drop("__v", "__rank", "__of")


def local_baseline(df: DataFrame, keys: list[str], order: list[str], value: str, radius: int) -> DataFrame:
    """df with median and mad of the `radius` rows on either side, the row itself left out, and a robust z score.

    mad is the median absolute deviation from that median; z is null where it is 0. Rows without neighbours have nulls.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.collect_list(value).over(w.rowsBetween(-radius, -1))
    after = F.collect_list(value).over(w.rowsBetween(1, radius))

    def middle(xs: Column) -> Column:
        s = F.array_sort(xs)
        n = F.size(s)
        return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)

    near = df.withColumn("__near", F.concat(before, after)).withColumn("median", middle(F.col("__near")))
    near = near.withColumn("mad", middle(F.transform("__near", lambda x: F.abs(x - F.col("median")))))
    z = F.when(F.col("mad") > 0, (F.col(value) - F.col("median")) / (F.col("mad") * 1.4826))
    return near.withColumn("z", z).drop("__near")


def centroid_changes(df: DataFrame, key: str, order: str, vector: str, window: int) -> DataFrame:
    """(key, order, position, change): at each row, 1 - cosine of the sums of the `window` vectors before it and of as many
    from it on; null without two whole windows or for a zero sum. position counts from 0.

    Each key's rows are one stream in order, so memory is bounded by the window.
    """
    kinds = dict(df.dtypes)

    def slide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, count = None, [], 0

        def cosine(rows: list) -> float | None:
            a, b = (np.sum([r[1] for r in part], axis=0) for part in (rows[:window], rows[window:]))
            n = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
            return float(1 - np.clip((a * b).sum() / n, -1, 1)) if n > 0 else None

        for pdf in batches:
            out = []
            for k, o, v in zip(pdf["k"], pdf["o"], pdf["v"]):
                if now is None or k != now:
                    out += [(now, r[0], p, None) for r, p in pending(held, count, window)]
                    now, held, count = k, [], 0
                held.append((o, np.asarray(v, np.float64)))
                count += 1
                if count < 2 * window and len(held) <= window:
                    out.append((k, o, count - 1, None)) if count <= window else None
                if len(held) == 2 * window:
                    out.append((k, held[window][0], count - window, cosine(held)))
                    held.pop(0)
            yield pd.DataFrame(out, columns=[key, order, "position", "change"])
        if now is not None:
            yield pd.DataFrame([(now, r[0], p, None) for r, p in pending(held, count, window)], columns=[key, order, "position", "change"])

    def pending(held: list, count: int, w: int) -> list:
        """Rows of the end that never had a whole window after them."""
        first = count - len(held)
        return [(r, first + i) for i, r in enumerate(held) if first + i >= w]

    rows = df.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(vector).alias("v"))
    laid = rows.repartition("k").sortWithinPartitions("k", "o")
    return laid.mapInPandas(slide, f"{key} {kinds[key]}, {order} {kinds[order]}, position long, change double")


def peaks(df: DataFrame, keys: list[str], position: str, score: str, gap: float) -> DataFrame:
    """One row an island of candidates: its ends, its best position (highest score, then the smaller position), and a search
    window that ends halfway to the neighbouring peaks."""
    grouped = gap_islands(df, keys, position, gap, position)
    best = F.max_by(F.struct(position, score), F.struct(F.col(score), -F.col(position)))
    one = grouped.groupBy(*keys, "island").agg(F.min(position).alias("start"), F.max(position).alias("end"), F.count("*").alias("n"), best.alias("b"))
    one = one.select(*keys, "island", "start", "end", "n", F.col(f"b.{position}").alias("peak"), F.col(f"b.{score}").alias("score"))
    w = Window.partitionBy(*keys).orderBy("island")
    low, high = (F.lag("peak").over(w) + F.col("peak")) / 2, (F.lead("peak").over(w) + F.col("peak")) / 2
    return one.withColumns({"search_from": F.coalesce(low, F.col("start")), "search_to": F.coalesce(high, F.col("end"))})


def overlap_recall(candidates: DataFrame, zones: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """One row: zones, zones that a candidate interval overlaps within `tolerance`, candidates, candidates that overlap a zone."""
    c = candidates.withColumnsRenamed({"start": "c_start", "end": "c_end"}).withColumn("c_id", F.monotonically_increasing_id())
    z = zones.withColumnsRenamed({"start": "z_start", "end": "z_end"}).withColumn("z_id", F.monotonically_increasing_id())
    touching = (F.col("c_start") - tolerance <= F.col("z_end")) & (F.col("c_end") + tolerance >= F.col("z_start"))
    hits = c.join(z, keys).where(touching)
    found = hits.agg(F.countDistinct("z_id").alias("zones_found"), F.countDistinct("c_id").alias("candidates_hit"))
    return zones.agg(F.count("*").alias("zones")).crossJoin(candidates.agg(F.count("*").alias("candidates"))).crossJoin(found)  # single rows


def position_sets(zones: DataFrame, keys: list[str]) -> DataFrame:
    """The integer positions of closed zones, each once."""
    return zones.select(*keys, F.explode(F.sequence("start", "end")).alias("position")).distinct()


def set_jaccard(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, shared, union, jaccard) of two position sets; null for an empty union."""
    both = left.withColumn("l", F.lit(1)).join(right.withColumn("r", F.lit(1)), [*keys, "position"], "full_outer")
    agg = both.groupBy(*keys).agg(F.sum(F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), 1).otherwise(0)).alias("shared"), F.count("*").alias("union"))
    return agg.withColumn("jaccard", F.when(F.col("union") > 0, F.round(F.col("shared") / F.col("union"), 6)))


def pages(df: DataFrame, keys: list[str], position: str, gap: float, most: int) -> DataFrame:
    """df with `segment` (islands by gap) and `page` (of at most `most` rows within a segment)."""
    cut_up = gap_islands(df, keys, position, gap, position).withColumnRenamed("island", "segment")
    w = Window.partitionBy(*keys, "segment").orderBy(position)
    return cut_up.withColumn("page", F.floor((F.row_number().over(w) - 1) / most))
