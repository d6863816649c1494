"""Joins with a cardinality contract, matches with explicit statuses, band and interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class CardinalityError(ValueError):
    """A join's keys break its declared cardinality."""


def repeated_keys(df: DataFrame, on: list[str]) -> DataFrame:
    return df.groupBy(*on).agg(F.count("*").alias("n")).where("n > 1")


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", validate: str = "many_to_one") -> DataFrame:
    """left.join(right), after asserting that `one` sides have each key once: one_to_one, one_to_many, many_to_one, many_to_many."""
    one_left, one_right = (side == "one" for side in validate.split("_to_"))
    for df, one, name in ((left, one_left, "left"), (right, one_right, "right")):
        if one and (row := repeated_keys(df, on).limit(1).collect()):
            raise CardinalityError(f"{validate}: the {name} side repeats the key {row[0].asDict()}")
    return left.join(right, on, how)


#: A key is hot with more than one row in so many; fewer keys than that can be.
SHARES = 1024


def spread_join(rows: DataFrame, one: DataFrame, key: str, by: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """rows.join(one, key, how), inner or left, with a hot key's rows dealt over many tasks by the hash of `by`.

    `one` has one row a key; its column `size` counts the key's rows, and `total` is their sum or more. Keys with more than
    total / SHARES rows are fewer than SHARES, which bounds what is broadcast; their rows of `one` are repeated, once a part.
    """
    level = max(1, total // SHARES)
    parts = F.ceil(F.col(size) / level).cast("int")
    hot = one.where(F.col(size) > level).select(key, parts.alias("__parts"))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64(by), F.col("__parts")).cast("int"), F.lit(0))).drop("__parts")
    last = F.when(F.col(size) > level, parts - 1).otherwise(0)
    return dealt.join(one.withColumn("__part", F.explode(F.sequence(F.lit(0), last))), [key, "__part"], how).drop("__part")


def match(left: DataFrame, right: DataFrame, keys: list[str], order: list[str], names: tuple[str, str, str]) -> DataFrame:
    """Full outer match on keys; of several right rows with a key the first by `order` wins. Columns of right (besides
    keys) and `status`: names are for matched, left alone, right alone."""
    first = Window.partitionBy(*keys).orderBy(*order)
    one = right.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n").withColumn("__r", F.lit(True))
    both = left.withColumn("__l", F.lit(True)).join(one, keys, "full_outer")
    status = F.when(F.col("__l") & F.col("__r"), names[0]).when(F.col("__l"), names[1]).otherwise(names[2])
    return both.withColumn("status", status).drop("__l", "__r")


def pair_unambiguous(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_left, n_right, status): matched only where the key is unique on both sides; else ambiguous, or alone."""
    a = left.groupBy(*keys).agg(F.count("*").alias("n_left"))
    b = right.groupBy(*keys).agg(F.count("*").alias("n_right"))
    both = a.join(b, keys, "full_outer").fillna(0, ["n_left", "n_right"])
    status = (
        F.when(F.col("n_right") == 0, "left_alone").when(F.col("n_left") == 0, "right_alone")
        .when((F.col("n_left") == 1) & (F.col("n_right") == 1), "matched").otherwise("ambiguous")
    )
    return both.withColumn("status", status)


def relationship(n_a: Column, n_b: Column, overlap: Column) -> Column:
    """How two sets relate, from their sizes and overlap."""
    return (
        F.when((n_a == 0) | (n_b == 0), "UNKNOWN").when(overlap == 0, "NO_OVERLAP").when((overlap == n_a) & (overlap == n_b), "IDENTICAL")
        .when(overlap == n_a, "SUBSET").when(overlap == n_b, "SUPERSET").otherwise("PARTIAL")
    )


def set_overlap(members: DataFrame, owner: str, item: str) -> DataFrame:
    """(a, b, n_a, n_b, overlap, jaccard, relationship) of all pairs of owners a < b by the distinct items they hold.

    Overlaps are counted through shared items, so pairs without any cost nothing; the frame of owner pairs is as small as
    the owners are few.
    """
    held = members.where(F.col(item).isNotNull()).select(F.col(owner).alias("o"), F.col(item).alias("i")).distinct()
    sizes = held.groupBy("o").agg(F.count("*").alias("n"))
    shared = held.alias("x").join(held.alias("y"), "i").where("x.o < y.o").groupBy(F.col("x.o").alias("a"), F.col("y.o").alias("b")).agg(F.count("*").alias("overlap"))
    a, b = sizes.select(F.col("o").alias("a"), F.col("n").alias("n_a")), sizes.select(F.col("o").alias("b"), F.col("n").alias("n_b"))
    frame = a.join(b, F.col("a") < F.col("b")).join(shared, ["a", "b"], "left").fillna(0, ["overlap"])
    jaccard = F.round(F.col("overlap") / (F.col("n_a") + F.col("n_b") - F.col("overlap")), 6)
    return frame.select("a", "b", "n_a", "n_b", "overlap", jaccard.alias("jaccard"), relationship(F.col("n_a"), F.col("n_b"), F.col("overlap")).alias("relationship"))


def band_join(left: DataFrame, right: DataFrame, keys: list[str], position_left: str, position_right: str, reach: Column | float) -> DataFrame:
    """Pairs with equal keys and |position_left - position_right| <= reach, by buckets of that width: each right row goes
    to its own bucket, each left row to three, so a key with very many rows is many buckets."""
    width = float(reach) if not isinstance(reach, Column) else reach
    own = F.floor(F.col(position_right) / F.lit(width)).cast("long")
    near = F.floor(F.col(position_left) / F.lit(width)).cast("long")
    a = left.withColumn("__b", F.explode(F.array(near - 1, near, near + 1)))
    b = right.withColumn("__b", own)
    return a.join(b, [*keys, "__b"]).where(F.abs(F.col(position_left) - F.col(position_right)) <= F.lit(width)).drop("__b")


def points_in_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], position: str, start: str, end: str, width: float, how: str = "inner") -> DataFrame:
    """Points with the closed intervals [start, end] that hold them, by buckets of `width`: an interval goes to each
    bucket that it touches, a point to one. `left` keeps points without one."""
    a = points.withColumn("__b", F.floor(F.col(position) / width).cast("long"))
    buckets = F.sequence(F.floor(F.col(start) / width).cast("long"), F.floor(F.col(end) / width).cast("long"))
    b = intervals.where(F.col(start) <= F.col(end)).withColumn("__c", F.explode(buckets))
    on = (F.col("__b") == F.col("__c")) & F.col(position).between(F.col(start), F.col(end))
    for k in keys:
        on = on & (a[k] == b[k])
    joined = a.join(b, on, how).drop("__b", "__c")
    for k in keys:
        joined = joined.drop(b[k])
    return joined


def exactly_one(points: DataFrame, intervals: DataFrame, keys: list[str], position: str, start: str, end: str, value: str, width: float) -> DataFrame:
    """points(keys, position) with the value of the one interval that holds it; null and a status where none or several do."""
    hit = points_in_intervals(points.select(*keys, position).distinct(), intervals.select(*keys, start, end, value), keys, position, start, end, width, "left")
    out = hit.groupBy(*keys, position).agg(F.count(value).alias("n_intervals"), F.min(value).alias("__v"))
    status = F.when(F.col("n_intervals") == 1, "one").when(F.col("n_intervals") == 0, "none").otherwise("several")
    return out.select(*keys, position, "n_intervals", F.when(F.col("n_intervals") == 1, F.col("__v")).alias(value), status.alias("status"))
