"""Splits of atomic groups: balance statistics, assignment, invariants, residual leakage over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.contents import SPLITS, split_bit
from tidemark.operators.joins import band_join


def crosstab(df: DataFrame, key: str, value: str, values: list, prefix: str = "class_") -> DataFrame:
    """(key, one count a fixed value), 0 where there is none."""
    wide = df.groupBy(key).pivot(value, values).agg(F.count(F.lit(1)))
    return wide.select(key, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(f"{prefix}{v}") for v in values])


def group_vectors(records: DataFrame, groups: DataFrame, content: str, measures: list[str]) -> DataFrame:
    """(group_id, contents, records, sums of measures) of atomic groups."""
    joined = records.join(groups, content)
    return joined.groupBy("group_id").agg(F.countDistinct(content).alias("contents"), F.count("*").alias("records"), *[F.sum(m).alias(m) for m in measures])


def balance(records: DataFrame, split: str, cls: str, content: str, classes: list, ratios: dict[str, float]) -> DataFrame:
    """Split by class on the full grid: images, distinct contents, share of the class, target share, deviation in points."""
    spark = records.sparkSession
    own = records.groupBy(F.col(split).alias("split"), F.col(cls).alias("class")).agg(F.count("*").alias("images"), F.countDistinct(content).alias("contents"))
    grid = spark.createDataFrame([(s, c, float(r)) for s, r in ratios.items() for c in classes], "split string, class string, target double")
    full = grid.join(own, ["split", "class"], "left").fillna(0, ["images", "contents"])
    total = F.sum("images").over(Window.partitionBy("class"))
    share = F.when(total > 0, F.col("images") / total)
    return full.select("split", "class", "images", "contents", F.round(share, 6).alias("share"), "target", F.round((share - F.col("target")) * 100, 6).alias("deviation_pp"))


def hash_order(group: str | Column, seed: int) -> Column:
    """A reproducible random order of groups: the SHA-256 of seed and id, which any engine can compute."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), (F.col(group) if isinstance(group, str) else group).cast("string")), 256)


def random_assignment(units: DataFrame, group: str, size: str, ratios: dict[str, float], seed: int) -> DataFrame:
    """units with `split`: groups in hash order, cut where the running sum of sizes comes nearest to each cumulative target.

    The running sum goes over range partitions of the hash order, so no task holds all groups: a group's sum is that of the
    partitions before its own and of the groups before it there.
    """
    from tidemark.storage import cut

    laid = cut(units.withColumn("__h", hash_order(group, seed)).repartitionByRange("__h").withColumn("__p", F.spark_partition_id()))
    sums = laid.groupBy("__p").agg(F.sum(size).alias("__s"))
    starts = sums.select("__p", F.coalesce(F.sum("__s").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    inner = F.sum(size).over(Window.partitionBy("__p").orderBy("__h", group).rowsBetween(Window.unboundedPreceding, 0))
    run = laid.join(F.broadcast(starts), "__p").withColumn("__end", F.col("__b") + inner)
    total = units.agg(F.sum(size)).first()[0] or 0
    names, cuts, at = list(ratios), [], 0.0
    for name in names[:-1]:
        at += ratios[name]
        near = run.agg(F.min(F.struct(F.abs(F.col("__end") - at * total).alias("d"), F.col("__end").alias("e"))).alias("m")).first().m
        cuts.append(near.e if near else 0)
    out = F.lit(names[-1])
    for name, end in reversed(list(zip(names, cuts))):
        out = F.when(F.col("__end") <= end, name).otherwise(out)
    return run.withColumn("split", out).drop("__h", "__p", "__b", "__end")


def profile_assignment(units: DataFrame, group: str, measures: list[str], ratios: dict[str, float], seed: int, steps: int = 2000) -> tuple[dict, float]:
    """Whole groups to splits so that every measure comes near its target: a greedy start, then the best moves.

    Groups with equal measures are one profile, and the driver sees profiles with counts, not groups; they are bounded by
    the number of distinct vectors, so round or bin measures for very large inputs. Returns {profile: {split: count}} and the
    objective, the sum over splits and measures of |sum - target| / (splits x max(target, 1)).
    """
    rows = units.groupBy(*measures).agg(F.count("*").alias("n")).orderBy(*measures).collect()
    names = list(ratios)
    profiles = [tuple(float(r[m]) for m in measures) for r in rows]
    counts = [int(r["n"]) for r in rows]
    totals = [sum(p[i] * n for p, n in zip(profiles, counts)) for i in range(len(measures))]
    target = {s: [ratios[s] * t for t in totals] for s in names}
    now = {s: [0.0] * len(measures) for s in names}
    given = [dict.fromkeys(names, 0) for _ in profiles]

    def cost(s: str, sums: list[float]) -> float:
        return sum(abs(x - t) / (len(names) * max(t, 1.0)) for x, t in zip(sums, target[s]))

    def moved(s: str, i: int, sign: int) -> list[float]:
        return [x + sign * p for x, p in zip(now[s], profiles[i])]

    for i in sorted(range(len(profiles)), key=lambda i: (-sum(profiles[i]), i)):
        for _ in range(counts[i]):
            best = min(names, key=lambda s: (cost(s, moved(s, i, 1)) - cost(s, now[s]), names.index(s)))
            now[best], given[i][best] = moved(best, i, 1), given[i][best] + 1
    for _ in range(steps):
        options = (
            (cost(a, moved(a, i, -1)) + cost(b, moved(b, i, 1)) - cost(a, now[a]) - cost(b, now[b]), i, a, b)
            for i in range(len(profiles)) for a in names for b in names if a != b and given[i][a]
        )
        gain, i, a, b = min(options, default=(0.0, 0, "", ""))
        if gain >= -1e-12:
            break
        now[a], now[b] = moved(a, i, -1), moved(b, i, 1)
        given[i][a], given[i][b] = given[i][a] - 1, given[i][b] + 1
    return {p: g for p, g in zip(profiles, given)}, sum(cost(s, now[s]) for s in names)


def apply_profiles(units: DataFrame, group: str, measures: list[str], plan: dict, seed: int) -> DataFrame:
    """units with `split`: of each profile's groups, in hash order, as many to each split as the plan says."""
    spark = units.sparkSession
    rows = []
    for profile, given in plan.items():
        at = 0
        for split, n in given.items():
            rows.append((*profile, at, at + n, split))
            at += n
    schema = ", ".join(f"__{m} double" for m in measures) + ", __from int, __to int, split string"
    table = spark.createDataFrame(rows, schema)
    order = Window.partitionBy(*measures).orderBy(hash_order(group, seed))
    numbered = units.withColumn("__n", F.row_number().over(order) - 1)
    on = (F.col("__n") >= F.col("__from")) & (F.col("__n") < F.col("__to"))
    for m in measures:
        on = on & (F.col(m).cast("double") == F.col(f"__{m}"))
    return numbered.join(F.broadcast(table), on).select(*units.columns, "split")  # one row a profile and split


def invariants(records: DataFrame, assigned: DataFrame, content: str, group: str) -> DataFrame:
    """(rule, violations) of an assignment (content, group, split) to records: covered once, known splits, groups whole."""
    from tidemark.operators.contents import violations

    per_content = assigned.groupBy(content).agg(F.countDistinct("split").alias("splits"), F.min("split").alias("split"))
    per_group = assigned.groupBy(group).agg(F.countDistinct("split").alias("splits"))
    covered = records.select(content).distinct().join(per_content, content, "left")
    a = violations(covered, {"covered": F.col("split").isNotNull(), "one_split": F.col("splits") == 1, "known_split": F.col("split").isin(list(SPLITS))})
    return a.unionByName(violations(per_group, {"group_whole": F.col("splits") == 1}))


def temporal_crossing(df: DataFrame, keys: list[str], position: str, split: str, tie: str, reaches: list[float]) -> DataFrame:
    """(reach, pairs, crossing, share): pairs of a key's rows at most `reach` apart, and those whose splits differ."""
    widest = max(reaches)
    a = df.select(*keys, F.col(position).alias("p"), F.col(split).alias("s"), F.col(tie).alias("t"))
    b = df.select(*keys, F.col(position).alias("q"), F.col(split).alias("r"), F.col(tie).alias("u"))
    near = band_join(a, b, keys, "p", "q", float(widest)).where("t < u")
    steps = df.sparkSession.createDataFrame([(float(x),) for x in reaches], "reach double")
    each = near.join(F.broadcast(steps), F.abs(F.col("p") - F.col("q")) <= F.col("reach"))
    counted = each.groupBy("reach").agg(F.count("*").alias("pairs"), F.count_if(F.col("s") != F.col("r")).alias("crossing"))
    full = steps.join(counted, "reach", "left").fillna(0, ["pairs", "crossing"])
    return full.withColumn("share", F.when(F.col("pairs") > 0, F.round(F.col("crossing") / F.col("pairs"), 6)))


def split_counts(df: DataFrame, key: str, split: str) -> DataFrame:
    """(splits, keys): how many keys lie in one, two or three splits."""
    masks = df.groupBy(key).agg(F.bit_or(split_bit(split)).alias("m"))
    return masks.groupBy(F.bit_count("m").alias("splits")).agg(F.count("*").alias("keys"))
