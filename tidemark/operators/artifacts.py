"""Tables that other tables are bound to: key contracts, correspondences, runs side by side, and replays of stored results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.contents import UNIT


class BindingError(ValueError):
    """Two tables that should have the same keys, each once, don't."""


def binding(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: distinct keys of either side, those of both, those of one alone, keys that a side repeats, and whether each side
    has every key of the other exactly once."""
    a, b = left.groupBy(*keys).agg(F.count("*").alias("l")), right.groupBy(*keys).agg(F.count("*").alias("r"))
    both = a.join(b, keys, "full_outer")
    many = {
        "n_left": F.count("l"), "n_right": F.count("r"), "matched": F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()),
        "left_alone": F.count_if(F.col("r").isNull()), "right_alone": F.count_if(F.col("l").isNull()),
        "repeated_left": F.count_if(F.col("l") > 1), "repeated_right": F.count_if(F.col("r") > 1),
    }
    got = both.agg(*[c.alias(n) for n, c in many.items()])
    return got.withColumn("bound", reduce(Column.__and__, [F.col(c) == 0 for c in ("left_alone", "right_alone", "repeated_left", "repeated_right")]))


def bind(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left.join(right, keys), after asserting that both have the same keys, each once."""
    row = binding(left, right, keys).first()
    if not row.bound:
        raise BindingError(f"keys {keys}: {row.asDict()}")
    return left.join(right, keys)


def endpoint_status(endpoints: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """endpoints with `matches`, how many targets have their keys, and `status`: exactly one, none or several."""
    known = endpoints.join(targets.groupBy(*keys).agg(F.count("*").alias("matches")), keys, "left").fillna(0, ["matches"])
    return known.withColumn("status", F.when(F.col("matches") == 1, "one").when(F.col("matches") == 0, "none").otherwise("several"))


def bijective(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Distinct pairs with the degree of either end; `eligible` where both are 1."""
    one = pairs.select(left, right).where(F.col(left).isNotNull() & F.col(right).isNotNull()).distinct()
    a = one.groupBy(left).agg(F.count("*").alias("left_degree"))
    b = one.groupBy(right).agg(F.count("*").alias("right_degree"))
    return one.join(a, left).join(b, right).withColumn("eligible", (F.col("left_degree") == 1) & (F.col("right_degree") == 1))


def agreement_by_policy(df: DataFrame, left: str, right: str, noise: int = -1) -> DataFrame:
    """(policy, n, coverage, trivial, ari, shared_noise): the adjusted Rand index of two groupings over all points, noise as one
    group, and over the points that are noise in neither. Null under two points; 1 where no other value is possible."""
    total = df.agg(F.count("*").alias("total"), F.avg(((F.col(left) == noise) & (F.col(right) == noise)).cast("double")).alias("shared_noise"))
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2.0
    out = []
    for policy, rows in (("all_points", df), ("common_clustered", df.where((F.col(left) != noise) & (F.col(right) != noise)))):
        cells = rows.groupBy(F.col(left).alias("u"), F.col(right).alias("v")).agg(F.count("*").alias("n"))
        a, b = (cells.groupBy(c).agg(F.sum("n").alias("n")) for c in "uv")
        one = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(two("n")).alias("ij"))
        one = one.crossJoin(a.agg(F.sum(two("n")).alias("i"), F.count("*").alias("ga"))).crossJoin(b.agg(F.sum(two("n")).alias("j"), F.count("*").alias("gb")))  # single rows
        out.append(one.withColumn("policy", F.lit(policy)))
    every = out[0].unionByName(out[1]).crossJoin(total)
    pairs = F.greatest(F.col("n") * (F.col("n") - 1) / 2.0, F.lit(1.0))
    expected, most = F.col("i") * F.col("j") / pairs, (F.col("i") + F.col("j")) / 2
    ari = F.when(F.abs(most - expected) < 1e-12, 1.0).otherwise((F.col("ij") - expected) / F.when(F.abs(most - expected) >= 1e-12, most - expected))
    return every.select("policy", "n", (F.col("n") / F.col("total")).alias("coverage"), ((F.col("ga") < 2) | (F.col("gb") < 2)).alias("trivial"), F.when(F.col("n") >= 2, ari).alias("ari"), "shared_noise")


def matched_sets(left: DataFrame, right: DataFrame, group: str, member: str) -> DataFrame:
    """(members, left_groups, right_groups): groups of either side by the set of their members, joined where the sets are equal."""
    sides = []
    for df, name in ((left, "left_groups"), (right, "right_groups")):
        sets = df.groupBy(group).agg(F.array_join(F.array_sort(F.collect_set(F.col(member).cast("string"))), "|").alias("members"))
        sides.append(sets.groupBy("members").agg(F.count("*").alias(name)))
    return sides[0].join(sides[1], "members", "full_outer").fillna(0, ["left_groups", "right_groups"])


def intervals_from_cuts(points: DataFrame, keys: list[str], position: str, cut: Column) -> DataFrame:
    """(keys, interval, start, end, n): a timeline cut before each row where `cut` holds."""
    w = Window.partitionBy(*keys).orderBy(position)
    numbered = points.withColumn("interval", F.sum(F.coalesce(cut, F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return numbered.groupBy(*keys, "interval").agg(F.min(position).alias("start"), F.max(position).alias("end"), F.count("*").alias("n"))


def interval_faults(intervals: DataFrame, keys: list[str], start: str, end: str, bounds: DataFrame, first: str, last: str) -> DataFrame:
    """(keys, intervals, reversed, outside, overlaps): intervals that end before they start, leave their timeline, or begin before an
    earlier one of the timeline has ended."""
    w = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    known = intervals.join(bounds.select(*keys, first, last), keys, "left").withColumn("__until", F.max(end).over(w))
    flags = {
        "reversed": F.col(end) < F.col(start), "outside": F.coalesce((F.col(start) < F.col(first)) | (F.col(end) > F.col(last)), F.lit(True)),
        "overlaps": F.coalesce(F.col(start) <= F.col("__until"), F.lit(False)),
    }
    return known.groupBy(*keys).agg(F.count("*").alias("intervals"), *[F.count_if(c).alias(n) for n, c in flags.items()])


def relation_metrics(pairs: DataFrame, left: str, right: str, state: str, splits: DataFrame, key: str, split: str) -> DataFrame:
    """(state, evidence, pairs, crossing): rows, distinct unordered pairs, and those whose ends lie in different splits."""
    keyed = pairs.groupBy(F.col(state).alias("state"), F.least(left, right).alias("a"), F.greatest(left, right).alias("b")).agg(F.count("*").alias("n"))
    p, q = (splits.select(F.col(key).alias(c), F.col(split).alias(f"s{c}")) for c in "ab")
    known = keyed.join(p, "a", "left").join(q, "b", "left")
    return known.groupBy("state").agg(F.sum("n").alias("evidence"), F.count("*").alias("pairs"), F.count_if(F.col("sa") != F.col("sb")).alias("crossing"))


def run_pairs(assignments: DataFrame, run: str, unit: str, label: str, runs: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """(a, b, kind, units, equal, share): runs a < b of a kind, compared by the labels that they give to the same units.

    `runs` has one row a run with its parameters; a kind is a condition on the parameters of both, prefixed a_ and b_.
    """
    sides = [runs.select(*[F.col(c).alias(f"{p}_{c}") for c in runs.columns]) for p in "ab"]
    kind = F.coalesce(*[F.when(c, F.lit(n)) for n, c in kinds.items()])
    wanted = sides[0].join(sides[1], F.col(f"a_{run}") < F.col(f"b_{run}")).withColumn("kind", kind).where("kind is not null")  # runs are an experiment's, few
    wanted = wanted.select(F.col(f"a_{run}").alias("a"), F.col(f"b_{run}").alias("b"), "kind")
    a, b = (assignments.select(F.col(run).alias(p), F.col(unit).alias("u"), F.col(label).alias(f"l{p}")) for p in "ab")
    both = F.broadcast(wanted).join(a, "a").join(b, ["b", "u"])
    got = both.groupBy("a", "b", "kind").agg(F.count("*").alias("units"), F.count_if(F.col("la").eqNullSafe(F.col("lb"))).alias("equal"))
    return got.withColumn("share", F.col("equal") / F.col("units"))


def membership_ids(assignments: DataFrame, run: str, columns: list[str], digits: int = 2) -> DataFrame:
    """(run, membership): an identity of each run's rows as a set of bucket digests, whatever their order; see contents.dataset_digest."""
    row = F.sha2(F.concat_ws(UNIT, *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns]), 256)
    buckets = assignments.select(run, row.alias("d")).groupBy(run, F.substring("d", 1, digits).alias("b")).agg(F.array_sort(F.collect_list("d")).alias("ds"))
    return buckets.groupBy(run).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("b", F.sha2(F.array_join("ds", ""), 256)))), ""), 256).alias("membership"))


def aliases(ids: DataFrame, run: str, membership: str) -> DataFrame:
    """(run, runs): runs of equal membership under the first of them."""
    return ids.groupBy(membership).agg(F.min(run).alias(run), F.array_join(F.array_sort(F.collect_list(run)), "|").alias("runs")).select(run, "runs")


def replay(stored: DataFrame, again: DataFrame, keys: list[str], values: list[str], digits: int = 9) -> DataFrame:
    """One row: rows of a stored table that a recomputation lacks, of the recomputation that the table lacks, rows whose values
    differ, and whether both are the same. Numbers are rounded first; keys are unique in either."""
    shown = lambda df, p: df.select(*keys, F.struct(*[F.round(c, digits).alias(c) if dict(df.dtypes)[c] == "double" else F.col(c) for c in values]).alias(p))
    both = shown(stored, "__s").join(shown(again, "__a"), keys, "full_outer")
    got = both.agg(
        F.count_if(F.col("__a").isNull()).alias("missing"), F.count_if(F.col("__s").isNull()).alias("extra"),
        F.count_if(F.col("__a").isNotNull() & F.col("__s").isNotNull() & (F.col("__a") != F.col("__s"))).alias("changed"),
    )
    return got.withColumn("verified", (F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("changed") == 0))


def variance_components(runs: DataFrame, arm: str, outer: str, value: str) -> DataFrame:
    """(arm, mean, between, within): the mean of outer means, their population variance, and the mean variance within them."""
    own = runs.groupBy(arm, outer).agg(F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    return own.groupBy(arm).agg(F.avg("m").alias("mean"), F.var_pop("m").alias("between"), F.avg("v").alias("within"))


def exemplars(sizes: DataFrame, key: str, size: str) -> DataFrame:
    """(role, key, size): the largest, the median and the smallest group by size, ties to the smaller key."""
    ranked = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.desc(size), key)))  # one row a group
    n = F.count("*").over(Window.partitionBy())
    role = F.when(F.col("place") == 1, "largest").when(F.col("place") == F.floor((F.col("n") + 1) / 2), "median").when(F.col("place") == F.col("n"), "smallest")
    return ranked.withColumn("n", n).withColumn("role", role).where("role is not null").select("role", key, size)


def corners(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """A normalized box's pixel corners, without clipping."""
    return F.struct(((x - w / 2) * width).alias("x1"), ((y - h / 2) * height).alias("y1"), ((x + w / 2) * width).alias("x2"), ((y + h / 2) * height).alias("y2"))


def looked_up(key: Column, names: dict, unknown: str = "unknown") -> Column:
    """A name from a fixed table, `unknown` for a key that it lacks."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[key], F.lit(unknown))


def cleaned(x: Column) -> Column:
    """A number for publication: NaN is null; infinity is an error."""
    return F.when(F.isnan(x), None).when(F.abs(x) == float("inf"), F.raise_error(F.lit("infinite number")).cast("double")).otherwise(x)
