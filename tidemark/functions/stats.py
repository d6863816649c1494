"""Aggregates with explicit denominators: an empty group has count 0 and null statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The quantiles of a distribution, by the names of their columns (linear interpolation, exact).
QUANTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75, "p90": 0.9, "p95": 0.95, "p975": 0.975, "p99": 0.99, "p995": 0.995, "p999": 0.999}


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite: undefined numbers are null in this library."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def distribution(x: str | Column, digits: int = 6, quantiles: dict[str, float] = QUANTILES) -> list[Column]:
    """count, mean, population std, min, max and quantiles of x's non-null values, as aggregates."""
    x = F.col(x) if isinstance(x, str) else x
    show = lambda c, name: F.round(c, digits).alias(name)
    ends = [F.count(x).alias("count"), show(F.avg(x), "mean"), show(F.stddev_pop(x), "std"), show(F.min(x), "min"), show(F.max(x), "max")]
    each = F.percentile(x, F.array(*[F.lit(q) for q in quantiles.values()]))  # one aggregate, shared by all columns
    return ends + [show(F.get(each, F.lit(i)), name) for i, name in enumerate(quantiles)]


def running(df: DataFrame, by: list[str], order: list, sums: dict[str, Column]) -> DataFrame:
    """df with the running sums `sums` (by name), within equal `by`, of the rows up to and with each row in `order`.

    Rows go to range partitions of (by, order), kept in the shared folder so that a row's partition is fixed; a row's sum is
    that of the partitions before its own and of the rows before it there. One key may thus have most of the rows.
    """
    from tidemark.storage import cut

    laid = cut(df.withColumns({f"__{n}": c.cast("double") for n, c in sums.items()}).repartitionByRange(*by, *order).withColumn("__p", F.spark_partition_id()))
    before = Window.partitionBy(*by).orderBy("__q").rowsBetween(Window.unboundedPreceding, -1)
    starts = laid.groupBy(*by, F.col("__p").alias("__q")).agg(*[F.sum(f"__{n}").alias(f"__{n}") for n in sums])  # a row a key and partition
    starts = starts.select(*[F.col(c).alias(f"__by_{c}") for c in by], "__q", *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0.0)).alias(f"__s_{n}") for n in sums])
    own = Window.partitionBy("__p", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = laid.withColumns({f"__{n}": F.sum(f"__{n}").over(own) for n in sums})
    same = F.col("__p") == F.col("__q")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    joined = inner.join(starts, same).withColumns({n: F.col(f"__{n}") + F.col(f"__s_{n}") for n in sums})
    return joined.select(*df.columns, *sums)


def average_rank(x: str, by: list[str] | None = None) -> Column:
    """Rank from 1 in ascending order of x, ties share their mean rank; null for null. A window: for groups that a task holds."""
    own = Window.partitionBy(*(by or [F.lit(1)]))
    ties = Window.partitionBy(*(by or []), x)
    rank = F.rank().over(own.orderBy(F.asc_nulls_last(x))) + (F.count(F.lit(1)).over(ties) - 1) / 2.0
    return F.when(F.col(x).isNotNull(), rank)


def average_ranks(df: DataFrame, x: str, by: list[str], out: str, of: str | None = None) -> DataFrame:
    """df with x's rank from 1 among the rows of equal `by` (ties share their mean rank; null for null), and in `of` their number.

    Ranks come from a table of distinct values, so only counts are summed in order.
    """
    counts = df.where(F.col(x).isNotNull()).groupBy(*by, F.col(x).alias("__x")).agg(F.count("*").alias("__n"))
    ranked = running(counts, by, ["__x"], {"__upto": F.col("__n")})
    ranked = ranked.withColumn(out, F.col("__upto") - (F.col("__n") - 1) / 2.0)
    if of:
        total = counts.groupBy(*by).agg(F.sum("__n").alias(of))
        ranked = ranked.join(total, by) if by else ranked.crossJoin(total)  # a single row
    ranked = ranked.select(*[F.col(c).alias(f"__by_{c}") for c in by], "__x", out, *([of] if of else []))
    same = F.col(x) == F.col("__x")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    return df.join(ranked, same, "left").drop("__x", *[f"__by_{c}" for c in by])


def global_average_rank(df: DataFrame, x: str, out: str) -> DataFrame:
    """df with the average rank of x over all rows."""
    return average_ranks(df, x, [], out)


def pearson(x: str | Column, y: str | Column, least: int = 3) -> Column:
    """Correlation over complete pairs; null under `least` pairs or if either is constant."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    fine = (F.count(a) >= least) & (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return F.when(fine, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def entropy_bits(counts: Column) -> Column:
    """Entropy in bits of an array of counts; zero counts add nothing."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c)
    return F.aggregate(F.filter(counts, lambda c: c > 0), F.lit(0.0), lambda s, c: s - c / total * F.log2(c / total))
