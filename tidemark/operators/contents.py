"""Occurrences and contents: identities, duplicate accounting, provenance consensus and split masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The bits of a split mask.
SPLITS = {"train": 1, "val": 2, "test": 4}
UNIT = chr(31)


def content_id(content: str | Column) -> Column:
    return F.sha2(F.col(content) if isinstance(content, str) else content, 256)


def stable_id(*parts: Column) -> Column:
    """SHA-256 of the parts joined by the unit separator."""
    return F.sha2(F.concat_ws(UNIT, *parts), 256)


def split_bit(split: str | Column) -> Column:
    """The mask of one split name, 0 for unknown."""
    c, out = F.col(split) if isinstance(split, str) else split, F.lit(0)
    for name, bit in SPLITS.items():
        out = F.when(c == name, bit).otherwise(out)
    return out


def crosses(mask: Column) -> Column:
    """Whether a mask has more than one split."""
    return mask.bitwiseAND(mask - 1) != 0


def split_names(mask: Column) -> Column:
    """A mask's splits joined by |, in the order of their bits."""
    return F.concat_ws("|", *[F.when(mask.bitwiseAND(F.lit(bit)) != 0, name) for name, bit in SPLITS.items()])


def identities(occurrences: DataFrame, content: str, frame: str, split: str) -> DataFrame:
    """One row a content: occurrences, smallest frame, split mask and whether it crosses splits."""
    own = occurrences.groupBy(content).agg(F.count("*").alias("occurrences"), F.min(frame).alias("representative"), F.bit_or(split_bit(split)).alias("mask"))
    return own.withColumns({"n_splits": F.bit_count("mask"), "crosses": crosses(F.col("mask"))})


def consensus(value: str, out: str | None = None) -> Column:
    """The one value that all rows of a group have, null if they differ or any is null."""
    c = F.col(value)
    return F.when((F.min(c) == F.max(c)) & (F.count(c) == F.count(F.lit(1))), F.min(c)).alias(out or value)


def overlap_matrix(occurrences: DataFrame, content: str, split: str) -> DataFrame:
    """(split_a, split_b, shared): distinct contents found in both splits, for all ordered pairs; the diagonal is 0."""
    masks = occurrences.groupBy(content).agg(F.bit_or(split_bit(split)).alias("mask")).groupBy("mask").agg(F.count("*").alias("n"))
    grid = occurrences.sparkSession.createDataFrame([(a, b, x, y) for a, x in SPLITS.items() for b, y in SPLITS.items()], "split_a string, split_b string, x int, y int")
    both = F.col("mask").bitwiseAND(F.col("x").bitwiseOR(F.col("y"))) == F.col("x").bitwiseOR(F.col("y"))
    hit = F.when(both & (F.col("x") != F.col("y")), F.col("n")).otherwise(0)
    return grid.crossJoin(F.broadcast(masks)).groupBy("split_a", "split_b").agg(F.sum(hit).alias("shared"))  # at most 8 masks by 9 cells


def duplicate_reports(occurrences: DataFrame, content: str, label: str) -> DataFrame:
    """Contents with several occurrences: whether their labels are known, equal, or in conflict."""
    own = occurrences.groupBy(content).agg(
        F.count("*").alias("occurrences"), F.count(label).alias("labelled"), F.countDistinct(label).alias("labels"),
    )
    return own.where("occurrences > 1").withColumn("conflict", F.col("labels") > 1)


def dataset_digest(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    """One row: a digest of the rows as a multiset, whatever their order or partitioning.

    Each row's digest goes to a bucket by its first `digits` hex digits; a bucket's digests are sorted and hashed, then the
    buckets. Buckets are bounded in number; with more rows than they hold well, use more digits.
    """
    row = F.sha2(F.concat_ws(UNIT, *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns]), 256)
    buckets = df.select(row.alias("d")).groupBy(F.substring("d", 1, digits).alias("b")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("d")).alias("ds"))
    hashed = buckets.select("b", "n", F.sha2(F.array_join("ds", ""), 256).alias("h"))
    every = F.array_sort(F.collect_list(F.concat("b", "h")))
    return hashed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.sha2(F.array_join(every, ""), 256).alias("digest"))


def equal_tables(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: rows of either table that the other lacks, as multisets, and whether they are equal."""
    a = left.exceptAll(right).agg(F.count("*").alias("only_left"))
    b = right.exceptAll(left).agg(F.count("*").alias("only_right"))
    return a.crossJoin(b).withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations): how many rows break each rule; a rule that is null counts as broken."""
    counts = df.agg(*[F.coalesce(F.sum(F.when(F.coalesce(rule, F.lit(False)), 0).otherwise(1)), F.lit(0)).alias(name) for name, rule in rules.items()])
    return counts.unpivot([], list(rules), "rule", "violations")
