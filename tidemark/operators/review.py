"""Review tables: decision counts at several grains, upserts with history, replay and pooled revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def decision_summary(review: DataFrame, stratum: str, group: str, decision: str) -> DataFrame:
    """Counts by decision (blank is one), overall, by stratum, by group and by both: one pass of grouping sets."""
    rows = review.select(F.col(stratum).alias("stratum"), F.col(group).alias("grp"), F.coalesce(decision, F.lit("")).alias("decision"))
    each = rows.groupingSets([[], ["stratum"], ["grp"], ["stratum", "grp"]], "stratum", "grp").agg(
        F.grouping_id().alias("grain"), F.count("*").alias("total"), F.count_if(F.col("decision") != "").alias("decided"),
        F.round(F.count_if(F.col("decision") != "") / F.count("*"), 6).alias("rate"),
    )
    return each


def upsert(review: DataFrame, decisions: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """review with the decisions' columns where they differ, and the log of changes (key, column, before, after).

    A decision for an unknown key is no row; a null in a decision leaves the value as it was.
    """
    new = decisions.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    both = review.join(new, key, "left")
    changed = {c: F.col(f"__{c}").isNotNull() & ~F.col(f"__{c}").eqNullSafe(F.col(c)) for c in columns}
    merged = both.select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in review.columns])
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("before"), F.col(f"__{c}").cast("string").alias("after"), changed[c].alias("hit")) for c in columns])
    log = both.select(key, F.explode(F.filter(entries, lambda e: e["hit"])).alias("e")).select(key, "e.column", "e.before", "e.after")
    return merged, log


def first_decisions(events: DataFrame, key: str, order: list[str], decision: str) -> DataFrame:
    """(key, decision, events, conflict): the first decision of each key stays; later different ones are a conflict."""
    w = Window.partitionBy(key).orderBy(*order)
    ranked = events.withColumn("__n", F.row_number().over(w))
    return ranked.groupBy(key).agg(
        F.max(F.when(F.col("__n") == 1, F.col(decision))).alias(decision), F.count("*").alias("events"), (F.countDistinct(decision) > 1).alias("conflict"),
    )


def pool(revisions: list[DataFrame], key: str, decision: str) -> DataFrame:
    """(key, revisions, decision, conflict): decisions pooled over revisions; one in conflict is null."""
    rows = revisions[0].select(key, decision)
    for r in revisions[1:]:
        rows = rows.unionByName(r.select(key, decision))
    one = F.countDistinct(decision) == 1
    return rows.groupBy(key).agg(F.count("*").alias("revisions"), F.when(one, F.min(decision)).alias(decision), (F.countDistinct(decision) > 1).alias("conflict"))
