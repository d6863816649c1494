"""Vectors that take part in searches and joins: any length, each compared with vectors of its own length."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(v: Column) -> Column:
    """A vector that isn't null, empty, zero, and has no null, NaN or infinite component."""
    x = F.transform(v, lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(x, lambda c: c != 0), F.lit(False))


def taking_part(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, v): rows with an id and a usable vector. Single precision stays so where it is stored: it widens without loss."""
    kind = dict(df.dtypes)[vector]
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v")))
    return rows if kind in ("array<float>", "array<double>") else rows.withColumn("v", F.col("v").cast("array<double>"))


def matrix(vectors: pd.Series) -> np.ndarray:
    """Vectors of one length as rows in double precision."""
    return np.stack([np.asarray(v, np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 0))


def by_length(vectors: pd.Series) -> dict[int, np.ndarray]:
    """The places of the vectors of each length."""
    sizes = np.fromiter((len(v) for v in vectors), np.int64, len(vectors))
    return {int(d): np.flatnonzero(sizes == d) for d in np.unique(sizes)}


def bounded_sample(rows: DataFrame, most: int, seed: int) -> dict[int, np.ndarray]:
    """At most `most` distinct vectors by length, those with the least hash: the documented bound of what a driver fits on."""
    n = rows.agg(F.approx_count_distinct(F.xxhash64("v"))).first()[0]
    if not n:
        return {}
    h = F.xxhash64(F.lit(seed), "v").bitwiseAND(F.lit(2**63 - 1))
    part = int(2**63 * min(1.0, 1.5 * most / n)) - 1
    got = rows.where(h <= part).select("v", h.alias("h")).groupBy("h").agg(F.first("v").alias("v")).orderBy("h").limit(most).collect()
    vectors = pd.Series([r.v for r in got], dtype=object)
    return {d: matrix(vectors.iloc[at]) for d, at in by_length(vectors).items()}
