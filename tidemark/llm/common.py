"""What the operators of this subpackage share: running sums over a whole table, besides the library's own storage and graphs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.graph import components
from tidemark.operators.joins import spread_join
from tidemark.storage import FEW, cut, cut_counted, narrow, release, scratch, small, stored

__all__ = ["FEW", "components", "cut", "cut_counted", "narrow", "release", "running", "scratch", "small", "spread_join", "stored"]


def running(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """df in the order of its columns `order`, with the sum of `value` over all rows before each row.

    Range-partitioned and sorted, kept in the shared folder, so that a row's partition is fixed; only one sum a
    partition reaches the driver, and each partition adds its own rows in a stream.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    laid = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order))
    sums = {r.p: int(r.s or 0) for r in laid.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(value).alias("s")).collect()}
    start, total = {}, 0
    for p in sorted(sums):
        start[p] = total
        total += sums[p]

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done = start.get(TaskContext.get().partitionId(), 0)
        for pdf in batches:
            ends = done + pdf[value].fillna(0).astype("int64").cumsum()
            pdf[out] = ends - pdf[value].fillna(0).astype("int64")
            done = int(ends.iloc[-1]) if len(pdf) else done
            yield pdf

    return laid.mapInPandas(add, T.StructType([*laid.schema.fields, T.StructField(out, T.LongType())]))
