"""Structured Streaming forms of the series operators: an extension, as the batch ones are bounded."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sessions(events: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """(key, start, end, n): sessions of events at most `gap` apart, closed once the watermark passes them."""
    own = events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return own.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_occurrences(events: DataFrame, content: str, ts: str, late: str) -> DataFrame:
    """The first event of each content within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([content])


def windowed(events: DataFrame, key: str, ts: str, value: str, width: str, slide: str, late: str) -> DataFrame:
    """(key, start, end, n, total) over sliding windows; events later than the watermark are dropped."""
    own = events.withWatermark(ts, late).groupBy(key, F.window(ts, width, slide).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return own.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def centroid_changes(events: DataFrame, key: str, order: str, vector: str, window: int) -> DataFrame:
    """(key, order, change): as the batch operator, once `window` vectors stand on either side; a key's state is those vectors.

    Events of a key must come in order; the state holds at most twice the window and never times out.
    """
    kinds = dict(events.dtypes)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        orders, flat = state.get if state.exists else ([], [])
        held = [(o, np.asarray(v, np.float64)) for o, v in zip(orders, flat)]
        out = []
        for pdf in batches:
            for o, v in pdf.sort_values(order)[[order, vector]].itertuples(index=False):
                held.append((o, np.asarray(v, np.float64)))
                if len(held) == 2 * window:
                    a, b = (np.sum([x for _, x in part], axis=0) for part in (held[:window], held[window:]))
                    n = float(np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))
                    out.append((k[0], held[window][0], float(1 - (a * b).sum() / n) if n else None))
                    held.pop(0)
        state.update(([o for o, _ in held], [[float(c) for c in x] for _, x in held]))
        yield pd.DataFrame(out, columns=[key, order, "change"])

    rows = events.select(key, order, vector)
    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, change double"
    held = f"orders array<{kinds[order]}>, vectors array<array<double>>"
    return rows.groupBy(key).applyInPandasWithState(step, schema, held, "append", GroupStateTimeout.NoTimeout)


def append_decisions(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that appends decisions whose key the table at `path` doesn't have yet; the first of a batch counts.

    A batch that is written again after a failure finds its own keys and adds nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        from pyspark.errors import AnalysisException

        new = batch.dropDuplicates([key])
        try:
            new = new.join(batch.sparkSession.read.parquet(path).select(key), key, "left_anti")
        except AnalysisException:  # the first batch: there is no table yet
            pass
        new.select(batch.columns).write.mode("append").parquet(path)

    return write
