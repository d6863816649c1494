"""What a session needs before a query runs."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of the session's application, once."""
    context = spark.sparkContext
    if context.applicationId in _done:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tidemark-code-")) / "tidemark_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, os.path.join(package.name, p.relative_to(package)))
    context.addPyFile(str(target))
    _done.add(context.applicationId)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
