"""ZIP archives and files as tables: members, gates, hashes; errors are rows, not failures."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import KINDS, depth, extension, member_kind, portable, split_of, stem

MEMBER = "archive string, ordinal int, path string, size long, compressed long, crc long, is_directory boolean, encrypted boolean, sha256 string, error string"


@dataclass(frozen=True)
class Limits:
    """What an archive may hold: entries, bytes in all and a member, and how far a member may expand."""

    entries: int = 200_000
    total: int = 64 << 30
    member: int = 1 << 30
    ratio: float = 1000.0


def files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, size, modified, sha256) of all files under root; contents are hashed on the JVM."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def opened(archives: DataFrame, kinds: list[str], limits: Limits, contents: bool) -> DataFrame:
    wanted = {e[1:] for k in kinds for e in KINDS.get(k, [])}

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in MEMBER.split(", ")] + ["content"] * contents
        for pdf in batches:
            for path, raw in zip(pdf["path"], pdf["content"]):
                rows: list[tuple] = []
                try:
                    with zipfile.ZipFile(io.BytesIO(raw)) as z:
                        for i, info in enumerate(z.infolist()):
                            digest, error, data = None, None, None
                            secret = bool(info.flag_bits & 1)
                            if secret:
                                error = "encrypted"
                            elif info.file_size > limits.member or info.file_size > limits.ratio * max(info.compress_size, 1):
                                error = "too large"
                            elif not info.is_dir() and (not kinds or info.filename.rpartition(".")[2].lower() in wanted):
                                try:
                                    with z.open(info) as f:
                                        h, parts = hashlib.sha256(), []
                                        while chunk := f.read(1 << 20):
                                            h.update(chunk)
                                            if contents:
                                                parts.append(chunk)
                                    digest, data = h.hexdigest(), b"".join(parts)
                                except (zipfile.BadZipFile, OSError, EOFError, NotImplementedError) as e:
                                    error = f"unreadable: {e}"
                            row = path, i, info.filename, info.file_size, info.compress_size, info.CRC, info.is_dir(), secret, digest, error
                            rows.append((*row, data) if contents else row)
                            if contents and len(rows) >= 64 or len(rows) >= 5000:
                                yield pd.DataFrame(rows, columns=names)
                                rows = []
                except zipfile.BadZipFile as e:
                    row = path, None, None, None, None, None, None, None, None, f"not an archive: {e}"
                    rows.append((*row, None) if contents else row)
                out = pd.DataFrame(rows, columns=names)
                yield out.astype({c: "Int64" for c in ("ordinal", "size", "compressed", "crc")} | {c: "boolean" for c in ("is_directory", "encrypted")})

    return archives.select("path", "content").mapInPandas(read, MEMBER + ", content binary" * contents)


def members(spark: SparkSession, root: str, kinds: list[str] | None = None, limits: Limits = Limits()) -> DataFrame:
    """One row a member of every .zip under root, hashed if of one of `kinds` (none: all); an unreadable archive is one row."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(root)
    return opened(found, kinds or [], limits, False)


def member_contents(spark: SparkSession, root: str, kinds: list[str] | None = None, limits: Limits = Limits()) -> DataFrame:
    """As members, with each member's bytes."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(root)
    return opened(found, kinds or [], limits, True)


def described(rows: DataFrame, folders: dict[str, list[str]]) -> DataFrame:
    """Members with kind, extension, depth, stem, split and whether the path is portable."""
    p = F.col("path")
    return rows.withColumns({"kind": member_kind(p), "extension": extension(p), "depth": depth(p), "stem": stem(p), "split": split_of(p, folders), "portable": portable(p)})


def gate(rows: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(archive, entries, bytes, reason): why an archive is refused, null if it isn't."""
    each = rows.groupBy("archive").agg(F.count("path").alias("entries"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_if(F.col("path").isNotNull() & ~portable(F.col("path"))).alias("unsafe"))
    reason: Column = (
        F.when(F.col("entries") > limits.entries, "entries").when(F.col("bytes") > limits.total, "bytes").when(F.col("unsafe") > 0, "unsafe path")
        .when(F.col("errors") > 0, "unreadable member")
    )
    return each.select("archive", "entries", "bytes", reason.alias("reason"))
