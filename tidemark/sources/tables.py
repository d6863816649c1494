"""Text tables with strict types, and publications: tables with a receipt written last and checked on reading."""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.contents import dataset_digest

#: How a text of each type must look to be cast.
SHAPES = {
    "long": r"^[+-]?[0-9]{1,18}$",
    "double": r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$",
    "boolean": r"^(true|false)$",
    "string": r"(?s)^.*$",
}


def read_text_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV of strings: no type is guessed, and an empty field is an empty string, never null."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("multiLine", True).option("escape", '"').option("emptyValue", "").option("nullValue", "\0").csv(path)
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])


def strict(rows: DataFrame, types: dict[str, str], optional: set[str] = frozenset()) -> tuple[DataFrame, DataFrame]:
    """(good, rejected): rows whose texts all have their type's shape, cast; others as they were, with the column at fault.

    Empty is null in an optional column and a fault elsewhere (but for strings).
    """
    fault = F.lit(None).cast("string")
    for c, kind in reversed(types.items()):
        empty = (F.col(c) == "") if c in optional else F.lit(False)
        fault = F.when(~(empty | F.col(c).rlike(SHAPES[kind])), c).otherwise(fault)
    marked = rows.withColumn("fault", fault)
    cast = [F.when(~((F.col(c) == "") & F.lit(c in optional)), F.col(c).try_cast(kind)).alias(c) for c, kind in types.items()]
    rest = [c for c in rows.columns if c not in types]
    return marked.where("fault is null").select(*cast, *rest), marked.where("fault is not null")


def describe(tables: dict[str, DataFrame]) -> dict:
    """Rows, columns with types, and the logical digest of each table."""
    out = {}
    for name, df in sorted(tables.items()):
        one = dataset_digest(df, df.columns).first()
        out[name] = {"rows": int(one.rows), "columns": [list(c) for c in df.dtypes], "digest": one.digest}
    return out


def encoded(value: object) -> bytes:
    """A value of plain types as bytes that no other value has: a type's letter, the length of what follows, and that.

    Mappings go by their keys' order; numbers that are equal but of another type differ; NaN and infinity have no encoding.
    """
    if isinstance(value, dict):
        kind, parts = b"m", b"".join(encoded(k) + encoded(value[k]) for k in sorted(value))
    elif isinstance(value, (list, tuple)):
        kind, parts = b"l", b"".join(map(encoded, value))
    elif isinstance(value, bool) or value is None:
        kind, parts = b"c", str(value).encode()
    elif isinstance(value, int):
        kind, parts = b"i", str(value).encode()
    elif isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("a number that isn't finite has no identity")
        kind, parts = b"f", value.hex().encode()
    else:
        kind, parts = b"s", str(value).encode("utf-8")
    return kind + str(len(parts)).encode() + b":" + parts


def identity(value: object, length: int = 10) -> str:
    """A name for a value: the start of its encoding's BLAKE2 digest, `length` bytes in hex."""
    return hashlib.blake2b(encoded(value), digest_size=length).hexdigest()


def publish(spark: SparkSession, root: str, kind: str, config: dict, tables: dict[str, DataFrame]) -> str:
    """Write tables under root/kind-id, the id from kind, config and the tables' digests; the receipt goes last, so a folder
    without one is unfinished. Nothing is overwritten: the same publication again is an error of the writer."""
    body = {"kind": kind, "config": config, "tables": describe(tables)}
    path = f"{root.rstrip('/')}/{kind}-{identity(body)}"
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
    receipt = spark.createDataFrame([(json.dumps(body | {"id": identity(body)}),)], "value string")
    receipt.coalesce(1).write.mode("errorifexists").text(f"{path}/receipt")
    return path


def inspect(spark: SparkSession, path: str) -> dict:
    """Booleans of a publication's checks, recomputed from its bytes; `valid` if all hold. A failure to read is a failed check."""
    checks: dict[str, bool] = {}
    try:
        lines = [r.value for r in spark.read.text(f"{path}/receipt").limit(2).collect()]
        body = json.loads(lines[0])
        own = body.pop("id")
        checks["one_receipt"] = len(lines) == 1
        checks["identity"] = own == identity(body) and path.rstrip("/").endswith(own)
        for name, want in body["tables"].items():
            got = describe({name: spark.read.parquet(f"{path}/{name}")})[name]
            checks[f"table_{name}"] = got == want
    except Exception as e:  # noqa: BLE001 - whatever fails, the publication isn't valid
        checks[f"readable ({type(e).__name__})"] = False
    return checks | {"valid": bool(checks) and all(checks.values())}


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(path, id, kind) of finished publications under root; an id found twice is left out."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "part-*.txt").text(root).select(F.input_file_name().alias("file"), "value")
    rows = files.where(F.col("file").contains("/receipt/")).select(F.regexp_replace("file", "/receipt/[^/]*$", "").alias("path"), F.get_json_object("value", "$.id").alias("id"), F.get_json_object("value", "$.kind").alias("kind"))
    once = rows.groupBy("id").agg(F.count("*").alias("n")).where("n = 1").select("id")
    return rows.join(once, "id").select("path", "id", "kind")
