"""The queries of this subpackage: each applies one operator to its whole table and derives the digests to return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, bpe, chat, language, lines, minhash, mix, pii, ranges, warc
from tidemark.llm.common import narrow

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    narrow(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    got = chat.read_back(chat.forest(rows))
    return got.withColumn("conv_id", F.nullif("conv", F.lit("")).cast("long")).drop("conv")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = minhash.classes(table(spark, sf_dir, "documents"))
    return got.withColumn("kept", F.col("doc_id") == F.col("class_id"))


def op3_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ranges.joined(table(spark, sf_dir, "embeddings"))
    return got.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = [k.name for k in pii.KINDS if k.base]
    found = pii.detect(table(spark, sf_dir, "documents"))

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(k) for k in base]
    own = F.filter("spans", lambda x: x["kind"].isin(base))
    return found.select("doc_id", *counts, F.sha2(pii.listed(own), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.col("lines.text"), 256).alias("kept_sha256"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.where(F.col("vec_id") % 100 == 0))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mix.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), texts=False)
    return got.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())
    return got.select("doc_id", "bpe.*")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~language.held_out()))
    told = docs.select("doc_id", language.held_out().alias("held_out"), language.classify(F.col("text"), model).alias("p"))
    return told.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def queries() -> dict[str, Query]:
    return {
        "op1_chat": op1_chat,
        "op2_minhash": op2_minhash,
        "op3_ranges": op3_ranges,
        "op4_pii": op4_pii,
        "op5_lines": op5_lines,
        "op6_warc": op6_warc,
        "op7_ann": op7_ann,
        "op8_mix": op8_mix,
        "op9_bpe": op9_bpe,
        "op10_language": op10_language,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat": chat.sql(), "op3_ranges": ranges.sql(), "op4_pii": pii.sql(), "op5_lines": lines.sql(), "op6_warc": warc.sql()}
