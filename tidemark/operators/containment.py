"""Which texts hold another table's texts whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def runs(text: Column, n: int) -> Column:
    """Distinct hashes of a text's runs of n words. The words are bound once, as a lambda's variable."""

    def hashed(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1)))
        return F.when(F.size(w) >= n, F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice(w, i, F.lit(n)), " "))))

    return F.array_distinct(F.coalesce(F.element_at(F.transform(F.array(words(text)), hashed), 1), F.array().cast("array<bigint>")))


def containing(items: DataFrame, item_id: str, item_text: str, docs: DataFrame, doc_id: str, doc_text: str, n: int = 8) -> DataFrame:
    """(item_id, documents, first_doc, contaminated): documents whose text holds an item's whole text.

    An item's probe is the run of n whole words after its first; a document that holds the item has that run among its own,
    so only pairs that share it are compared whole. Items too short for a probe are compared by a scan of the documents.
    """
    w = words(F.col(item_text))
    probe = F.when(F.size(w) >= n + 2, F.xxhash64(F.array_join(F.slice(w, F.lit(2), F.lit(n)), " ")))
    own = items.select(item_id, F.col(item_text).alias("__t"), probe.alias("__p"))
    docs = docs.select(doc_id, F.col(doc_text).alias("__d"))
    probes = own.where("__p is not null")
    wanted = probes.select("__p").distinct()
    hits = docs.select(doc_id, F.explode(runs(F.col("__d"), n)).alias("__p")).join(wanted, "__p").distinct()
    pairs = hits.join(probes, "__p").join(docs, doc_id).where(F.contains("__d", "__t")).select(item_id, doc_id)
    short = own.where("__p is null and __t is not null")
    if not short.isEmpty():
        pairs = pairs.unionByName(short.join(docs, F.contains("__d", "__t")).select(item_id, doc_id))
    found = pairs.distinct().groupBy(item_id).agg(F.count("*").alias("documents"), F.min(doc_id).alias("first_doc"))
    return items.select(item_id).join(found, item_id, "left").select(item_id, F.coalesce("documents", F.lit(0)).alias("documents"), "first_doc", F.coalesce(F.col("documents") > 0, F.lit(False)).alias("contaminated"))
