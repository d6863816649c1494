"""Line deduplication: two Bloom filters find the lines seen twice, and only those shuffle for exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import FEW, cut, spread_join, stored

#: A page of a filter, in bytes; tasks send only the pages that they touched.
PAGE = 8192
#: Digests of dropped lines that are broadcast to the texts, and buckets (of 32,768 bits) of the bitmap that is used beyond them.
SMALL, BUCKETS = 500_000, 2048
STRIP = b" \t\n\x0b\x0c\r"


def keys(text: str | None, least: int) -> list[bytes | None]:
    """A line's key: stripped and A-Z lower-cased, in UTF-8; None where it has fewer than `least` code points."""
    out: list[bytes | None] = []
    for line in (text or "").encode("utf-8", "replace").split(b"\n"):
        key = line.strip(STRIP).lower()  # of bytes, lower() changes A-Z alone
        out.append(key if len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8")) >= least) else None)
    return out


def places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash's two bits of a filter."""
    mask = np.uint64(bits - 1)
    return hashes & mask, (hashes >> np.uint64(32)) * np.uint64(0x9E3779B1) + (hashes >> np.uint64(7)) & mask


def hashed(found: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter((xxh3_64_intdigest(k) for k in found), np.uint64, len(found))


def filters(docs: DataFrame, text: str, least: int, bits: int) -> np.ndarray:
    """The filter of keys seen in two rows or more, as bytes; it has every such key, and a few others.

    Each task fills a once-seen and a twice-seen filter over its rows. Filters merge by OR, and what two once-seen filters
    share is seen twice. Touched pages shuffle by their number and merge in a stream; the twice-seen filter, of
    `bits` bits whatever the input, reaches the driver.
    """

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once, twice = np.zeros(bits, bool), np.zeros(bits, bool)
        for pdf in batches:
            got = [hashed(list({k for k in keys(t, least) if k is not None})) for t in pdf["text"]]
            h, n = np.unique(np.concatenate(got) if got else np.zeros(0, np.uint64), return_counts=True)
            a, b = places(h, bits)
            again = (n > 1) | (once[a] & once[b])
            twice[a[again]] = twice[b[again]] = True
            once[a] = once[b] = True
        pages = {}
        for name, f in (("once", once), ("twice", twice)):
            pages[name] = np.packbits(f).reshape(-1, min(PAGE, bits // 8))
        touched = np.flatnonzero(pages["once"].any(axis=1))
        for i in range(0, len(touched), 64):
            some = touched[i : i + 64]
            yield pd.DataFrame({"page": some, "once": [pages["once"][p].tobytes() for p in some], "twice": [pages["twice"][p].tobytes() for p in some]})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, once, twice = None, None, None
        for pdf in batches:
            for page, o, t in zip(pdf["page"], pdf["once"], pdf["twice"]):
                o, t = np.frombuffer(o, np.uint8), np.frombuffer(t, np.uint8)
                if page != at:
                    if at is not None and twice.any():
                        yield pd.DataFrame({"page": [at], "twice": [twice.tobytes()]})
                    at, once, twice = page, o, t
                else:
                    once, twice = once | o, twice | t | (once & o)
        if at is not None and twice.any():
            yield pd.DataFrame({"page": [at], "twice": [twice.tobytes()]})

    pages = docs.select(F.col(text).alias("text")).mapInPandas(fill, "page long, once binary, twice binary")
    merged = pages.repartition("page").sortWithinPartitions("page").mapInPandas(merge, "page long, twice binary")
    out = np.zeros((max(1, bits // 8 // PAGE), min(PAGE, bits // 8)), np.uint8)
    for r in merged.collect():  # at most bits / 8 bytes
        out[r.page] = np.frombuffer(r.twice, np.uint8)
    return out.reshape(-1)


def size_for(docs: DataFrame, text: str, most: int) -> int:
    """Bits of a filter: a power of two, 8 or more for every 64 bytes of text, at most `most`: beyond that the filter
    lets more keys through, which costs shuffle and changes no result."""
    total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return min(most, 1 << max(16, int(total * 8 / 64).bit_length()))


def repeated(docs: DataFrame, doc_id: str, text: str, least: int = 40, copies: int = 5, most_bits: int = 1 << 26) -> DataFrame:
    """(doc_id, drops): for documents that lose lines, the 16-byte digests of the keys they lose.

    Only keys in the twice-seen filter leave their task, as digests; groups of them count distinct documents (so repeated
    rows of a document count once) and name the largest doc_id, which keeps the line.
    """
    bits = size_for(docs, text, most_bits)
    twice = docs.sparkSession.sparkContext.broadcast(filters(docs, text, least, bits))

    def suspects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_128_digest

        seen = twice.value
        for pdf in batches:
            ids, digests = [], []
            found = [list({k for k in keys(t, least) if k is not None}) for t in pdf["text"]]
            h = hashed([k for own in found for k in own])
            a, b = places(h, bits)
            hit = ((seen[a >> np.uint64(3)] >> (7 - (a & np.uint64(7))).astype(np.uint8)) & (seen[b >> np.uint64(3)] >> (7 - (b & np.uint64(7))).astype(np.uint8)) & 1).astype(bool)
            at = 0
            for i, own in zip(pdf["doc_id"], found):
                for k in range(len(own)):
                    if hit[at + k]:
                        ids.append(i)
                        digests.append(xxh3_128_digest(own[k]))
                at += len(own)
            yield pd.DataFrame({"doc_id": pd.Series(ids, dtype=object), "key": pd.Series(digests, dtype=object)})

    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"))
    pairs = rows.mapInPandas(suspects, "doc_id string, key binary").select("key", F.col("doc_id").cast("long").alias("doc_id")).groupBy("key", "doc_id").agg(F.lit(1).alias("one"))
    pairs = stored(pairs.select("key", "doc_id"), "lines")
    many = pairs.groupBy("key").agg(F.count("doc_id").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= copies)
    many = cut(many)
    lost = spread_join(pairs, many, "key", "doc_id", "n", pairs.count()).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return cut(lost.groupBy("doc_id").agg(F.collect_list("key").alias("drops")))


def dropped(text: Column, drops: Column, least: int) -> Column:
    """struct<n_lines, n_dropped, text>: a text without the lines whose keys' digests are in drops; null counts as empty."""

    @F.pandas_udf("n_lines long, n_dropped long, text string")
    def cut_lines(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_128_digest

        def one(t: str | None, gone) -> tuple[int, int, str]:
            t = t or ""
            if gone is None or not len(gone):
                return t.count("\n") + 1, 0, t
            gone, lines = {bytes(g) for g in gone}, t.split("\n")
            kept = [x for x, k in zip(lines, keys(t, least)) if k is None or xxh3_128_digest(k) not in gone]
            return len(lines), len(lines) - len(kept), "\n".join(kept)

        for texts, gone in batches:
            yield pd.DataFrame([one(t, g) for t, g in zip(texts, gone)], columns=["n_lines", "n_dropped", "text"])

    return cut_lines(text, drops)


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 40, copies: int = 5) -> DataFrame:
    """docs with a column `lines`: struct<n_lines, n_dropped, text>, the text without its repeated lines.

    A line's key is the line stripped of blanks and lower-cased (A-Z). A key of `least` code points or more, found in
    `copies` distinct documents or more, stays only in the document with the largest id, there with all its lines. A null or
    empty text is one empty line. Rows without an id lose such lines too and never keep them. All columns of docs stay; one
    named `lines` is replaced. Keys are compared by 128-bit digests.
    """
    gone = repeated(docs, doc_id, text, least, copies).select(F.col("doc_id").alias("__id"), F.col("drops").alias("__drops"))
    size = gone.agg(F.count("*").alias("docs"), F.sum(F.size("__drops")).alias("lines")).first()
    match = F.col(doc_id).cast("long").eqNullSafe(F.col("__id"))
    if (size.docs or 0) <= FEW and (size.lines or 0) <= SMALL:
        joined = docs.join(F.broadcast(gone), match, "left")
        return joined.withColumn("lines", dropped(F.col(text), F.col("__drops"), least)).drop("__id", "__drops")
    # Texts that lose nothing stay where they are; the others, and a few that a bitmap of ids can't tell from them, go to their drops.
    maybe = docs.join(F.broadcast(bitmap(gone)), place(F.col(doc_id))[0] == F.col("__bucket"), "left")
    maybe = maybe.withColumn("__hit", F.coalesce(bit_of(F.col("__bits"), place(F.col(doc_id))[1]), F.lit(False))).drop("__bucket", "__bits")
    whole = F.struct(F.size(F.split(F.coalesce(text, F.lit("")), "\n", -1)).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), F.coalesce(text, F.lit("")).alias("text"))
    joined = maybe.where("__hit").join(gone, match, "left").withColumn("lines", dropped(F.col(text), F.col("__drops"), least)).drop("__id", "__drops")
    return maybe.where("not __hit").withColumn("lines", whole).unionByName(joined).drop("__hit")


def place(doc_id: Column) -> tuple[Column, Column]:
    """An id's bucket of the bitmap, and its bit there."""
    at = F.pmod(F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(BUCKETS * 32768))
    return F.floor(at / 32768), (at % 32768).cast("int")


def bitmap(ids: DataFrame) -> DataFrame:
    """(__bucket, __bits) of __id: at most BUCKETS rows of 4096 bytes, whatever the ids."""
    bucket, at = place(F.col("__id"))
    return ids.select(bucket.alias("__bucket"), at.cast("long").alias("at")).groupBy("__bucket").agg(F.bitmap_construct_agg("at").alias("__bits"))


def bit_of(bits: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substr(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1


def sql(documents: str = "documents") -> str:
    """The query's result in DuckDB's SQL."""
    blank = r"[\x20\x09-\x0D]"
    return rf"""
WITH l AS (SELECT doc_id, i, line, translate(regexp_replace(line, '^{blank}+|{blank}+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(ls) AS line, unnest(generate_series(1, len(ls))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {documents}))),
m AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
f AS (SELECT l.doc_id, l.i, l.line, m.k IS NOT NULL AND l.doc_id <> m.keeper AS gone FROM l LEFT JOIN m ON l.k = m.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM f GROUP BY doc_id"""
