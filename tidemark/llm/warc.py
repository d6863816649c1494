"""WARC archives compressed record by record with a Zstandard dictionary, which leads the file in a skippable frame."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import FEW, cut, scratch, spread_join

#: Fixed values of the format: the magic number of the dictionary's skippable frame, and of an empty one that may follow.
DICTIONARY_MAGIC = 0x184D2A5D
#: Spark's text writer ends each row with this: an empty skippable frame, which is ASCII and which readers skip.
TRAILER = struct.pack("<II", 0x184D2A50, 0).decode("ascii")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROW = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def planned(pages: DataFrame, page_id: str, url: str, html: str, least: int) -> DataFrame:
    """page_id, url, html (null for revisits), bytes, digest, record_type, refers_to; ids as text.

    Rows with equal payloads of `least` bytes or more: those with the largest page_id are the response, others revisit it.
    Payloads are grouped by SHA-1 without their texts. The repeated ones are broadcast to the rows if they are counted and few;
    else rows and payloads shuffle, a payload with very many rows to many tasks.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumns({"bytes": F.octet_length("html").cast("long"), "digest": F.sha1(F.col("html").cast("binary"))})
    same = rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    same = cut(same.where("n > 1 and first is not null"))
    found = same.agg(F.count("*").alias("digests"), F.sum("n").alias("rows")).first()
    if found.digests <= FEW:
        known = rows.join(F.broadcast(same), "digest", "left")
    else:
        known = spread_join(rows, same, "digest", "page_id", "n", found.rows, "left")
    known = known.withColumn("first", F.when(F.col("bytes") >= least, F.col("first")))
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return known.select(
        F.col("page_id").cast("string").alias("page_id"), "url", F.when(~again, F.col("html")).alias("html"), "bytes", "digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first").cast("string")).alias("refers_to"),
    )


def record(page_id, url, html, size: int, digest: str, kind: str, refers_to, date: str) -> bytes:
    """One WARC/1.1 record. A revisit holds the HTTP header alone, with the length of the payload that it saw."""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (html.encode("utf-8") if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if kind == "revisit":
        head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(pages: DataFrame, html: str, date: str, records: int = 400, chars: int = 16384, size: int = 65536) -> bytes:
    """A dictionary trained on at most `records` records of `chars` code points (the bound of the sample); it helps the
    compressor and changes no content. Without enough to train on, the records themselves; empty for an empty table."""
    n = pages.count()
    part = F.pmod(F.xxhash64(html, F.monotonically_increasing_id()), F.lit(1 << 20)) < int(min(1.0, 4 * records / max(n, 1)) * (1 << 20)) + 1
    some = pages.where(F.col(html).isNotNull() & part).limit(records).select(F.substring(html, 1, chars).alias("h")).collect()
    samples = [record(i, "http://example.com/", r.h, len(r.h), hashlib.sha1(r.h.encode()).hexdigest(), "response", None, date) for i, r in enumerate(some)]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 1000,
          roll: int = 16 << 20, date: str = "2024-01-01T00:00:00Z", level: int = 6) -> None:
    """One record a row of pages, into archives under path, a new one after `roll` compressed bytes.

    An archive is a skippable frame with the dictionary, then a frame for each record, each of which opens alone. Spark's
    own text writer puts out whole archives, one a file, so any file system that Spark writes to will do and a lost task's
    files are written again with the same content; then the files are renamed to .warc.zst. A null payload is empty; small and unequal payloads are responses.
    """
    raw = dictionary(pages, html, date)
    rows = planned(pages, page_id, url, html, least)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = zstandard.ZstdCompressionDict(raw) if raw else None
        zip_ = zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=True)
        lead = struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw if raw else b""
        lead += zip_.compress(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:info:pages>\r\nWARC-Date: " + date.encode() + b"\r\nContent-Length: 0\r\n\r\n\r\n\r\n")
        out = bytearray()
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                out += zip_.compress(record(*r, date)) if out else lead + zip_.compress(record(*r, date))
                if len(out) >= roll:
                    yield pd.DataFrame({"value": [bytes(out)]})
                    out.clear()
        if out:
            yield pd.DataFrame({"value": [bytes(out)]})

    archives = rows.mapInPandas(pack, "value binary").select(F.col("value").cast("string").alias("value"))
    archives.write.option("lineSep", TRAILER).option("maxRecordsPerFile", 1).option("compression", "none").text(path)
    rename(pages.sparkSession, path)


def rename(spark: SparkSession, path: str) -> None:
    """Give the finished files the name's end that WARC tools expect: a change of the file system's names alone."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for f in fs.listStatus(folder):
        name = f.getPath().getName()
        if name.endswith(".txt"):
            fs.rename(f.getPath(), spark._jvm.org.apache.hadoop.fs.Path(folder, name.removesuffix(".txt") + ".warc.zst"))


def frames(content: bytes) -> Iterator[bytes]:
    """The decompressed frames of an archive, in order; skippable ones but the dictionary are passed over."""
    unzip, at, view = zstandard.ZstdDecompressor(), 0, memoryview(content)
    while at < len(content):
        (magic,) = struct.unpack_from("<I", content, at)
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            (n,) = struct.unpack_from("<I", content, at + 4)
            if magic == DICTIONARY_MAGIC:
                unzip = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(view[at + 8 : at + 8 + n])))
            at += 8 + n
            continue
        one, out = unzip.decompressobj(), []
        while not one.eof:
            some = view[at : at + 16384]
            if not some:
                raise ValueError("the archive ends within a frame")
            out.append(one.decompress(some))
            at += len(some) - len(one.unused_data)
        yield b"".join(out)


def parsed(frame: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers (names in lower case) and its block."""
    head, _, rest = frame.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    headers = {k.lower(): v for k, v in headers.items()}
    n = int(headers["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("the record's length doesn't fit its block")
    return headers, rest[:n]


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record under path; with payloads also url and
    html. Lengths and digests of responses are taken from the payload as read, those of revisits from their headers."""
    schema = ROW + ", url string, html string" * payloads

    def number(name: str) -> int | None:
        return int(name[len("<urn:page:") : -1]) if len(name) > len("<urn:page:>") else None

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]

        def frame(rows: list[tuple]) -> pd.DataFrame:
            exact = {c: pd.array([r[names.index(c)] for r in rows], dtype="Int64") for c in ("page_id", "refers_to")}
            return pd.DataFrame(rows, columns=names).assign(**exact)

        for pdf in batches:
            for content in pdf["content"]:
                rows, held = [], 0
                for headers, block in map(parsed, frames(content)):
                    if headers["warc-type"] == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    seen = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
                    digest = base64.b32decode(headers["warc-payload-digest"][5:]).hex()
                    refers = None
                    if headers["warc-type"] == "response":
                        seen, digest = len(payload), hashlib.sha1(payload).hexdigest()
                    else:
                        refers = number(headers["warc-refers-to"])
                    row = number(headers["warc-record-id"]), seen, digest, headers["warc-type"], refers
                    rows.append((*row, headers.get("warc-target-uri"), payload.decode("utf-8")) if payloads else row)
                    held += len(block) if payloads else 100
                    if held > 4 << 20:
                        yield frame(rows)
                        rows, held = [], 0
                yield frame(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, schema)


def archived(pages: DataFrame, **options) -> DataFrame:
    """pages written to a fresh folder of the shared storage, and read back."""
    path = scratch(pages.sparkSession, "warc")
    write(pages, path, **options)
    return read(pages.sparkSession, path)


def sql(pages: str = "pages") -> str:
    """The query's result in DuckDB's SQL."""
    return f"""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM {pages}),
w AS (SELECT payload_digest AS d, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN w ON payload_digest = d"""
