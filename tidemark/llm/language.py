"""Language identification by compression: a zstandard raw-content dictionary a language, the smallest result wins."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Everything but letters and their marks becomes one space: punctuation and digits are no evidence of a language.
OTHER = re.compile(r"[\W\d_]+")
#: Sizes are whole bytes; where the least ones tie, the text is written so many times over, which a known text bears better.
REPEATS = 4
RESULT = "lang_pred string, score double, rejected boolean"


def plain(text: str) -> bytes:
    """Lower-case letters with single spaces between the words."""
    return OTHER.sub(" ", text.lower()).encode("utf-8", "replace")


@dataclass(frozen=True)
class Languages:
    """One raw-content dictionary a language, in lower case, the commonest language first. A text is rejected below the relative
    margin `floor`; since sizes are whole bytes, for a short text that is a tie."""

    dictionaries: dict[str, bytes] = field(default_factory=dict)
    level: int = 3
    piece: int = 8192
    floor: float = 0.002


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", budget: int = 1 << 19, **options) -> Languages:
    """Dictionaries from at most `budget` bytes of whole texts a language (the documented bound of the sample).

    The texts are those with the least hash, each distinct text once, so reruns agree and a hot text counts once; a text
    that alone exceeds the budget is none of them. Rows without text or language are left out, and without any row
    nothing is learned. One row a language, and the bounded sample, reach the driver.
    """
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(lang).alias("g"), F.col(text).alias("t"), F.octet_length(text).cast("long").alias("n"), F.xxhash64(text).bitwiseAND(F.lit(2**63 - 1)).alias("h")
    ).where(F.col("n") <= budget)
    counts = {r.g: (r.many, r["mean"]) for r in rows.groupBy("g").agg(F.approx_count_distinct("h").alias("many"), F.avg("n").alias("mean")).collect()}
    if not counts:
        return Languages(**options)
    share = lambda many, mean: int(2**63 * min(1.0, 3 * budget / max(many * mean, 1.0))) - 1
    near = rows.where(F.col("h") <= F.create_map(*[F.lit(x) for g, c in counts.items() for x in (g, share(*c))])[F.col("g")])
    near = near.groupBy("g", "h").agg(F.first("t").alias("t"), F.first("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("g").orderBy("h"))  # some budgets' worth of texts a language
    texts: dict[str, list[str]] = {g: [] for g in counts}
    for r in sorted(near.withColumn("upto", upto).where(F.col("upto") <= budget).select("g", "h", "t").collect(), key=lambda r: (r.g, r.h)):
        texts[r.g].append(r.t)
    # The best-known content goes last: zstandard reaches the end of a dictionary with the shortest offsets.
    return Languages({g: plain(" ".join(reversed(t))) for g, t in sorted(texts.items(), key=lambda x: (-counts[x[0]][0], x[0]))}, **options)


def classify(text: Column, model: Languages) -> Column:
    """struct<lang_pred, score, rejected> of a text column.

    `und`, score 0 and rejected where the text is null or has no letter, or nothing was learned. Otherwise the language
    whose dictionary gives the fewest bytes over the whole text, compressed in pieces so that length does not thin out
    the dictionary (a tie is decided on the repeated text, then for the language with more labelled texts); letter case is no evidence. Score is 1 - fewest / second
    fewest, rejected where that is below the model's floor, whatever the text's length: a tie, or languages that the text does not
    tell apart. Only the text decides; rows are told one by one, so repeats and other columns change nothing, and an empty
    table gives an empty result.
    """

    @F.pandas_udf(RESULT)
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tools = []
        for order, (name, raw) in enumerate(model.dictionaries.items()):
            known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if raw else None
            if known:
                known.precompute_compress(level=model.level)
            tools.append((order, name, zstandard.ZstdCompressor(level=model.level, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)))

        def one(t: str | None) -> tuple[str, float, bool]:
            if t is None or not tools or not any(map(str.isalpha, t)):
                return "und", 0.0, True
            raw = plain(t)
            pieces = [raw[i : i + model.piece] for i in range(0, len(raw), model.piece)]
            sizes = sorted((sum(len(z.compress(p)) for p in pieces), order, name) for order, name, z in tools)
            if len(sizes) == 1:
                return sizes[0][2], 1.0, False
            if sizes[0][0] == sizes[1][0]:
                again = [raw[i : i + model.piece // REPEATS] + b" " for i in range(0, len(raw), model.piece // REPEATS)]
                sizes = sorted((sum(len(z.compress(p * REPEATS)) for p in again), order, name) for order, name, z in tools)
            score = 1 - sizes[0][0] / sizes[1][0]
            return sizes[0][2], score, score < model.floor

        for s in batches:
            yield pd.DataFrame([one(t) for t in s], columns=["lang_pred", "score", "rejected"])

    return told(text)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the quarter of documents that is never learned from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2
