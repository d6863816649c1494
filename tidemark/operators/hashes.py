"""Perceptual hashes of small grey images, and pairs of hashes within a Hamming distance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def from_hex(text: Column) -> Column:
    """Sixteen hex digits as a signed long: the same 64 bits."""
    return F.conv(text, 16, -10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def near_hashes(rows: DataFrame, key: str, bits: str, most: int, width: int = 64) -> DataFrame:
    """(a, b, distance) of keys a < b whose hashes differ in at most `most` bits.

    The bits are cut into most + 1 bands: two hashes that differ in no more than `most` agree in one band at least, so
    only rows that share a band are compared, each pair once, in its first band. Equal hashes meet as one, by a star of
    their least key; see expand() for all their pairs.
    """
    step = -(-width // (most + 1))
    one = rows.where(F.col(bits).isNotNull()).groupBy(F.col(bits).alias("h")).agg(F.min(key).alias("k"))
    mask = lambda i: ((1 << max(0, min(step, width - i * step))) - 1)
    band = lambda c, i: F.shiftrightunsigned(c, i * step).bitwiseAND(F.lit(mask(i)))
    bands = [i for i in range(most + 1) if mask(i)]
    cut = one.withColumn("b", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), band(F.col("h"), i).alias("v")) for i in bands])))
    a, c = cut.select("b", F.col("h").alias("x"), F.col("k").alias("p")), cut.select("b", F.col("h").alias("y"), F.col("k").alias("q"))
    first = F.lit(True)
    for i in bands:
        first = first & ((F.col("b.i") <= i) | (band(F.col("x"), i) != band(F.col("y"), i)))
    pairs = a.join(c, "b").where("p < q").where(hamming(F.col("x"), F.col("y")) <= most).where(first)
    near = pairs.select(F.col("p").alias("a"), F.col("q").alias("b"), hamming(F.col("x"), F.col("y")).alias("distance"))
    same = rows.where(F.col(bits).isNotNull()).select(F.col(key).alias("b"), F.col(bits).alias("h")).join(one, "h").where("b <> k")
    return near.unionByName(same.select(F.col("k").alias("a"), "b", F.lit(0).alias("distance")))


def expand(near: DataFrame, rows: DataFrame, key: str, bits: str) -> DataFrame:
    """All pairs (a, b, distance) of keys a < b, from the pairs of near_hashes: each key of equal hashes stands where their least does."""
    own = rows.where(F.col(bits).isNotNull()).select(F.col(key).alias("k"), F.col(bits).alias("h"))
    held = own.join(own.groupBy("h").agg(F.min("k").alias("least")), "h").select("least", "k")
    side = lambda c: held.select(F.col("least").alias(f"{c}_least"), F.col("k").alias(c))
    x, y = side("x"), side("y")
    apart = near.where("distance > 0").join(x, F.col("a") == F.col("x_least")).join(y, F.col("b") == F.col("y_least"))
    equal = x.join(y, F.col("x_least") == F.col("y_least")).where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"), F.lit(0).alias("distance"))
    return apart.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance").unionByName(equal)


def dct_rows(n: int, k: int) -> np.ndarray:
    """The first k rows of the orthonormal DCT-II of size n."""
    i = np.arange(n)
    m = np.cos(np.pi * (2 * i[None, :] + 1) * np.arange(k)[:, None] / (2 * n)) * np.sqrt(2 / n)
    m[0] /= np.sqrt(2)
    return m


def packed(bits: np.ndarray) -> int:
    """Bits, the most significant first, as a signed 64-bit integer."""
    return int.from_bytes(np.packbits(bits.reshape(-1).astype(np.uint8)).tobytes(), "big", signed=True)


def phash_of(grey: np.ndarray) -> int:
    """A 32 x 32 image: which of the 8 x 8 lowest frequencies are above the median of those without the first row and column."""
    d = dct_rows(32, 8)
    low = d @ grey.astype(np.float64) @ d.T
    return packed(low > np.median(low[1:, 1:]))


def dhash_of(grey: np.ndarray) -> int:
    """An image 9 wide and 8 high: which pixels are darker than their right neighbour."""
    return packed(grey[:, 1:] > grey[:, :-1])


def entropy_of(grey: np.ndarray) -> float:
    """Entropy in bits of the 256 grey levels."""
    n = np.bincount(grey.reshape(-1).astype(np.uint8), minlength=256)
    p = n[n > 0] / n.sum()
    return float(-(p * np.log2(p)).sum())


def laplacian_variance_of(grey: np.ndarray) -> float:
    """Variance of the five-point Laplacian, edges repeated."""
    g = np.pad(grey.astype(np.float64), 1, mode="edge")
    return float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var())


def diagnostics(images: DataFrame, key: str, pixels: str, width: str) -> DataFrame:
    """(key, entropy, laplacian_variance, mean, std) of grey images given as an array of 0..255 by rows and a width; nulls
    for a missing or ragged image."""
    kind = dict(images.dtypes)[key]

    def look(batches):
        for pdf in batches:
            out = []
            for k, p, w in zip(pdf["k"], pdf["p"], pdf["w"]):
                fine = p is not None and w is not None and w == w and w > 0 and len(p) and len(p) % int(w) == 0
                g = np.asarray(p).reshape(-1, int(w)) if fine else None
                out.append((k, entropy_of(g), laplacian_variance_of(g), float(g.mean()), float(g.std())) if fine else (k, None, None, None, None))
            yield pd.DataFrame(out, columns=[key, "entropy", "laplacian_variance", "mean", "std"])

    rows = images.select(F.col(key).alias("k"), F.col(pixels).alias("p"), F.col(width).alias("w"))
    return rows.mapInPandas(look, f"{key} {kind}, entropy double, laplacian_variance double, mean double, std double")
