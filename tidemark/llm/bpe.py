"""Byte-level BPE: long texts are encoded as halves and joined by tree concatenation, then decoded again."""

from __future__ import annotations

import functools
import hashlib
import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut

#: No added token or contraction of the vocabulary is longer, so what a cut changes begins less than this before it.
REACH = 16

#: Code points on whose classes (letter, number, blank) all splitters agree; a text with any other goes to tokenizers itself.
UNUSUAL = re.compile(r"[^\x00-\u024f\u2010-\u201f\u20ac]")
#: The splitting pattern of the byte-level vocabulary, as published with it (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Part:
    """A text's exact encoding: ids, where each token begins in bytes, and where the splitting pattern's pieces begin."""

    __slots__ = ("raw", "ids", "at", "pieces")

    def __init__(self, raw: bytes, ids: np.ndarray, at: np.ndarray, pieces: np.ndarray):
        self.raw, self.ids, self.at, self.pieces = raw, ids, at, pieces


class Encoder:
    """tokenizers' encoding of whole texts; texts over `chunk` bytes go through encode_long.

    The result equals the library's own encoding of the whole text. Two parts agree at a place if both begin a piece
    of the splitting pattern there: from such a place on, the pattern (which never looks back) runs alike. Inside one
    piece longer than the window they agree at a token that both have: BPE merges by rank are such that a sequence is the
    encoding of its bytes if each neighbouring pair is, and every pair then comes from one exact encoding.
    """

    def __init__(self, path: str, chunk: int = 32768, window: int = 256, run: int = 1000):
        import tiktoken
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.chunk, self.window, self.run = chunk, window, run
        special = {t.content: len(t.content.encode()) for t in self.tok.get_added_tokens_decoder().values()}
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.length = np.zeros(size, np.int64)
        for token, i in self.tok.get_vocab(with_added_tokens=True).items():
            self.length[i] = special.get(token, len(token))  # each character of a byte-level token stands for a byte
        # The same vocabulary as ranks, for texts of usual characters: several times as fast, with the same results.
        config = json.loads(self.tok.to_str())
        letters = sorted(ByteLevel.alphabet(), key=ord)
        printable = [c for c in letters if ord(c) < 256]
        rest = [b for b in range(256) if chr(b) not in printable]
        byte = {c: ord(c) for c in printable} | dict(zip(letters[len(printable) :], rest))
        tokens = {t: i for t, i in config["model"]["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding(
            path, pat_str=PATTERN, mergeable_ranks={bytes(byte[c] for c in t): i for t, i in tokens.items()},
            special_tokens={t: i for t in special if (i := self.tok.token_to_id(t)) is not None},
        )

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.encode_one(t) for t in texts]

    def encode_one(self, text: str) -> list[int]:
        if len(text) > self.chunk or len(text) > self.run and max(map(len, text.split()), default=len(text)) > self.run:
            return self.encode_long(text)
        if UNUSUAL.search(text):
            return self.tok.encode(text, add_special_tokens=False).ids
        return self.fast.encode(text, allowed_special="all")

    def decode(self, ids: list[int]) -> str:
        """As tokenizers decodes with special tokens kept: the tokens' bytes in a row, bad ones replaced."""
        return self.fast.decode_bytes(ids).decode("utf-8", "replace")

    def encode_long(self, text: str) -> list[int]:
        return self.part(text).ids.tolist()

    def part(self, text: str) -> Part:
        """Halves down to `chunk` code points are encoded side by side, then joined pairwise up the tree."""
        cuts = [0, len(text)]
        while max(b - a for a, b in zip(cuts, cuts[1:])) > self.chunk:
            cuts = sorted({*cuts, *((a + b) // 2 for a, b in zip(cuts, cuts[1:]) if b - a > self.chunk)})
        return self.tree(self.parts([text[a:b] for a, b in zip(cuts, cuts[1:])]))

    def tree(self, parts: list[Part]) -> Part:
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]

    def again(self, text: str, ids: np.ndarray, pieces: np.ndarray) -> Part:
        """A part that another task has encoded."""
        ends = np.cumsum(self.length[ids])
        return Part(text.encode("utf-8"), ids, ends - self.length[ids], pieces)

    def parts(self, texts: list[str]) -> list[Part]:
        out = []
        for t, e in zip(texts, self.tok.encode_batch(texts, add_special_tokens=False)):
            ids = np.array(e.ids, np.int64)
            ends = np.cumsum(self.length[ids])
            at = ends - self.length[ids]
            word = np.array(e.word_ids, np.int64)
            new = np.ones(len(ids), bool)
            new[1:] = word[1:] != word[:-1]
            out.append(Part(t.encode("utf-8"), ids, at, at[new]))
        return out

    def join(self, a: Part, b: Part) -> Part:
        """The encoding of both texts in a row, by windows around the join that grow until both sides agree."""
        cut, raw, width = len(a.raw), a.raw + b.raw, self.window
        whole = len(raw)
        while True:
            for within in (False, True):
                if found := self.fit(a, b, raw, cut, width, within):
                    return found
            if width >= 2 * whole:
                raise AssertionError("a window over the whole text always agrees")
            width *= 4

    def fit(self, a: Part, b: Part, raw: bytes, cut: int, width: int, within: bool) -> Part | None:
        """One window: from a place in a to a place in b; None unless its encoding agrees with a before and with b after."""
        left, right = (a.at, b.at) if within else (a.pieces, b.pieces)
        i = bisect_left(left, cut - max(width, REACH) + 1) - 1
        start = int(left[i]) if i >= 0 else 0
        j = bisect_left(right, max(width, REACH))
        end = cut + int(right[j]) if j < len(right) else len(raw)
        if within:
            if not self.one_piece(a, b, raw, cut, start, end):
                return None
        w = self.parts([raw[start:end].decode("utf-8")])[0]
        own = w.at if within else w.pieces
        last = len(raw) if end == len(raw) else end - REACH
        if within and start > 0:
            # The first token must be the one that a has there; what comes before it in a then stays.
            k = bisect_left(a.at, start)
            if len(w.ids) < 2 or a.ids[k] != w.ids[0]:
                return None
        meet = np.intersect1d(own + start, right + cut, assume_unique=True)
        meet = meet[(meet >= cut) & (meet <= last)]
        if within and len(meet):
            at_w, at_b = np.searchsorted(w.at + start, meet), np.searchsorted(b.at + cut, meet)
            same = w.ids[at_w] == b.ids[at_b]
            meet = meet[same]
        if len(meet):
            m = int(meet[0])
        elif end == len(raw):
            m = end
        else:
            return None
        ka, kb = bisect_left(a.at, start), bisect_left(b.at, m - cut)
        kw = bisect_left(w.at, m - start)
        ids = np.concatenate([a.ids[:ka], w.ids[:kw], b.ids[kb:]])
        at = np.concatenate([a.at[:ka], w.at[:kw] + start, b.at[kb:] + cut])
        inner = w.pieces[(w.pieces < m - start) & ((w.pieces > 0) if within and start > 0 else True)] + start
        after = b.pieces[b.pieces >= m - cut] + cut
        if within:
            after = after[after > m]
        pieces = np.concatenate([a.pieces[a.pieces < start] if not within else a.pieces[a.pieces <= start], inner, after])
        return Part(raw, ids, at, np.unique(pieces))

    def one_piece(self, a: Part, b: Part, raw: bytes, cut: int, start: int, end: int) -> bool:
        """Is raw[start:end] inside one run of letters, on whole code points, from a's last piece to b's first?"""
        if not len(a.pieces) or start <= a.pieces[-1] or (len(b.pieces) > 1 and end - cut >= b.pieces[1]) or end >= len(raw):
            return False
        if raw[start] & 0xC0 == 0x80 or raw[end] & 0xC0 == 0x80:
            return False
        return raw[start:end].decode("utf-8").isalpha() and raw[end : end + 4].decode("utf-8", "ignore")[:1].isalpha()


@functools.lru_cache(2)
def encoder_of(path: str, chunk: int) -> Encoder:
    """One encoder a worker process: it takes a second to build, more than many tasks."""
    return Encoder(path, chunk)


def row_of(encoder: Encoder, digits: list[str], ids: list[int], keep_ids: bool) -> tuple:
    """A text's number of tokens and the digests of its ids and of the text that they decode to."""
    shown = ",".join([digits[i] for i in ids])
    out = len(ids), hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(encoder.decode(ids).encode("utf-8")).hexdigest()
    return (*out, np.array(ids, np.int32)) if keep_ids else out


def kind_of(keep_ids: bool) -> str:
    return "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids


def quiet(path: str, chunk: int) -> tuple[Encoder, list[str]]:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    encoder = encoder_of(path, chunk)
    return encoder, [str(i) for i in range(len(encoder.length))]


def encoded(text: Column, path: str, keep_ids: bool = False, chunk: int = 32768) -> Column:
    """struct<n_tokens, ids_sha256, decoded_sha256[, ids]> of a text column; null counts as the empty text.

    Whole texts, one at a time, so memory is bounded by an Arrow batch and the longest text. The tokens are decoded
    again, special ones kept, and both digests are taken from what was made.
    """
    kind = kind_of(keep_ids)

    @F.pandas_udf(kind)
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder, digits = quiet(path, chunk)
        names = [c.split()[0] for c in kind.split(", ")]
        for s in batches:
            yield pd.DataFrame([row_of(encoder, digits, encoder.encode_one("" if t is None else t), keep_ids) for t in s], columns=names)

    return coded(text)


def encode(docs: DataFrame, path: str, text: str = "text", keep_ids: bool = False, chunk: int = 32768, segment: int = 65536) -> DataFrame:
    """docs with `bpe`: struct<n_tokens, ids_sha256, decoded_sha256[, ids]> of the text.

    A text of more than `segment` code points is cut into segments, which are rows of their own: tasks encode them side by side,
    each as halves down to `chunk` joined up the tree, and the segments' parts are then joined up the tree once more, where
    windows around each cut grow until both sides agree. So a very long text is many tasks' work, and only the
    joining, which reads little beyond the cuts, is one's. All other texts are encoded where they are.

    Null counts as the empty text, which has no tokens. Rows are encoded one by one, so repeated rows and ids stay; extra
    columns stay, a column `bpe` is replaced; an empty table gives an empty result.
    """
    kind, column = kind_of(keep_ids), F.col(text)
    names = [c.split()[0] for c in kind.split(", ")]
    long = cut(docs.where(F.length(column) > segment).withColumn("__row", F.monotonically_increasing_id()))
    short = docs.where(F.coalesce(F.length(column) <= segment, F.lit(True))).withColumn("bpe", encoded(column, path, keep_ids, chunk))
    if long.isEmpty():
        return short
    starts = F.sequence(F.lit(0), F.floor((F.length(column) - 1) / segment).cast("int"))
    pieces = long.select("__row", F.posexplode(F.transform(starts, lambda i: F.substring(column, i * segment + 1, F.lit(segment)))).alias("i", "t"))

    def encode_segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, _ = quiet(path, chunk)
        for pdf in batches:
            for row, i, t in zip(pdf["__row"], pdf["i"], pdf["t"]):
                part = encoder.part(t)
                yield pd.DataFrame({"__row": [row], "i": [i], "t": [t], "ids": [part.ids.astype(np.int32)], "pieces": [part.pieces]})

    def join_segments(pdf: pd.DataFrame) -> pd.DataFrame:
        encoder, digits = quiet(path, chunk)
        pdf = pdf.sort_values("i")
        whole = encoder.tree([encoder.again(t, np.asarray(ids, np.int64), np.asarray(at, np.int64)) for t, ids, at in zip(pdf["t"], pdf["ids"], pdf["pieces"])])
        return pd.DataFrame([(pdf["__row"].iloc[0], *row_of(encoder, digits, whole.ids.tolist(), keep_ids))], columns=["__row", *names])

    parts = pieces.repartition("__row", "i").mapInPandas(encode_segments, "__row long, i int, t string, ids array<int>, pieces array<long>")
    whole = parts.groupBy("__row").applyInPandas(join_segments, f"__row long, {kind}")
    done = long.drop("bpe").join(whole.select("__row", F.struct(*names).alias("bpe")), "__row").drop("__row")
    return short.unionByName(done)
