"""Chat formatting over a prefix tree: conversations that begin with the same turns share them, depth first."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, running, spread_join, stored

#: A turn is `<turn ROLE>TEXT</turn>` and a line end. Inside roles and texts the three control characters are escaped, so
#: no mark can be forged and every turn reads back as it was.
TURN = re.compile(r"<turn ([^<>]*)>([^<>]*)</turn>\n")
ESCAPES = {"\\": "\\\\", "<": "\\l", ">": "\\g"}
BACK = {v[1]: k for k, v in ESCAPES.items()}
CHAIN = "conv string, n long, turns long, node binary, parent binary, root binary, position long, length long, learnt_from long, learnt_to long, text string, path binary"
#: Bytes of a turn in a conversation's sorting key.
STEP = 8


def escaped(text: str) -> str:
    return re.sub(r"[\\<>]", lambda m: ESCAPES[m[0]], text)


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: BACK[m[1]], text)


def rendered(role: str, text: str) -> tuple[str, int, int]:
    """A turn's formatted text, and where the words that an assistant's turn teaches begin and end (else both 0)."""
    head, body = f"<turn {escaped(role)}>", escaped(text)
    learnt = (len(head), len(head) + len(body)) if role == "assistant" else (0, 0)
    return f"{head}{body}</turn>\n", *learnt


@dataclass(frozen=True)
class Forest:
    """`nodes`: one row a distinct beginning of a conversation: tree, node, parent, depth, start (of its tokens in the tree's
    depth-first sequence), length, position (of its first token; the others follow by one), ancestors (merged intervals
    [start, end) of the sequence that its tokens attend to, besides their own node up to themselves), learnt_from and
    learnt_to (loss mask within the node), text, uses (turns that are this node). `turns`: conv, n, turns and the node of each turn."""

    nodes: DataFrame
    turns: DataFrame


def chained(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """Each turn with its node, by a stream over the sorted turns of a conversation: a node's id is the hash of its
    parent's id and its own text. The last turn also has the conversation's path, STEP bytes a turn, and its length."""
    rows = rows.select(
        F.coalesce(F.col(conv_id).cast("string"), F.lit("")).alias("conv"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    names = [c.split()[0] for c in CHAIN.split(", ")]

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_128_digest

        held, path, out = None, bytearray(), []  # the row before waits until it is known whether it is a last one
        for pdf in batches:
            for conv, role_, text_ in zip(pdf["conv"], pdf["role"], pdf["text"]):
                shown, a, b = rendered(role_, text_)
                if held is not None and held[0] == conv:
                    n, parent, root, at = held[1] + 1, held[3], held[5], held[6] + held[7]
                    out.append(held)
                else:
                    if held is not None:
                        out.append((*held[:2], held[1] + 1, *held[3:-1], bytes(path)))
                    n, parent, root, at = 0, None, None, 0
                    path.clear()
                node = xxh3_128_digest((parent or b"") + shown.encode("utf-8", "replace"))
                path += node[:STEP]
                held = (conv, n, None, node, parent, root or node, at, len(shown), a, b, shown, None)
                if len(out) >= 2000:
                    yield typed(out)
                    out = []
        if held is not None:
            out.append((*held[:2], held[1] + 1, *held[3:-1], bytes(path)))
        yield typed(out)

    def typed(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=names).astype({"turns": "Int64"})

    ordered = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    return ordered.select("conv", "role", "text").mapInPandas(chain, CHAIN)


def forest(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Forest:
    """The prefix trees of conversations (rows by turn; ties of a turn by role and text, repeated rows stay).

    A null text or role is empty; rows without a conv_id are one conversation, named "". Tokens are code points. A tree may
    hold most of the corpus: it is ordered by sorting the distinct conversations' paths and numbered by distributed sums, so
    no tree, hot first turn or often repeated conversation is gathered; ids and lengths alone are sorted and joined, texts come
    in at the end. One conversation is streamed, STEP bytes a turn.
    """
    chain = stored(chained(rows, conv_id, turn, role, text), "chain")
    ends = chain.where("path is not null")
    distinct = ends.groupBy("node").agg(F.min("conv").alias("conv"), F.first("path").alias("path"), F.lit(1).cast("long").alias("one"))
    ranked = cut(running(distinct, ["path"], "one", "rank").select("conv", "rank"))
    walked = cut(chain.select("conv", "n", "node", "root", "length").join(ranked, "conv"))
    # The first conversation in order that has a node owns it; depth-first order is then (owner, depth). Texts stay behind.
    own = walked.groupBy("node").agg(F.min("rank").alias("rank"), F.first("n").alias("n"), F.first("root").alias("root"), F.first("length").alias("length"), F.count("*").alias("walks"))
    laid = running(own, ["rank", "n"], "length", "at")
    trees = cut(laid.groupBy("root").agg(F.min("at").alias("first"), F.count("*").alias("nodes")))
    laid = cut(spread_join(laid, trees, "root", "node", "nodes", trees.agg(F.sum("nodes")).first()[0] or 0).withColumn("start", F.col("at") - F.col("first")).drop("at", "first", "nodes"))

    def ancestors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rank, spans, out = None, [], []
        for pdf in batches:
            for r, node, start, length, owner in zip(pdf["rank"], pdf["node"], pdf["start"], pdf["length"], pdf["owner"]):
                if r != rank:
                    rank, spans = r, []
                if owner == r:
                    out.append((node, [{"start": a, "end": b} for a, b in spans]))
                if spans and spans[-1][1] == start:
                    spans[-1] = (spans[-1][0], start + length)
                else:
                    spans.append((start, start + length))
                if len(out) >= 2000:
                    yield pd.DataFrame(out, columns=["node", "ancestors"])
                    out = []
        yield pd.DataFrame(out, columns=["node", "ancestors"])

    places = laid.select("node", "start", F.col("rank").alias("owner"), "walks")
    steps = spread_join(walked.select("rank", "n", "node", "length"), places, "node", "rank", "walks", walked.count())
    above = steps.repartition("rank").sortWithinPartitions("rank", "n").mapInPandas(ancestors, "node binary, ancestors array<struct<start:long,end:long>>")
    said = chain.groupBy("node").agg(F.first(F.struct("parent", "position", "learnt_from", "learnt_to", "text")).alias("s"), F.count("*").alias("uses")).select("node", "s.*", "uses")
    nodes = said.join(laid, "node").join(above, "node").select(
        F.lower(F.hex("root")).alias("tree"), "node", "parent", F.col("n").alias("depth"), "start", "length", "position",
        "ancestors", "learnt_from", "learnt_to", "text", "uses",
    )
    return Forest(nodes, chain.select("conv", "n", "turns", "node"))


def read_back(made: Forest) -> DataFrame:
    """conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: each conversation as its nodes give it."""
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, state, out = None, None, []
        for pdf in batches:
            for c, text, a, b in zip(pdf["conv"], pdf["text"], pdf["learnt_from"], pdf["learnt_to"]):
                if conv is None or c != conv:
                    if conv is not None:
                        out.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, body = map(unescaped, TURN.fullmatch(text).groups())
                learnt = unescaped(text[a:b])
                state[0] += 1
                state[1].update(f"{role}\n{body}\n".encode("utf-8", "replace"))
                state[2] += len(learnt)
                state[3].update(learnt.encode("utf-8", "replace"))
                state[4] += len(text)
            if len(out) >= 2000:
                yield pd.DataFrame(out, columns=names)
                out = []
        if conv is not None:
            out.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
        yield pd.DataFrame(out, columns=names)

    nodes = made.nodes.select("node", "text", "learnt_from", "learnt_to", "uses")
    turns = spread_join(made.turns, nodes, "node", "conv", "uses", made.turns.count())
    ordered = turns.repartition("conv").sortWithinPartitions("conv", "n").select("conv", "text", "learnt_from", "learnt_to")
    return ordered.mapInPandas(digest, "conv string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def sql(conversations: str = "conversations") -> str:
    """The query's result in DuckDB's SQL; the template's own length a turn is a constant and escapes double a character."""
    plain = r"length(x) + length(x) - length(replace(replace(replace(x, '\', ''), '<', ''), '>', ''))"
    size = lambda x: "(" + plain.replace("(x", f"({x}") + ")"
    return rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM {conversations}
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({size("role")} + {size("text")} + length('<turn ></turn>') + 1) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""
