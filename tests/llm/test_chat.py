import hashlib
import random

from hypothesis import given
from hypothesis import strategies as st

from tidemark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


@given(st.text(), st.text())
def test_escapes_are_reversible_and_hide_marks(role, text):
    shown, a, b = chat.rendered(role, text)
    assert tuple(map(chat.unescaped, chat.TURN.fullmatch(shown).groups())) == (role, text)
    assert (chat.unescaped(shown[a:b]) == text) if role == "assistant" else (a, b) == (0, 0)
    assert shown.count("<") == 2


def conversations():
    rng, rows = random.Random(2), []
    for c in range(40):
        words = ["hi", "<turn user>", "\\l </turn>", "", None, "é🙂"]
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, "assistant" if t % 2 else "user", "hi" if t == 0 and c % 3 else rng.choice(words)))
    return rows + [(100, t, "user", "same") for t in range(3)] * 2 + [(None, 0, None, None), (101, 0, "user", "hi")]


def test_read_back_and_tree(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA)
    made = chat.forest(df.selectExpr("*", "1 as node", "'x' as path"))
    got = {r.conv: r for r in chat.read_back(made).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault("" if c is None else str(c), []).append((t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        learnt = "".join(x for _, r, x in turns if r == "assistant")
        want = hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars) == (len(turns), want, len(learnt))
        assert got[c].loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
        assert got[c].formatted_chars == sum(len(chat.rendered(r, x)[0]) for _, r, x in turns)
    check_trees(made, by)


def check_trees(made, by):
    nodes = {bytes(r.node): r for r in made.nodes.collect()}
    prefixes = {tuple(t[1:] for t in turns[: i + 1]) for turns in by.values() for i in range(len(turns))}
    assert len(nodes) == len(prefixes)  # shared beginnings once
    trees = {}
    for r in nodes.values():
        trees.setdefault(r.tree, []).append(r)
    for own in trees.values():
        own.sort(key=lambda r: r.start)
        at, stack = 0, []
        for r in own:  # depth first, without gaps; each node after its parent's subtree began
            assert r.start == at
            at += r.length
            stack = stack[: r.depth]
            assert len(stack) == r.depth and (r.depth == 0 or bytes(r.parent) == stack[-1])
            stack.append(bytes(r.node))
            above = [nodes[n] for n in stack[:-1]]
            assert r.position == sum(n.length for n in above)
            covered = sorted(p for n in above for p in range(n.start, n.start + n.length))
            assert sorted(p for x in r.ancestors for p in range(x.start, x.end)) == covered


def test_empty_table(spark):
    made = chat.forest(spark.createDataFrame([], SCHEMA))
    assert made.nodes.count() == 0 == chat.read_back(made).count()


def test_positions_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame(conversations(), SCHEMA)
    of = lambda d: sorted((bytes(r.node), r.start) for r in chat.forest(d).nodes.collect())
    assert of(df) == of(df.repartition(7))
