import hashlib
import random

import numpy as np

from tidemark.llm import lines, minhash


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n)]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def shared(a, b):
    """Jaccard similarity of the texts' five-word shingles; 0 under five words."""
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    return len(x & y) / len(x | y) if x and y else 0


def test_near_copies_meet_and_others_do_not(spark):
    rng, docs = random.Random(4), []
    for g in range(12):
        base = words(rng, rng.choice([12, 60, 150]))
        for _ in range(rng.randint(1, 6)):
            own = base[:]
            for _ in range(rng.randint(0, len(base) // 30 + 1)):
                own[rng.randrange(len(own))] = rng.choice(["new", "word"])
            docs.append(" ".join(own))
    passage = " ".join(words(rng, 60))
    docs += [passage + " " + " ".join(words(rng, 90)) for _ in range(30)]  # a shared passage makes no copies
    docs += ["", "", None, "short one", "short one", "Short  one", " ".join(["of"] * 400), " ".join(["of"] * 398)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").selectExpr("*", "1 as id", "'x' as class_id")
    got = {r.doc_id: r.class_id for r in minhash.classes(df).collect()}
    n = len(docs)
    up = list(range(n))  # components of all pairs that align

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            a, b = ((docs[x] or "").lower().split() for x in (i, j))
            same = (docs[i] or "") == (docs[j] or "")
            aligns = same or a == b or edits(a, b) <= 0.2 * max(len(a), len(b), 1)
            if aligns:
                x, y = sorted((top(i), top(j)))
                up[y] = x
            if same or (aligns and shared(a, b) >= 0.6):
                assert got[i] == got[j], (i, j)
    assert all(top(i) == top(got[i]) and got[i] <= i for i in range(n))


def test_repeated_rows_missing_ids_and_empty_tables(spark):
    text = " ".join(words(random.Random(1), 50))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text + " x")], "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id, r.n_copies) for r in minhash.classes(df).collect()) == [(1, 1, 1), (2, 1, 1)]
    assert minhash.classes(df.limit(0)).count() == 0


def test_every_pair_of_a_hot_bucket_is_tried(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 40, raising=False)
    rng, tool, texts = random.Random(12), minhash.Sketcher(functions=6), []
    passage = words(rng, 60)
    for _ in range(100):  # copies that share no five words but the passage's
        own = words(rng, 40)
        texts += [passage + own, passage + [w if i % 4 else "x" + w for i, w in enumerate(own)]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in minhash.classes(df, functions=6).collect()}
    meet = {i for i in range(0, 200, 2) if (tool.keys(texts[i]) == tool.keys(texts[i + 1])).any()}
    assert len(meet) > 20 and all(got[i] == i and got[i + 1] == i + (i not in meet) for i in range(0, 200, 2))


def test_bounded_distance_against_plain_edits():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(0, 90))] for _ in range(2))
        if rng.random() < 0.6:
            b = [x for x in a if rng.random() < 0.9]
        d = edits(a, b)
        assert [minhash.banded(np.array(a, int), np.array(b, int), most) for most in (d - 1, d, d + 1)] == [False, True, True]


def test_order_matters_to_the_sketch():
    rng = random.Random(9)
    tool, a = minhash.Sketcher(), words(rng, 300)
    b = a[150:] + a[:150]
    near = a[:100] + ["x"] + a[101:]
    share = lambda p, q: (tool.keys(p) == tool.keys(q)).mean()
    assert share(a, a) == 1 and share(a, near) > 0.8 and share(a, b) < share(a, near) - 0.2


def test_very_long_text_is_sketched_in_steps():
    tool = minhash.Sketcher()
    assert (tool.keys(["a", "b", "c"] * 200_000) == tool.keys(["a", "b", "c"] * 200_000)).all()


def expected_lines(rows, least=40, copies=5):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = {}
    for i, text in rows:
        for s in (text or "").split("\n"):
            if len(key(s)) >= least and i is not None:
                holders.setdefault(key(s), set()).add(i)
    out = []
    for i, text in rows:
        own = (text or "").split("\n")
        kept = [s for s in own if len(holders.get(key(s), ())) < copies or max(holders[key(s)]) == i]
        out.append((i, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_lines_against_brute_force(spark, rows):
    rng = random.Random(6)
    pool = ["x" * 40, "Y" * 39 + "é", "\t " + "Zz" * 30 + "\r", "ü" * 40, "ü" * 39, "short", "", "q" * 500]
    docs = [(rng.choice([i, i, 7]), "\n".join(rng.choice(pool) + rng.choice(["", "", str(i)]) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    docs += [(100, None), (101, ""), (2**60 + 1, "x" * 40), (2**60 + 1, "x" * 40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'c' as lines", "1 as key", "2 as n")
    got = lines.dedup(df)
    assert set(got.columns) == set(df.columns)
    own = sorted(((r.doc_id, r.lines.n_lines, r.lines.n_dropped, hashlib.sha256(r.lines.text.encode()).hexdigest()) for r in got.collect()), key=repr)
    assert own == expected_lines(docs)
    nameless = spark.createDataFrame([(i, "x" * 40) for i in range(5)] + [(None, "x" * 40)], "doc_id long, text string")
    assert rows(lines.dedup(nameless).selectExpr("doc_id", "lines.n_dropped as n")) == sorted([(0, 1), (1, 1), (2, 1), (3, 1), (4, 0), (None, 1)], key=repr)
    assert lines.dedup(df.limit(0)).count() == 0


def test_lines_with_many_drops_go_by_a_bitmap(spark, monkeypatch):
    """The way beyond the broadcast gives the same."""
    rng = random.Random(9)
    pool = ["x" * 40, "y" * 41, "z" * 39, "short", ""]
    docs = [(i, "\n".join(rng.choice([*pool, str(i) * 41]) for _ in range(rng.randint(0, 4))) if i % 9 else None) for i in range(60)] + [(None, "x" * 40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(lines, "SMALL", 0)
    monkeypatch.setattr(lines, "BUCKETS", 1)
    got = lines.dedup(df)
    own = sorted(((r.doc_id, r.lines.n_lines, r.lines.n_dropped, hashlib.sha256(r.lines.text.encode()).hexdigest()) for r in got.collect()), key=repr)
    assert own == expected_lines(docs) and got.columns == [*df.columns, "lines"]


def test_filter_never_misses_a_repeat(spark):
    docs = [(i, "\n".join(f"{(i * 7 + j) % 50:050d}" for j in range(5))) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    seen = lines.filters(df, "text", 40, 1 << 16)
    import numpy as np

    twice = [f"{k:050d}".encode() for k in range(50) if sum((i * 7 + j) % 50 == k for i in range(40) for j in range(5)) > 1]
    for bits in lines.places(lines.hashed(twice), 1 << 16):
        assert all((seen[int(b) >> 3] >> (7 - int(b) % 8)) & 1 for b in bits)
    assert isinstance(seen, np.ndarray)
