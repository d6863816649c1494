import numpy as np
import pytest

from tidemark.llm import ann, ranges

SCHEMA = "vec_id long, embedding array<float>"
ODD = [(9000, None), (9001, [0.0] * 8), (9002, [float("nan")] + [1.0] * 7), (9003, [1.0] * 7 + [None]), (9004, []), (9005, [1.0, 2.0]), (9006, [float("inf")] * 8)]


def clustered(n=400, dims=8, seed=0):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(12, dims))
    x = c[rng.integers(0, 12, n)] + rng.normal(size=(n, dims)) * rng.choice([0.02, 0.2, 0.6], n)[:, None]
    x[50:90] = x[50]  # a group of equal vectors
    x[90:95] = x[50] * 3  # and of parallel ones
    return x.astype("float32")


@pytest.mark.parametrize("copy, block", [(0, 16), (1000, 100), (1000, None)])
def test_range_join_against_brute_force(spark, monkeypatch, copy, block):
    monkeypatch.setattr(ranges, "COPY", copy)  # 0: as many cells as there are pivots
    x = clustered()
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + ODD + [(None, [1.0] * 8)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as id", "'h' as h")
    got = {r.vec_id: (r.n_links, r.component_id) for r in ranges.joined(df, block=block).collect()}
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    root = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([min(root[i], root[link[i]].min(initial=len(x))) for i in range(len(x))])
        if (new == root).all():
            break
        root = new
    assert [got[i] for i in range(len(x))] == [(int(link[i].sum()), int(root[i])) for i in range(len(x))]
    assert all(got[i] == (0, i) for i, _ in ODD) and len(got) == len(x) + len(ODD)


def test_range_join_of_nothing_and_of_an_id_with_two_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [1.0, 0.01])], SCHEMA)
    got = {r.vec_id: r.component_id for r in ranges.joined(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1}
    assert ranges.joined(df.limit(0)).count() == 0
    assert {r.vec_id: r.n_links for r in ranges.joined(spark.createDataFrame([(1, None), (2, [0.0])], SCHEMA)).collect()} == {1: 0, 2: 0}


@pytest.mark.parametrize("block", [64, 4096])
def test_search_recall_scores_and_ties(spark, block):
    x = clustered(900, seed=1)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + ODD
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as leaf", "2 as bin")
    got = ann.search(df, df.where("vec_id % 10 = 0"), leaf=32, block=block).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    x, hits = x.astype(float), 0
    assert set(by) == set(range(0, 900, 10))
    for q, own in by.items():
        own.sort()
        d = ann.distances(x[q], x)
        order = [int(i) for i in np.lexsort((np.arange(len(x)), d)) if i != q][:10]
        assert [r for r, _, _ in own] == list(range(1, 11)) and all(s == d[i] for _, i, s in own)
        assert [(s, i) for _, i, s in own] == sorted((s, i) for _, i, s in own) and q not in {i for _, i, _ in own}
        hits += len({i for _, i, _ in own} & set(order))
        if q in range(50, 90):
            assert [i for _, i, _ in own] == order  # ties of equal vectors by id
    assert hits / (10 * len(by)) >= 0.9


def test_search_with_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], SCHEMA)
    got = ann.search(df, df.where("vec_id = 0")).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 2), (2, 1)]
    assert ann.search(df.limit(0), df).count() == 0


def test_bins_hold_every_row_of_a_large_leaf():
    bins = ann.packed({0: 10, 1: 5000, 2: 3, 3: 4}, 1000)
    first, parts = bins[1]
    assert parts == 5 and bins[2] == bins[3] == (first + 5, 1) and bins[0] == (0, 1) and first == 1


def test_vectors_of_every_length_meet_their_own(spark):
    """Links and neighbours within each length, also of rare ones; most queries of another length than most rows."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(1, 200, 2)] + [(i, rng.normal(size=2).tolist()) for i in range(0, 100, 2)]
    rows += [(1000, [1.0, 2.0, 3.0]), (1002, [1.0, 2.0, 3.01]), (1004, [5.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    vectors = {i: np.asarray(v, "float32").astype(float) for i, v in rows}
    cosine = lambda a, b: (a @ b) / np.sqrt((a @ a) * (b @ b))
    got = {r.vec_id: r.n_links for r in ranges.joined(df, block=16).collect()}
    assert got == {i: sum(len(v) == len(w) and i != j and cosine(v, w) >= 0.95 for j, w in vectors.items()) for i, v in vectors.items()}
    found = {}
    for r in ann.search(df, df.where("vec_id % 2 = 0"), recall=1.0, leaf=16).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    for q in (0, 50, 98, 1000, 1002):
        own = sorted((np.sqrt(((w - vectors[q]) ** 2).sum()), j) for j, w in vectors.items() if j != q and len(w) == len(vectors[q]))[:10]
        assert [j for _, j in sorted(found[q])] == [j for _, j in own]
    assert 1004 not in found


def test_a_query_id_with_two_vectors_has_two_lists(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)] + [(0, [29.0, 2.0])] * 2, SCHEMA)
    got = ann.search(df, df.where("vec_id = 0")).collect()
    assert sorted(r["rank"] for r in got) == sorted([*range(1, 11)] * 2)
    assert {r.vec_id for r in got} == {*range(1, 11), *range(20, 30)}


def test_queries_come_in_lots(spark):
    x = clustered(300, seed=4)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], SCHEMA)
    of = lambda **o: sorted(map(tuple, ann.search(df, df, **o).collect()))
    assert of(lot=7) == of()
