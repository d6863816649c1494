import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import hashes, kernels, planning


def blobs(spark, n=40):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.1, (n, 2)) for c in ((0, 0), (5, 5), (0, 6))] + [np.array([[20.0, 20.0], [-20.0, 5.0]])])
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")


def test_hdbscan_finds_blobs_and_noise(spark):
    got = {r.id: r.cluster for r in kernels.hdbscan(blobs(spark), 10).collect()}
    for b in range(3):
        assert {got[i] for i in range(40 * b, 40 * b + 40)} - {-1} == {b}
    assert sum(got[i] == -1 for i in range(120)) <= 12 and got[120] == got[121] == -1
    assert kernels.hdbscan(blobs(spark).limit(0), 5).count() == 0


def test_optics_orders_blobs_together(spark):
    got = sorted(((r.position, r.id, r.reachability) for r in kernels.optics(blobs(spark), 5).collect()))
    assert got[0][2] is None and [p for p, _, _ in got] == list(range(122))
    assert sum(1 for _, i, r in got if r is not None and r > 2) == 4


@pytest.mark.parametrize("linkage", ["average", "complete", "ward"])
def test_agglomerative(spark, linkage):
    got = {r.id: r.cluster for r in kernels.agglomerative(blobs(spark).where("id < 120"), 3, linkage).collect()}
    assert [got[i] for i in range(120)] == [0] * 40 + [1] * 40 + [2] * 40


@pytest.mark.parametrize("linkage", ["average", "complete", "ward"])
def test_agglomerative_against_a_scan_of_all_pairs(spark, linkage):
    """Ties go to the smaller members, as in a search of the whole matrix before each merge."""
    x = np.random.default_rng(3).integers(0, 5, (90, 2)).astype(float)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) ** (2 if linkage == "ward" else 1)
    np.fill_diagonal(d, np.inf)
    size, owner, alive = np.ones(90), np.arange(90), np.ones(90, bool)
    for _ in range(90 - 7):
        i, j = sorted(divmod(int(d.argmin()), 90))
        ward = ((size[i] + size) * d[i] + (size[j] + size) * d[j] - size * d[i, j]) / (size[i] + size[j] + size)
        new = {"complete": np.maximum(d[i], d[j]), "average": (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j]), "ward": ward}[linkage]
        new[~alive] = new[i] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        size[i], alive[j] = size[i] + size[j], False
        owner[owner == j] = i
    names = {c: k for k, c in enumerate(dict.fromkeys(owner.tolist()))}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    assert {r.id: r.cluster for r in kernels.agglomerative(df, 7, linkage).collect()} == {i: names[c] for i, c in enumerate(owner.tolist())}
    assert kernels.agglomerative(df.limit(0), 7, linkage).count() == 0 and kernels.MOST_PAIRS > 10_256


@pytest.mark.parametrize("linkage", ["average", "complete", "ward"])
def test_agglomerative_of_larger_tables_is_spread(spark, monkeypatch, linkage):
    """Past what the driver compares itself nothing is refused, and clusters are the same; copies, far pairs and hubs included."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 1, (500, 6)), rng.normal(4, 0.2, (150, 6)), np.full((5, 6), 9.0), rng.normal(0, 40, (6, 6))])
    x = np.concatenate([x, x[:40], x[650:652] + 0.01])
    df = spark.createDataFrame([(5 * i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    want = sorted(kernels.agglomerative(df, 10, linkage).collect())
    monkeypatch.setattr(kernels, "MOST_PAIRS", 50)
    monkeypatch.setattr(kernels, "MOST_LEFT", 300)
    monkeypatch.setattr(kernels, "BLOCK", 256)
    assert sorted(kernels.agglomerative(df, 10, linkage).collect()) == want and len({r.cluster for r in want}) == 10


def test_too_many_points_are_refused(spark):
    with pytest.raises(ValueError, match="more than"):
        kernels.points(blobs(spark), 50)


def test_larger_tables_are_spread(spark, monkeypatch):
    """Past what the driver compares itself, equal results from distributed comparisons; copies and ties included."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 0.3, (60, 2)) for c in ((0, 0), (5, 5), (0, 6))] + [np.round(rng.normal(3, 2, (40, 2))), np.full((6, 2), 9.0)])
    df = spark.createDataFrame([(7 * i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    clusters, order = kernels.hdbscan(df, 6).collect(), kernels.optics(df, 5).collect()
    monkeypatch.setattr(kernels, "MOST", 50)
    monkeypatch.setattr(kernels, "NEAR", 8)
    assert sorted(kernels.hdbscan(df, 6).collect()) == sorted(clusters) and len({r.cluster for r in clusters}) > 3
    got = sorted(kernels.optics(df, 5).collect(), key=lambda r: r.position)
    want = sorted(order, key=lambda r: r.position)
    assert [r.id for r in got] == [r.id for r in want] and got[0].reachability is None
    assert max(abs(a.reachability - b.reachability) for a, b in zip(got[1:], want[1:])) < 1e-9 and max(abs(a.core - b.core) for a, b in zip(got, want)) < 1e-9


def test_larger_optics_stays_off_the_driver(spark, monkeypatch):
    """Neither vectors nor neighbours are collected, and the order is that of the driver's own scan."""
    df = blobs(spark).repartition(3)
    want = sorted(kernels.optics(df, 5).collect(), key=lambda r: r.position)
    monkeypatch.setattr(kernels, "MOST", 50)
    monkeypatch.setattr(kernels, "NEAR", 8)
    with monkeypatch.context() as m:
        m.setattr(type(df), "toPandas", lambda _: pytest.fail("collected"))
        got = kernels.optics(df, 5)
    got = sorted(got.collect(), key=lambda r: r.position)
    assert [(r.id, r.position) for r in got] == [(r.id, r.position) for r in want] and got[0].reachability is None
    assert all(abs(a.reachability - b.reachability) < 1e-9 for a, b in zip(got[1:], want[1:]))


def test_near_hashes_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-(2**63), 2**63 - 1, 20, dtype=np.int64)
    h = [int(b) ^ int(np.int64(1) << np.int64(rng.integers(0, 63))) if i % 2 else int(b) for i in range(6) for b in base] + [-1, 0, -1]
    df = spark.createDataFrame(list(enumerate(h)), "k long, h long")
    got = {(r.a, r.b): r.distance for r in hashes.near_hashes(df, "k", "h", 4).collect()}
    first = {}
    for i, x in enumerate(h):
        first.setdefault(x, i)
    want = {(i, j): ((x ^ y) & (2**64 - 1)).bit_count() for x, i in first.items() for y, j in first.items() if i < j and ((x ^ y) & (2**64 - 1)).bit_count() <= 4}
    want |= {(first[x], i): 0 for i, x in enumerate(h) if first[x] != i}
    assert got == want
    every = {(i, j): ((x ^ y) & (2**64 - 1)).bit_count() for i, x in enumerate(h) for j, y in enumerate(h) if i < j and ((x ^ y) & (2**64 - 1)).bit_count() <= 4}
    full = [(r.a, r.b, r.distance) for r in hashes.expand(hashes.near_hashes(df, "k", "h", 4), df, "k", "h").collect()]
    assert len(full) == len(every) > len(want) and {(a, b): d for a, b, d in full} == every
    assert spark.range(1).select(hashes.from_hex(F.lit("ffffffffffffffff")).alias("x")).first().x == -1


def test_image_kernels(spark):
    noise = np.random.default_rng(1).integers(0, 100, (32, 32))
    flat, ramp = np.full((32, 32), 7), np.tile(np.arange(32) * 8, (32, 1))
    assert hashes.entropy_of(flat) == 0 and hashes.laplacian_variance_of(flat) == 0 and hashes.entropy_of(ramp) == 5
    assert hashes.phash_of(noise) == hashes.phash_of(noise * 2.0) != hashes.phash_of(noise.T)
    assert hashes.dhash_of(ramp[:8, :9]) == -1
    df = spark.createDataFrame([(1, [0, 255, 0, 255], 2), (2, None, 2), (3, [1, 2, 3], 2)], "k int, p array<int>, w int")
    assert {r.k: r.entropy for r in hashes.diagnostics(df, "k", "p", "w").collect()} == {1: 1.0, 2: None, 3: None}


def test_plans(spark):
    grid = planning.expand_grid({"a": 1}, {"m": [1, 2, 3], "q": [0.1, 0.2]})
    assert len(grid) == 6
    with pytest.raises(ValueError):
        planning.expand_grid({}, {"m": list(range(300))})
    df = spark.createDataFrame([(i, g["m"], g["q"]) for i, g in enumerate(grid)], "k int, m int, q double")
    assert planning.parameter_neighbors(df, "k", ["m", "q"]).count() == 4 + 3
    needs = {"c": ["a", "b"], "a": [], "b": ["a"]}
    assert planning.stage_order(needs) == ["a", "b", "c"]
    states = planning.stage_states(needs, {"b": "failed"}, {"a": True})
    assert states == {"a": "completed", "b": "failed", "c": "blocked"} and planning.next_actions(states)["a"] == "reuse_verified"
    with pytest.raises(ValueError):
        planning.stage_order({"a": ["b"], "b": ["a"]})
    items = [("x", {1}), ("y", {1, 2}), ("z", {1}), ("w", set())]
    assert "y" in planning.coverage_subset(items, 2, 1) and len(planning.coverage_subset(items, 3, 1)) == 3
    rows = [{"k": i, "g": i % 2, "s": float(i)} for i in range(6)]
    assert planning.spread(rows, ["s"], "g", "k", 3) == [0, 1, 5]
    runs = planning.experiment_matrix(spark.createDataFrame([("s",)], "split string"), [1, 2, 3])
    seen = spark.createDataFrame([("s", 1), ("s", 2), ("s", 2), ("t", 1)], "split string, seed int")
    assert {(r.split, r.seed): r.status for r in planning.matched_runs(runs, seen, ["split", "seed"]).collect()} == {("s", 1): "complete", ("s", 2): "duplicate", ("s", 3): "missing", ("t", 1): "unexpected"}
