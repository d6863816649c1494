"""Edge cases of the library's operators."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions.stats import average_rank, distribution, entropy_bits, pearson
from tidemark.functions.vectors import l2_normalize, quality
from tidemark.operators import clusters, contents, evaluation, graph, joins, leakage, review, series, similarity, splits


def test_checked_join_names_the_repeated_side(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k int, a string")
    b = spark.createDataFrame([(1, "z")], "k int, b string")
    assert joins.checked_join(a, b, ["k"], validate="many_to_one").count() == 2
    with pytest.raises(joins.CardinalityError, match="right"):
        joins.checked_join(b, a, ["k"], validate="one_to_one")


def test_band_join_equals_a_theta_join(spark, rows):
    rng = random.Random(1)
    pts = [(rng.randint(0, 2), float(rng.randint(-50, 50)), i) for i in range(120)]
    a = spark.createDataFrame(pts, "k int, p double, i int")
    b = a.select("k", F.col("p").alias("q"), F.col("i").alias("j"))
    got = rows(joins.band_join(a, b, ["k"], "p", "q", 7.0), "i", "j")
    assert got == sorted(((i, j) for k, p, i in pts for m, q, j in pts if k == m and abs(p - q) <= 7), key=repr)


def test_points_in_no_one_and_several_intervals(spark, rows):
    points = spark.createDataFrame([("a", float(p)) for p in range(6)], "k string, p double")
    spans = spark.createDataFrame([("a", 1.0, 2.0, "x"), ("a", 2.0, 4.0, "y"), ("b", 0.0, 9.0, "z")], "k string, s double, e double, v string")
    got = joins.exactly_one(points, spans, ["k"], "p", "s", "e", "v", 1.5)
    assert rows(got, "p", "v", "status") == sorted([(0.0, None, "none"), (1.0, "x", "one"), (2.0, None, "several"), (3.0, "y", "one"), (4.0, "y", "one"), (5.0, None, "none")], key=repr)


def test_distribution_of_nothing_has_count_zero_and_nulls(spark):
    row = spark.createDataFrame([], "x double").agg(*distribution("x")).first()
    assert row["count"] == 0 and all(row[c] is None for c in row.asDict() if c != "count")


def test_average_rank_shares_ties_and_skips_nulls(spark, rows):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 1.0), (4, None)], "i int, x double")
    assert rows(df.select("i", average_rank("x").alias("r"))) == [(1, 2.5), (2, 2.5), (3, 1.0), (4, None)]


def test_correlation_of_few_or_constant_points_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 2.0)], "x double, y double")
    assert df.agg(pearson("x", "y").alias("r")).first().r is None
    assert df.limit(2).agg(pearson("x", "x").alias("r")).first().r is None


def test_entropy_in_bits(spark):
    one = spark.range(1).select(entropy_bits(F.array(F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit(2.0))).alias("h")).first()
    assert one.h == pytest.approx(1.5)


def test_vector_quality_and_zero_norm(spark):
    df = spark.createDataFrame([([1.0, 0.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), (None,), ([3.0, 4.0],)], "v array<double>")
    assert [r.q for r in df.select(quality(F.col("v")).alias("q")).collect()] == ["ok", "zero", "non_finite", "missing", "not_unit"]
    assert [r.u for r in df.where("v is not null").select(l2_normalize(F.col("v")).alias("u")).collect()][1] == [0.0, 0.0]


def test_paths(spark):
    df = spark.createDataFrame([("train/v1_frame_000001.jpg",), ("../x.txt",), ("a/con.txt",), ("a\\b.png",), ("",)], "p string")
    got = df.select(X.portable(F.col("p")).alias("ok"), X.member_kind(F.col("p")).alias("kind")).collect()
    assert [r.ok for r in got] == [True, False, False, False, False]
    assert [r.kind for r in got] == ["image", "label", "label", "image", "other"]


def test_label_lines(spark):
    texts = ["0 0.5 0.5 0.2 0.2\n\n1 0.5 0.5 0.1 0.1", "", None, "7 0.5 0.5 0.1 0.1", "0 nan 0.5 0.1 0.1", "0 0.5 0.5 0.1", "0 0.01 0.5 0.5 0.1"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(X.label_boxes(F.col("t")).alias("b")).collect()
    assert [len(r.b.boxes) for r in got] == [2, 0, 0, 0, 0, 0, 0]
    assert [list(r.b.issues) for r in got] == [[], [], [], ["class"], ["number"], ["fields"], ["outside"]]


def test_frame_rates_and_utc(spark):
    df = spark.createDataFrame([("30000/1001",), ("0/0",), ("N/A",), ("25",)], "r string")
    assert [r.f and round(r.f, 3) for r in df.select(X.frame_rate(F.col("r")).alias("f")).collect()] == [29.97, None, None, 25.0]
    times = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("2024-01-01T00:00:00+02:00",), ("2024-01-01",)], "t string")
    assert [r.u is not None for r in times.select(X.utc_timestamp(F.col("t")).alias("u")).collect()] == [True, False, False]


def test_digest_ignores_order_and_partitions_and_sees_repeats(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "i int, s string")
    of = lambda d: contents.dataset_digest(d, ["i", "s"]).first().digest
    assert of(df) == of(df.orderBy(F.desc("i")).repartition(3)) != of(df.unionByName(df.limit(1)))


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1080)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((top(a), top(b)))
            up[b] = a
    assert got == {x: top(x) for x in up}


def test_a_rejected_pair_vetoes_its_edge_and_shows_contradictions(spark):
    nodes = spark.createDataFrame([(i,) for i in range(5)], "n long")
    edges = spark.createDataFrame([(0, 1, "exact"), (1, 2, "exact"), (0, 2, "rejected"), (3, 4, "exact"), (4, 3, "rejected")], "a long, b long, state string")
    got = graph.dependency_groups(nodes, edges, "n", "a", "b", "state", ["exact"], "rejected")
    assert {r.node: r.group_id for r in got.collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4}
    assert [(r.a, r.b) for r in graph.contradictions(got, edges, "a", "b", "state", "rejected").collect()] == [(0, 2)]


def test_dbscan_with_border_and_noise(spark):
    pts = [(0, [0.0]), (1, [0.1]), (2, [0.2]), (3, [0.45]), (4, [5.0]), (5, [9.0]), (6, [9.1]), (7, [9.2])]
    got = clusters.dbscan(spark.createDataFrame(pts, "id long, v array<double>"), 0.3, 3)
    assert {r.id: r.cluster for r in got.collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: -1, 5: 1, 6: 1, 7: 1}


def test_agreement_of_equal_groupings(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (2, 6), (2, 6), (3, 7)], "u int, v int")
    row = clusters.agreement(df, "u", "v").first()
    assert (row.ari, row.homogeneity, row.v_measure) == (1.0, 1.0, 1.0)
    assert clusters.adjusted_mutual_information(df, "u", "v") == pytest.approx(1.0)
    one = df.withColumn("u", F.lit(1)).withColumn("v", F.lit(1))
    assert clusters.agreement(one, "u", "v").first().ari is None
    assert clusters.adjusted_mutual_information(one, "u", "v") is None


def test_top_k_in_blocks_is_the_same(spark, rows):
    rng = random.Random(5)
    vs = [(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(3)]) for i in range(60)]
    df = spark.createDataFrame(vs, "id long, v array<double>")
    assert rows(similarity.top_k(df, df, 4)) == rows(similarity.top_k(df, df, 4, block=16))
    want = {(i, j, n + 1) for i, v in vs for n, (j, _) in enumerate(sorted(((j, w) for j, w in vs if j != i), key=lambda x: (-sum(a * b for a, b in zip(v, x[1])), x[0]))[:4])}
    assert {(r.query, r.neighbor, r["rank"]) for r in similarity.top_k(df, df, 4).collect()} == want


def test_runs_and_returns(spark, rows):
    df = spark.createDataFrame([("k", i, c) for i, c in enumerate("aabbacca")], "k string, i int, c string")
    got = series.transitions(series.runs(df, ["k"], ["i"], "c"), ["k"], "c")
    assert rows(got, "run", "c", "start", "end", "returned") == [(1, "a", 0, 1, False), (2, "b", 2, 3, False), (3, "a", 4, 4, True), (4, "c", 5, 6, False), (5, "a", 7, 7, True)]


def test_centroid_changes_lists_every_row_once(spark):
    df = spark.createDataFrame([("k", i, [1.0, 0.0] if i < 6 else [0.0, 1.0]) for i in range(12)] + [("s", 0, [1.0, 0.0])], "k string, i int, v array<double>")
    got = {(r.k, r.i): r.change for r in series.centroid_changes(df, "k", "i", "v", 3).collect()}
    assert len(got) == 13 and got["k", 6] == pytest.approx(1.0) and got["k", 3] == pytest.approx(0.0)
    assert [got["k", i] for i in (0, 1, 2, 10, 11)] == [None] * 5 and got["s", 0] is None


def test_average_precision_of_perfect_and_missing_classes(spark):
    found = spark.createDataFrame([("a", 0.9, True, 1), ("a", 0.8, True, 2)], "c string, conf double, hit boolean, i int")
    support = spark.createDataFrame([("a", 2), ("b", 3), ("z", 0)], "c string, support long")
    got = {r.c: r.ap for r in evaluation.average_precision(evaluation.precision_recall(found, "c", "conf", "hit", "i", support), "c", support).collect()}
    assert got["a"] == pytest.approx(1.0, abs=0.011) and got["b"] == 0.0 and got["z"] is None


def plain_precision(hits, support):
    """101 points of the envelope, integrated by trapezoids."""
    r, p, k = [0.0], [1.0], 0
    for n, h in enumerate(hits, 1):
        k += h
        r.append(k / support)
        p.append(k / n)
    r, p = np.array([*r, 1.0]), np.array([*p, 0.0])
    x = np.linspace(0, 1, 101)
    y = np.interp(x, r, np.maximum.accumulate(p[::-1])[::-1])
    return float(((y[1:] + y[:-1]) / 2 * np.diff(x)).sum())


def test_precision_against_the_plain_integral(spark):
    rng = random.Random(7)
    rows = [(c, round(rng.random(), 2), rng.random() < q, i, rng.randint(0, 9)) for i, (c, q) in enumerate([("a", 0.9), ("b", 0.5), ("c", 0.1), ("d", 0.0), ("e", 1.0)] * 40)]
    df = spark.createDataFrame(rows, "c string, conf double, hit boolean, i int, image int")
    targets = spark.createDataFrame([(r[0], r[4]) for r in rows], "c string, image int")
    support = targets.groupBy("c").agg(F.count("*").alias("support"))
    got = {r.c: r.ap for r in evaluation.average_precision(evaluation.precision_recall(df, "c", "conf", "hit", "i", support), "c", support).collect()}
    for c in "abcde":
        own = sorted((-x[1], x[3], x[2]) for x in rows if x[0] == c)
        assert got[c] == pytest.approx(plain_precision([h for _, _, h in own], 40), abs=1e-9)
    weights = spark.range(6).select(F.col("id").cast("int").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("image")).select("r", "image", evaluation.poisson_weight(5, "r", "image").alias("w"))
    weight = {(r.r, r.image): r.w for r in weights.collect()}
    spread = {r.c: r for r in evaluation.bootstrap_average_precision(df, targets, "c", "conf", "hit", "i", "image", 6, 0.5, 5).collect()}
    for c in "ab":
        each = []
        for r in range(6):
            hits = [h for _, _, h, w in sorted((-x[1], x[3], x[2], weight[r, x[4]]) for x in rows if x[0] == c) for _ in range(w)]
            each.append(plain_precision(hits, len(hits)))
        assert (spread[c].low, spread[c].high) == pytest.approx(tuple(np.quantile(each, [0.25, 0.75])), abs=1e-9)


def test_bootstrap_is_repeatable_and_covers_the_mean(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(200)], "u int, x double")
    a, b = (evaluation.bootstrap(df.repartition(n), "u", "x", [], 100, 0.9, 1).first() for n in (1, 5))
    assert a == b and a.low < a["mean"] < a.high


def test_profiles_reach_their_targets_and_keep_groups_whole(spark):
    units = spark.createDataFrame([(i, i % 3 + 1, 1) for i in range(60)], "g long, a long, b long")
    plan, objective = splits.profile_assignment(units, "g", ["a", "b"], {"train": 0.5, "val": 0.25, "test": 0.25}, 1)
    done = splits.apply_profiles(units, "g", ["a", "b"], plan, 1)
    assert done.count() == 60 == done.select("g").distinct().count()
    sums = {r.split: r["sum(a)"] for r in done.groupBy("split").sum("a").collect()}
    assert all(abs(sums[k] - want) <= 2 for k, want in {"train": 60, "val": 30, "test": 30}.items()) and objective < 0.05


def test_upsert_changes_only_what_differs(spark, rows):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, d string, n int")
    new = spark.createDataFrame([(1, "a", 5), (2, None, None), (9, "z", 9)], "k int, d string, n int")
    merged, log = review.upsert(old, new, "k", ["d", "n"])
    assert rows(merged) == [(1, "a", 5), (2, "b", 2)] and rows(log) == [(1, "n", "1", "5")]


def test_blocks_are_read_where_they_are_kept(spark):
    """However many blocks, no row is copied to meet them; every pair counts once."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(150, 4)), np.repeat(rng.normal(size=(2, 4)), 30, axis=0)])
    df = spark.createDataFrame([(i, i % 3, [float(v) for v in r]) for i, r in enumerate(x)], "id long, g int, v array<double>")
    got = similarity.pairs(df, 16, "g")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    seen = {(r.a, r.b): (r.g_a, r.g_b) for r in got.collect()}
    assert len(seen) == got.count() == 210 * 209 // 2 and all(a < b and g == (a % 3, b % 3) for (a, b), g in seen.items())
    exact = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(similarity.distances(x, x) - exact).max() < 1e-12
    sums = {(r.id, r.other): (r.n, r.total) for r in similarity.distance_sums(df, "g").collect()}
    assert all(sums[i, g][0] == 70 - (i % 3 == g) and abs(sums[i, g][1] - exact[i, g::3].sum()) < 1e-9 for i in range(210) for g in range(3))


def test_neighbours_are_ranked_where_they_are_found(spark):
    """With left blocks enough a task streams all right ones, so nothing shuffles after it; rows of one id have one ranking."""
    rng = np.random.default_rng(10)
    x = np.round(rng.normal(size=(200, 3)), 1)
    ids = [*range(199), 7]  # an id with two rows
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in zip(ids, x)], "id long, v array<double>")
    got = similarity.top_k(df, df.where("id <> 7"), 4, block=16)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan and "Window" not in plan
    found = {}
    for r in got.collect():
        found.setdefault(r["query"], {})[r["rank"]] = (r.neighbor, r.score)
    score = np.round(x @ x.T, 6)
    for q in range(199):
        best = sorted((-score[i, j], j) for i in range(200) if ids[i] == q for j in range(199) if j not in (7, q))[:4]
        assert [found[q][k][1] for k in (1, 2, 3, 4)] == [-s for s, _ in best]
        assert q == 7 or [found[q][k][0] for k in (1, 2, 3, 4)] == [j for _, j in best]
    assert len(found) == 199 and got.count() == 199 * 4


def test_passes_over_all_pairs_share_blocks_and_sum_in_few_tasks(spark, monkeypatch):
    """Blocks are packed once for all passes, and bins come from some tasks a core, however many blocks."""
    monkeypatch.setattr(similarity, "STRATA", 16)
    monkeypatch.setattr(similarity, "FINAL", 50)
    rng, cut, cuts = np.random.default_rng(11), similarity.cut, []
    monkeypatch.setattr(similarity, "cut", lambda df: cuts.append(df.columns) or cut(df))
    x = rng.normal(size=(600, 3))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    got = similarity.pair_summary(df, quantiles={"median": 0.5, "p99": 0.99}).first()
    assert sum(c == ["x", "rows"] for c in cuts) == 1
    exact = (x @ x.T)[np.triu_indices(600, 1)]
    assert got["count"] == len(exact) and abs(got.median - np.quantile(exact, 0.5)) < 1e-12 and abs(got.p99 - np.quantile(exact, 0.99)) < 1e-12
    kept = similarity.packed(df, 16)
    values = similarity.stratum_values(kept, similarity.everything, None, lambda name, v: None, "n long")
    assert kept.n == 38 and values.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism


def test_dbscan_links_of_copies_are_no_square(spark):
    """Three hundred copies, a border row and noise: links leave a task as a forest."""
    x = [[0.0, 0.0]] * 300 + [[1.0, 0.0], [9.0, 9.0]] + [[5.0, 0.1 * i] for i in range(5)]
    df = spark.createDataFrame(list(enumerate(x)), "id long, v array<double>")
    got = {r.id: r.cluster for r in clusters.dbscan(df, 1.0, 5).collect()}
    assert [got[i] for i in range(307)] == [0] * 301 + [-1] + [1] * 5
    x[300] = [0.0, 1.0 + 1e-9]
    df = spark.createDataFrame(list(enumerate(x)), "id long, v array<double>")
    assert {r.id: r.cluster for r in clusters.dbscan(df, 1.0, 5).collect()}[300] == -1


def test_near_ranks_against_full_rankings(spark):
    """Only the nearest come out, with their rank among all rows by the other vector; ties go to the smaller id."""
    rng = np.random.default_rng(9)
    x, y = rng.integers(0, 4, (60, 3)).astype(float), rng.integers(0, 3, (60, 2)).astype(float)
    df = spark.createDataFrame([(i, v.tolist(), w.tolist()) for i, (v, w) in enumerate(zip(x, y))], "id long, v array<double>, w array<double>")
    ranks = {}
    for c, z in (("v", x), ("w", y)):
        d = np.round(np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2)), 9)
        for i in range(60):
            for r, j in enumerate(sorted((j for j in range(60) if j != i), key=lambda j: (d[i, j], j)), 1):
                ranks[c, i, j] = r
    got = similarity.near_ranks(df, 7).collect()
    assert len(got) == 60 * 7 * 2
    assert all(ranks[r.by, r["query"], r.neighbor] == r["rank"] and ranks["vw".replace(r.by, ""), r["query"], r.neighbor] == r.other for r in got)


def test_blocks_are_compressed_before_they_shuffle_and_lose_no_digit(spark):
    """Single-precision numbers are kept as such, others as doubles; each task sends its share of a block in one row."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(400, 16))
    sizes = {}
    for name, z in (("half", x.astype(np.float32).astype(float)), ("full", x)):
        df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(z)], "id long, v array<double>").repartition(2)
        kept = similarity.packed(df, 100)
        got = kept.blocks.collect()
        rows = {i: v for r in got for i, v in similarity.unpacked(r["rows"])[["id", "v"]].itertuples(index=False)}
        assert len(got) == kept.n == 4 and len(rows) == 400 and all(np.array_equal(similarity.matrix([rows[i]])[0], z[i]) for i in rows)
        sizes[name] = sum(len(r["rows"]) for r in got)
    assert sizes["half"] < 0.6 * sizes["full"]


def test_half_a_grid_is_even(spark):
    """Each two blocks meet once, and every left block meets about as many."""
    df = spark.createDataFrame([(i, [1.0]) for i in range(160)], "id long, v array<double>")
    for block in (10, 12):
        kept = similarity.packed(df, block)
        met = similarity.grid(kept, kept, lambda p, q: pd.DataFrame({"a": [p["id"][0]], "b": [q["id"][0]]}), "a long, b long", half=True).collect()
        assert len({frozenset((r.a, r.b)) for r in met}) == len(met) == kept.n * (kept.n + 1) // 2
        each = [sum(r.a == a for r in met) for a in {r.a for r in met}]
        assert max(each) - min(each) <= 1


def test_neighbours_by_two_views_meet_where_they_are_found(spark, rows):
    """Agreement and unions of two rankings as from two neighbour tables, without a shuffle after the blocks."""
    rng = np.random.default_rng(13)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(np.round(rng.normal(size=(90, 4)), 1))], "id long, v array<double>")
    views = similarity.unit_part(0, 2), similarity.unit_part(2, 4)
    x, y = (df.select("id", l2_normalize(F.slice("v", s, 2)).alias("v")) for s in (1, 3))
    for got, want in (
        (similarity.view_agreement(df, views, [2, 5], 16), similarity.agreement(similarity.top_k(x, x, 5), similarity.top_k(y, y, 5), [2, 5])),
        (similarity.view_candidates(df, views, 3, 16), similarity.union_candidates(similarity.top_k(x, x, 3), similarity.top_k(y, y, 3))),
    ):
        assert rows(got.select(want.columns)) == rows(want)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_neighbours_carry_the_labels_that_metrics_ask_for(spark, rows):
    rng = np.random.default_rng(14)
    df = spark.createDataFrame([(i, [float(v) for v in r], i % 4 - 1) for i, r in enumerate(rng.normal(size=(80, 3)))], "id long, v array<double>, c int")
    labels = df.select("id", "c")
    got, want = (clusters.metrics(labels, "id", "c", similarity.top_k(df, df, 5, extra=e), [2, 5]) for e in (("c",), ()))
    assert rows(got) == rows(want)


def test_large_tables_are_packed_some_blocks_at_a_time(spark, monkeypatch):
    """The shuffle that packs a table is let go of after each round, and every row is in one block all the same."""
    monkeypatch.setattr(similarity, "ROUND", 200)
    cut, held = similarity.cut, []
    monkeypatch.setattr(similarity, "cut", lambda df: held.append(cut(df)) or held[-1])
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(600)], "id long, v array<double>")
    kept = similarity.packed(df, 16)
    blocks = [(r.x, similarity.unpacked(bytes(r.rows))["id"].tolist()) for r in kept.blocks.collect()]
    assert len(held) == 3 and max(len(h.collect()) for h in held) <= 13
    assert sorted(x for x, _ in blocks) == list(range(38)) and kept.blocks.rdd.getNumPartitions() == 38
    assert sorted(i for _, ids in blocks for i in ids) == list(range(600))


def test_strata_of_rows_against_all_pairs(spark, monkeypatch):
    """Strata named by their rows are compared alone; tied scores, scores on the ends of bins and rounding change no value."""
    monkeypatch.setattr(similarity, "STRATA", 16)
    monkeypatch.setattr(similarity, "FINAL", 40)
    rng = np.random.default_rng(21)
    x, g = rng.integers(-2, 3, size=(150, 2)) / 2, np.arange(150) % 3  # sums of quarters: few values, on ends of bins
    df = spark.createDataFrame([(i, [float(v) for v in r], int(k)) for i, (r, k) in enumerate(zip(x, g))], "id long, v array<double>, g int")

    def own(p, q):
        return {str(k): (np.flatnonzero(p["g"] == k), np.flatnonzero(q["g"] == k)) for k in sorted(set(p["g"]) & set(q["g"]))}

    for digits in (None, 1):
        got = {r.stratum: r for r in similarity.pair_summary(df, own, {"median": 0.5, "p9": 0.9}, digits).collect()}
        for k in range(3):
            y = x[g == k]
            exact = (y @ y.T)[np.triu_indices(len(y), 1)]
            exact = exact if digits is None else np.round(exact, digits)
            r = got[str(k)]
            assert (r["count"], r.min, r.max) == (len(exact), exact.min(), exact.max())
            assert np.allclose([r.mean, r.std, r.median, r.p9], [exact.mean(), exact.std(), *np.quantile(exact, [0.5, 0.9])], atol=1e-12)
    for key in (0, 1, 17, 4096, 8191):
        least = similarity.least_of(key, 1.1)
        assert similarity.bins_of(np.array([least]), 1.1)[0] == key and (not key or similarity.bins_of(np.array([np.nextafter(least, -2)]), 1.1)[0] == key - 1)


def test_relations_of_named_sequences_against_all_pairs(spark):
    """Sequences of any type, missing ones among them; gaps are of equal sequences alone."""
    rng = np.random.default_rng(22)
    x, seq, mask = rng.normal(size=(90, 3)), [None if i % 7 == 0 else "abc"[i % 3] for i in range(90)], [1 << i % 3 for i in range(90)]
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], seq[i], 2 * i, mask[i]) for i in range(90)], "id long, v array<double>, sequence string, position long, mask int")
    want = {}
    for i in range(90):
        for j in range(i + 1, 90):
            same = seq[i] == seq[j] if seq[i] and seq[j] else None
            want.setdefault((same, mask[i] != mask[j], same is not None), []).append((round(float(x[i] @ x[j]), 9), 2 * (j - i)))
    got = {(r.same_sequence, r.cross_split, r.complete): r for r in leakage.relation_counts(df, 9).collect()}
    assert set(got) == set(want)
    for k, pairs in want.items():
        r, gap = got[k], [d for _, d in pairs]
        assert r.pairs == len(pairs) and abs(r["mean"] - np.mean([s for s, _ in pairs])) < 1e-9
        assert (r.least, r.most) == ((min(gap), max(gap)) if k[0] else (None, None))
    p = pd.DataFrame({"sequence": ["a", None, "b"], "position": [1, 2, 9], "mask": [1, 2, 4]})
    same = leakage.pair_relations(p, p)["same"]
    assert same.tolist() == [[True, False, False], [False] * 3, [False, False, True]] and leakage.gaps(p, p, ~same).tolist() == [1, 8, 1, 0, 7, 8, 7]


def test_own_sums_and_support_against_all_pairs(spark, rows):
    """Sums within groups as those of all groups, and mutual best matches as found by a join of either direction."""
    rng = np.random.default_rng(15)
    x = rng.normal(size=(120, 3))
    df = spark.createDataFrame([(i, i % 3, [float(v) for v in r]) for i, r in enumerate(x)], "id long, g int, v array<double>")
    got = similarity.own_sums(df, "g", 16)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert rows(got.withColumn("total", F.round("total", 9))) == rows(similarity.distance_sums(df, "g").where("own = other").withColumn("total", F.round("total", 9)).select(got.columns))
    score = np.round(x @ x.T, 6)
    best = {(i, g): max(range(g, 120, 3), key=lambda j: (score[i, j], -j)) for i in range(120) for g in range(3) if g != i % 3}
    for r in similarity.directed_support(df, "g", block=16).collect():
        own = [(i, best[i, r.right]) for i in range(r.left, 120, 3)]
        s = [score[e] for e in own]
        assert (r.n, r.mutual) == (40, sum(best[j, r.left] == i for i, j in own))
        assert abs(r.median - np.quantile(s, 0.5)) < 1e-9 and abs(r.p95 - np.quantile(s, 0.95)) < 1e-9


def test_rounded_scores_need_two_sweeps(spark, monkeypatch):
    """However many pairs a first bin has, its rounded scores are few values, which the second sweep counts."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(400, 3))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    df = spark.createDataFrame([(i, [float(c) for c in v], i % 3) for i, v in enumerate(x)], "id long, v array<double>, g int")
    monkeypatch.setattr(similarity, "FINAL", 1500)
    swept, sweeps = similarity.swept, []
    monkeypatch.setattr(similarity, "swept", lambda *a, **k: sweeps.append(1) or swept(*a, **k))

    def own(p, q):
        same = p["g"].to_numpy()[:, None] == q["g"].to_numpy()[None, :]
        return similarity.everything(p, q) | {"same": same, "other": ~same, "none": same & ~same}

    got = {r.stratum: r for r in similarity.pair_summary(df, own, {"median": 0.5, "p99": 0.99}, 6).collect()}
    i, j = np.triu_indices(400, 1)
    score, same = np.round((x[i] * x[j]).sum(axis=1), 6), i % 3 == j % 3
    assert len(sweeps) == 2 and set(got) == {"all", "same", "other"}
    for name, v in {"all": score, "same": score[same], "other": score[~same]}.items():
        r = got[name]
        assert r["count"] == len(v) and (r.min, r.max) == (v.min(), v.max())
        assert np.allclose([r.mean, r.std, r.median, r.p99], [v.mean(), v.std(), *np.quantile(v, [0.5, 0.99])], rtol=0, atol=1e-9)
