"""Queries that bind tables to each other, set runs side by side, and replay stored results, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import artifacts as A
from tidemark.operators import contents as C
from tidemark.operators import planning as N
from tidemark.operators import similarity as S
from tidemark.operators import splits as P
from tidemark.plans.base import Catalogue, table
from tidemark.plans.contents import OCC, occurrences
from tidemark.plans.series import NEXT, RUNS_OF, TIMED, labelled_evidence, seeded_runs, timed
from tidemark.plans.vectors import BOTH, DISTANCES, vectors
from tidemark.storage import stored

catalogue = Catalogue()


@catalogue.add("""WITH a AS (SELECT doc_id, count(*) AS l FROM documents GROUP BY 1), b AS (SELECT doc_id, count(*) AS r FROM labels GROUP BY 1), j AS (SELECT l, r FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id),
c AS (SELECT count(l) AS n_left, count(r) AS n_right, count(*) FILTER (WHERE l IS NOT NULL AND r IS NOT NULL) AS matched, count(*) FILTER (WHERE r IS NULL) AS left_alone, count(*) FILTER (WHERE l IS NULL) AS right_alone, count(*) FILTER (WHERE l > 1) AS repeated_left, count(*) FILTER (WHERE r > 1) AS repeated_right FROM j)
SELECT *, left_alone = 0 AND right_alone = 0 AND repeated_left = 0 AND repeated_right = 0 AS bound FROM c""")
def label_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether labels cover the documents, each once."""
    return A.binding(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"])


@catalogue.add("""WITH s AS (SELECT o_custkey, count(*) AS orders, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY 1) SELECT c_custkey, c_mktsegment, orders, spent FROM customer JOIN s ON o_custkey = c_custkey""")
def bound_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers bound to a feature table by id, which must have each of them once; those without orders are left out before."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"))
    known = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(orders.select("c_custkey"), "c_custkey", "left_semi")
    return A.bind(known, orders, ["c_custkey"])


@catalogue.add("""WITH t AS (SELECT source, n_chars, count(*) AS matches FROM documents GROUP BY 1, 2), e AS (SELECT source, n_chars FROM labels JOIN documents USING (doc_id))
SELECT CASE WHEN coalesce(matches, 0) = 1 THEN 'one' WHEN matches IS NULL THEN 'none' ELSE 'several' END AS status, count(*) AS endpoints FROM e LEFT JOIN t USING (source, n_chars) GROUP BY 1""")
def evidence_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence names a document by source and length: how many documents each endpoint has."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    ends = table(spark, sf_dir, "labels").join(docs, "doc_id").select("source", "n_chars")
    return A.endpoint_status(ends, docs, ["source", "n_chars"]).groupBy("status").agg(F.count("*").alias("endpoints"))


@catalogue.add(f"""WITH {OCC}, p AS (SELECT DISTINCT content_id, source FROM occ), a AS (SELECT content_id, count(*) AS left_degree FROM p GROUP BY 1), b AS (SELECT source, count(*) AS right_degree FROM p GROUP BY 1)
SELECT content_id, source, left_degree, right_degree, left_degree = 1 AND right_degree = 1 AS eligible FROM p JOIN a USING (content_id) JOIN b USING (source) WHERE left_degree > 1""")
def content_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents and the sources that have them: those of several sources aren't paired one to one."""
    return A.bijective(occurrences(spark, sf_dir), "content_id", "source").where("left_degree > 1")


NOISY = "x AS (SELECT label - 1 AS u, (label * 7 + vec_id % 3) % 5 - 1 AS v FROM embeddings)"


@catalogue.add(f"""WITH {NOISY}, r AS (SELECT 'all_points' AS policy, u, v FROM x UNION ALL SELECT 'common_clustered', u, v FROM x WHERE u <> -1 AND v <> -1), c AS (SELECT policy, u, v, count(*) AS n FROM r GROUP BY 1, 2, 3),
t AS (SELECT policy, sum(n) AS n, sum(n * (n - 1) / 2) AS ij FROM c GROUP BY 1), a AS (SELECT policy, count(*) AS ga, sum(n * (n - 1) / 2) AS i FROM (SELECT policy, u, sum(n) AS n FROM c GROUP BY 1, 2) GROUP BY 1),
b AS (SELECT policy, count(*) AS gb, sum(n * (n - 1) / 2) AS j FROM (SELECT policy, v, sum(n) AS n FROM c GROUP BY 1, 2) GROUP BY 1), m AS (SELECT count(*) AS total, avg(CASE WHEN u = -1 AND v = -1 THEN 1.0 ELSE 0 END) AS shared_noise FROM x)
SELECT policy, CAST(n AS BIGINT) AS n, round(n / total, 6) AS coverage, ga < 2 OR gb < 2 AS trivial, round((ij - i * j / (n * (n - 1) / 2)) / ((i + j) / 2 - i * j / (n * (n - 1) / 2)), 6) AS ari, round(shared_noise, 6) AS shared_noise FROM t JOIN a USING (policy) JOIN b USING (policy), m""")
def assignment_agreement_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select((F.col("label") - 1).alias("u"), ((F.col("label") * 7 + F.col("vec_id") % 3) % 5 - 1).alias("v"))
    got = A.agreement_by_policy(rows, "u", "v")
    return got.withColumns({c: F.round(c, 6) for c in ("coverage", "ari", "shared_noise")})


@catalogue.add("""WITH a AS (SELECT l_orderkey AS g, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS members FROM lineitem GROUP BY 1), b AS (SELECT l_partkey AS g, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS members FROM lineitem GROUP BY 1),
x AS (SELECT members, count(*) AS n FROM a GROUP BY 1), y AS (SELECT members, count(*) AS n FROM b GROUP BY 1) SELECT coalesce(x.members, y.members) AS members, coalesce(x.n, 0) AS left_groups, coalesce(y.n, 0) AS right_groups FROM x FULL OUTER JOIN y ON x.members = y.members""")
def recurrent_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and parts by the set of return flags that they hold, joined where the sets are equal."""
    lines = table(spark, sf_dir, "lineitem")
    return A.matched_sets(lines.select(F.col("l_orderkey").alias("g"), "l_returnflag"), lines.select(F.col("l_partkey").alias("g"), "l_returnflag"), "g", "l_returnflag")


@catalogue.add(f"""WITH {TIMED}, c AS (SELECT *, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos) AS BIGINT) AS interval FROM t) SELECT user_id, interval, min(pos) AS start, max(pos) AS "end", count(*) AS n FROM c GROUP BY 1, 2""")
def constructed_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timelines cut at accepted events."""
    return A.intervals_from_cuts(timed(spark, sf_dir), ["user_id"], "pos", F.col("event_type") == "signup")


@catalogue.add(f"""WITH {TIMED}, i AS (SELECT user_id, pos AS a, pos + CASE WHEN value > 100 THEN 3 ELSE -1 END AS b FROM t WHERE event_type = 'error'), s AS (SELECT user_id, min(pos) AS f, max(pos) AS l FROM t GROUP BY 1),
u AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM i JOIN s USING (user_id))
SELECT user_id, count(*) AS intervals, count(*) FILTER (WHERE b < a) AS reversed, count(*) FILTER (WHERE a < f OR b > l) AS outside, count(*) FILTER (WHERE a <= until) AS overlaps FROM u GROUP BY 1""")
def interval_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals around errors, against their timelines and each other."""
    t = timed(spark, sf_dir)
    spans = t.where("event_type = 'error'").select("user_id", F.col("pos").alias("a"), (F.col("pos") + F.when(F.col("value") > 100, 3).otherwise(-1)).alias("b"))
    bounds = t.groupBy("user_id").agg(F.min("pos").alias("f"), F.max("pos").alias("l"))
    return A.interval_faults(spans, ["user_id"], "a", "b", bounds, "f", "l")


@catalogue.add(f"""WITH {OCC}, g AS (SELECT source, split, count(*) AS n FROM occ GROUP BY 1, 2) SELECT source, string_agg(split, '+' ORDER BY split) AS splits, CAST(sum(n) AS BIGINT) AS members, count(*) > 1 AS fractured, CAST(sum(CASE WHEN split = 'test' THEN n ELSE 0 END) AS BIGINT) AS tested FROM g GROUP BY 1""")
def split_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split laid over a grouping: which splits each source lies in."""
    own = occurrences(spark, sf_dir).groupBy("source", "split").agg(F.count("*").alias("n"))
    splits = F.array_join(F.array_sort(F.collect_list("split")), "+").alias("splits")
    return own.groupBy("source").agg(splits, F.sum("n").alias("members"), (F.count("*") > 1).alias("fractured"), F.sum(F.when(F.col("split") == "test", F.col("n")).otherwise(0)).alias("tested"))


@catalogue.add(f"""WITH {OCC}, b AS (SELECT doc_id, split, CASE WHEN substr(content_id, 1, 1) IN ('0', '1') THEN 'val' WHEN substr(content_id, 1, 1) IN ('2', '3', '4') THEN 'test' ELSE 'train' END AS other FROM occ)
SELECT split AS "left", other AS "right", count(*) AS occurrences, split <> other AS moved FROM b GROUP BY 1, 2, 4""")
def compared_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two assignments of the same documents side by side."""
    digit = F.substring("content_id", 1, 1)
    other = F.when(digit.isin("0", "1"), "val").when(digit.isin("2", "3", "4"), "test").otherwise("train")
    both = occurrences(spark, sf_dir).select(F.col("split").alias("left"), other.alias("right"))
    return both.groupBy("left", "right").agg(F.count("*").alias("occurrences")).withColumn("moved", F.col("left") != F.col("right"))


@catalogue.add(f"""WITH {OCC}, {NEXT}, s AS (SELECT content_id, min(doc_id) AS m FROM occ GROUP BY 1), e AS (SELECT 'exact' AS state, m AS a, doc_id AS b FROM occ JOIN s USING (content_id) WHERE doc_id <> m UNION ALL SELECT 'confirmed', a, b FROM n UNION ALL SELECT 'rejected', a, b FROM n WHERE no)
SELECT state, count(*) AS evidence, count(DISTINCT (least(a, b), greatest(a, b))) AS pairs, count(*) FILTER (WHERE p.split <> q.split) AS crossing FROM e JOIN occ p ON p.doc_id = a JOIN occ q ON q.doc_id = b GROUP BY 1""")
def relation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.relation_metrics(labelled_evidence(spark, sf_dir), "a", "b", "state", occurrences(spark, sf_dir), "doc_id", "split")


@catalogue.add(f"""WITH {RUNS_OF} SELECT arm, outer_seed, {", ".join(f"round(max(CASE WHEN inner_seed = {i} THEN map50 END), 6) AS seed_{i}" for i in range(1, 8))} FROM r GROUP BY 1, 2""")
def wide_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a run, its seeds' metrics as columns."""
    wide = seeded_runs(spark, sf_dir).groupBy("arm", "outer_seed").pivot("inner_seed", list(range(1, 8))).agg(F.max("map50"))
    return wide.select("arm", "outer_seed", *[F.round(F.col(str(i)), 6).alias(f"seed_{i}") for i in range(1, 8)])


LABELLED = "r AS (SELECT p * 10 + s AS run, p, s FROM (SELECT unnest([2, 3, 4]) AS p), (SELECT unnest([0, 1]) AS s)), g AS (SELECT run, p, s, vec_id, (vec_id * (s + 1) + label) % p AS l FROM embeddings, r)"


@catalogue.add(f"""WITH {LABELLED} SELECT a.run AS a, b.run AS b, CASE WHEN a.p = b.p THEN 'seed' ELSE 'parameter' END AS kind, count(*) AS units, count(*) FILTER (WHERE a.l = b.l) AS equal, round(count(*) FILTER (WHERE a.l = b.l) / count(*), 6) AS share
FROM g a JOIN g b ON a.vec_id = b.vec_id AND a.run < b.run AND (a.p = b.p OR (a.s = b.s AND b.p - a.p = 1)) GROUP BY 1, 2, 3""")
def run_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that differ in their seed, or in one step of one parameter."""
    runs = spark.createDataFrame([(p * 10 + s, p, s) for p in (2, 3, 4) for s in (0, 1)], "run int, p int, s int")
    label = (F.col("vec_id") * (F.col("s") + 1) + F.col("label")) % F.col("p")
    given = table(spark, sf_dir, "embeddings").select("vec_id", "label").crossJoin(F.broadcast(runs)).select("run", "vec_id", label.alias("l"))  # six runs
    kinds = {"seed": F.col("a_p") == F.col("b_p"), "parameter": (F.col("a_s") == F.col("b_s")) & (F.col("b_p") - F.col("a_p") == 1)}
    return A.run_pairs(given, "run", "vec_id", "l", runs, kinds).withColumn("share", F.round("share", 6))


@catalogue.add("""WITH r AS (SELECT unnest(['a', 'b', 'c', 'd']) AS run, unnest([2, 3, 2, 3]) AS m), x AS (SELECT run, sha256(o_orderkey || chr(31) || (o_orderkey % m)) AS d FROM orders, r),
k AS (SELECT run, substr(d, 1, 2) AS b, sha256(string_agg(d, '' ORDER BY d)) AS h FROM x GROUP BY 1, 2), i AS (SELECT run, sha256(string_agg(b || h, '' ORDER BY b || h)) AS membership FROM k GROUP BY 1)
SELECT min(run) AS run, string_agg(run, '|' ORDER BY run) AS runs FROM i GROUP BY membership""")
def alias_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that put every order where another run does."""
    runs = spark.createDataFrame([("a", 2), ("b", 3), ("c", 2), ("d", 3)], "run string, m int")
    given = table(spark, sf_dir, "orders").select("o_orderkey").crossJoin(F.broadcast(runs)).select("run", "o_orderkey", (F.col("o_orderkey") % F.col("m")).alias("group"))  # four runs
    return A.aliases(A.membership_ids(given, "run", ["o_orderkey", "group"]), "run", "membership")


@catalogue.add(f"""WITH {TIMED}, m AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY pos) AS p FROM t) SELECT user_id, count(*) AS occurrences, count(DISTINCT event_type) AS clusters, count(*) FILTER (WHERE p <> event_type) AS transitions, count(*) FILTER (WHERE event_type = 'error') AS noise FROM m GROUP BY 1""")
def inspection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A timeline's occurrences, clusters, transitions and noise."""
    w = Window.partitionBy("user_id").orderBy("pos")
    rows = timed(spark, sf_dir).withColumn("p", F.lag("event_type").over(w))
    return rows.groupBy("user_id").agg(F.count("*").alias("occurrences"), F.countDistinct("event_type").alias("clusters"), F.count_if(F.col("p") != F.col("event_type")).alias("transitions"), F.count_if(F.col("event_type") == "error").alias("noise"))


@catalogue.add(f"""WITH {RUNS_OF}, o AS (SELECT arm, outer_seed, avg(map50) AS m, var_pop(map50) AS v FROM r GROUP BY 1, 2) SELECT arm, round(avg(m), 6) AS mean, round(var_pop(m), 6) AS between, round(avg(v), 6) AS within FROM o GROUP BY 1""")
def variance_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = A.variance_components(seeded_runs(spark, sf_dir), "arm", "outer_seed", "map50")
    return got.withColumns({c: F.round(c, 6) for c in ("mean", "between", "within")})


@catalogue.add(f"""WITH {RUNS_OF}, g AS (SELECT avg(map50) AS m FROM r) SELECT arm, count(*) AS runs, round(avg(map50), 6) AS mean, round(avg(map50 - m), 6) AS residual, round(avg(abs(map50 - m)), 6) AS spread FROM r, g GROUP BY 1""")
def strategy_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each strategy's mean metric, and its mean residual from the mean of all runs."""
    runs = seeded_runs(spark, sf_dir)
    off = runs.crossJoin(runs.agg(F.avg("map50").alias("m"))).withColumn("d", F.col("map50") - F.col("m"))  # a single row
    return off.groupBy("arm").agg(F.count("*").alias("runs"), F.round(F.avg("map50"), 6).alias("mean"), F.round(F.avg("d"), 6).alias("residual"), F.round(F.avg(F.abs("d")), 6).alias("spread"))


@catalogue.add("""SELECT lang, count(*) AS n, count(l.doc_id) AS paired, round(count(l.doc_id) / count(*), 6) AS coverage FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1""")
def paired_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("has"))
    both = table(spark, sf_dir, "documents").select("doc_id", "lang").join(labelled, "doc_id", "left")
    return both.groupBy("lang").agg(F.count("*").alias("n"), F.count("has").alias("paired"), F.round(F.count("has") / F.count("*"), 6).alias("coverage"))


@catalogue.add("""SELECT 'documents' AS variant, lang AS part, count(*) AS n, round(avg(n_chars), 6) AS mean, max(n_chars) AS most FROM documents GROUP BY 2 UNION ALL SELECT 'pages', split_part(split_part(url, '//', 2), '/', 2), count(*), round(avg(length(html)), 6), max(length(html)) FROM pages GROUP BY 2""")
def described_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same description of two variants, one under the other."""
    docs = table(spark, sf_dir, "documents").select(F.lit("documents").alias("variant"), F.col("lang").alias("part"), F.col("n_chars").alias("size"))
    part = F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("/"), F.lit(2))
    pages = table(spark, sf_dir, "pages").select(F.lit("pages").alias("variant"), part.alias("part"), F.length("html").cast("long").alias("size"))
    return docs.unionByName(pages).groupBy("variant", "part").agg(F.count("*").alias("n"), F.round(F.avg("size"), 6).alias("mean"), F.max("size").alias("most"))


@catalogue.add(f"""WITH {TIMED}, f AS (SELECT user_id, value > 80 AS x, event_type IN ('error', 'purchase') AS y FROM t) SELECT user_id, count(*) FILTER (WHERE x AND y) AS shared, count(*) FILTER (WHERE x OR y) AS "union", CASE WHEN count(*) FILTER (WHERE x OR y) > 0 THEN round(count(*) FILTER (WHERE x AND y) / count(*) FILTER (WHERE x OR y), 6) END AS jaccard FROM f GROUP BY 1""")
def zone_flag_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two flags of the same points: how far they agree in each timeline."""
    x, y = F.col("value") > 80, F.col("event_type").isin("error", "purchase")
    got = timed(spark, sf_dir).groupBy("user_id").agg(F.count_if(x & y).alias("shared"), F.count_if(x | y).alias("union"))
    return got.withColumn("jaccard", F.when(F.col("union") > 0, F.round(F.col("shared") / F.col("union"), 6)))


@catalogue.add(f"""WITH {OCC}, k AS (SELECT content_id, min(doc_id) AS id, list_sort(list_distinct(flatten(list([lang, source, split])))) AS w FROM occ GROUP BY 1) SELECT id, array_to_string(w, ',') AS keywords, len(w) AS n FROM k""")
def display_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One display row a content, with its keywords."""
    words = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("lang", "source", "split")))))
    own = occurrences(spark, sf_dir).groupBy("content_id").agg(F.min("doc_id").alias("id"), words.alias("w"))
    return own.select("id", F.array_join("w", ",").alias("keywords"), F.size("w").alias("n"))


@catalogue.add("""WITH s AS (SELECT label, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n, len(embedding) AS d FROM embeddings) SELECT label, count(*) AS vectors, min(d) AS dimensions, round(min(n), 6) AS least, round(avg(n), 6) AS mean, round(max(n), 6) AS most FROM s GROUP BY 1""")
def embedding_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.functions.vectors import norm

    rows = table(spark, sf_dir, "embeddings").select("label", norm(F.col("embedding")).alias("n"), F.size("embedding").alias("d"))
    return rows.groupBy("label").agg(F.count("*").alias("vectors"), F.min("d").alias("dimensions"), F.round(F.min("n"), 6).alias("least"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.max("n"), 6).alias("most"))


@catalogue.add("""WITH s AS (SELECT l_suppkey AS k, l_linenumber AS seed, avg(l_quantity) AS q FROM lineitem GROUP BY 1, 2), w AS (SELECT k, round(min(q), 6) AS worst, round(avg(q), 6) AS mean, round(coalesce(stddev_samp(q), 0), 6) AS std, count(*) AS seeds FROM s GROUP BY 1 HAVING count(*) >= 5),
a AS (SELECT 'worst' AS anchor, k, row_number() OVER (ORDER BY worst DESC, k) AS i FROM w UNION ALL SELECT 'mean', k, row_number() OVER (ORDER BY mean DESC, k) FROM w UNION ALL SELECT 'steady', k, row_number() OVER (ORDER BY std, k) FROM w)
SELECT anchor, w.* FROM a JOIN w USING (k) WHERE i = 1""")
def final_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with enough seeds: the best worst seed, the best mean, the least spread; ties to the smaller key."""
    seeds = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("seed")).agg(F.avg("l_quantity").alias("q"))
    own = seeds.groupBy("k").agg(F.round(F.min("q"), 6).alias("worst"), F.round(F.avg("q"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("q"), F.lit(0.0)), 6).alias("std"), F.count("*").alias("seeds")).where("seeds >= 5")
    row = F.struct("k", "worst", "mean", "std", "seeds")
    best = own.agg(F.min_by(row, F.struct(-F.col("worst"), "k")).alias("worst"), F.min_by(row, F.struct(-F.col("mean"), "k")).alias("mean"), F.min_by(row, F.struct("std", "k")).alias("steady"))
    return best.select(F.explode(F.array(*[F.struct(F.lit(n).alias("anchor"), F.col(n).alias("r")) for n in ("worst", "mean", "steady")])).alias("x")).select("x.anchor", "x.r.*")


@catalogue.add("""WITH s AS (SELECT source, count(*) AS size FROM documents GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY size DESC, source) AS i, count(*) OVER () AS n FROM s) SELECT CASE WHEN i = 1 THEN 'largest' WHEN i = (n + 1) // 2 THEN 'median' ELSE 'smallest' END AS role, source, size FROM r WHERE i IN (1, (n + 1) // 2, n)""")
def exemplar_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.exemplars(table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("size")), "source", "size")


@catalogue.add(f"""WITH {DISTANCES}, c AS (SELECT q, lq, round(sum(d), 6) AS cost FROM d WHERE lq = ln GROUP BY 1, 2), m AS (SELECT lq AS cluster, arg_min(q, (cost, q)) AS medoid FROM c GROUP BY 1), n AS (SELECT cluster, medoid, n AS member, round(d, 6) AS distance FROM m JOIN d ON q = medoid AND ln = cluster),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY distance, member) AS i, count(*) OVER (PARTITION BY cluster) AS k FROM n) SELECT cluster, medoid, CASE WHEN i = 1 THEN 'nearest' WHEN i = k THEN 'farthest' ELSE 'middle' END AS role, member, distance FROM r WHERE i IN (1, (k + 1) // 2, k)""")
def exemplar_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cluster's medoid with its nearest, middle and farthest member."""
    from tidemark.functions.vectors import euclidean

    rows = vectors(spark, sf_dir, "label")
    medoid = S.medoids(S.distance_sums(rows, "label")).select("cluster", "medoid")
    centre = medoid.join(rows.select(F.col("id").alias("medoid"), F.col("v").alias("c")), "medoid")
    near = rows.join(F.broadcast(centre), F.col("label") == F.col("cluster")).where("id <> medoid")  # one row a cluster
    near = near.select("cluster", "medoid", F.col("id").alias("member"), F.round(euclidean(F.col("v"), F.col("c")), 6).alias("distance"))
    w = Window.partitionBy("cluster")
    placed = near.withColumns({"i": F.row_number().over(w.orderBy("distance", "member")), "k": F.count("*").over(w)})
    middle = F.floor((F.col("k") + 1) / 2)
    role = F.when(F.col("i") == 1, "nearest").when(F.col("i") == F.col("k"), "farthest").otherwise("middle")
    return placed.where((F.col("i") == 1) | (F.col("i") == middle) | (F.col("i") == F.col("k"))).select("cluster", "medoid", role.alias("role"), "member", "distance")


@catalogue.add("""WITH g AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings) SELECT CASE WHEN label = 0 THEN 'noise' ELSE 'representative' END AS kind, label, vec_id FROM g WHERE i <= CASE WHEN label = 0 THEN 5 ELSE 2 END""")
def gallery_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first members of each cluster, and a few more of the noise."""
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id").withColumn("i", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")))
    most = F.when(F.col("label") == 0, 5).otherwise(2)
    return rows.where(F.col("i") <= most).select(F.when(F.col("label") == 0, "noise").otherwise("representative").alias("kind"), "label", "vec_id")


@catalogue.add(f"""WITH {BOTH} SELECT q AS a, n AS b, c AS score FROM s WHERE q < n ORDER BY c DESC, q, n LIMIT 1""")
def closest_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar pair of all, ties to the smaller ids."""
    rows = vectors(spark, sf_dir)
    best = S.top_k(rows, rows, 1).where("query < neighbor")
    return best.orderBy(F.desc("score"), "query", "neighbor").limit(1).select(F.col("query").alias("a"), F.col("neighbor").alias("b"), "score")


CLASSES = {"A": "accepted", "N": "none", "R": "returned"}


@catalogue.add("""SELECT coalesce(CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'N' THEN 'none' WHEN 'R' THEN 'returned' END, 'unknown') AS class_name, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def class_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(A.looked_up(F.col("l_returnflag"), CLASSES).alias("class_name"), "l_linestatus").agg(F.count("*").alias("n"))


@catalogue.add("""WITH b AS (SELECT l_orderkey, l_linenumber, l_discount + 0.45 AS x, l_tax + 0.4 AS y, l_quantity / 50 AS w, l_tax + 0.01 AS h FROM lineitem) SELECT l_orderkey, l_linenumber, round((x - w / 2) * 640, 6) AS x1, round((y - h / 2) * 512, 6) AS y1, round((x + w / 2) * 640, 6) AS x2, round((y + h / 2) * 512, 6) AS y2 FROM b""")
def projected_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalized boxes as pixel corners of a 640 x 512 image."""
    box = A.corners(F.col("l_discount") + 0.45, F.col("l_tax") + 0.4, F.col("l_quantity") / 50, F.col("l_tax") + 0.01, F.lit(640), F.lit(512))
    got = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", box.alias("c")).select("l_orderkey", "l_linenumber", "c.*")
    return got.withColumns({c: F.round(c, 6) for c in ("x1", "y1", "x2", "y2")})


@catalogue.add(f"""WITH {OCC}, c AS (SELECT content_id, bit_or(bit) AS m FROM occ GROUP BY 1) SELECT CASE m WHEN 1 THEN 'train' WHEN 2 THEN 'val' WHEN 4 THEN 'test' WHEN 3 THEN 'train|val' WHEN 5 THEN 'train|test' WHEN 6 THEN 'val|test' ELSE 'train|val|test' END AS category, count(*) AS contents FROM c GROUP BY 1""")
def split_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = C.identities(occurrences(spark, sf_dir), "content_id", "doc_id", "split")
    return one.groupBy(C.split_names(F.col("mask")).alias("category")).agg(F.count("*").alias("contents"))


@catalogue.add("""SELECT label, count(*) AS points, round(min(embedding[1]), 6) AS x_least, round(max(embedding[1]), 6) AS x_most, round(avg(embedding[2]::DOUBLE), 6) AS y_mean FROM embeddings GROUP BY 1""")
def layout_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored coordinates bound to their points by id, and each cluster's extent."""
    rows = table(spark, sf_dir, "embeddings")
    layout = rows.select("vec_id", F.element_at("embedding", 1).alias("x"), F.element_at("embedding", 2).cast("double").alias("y"))
    both = A.bind(rows.select("vec_id", "label"), layout, ["vec_id"])
    return both.groupBy("label").agg(F.count("*").alias("points"), F.round(F.min("x"), 6).alias("x_least"), F.round(F.max("x"), 6).alias("x_most"), F.round(F.avg("y"), 6).alias("y_mean"))


@catalogue.add("""WITH v AS (SELECT s_name, sha256('suppliers' || chr(31) || s_name || chr(31) || n_name) AS id FROM supplier JOIN nation ON n_nationkey = s_nationkey) SELECT s_name, 'variant_' || substr(id, 1, 16) AS variant_id, count(*) OVER (PARTITION BY id) = 1 AS valid FROM v""")
def variant_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared variants: an identity from the parent, the name and the definition, which no other has."""
    known = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    named = known.select("s_name", C.stable_id(F.lit("suppliers"), F.col("s_name"), F.col("n_name")).alias("id"))
    alone = F.count("*").over(Window.partitionBy("id")) == 1
    return named.select("s_name", F.concat(F.lit("variant_"), F.substring("id", 1, 16)).alias("variant_id"), alone.alias("valid"))


@catalogue.add(f"""WITH {OCC} SELECT split, count(*) AS records, round(count(*) / (SELECT count(*) FROM occ), 6) AS target, count(DISTINCT content_id) AS contents FROM occ GROUP BY 1""")
def historical_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that a historical split had, as targets of a new one."""
    occ = occurrences(spark, sf_dir)
    own = occ.groupBy("split").agg(F.count("*").alias("records"), F.countDistinct("content_id").alias("contents"))
    total = own.agg(F.sum("records").alias("t"))
    return own.crossJoin(total).select("split", "records", F.round(F.col("records") / F.col("t"), 6).alias("target"), "contents")  # a single row


@catalogue.add(f"""WITH {RUNS_OF}, a AS (SELECT arm, outer_seed, avg(map50) AS m, avg(recall) AS r FROM r GROUP BY 1, 2), b AS (SELECT outer_seed, m AS bm, r AS br FROM a WHERE arm = 'N')
SELECT arm, count(*) AS seeds, count(*) FILTER (WHERE m >= bm) AS better, bool_and(abs(r - br) <= 0.01) AS comparable, count(*) FILTER (WHERE m >= bm) * 2 >= count(*) AND bool_and(abs(r - br) <= 0.01) AS eligible FROM a JOIN b USING (outer_seed) WHERE arm <> 'N' GROUP BY 1""")
def eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which arms may go on: against the baseline of the same seed, better in half of the seeds and comparable in all."""
    own = seeded_runs(spark, sf_dir).groupBy("arm", "outer_seed").agg(F.avg("map50").alias("m"), F.avg("recall").alias("r"))
    base = own.where("arm = 'N'").select("outer_seed", F.col("m").alias("bm"), F.col("r").alias("br"))
    better, near = F.col("m") >= F.col("bm"), F.abs(F.col("r") - F.col("br")) <= 0.01
    got = own.where("arm <> 'N'").join(base, "outer_seed").groupBy("arm").agg(F.count("*").alias("seeds"), F.count_if(better).alias("better"), F.every(near).alias("comparable"))
    return got.withColumn("eligible", (F.col("better") * 2 >= F.col("seeds")) & F.col("comparable"))


@catalogue.add("""WITH e AS (SELECT s, l FROM (SELECT DISTINCT l_shipmode AS s FROM (SELECT l_returnflag AS l_shipmode FROM lineitem)), (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS l)), o AS (SELECT l_returnflag AS s, l_linenumber AS l, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT coalesce(e.s, o.s) AS arm, coalesce(e.l, o.l) AS seed, coalesce(n, 0) AS n, CASE WHEN e.s IS NULL THEN 'unexpected' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' ELSE 'complete' END AS status FROM e FULL OUTER JOIN o ON e.s = o.s AND e.l = o.l""")
def run_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An expected grid of runs against the observed ones."""
    seen = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("arm"), F.col("l_linenumber").alias("seed"))
    return N.matched_runs(N.experiment_matrix(seen.select("arm").distinct(), list(range(1, 9))), seen, ["arm", "seed"])


@catalogue.add("""WITH r AS (SELECT d.doc_id, lang, quality, toxic, n_chars FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) SELECT 'known_decision' AS rule, count(*) FILTER (WHERE quality IS NOT NULL AND quality NOT IN (0, 1)) AS violations FROM r UNION ALL SELECT 'both_or_none', count(*) FILTER (WHERE (quality IS NULL) <> (toxic IS NULL)) FROM r
UNION ALL SELECT 'toxic_is_low', count(*) FILTER (WHERE toxic = 1 AND quality = 1) FROM r UNION ALL SELECT 'one_group', (SELECT count(*) FROM (SELECT doc_id FROM labels GROUP BY 1 HAVING count(*) > 1)) UNION ALL SELECT 'decided', count(*) FILTER (WHERE quality IS NULL) FROM r""")
def review_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that a review's decisions must keep, with how often they don't."""
    labels = table(spark, sf_dir, "labels")
    rows = table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left")
    q, t = F.col("quality"), F.col("toxic")
    rules = {"known_decision": q.isNull() | q.isin(0, 1), "both_or_none": q.isNull() == t.isNull(), "toxic_is_low": F.coalesce(~((t == 1) & (q == 1)), F.lit(True)), "decided": q.isNotNull()}
    twice = labels.groupBy("doc_id").count().agg(F.count_if(F.col("count") > 1).alias("violations")).select(F.lit("one_group").alias("rule"), "violations")
    return C.violations(rows, rules).withColumn("violations", F.col("violations").cast("long")).unionByName(twice)


@catalogue.add("""WITH o AS (SELECT 'document' AS family, CAST(doc_id AS VARCHAR) AS frame, sha256(text) AS content FROM documents UNION ALL SELECT 'page', 'p' || page_id, sha256(html) FROM pages), f AS (SELECT frame, count(*) AS n FROM o GROUP BY 1) SELECT family, count(*) AS occurrences, count(DISTINCT content) AS contents, count(*) FILTER (WHERE n > 1) AS conflicts FROM o JOIN f USING (frame) GROUP BY 1""")
def occurrence_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of two families under one schema; no id may be in both."""
    docs = table(spark, sf_dir, "documents").select(F.lit("document").alias("family"), F.col("doc_id").cast("string").alias("frame"), C.content_id("text").alias("content"))
    pages = table(spark, sf_dir, "pages").select(F.lit("page").alias("family"), F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("frame"), C.content_id("html").alias("content"))
    both = docs.unionByName(pages)
    known = both.join(both.groupBy("frame").agg(F.count("*").alias("n")), "frame")
    return known.groupBy("family").agg(F.count("*").alias("occurrences"), F.countDistinct("content").alias("contents"), F.count_if(F.col("n") > 1).alias("conflicts"))


@catalogue.add("""SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""")
def absent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that provably have no urgent order."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(urgent, "c_custkey", "left_anti")


@catalogue.add(f"""WITH {OCC}, m AS (SELECT content_id, min(doc_id) AS q, list_sort(list({{'doc_id': doc_id, 'lang': lang, 'split': split}})) AS e, count(*) AS n FROM occ GROUP BY 1) SELECT q AS query, n, CAST(to_json(e) AS VARCHAR) AS evidence FROM m WHERE n > 1""")
def nested_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review query's evidence as one nested document."""
    nested = F.array_sort(F.collect_list(F.struct("doc_id", "lang", "split")))
    own = occurrences(spark, sf_dir).groupBy("content_id").agg(F.min("doc_id").alias("query"), F.count("*").alias("n"), nested.alias("e")).where("n > 1")
    return own.select("query", "n", F.to_json("e").alias("evidence"))


@catalogue.add("""WITH s AS (SELECT user_id % 4 AS shard, user_id, count(*) AS n FROM events GROUP BY 1, 2) SELECT shard, count(*) AS users, CAST(sum(n) AS BIGINT) AS events, (SELECT count(DISTINCT user_id) FROM events) AS expected, sum(count(*)) OVER () = (SELECT count(DISTINCT user_id) FROM events) AS complete FROM s GROUP BY 1""")
def merged_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards computed apart and united: together they must cover every key once."""
    events = table(spark, sf_dir, "events")
    shards = [events.where(F.col("user_id") % 4 == i).groupBy("user_id").agg(F.count("*").alias("n")).withColumn("shard", F.lit(i).cast("long")) for i in range(4)]
    merged = shards[0].unionByName(shards[1]).unionByName(shards[2]).unionByName(shards[3])
    report = A.binding(merged, events.select("user_id").distinct(), ["user_id"]).select(F.col("n_right").alias("expected"), F.col("bound").alias("complete"))
    return merged.groupBy("shard").agg(F.count("*").alias("users"), F.sum("n").alias("events")).crossJoin(report)  # a single row


@catalogue.add(f"""WITH {TIMED}, z AS (SELECT user_id, pos FROM t WHERE event_type = 'error'), r AS (SELECT user_id, pos FROM t WHERE value > 100) SELECT coalesce(z.user_id, r.user_id) AS user_id, count(z.pos) AS zone, count(r.pos) AS regions, count(*) FILTER (WHERE z.pos IS NULL OR r.pos IS NULL) AS differing FROM z FULL OUTER JOIN r ON z.user_id = r.user_id AND z.pos = r.pos GROUP BY 1""")
def zone_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a timeline's zone is the union of its supported regions, position by position."""
    t = timed(spark, sf_dir).select("user_id", "pos", "event_type", "value")
    z, r = t.where("event_type = 'error'").select("user_id", "pos", F.lit(1).alias("z")), t.where("value > 100").select("user_id", "pos", F.lit(1).alias("r"))
    return z.join(r, ["user_id", "pos"], "full_outer").groupBy("user_id").agg(F.count("z").alias("zone"), F.count("r").alias("regions"), F.count_if(F.col("z").isNull() | F.col("r").isNull()).alias("differing"))


@catalogue.add("""SELECT user_id, count(*) AS epochs, min(k) AS first, max(k) AS last, count(DISTINCT k) AS distinct_epochs, count(*) = count(k) AS complete FROM (SELECT user_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events) GROUP BY 1""")
def parsed_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories parsed from text with an explicit schema; a row that doesn't parse makes its history incomplete."""
    rows = table(spark, sf_dir, "events").select("user_id", F.from_json("props", "k int").alias("p")).select("user_id", "p.k")
    return rows.groupBy("user_id").agg(F.count("*").alias("epochs"), F.min("k").alias("first"), F.max("k").alias("last"), F.countDistinct("k").alias("distinct_epochs"), (F.count("*") == F.count("k")).alias("complete"))


@catalogue.add(f"""WITH {BOTH}, r AS (SELECT q, lq, n, c, row_number() OVER (PARTITION BY q ORDER BY c DESC, n) AS i FROM s) SELECT 0 AS missing, count(*) FILTER (WHERE lq = 4 AND i = 3) AS extra, count(*) FILTER (WHERE lq = 3 AND i = 1) AS changed, false AS verified FROM r WHERE i <= 3""")
def verify_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored neighbour table, with planted faults, against a recomputation in other blocks: ranks that lack and scores that differ."""
    rows = vectors(spark, sf_dir)
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query"), "label")
    faulty = S.top_k(rows, rows, 3).join(labels, "query").where("not (label = 4 and rank = 3)")
    kept = stored(faulty.withColumn("score", F.col("score") + F.when((F.col("label") == 3) & (F.col("rank") == 1), 0.5).otherwise(0.0)), "neighbors")
    return A.replay(kept, S.top_k(rows, rows, 3, block=300), ["query", "rank"], ["neighbor", "score"], 6)


@catalogue.add("""SELECT count(*) FILTER (WHERE event_type = 'missing') AS missing, 0 AS extra, count(*) FILTER (WHERE event_type = 'click') AS changed, false AS verified FROM (SELECT DISTINCT event_type, user_id FROM events)""")
def verify_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored summaries, one type's changed, against the events that they came from."""
    own = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    kept = stored(own.withColumn("n", F.col("n") + F.when(F.col("event_type") == "click", 1).otherwise(0)), "summaries")
    return A.replay(kept, own, ["event_type", "user_id"], ["n", "mean"])


@catalogue.add("""SELECT 0 AS missing, 0 AS extra, 0 AS changed, count(*) >= 0 AS verified FROM orders""")
def verify_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored split of customers, made again from its seed."""
    units = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("g")).agg(F.count("*").alias("n"))
    again = lambda df: P.random_assignment(df, "g", "n", {"train": 0.7, "val": 0.1, "test": 0.2}, 7)
    return A.replay(stored(again(units), "assignments"), again(units.repartition(3)), ["g"], ["n", "split"])


@catalogue.add("""SELECT count(*) FILTER (WHERE url LIKE '%/es/%') AS missing, count(*) FILTER (WHERE url LIKE '%/de/%') AS extra, count(*) FILTER (WHERE url LIKE '%/fr/%') AS changed, count(*) FILTER (WHERE url LIKE '%/es/%' OR url LIKE '%/de/%' OR url LIKE '%/fr/%') = 0 AS verified FROM pages""")
def verify_receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A receipt's checksums against the files that are there: gone, new and changed ones."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    receipt = pages.where("url not like '%/de/%'").select("page_id", F.sha2("html", 256).alias("sha256"))
    there = pages.where("url not like '%/es/%'").select("page_id", F.sha2(F.when(F.col("url").like("%/fr/%"), F.concat("html", F.lit("!"))).otherwise(F.col("html")), 256).alias("sha256"))
    return A.replay(receipt, there, ["page_id"], ["sha256"])
