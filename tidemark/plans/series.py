"""Queries on ordered events, intervals, splits, reviews and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import contents as C
from tidemark.operators import evaluation as E
from tidemark.operators import graph as G
from tidemark.operators import joins as J
from tidemark.operators import review as R
from tidemark.operators import series as S
from tidemark.operators import splits as P
from tidemark.plans.base import Catalogue, table
from tidemark.plans.contents import OCC, occurrences

catalogue = Catalogue()
TIMED = "t AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1000000.0 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)"
BIT = "CASE WHEN event_id % 10 = 0 THEN 2 WHEN event_id % 10 IN (1, 2) THEN 4 ELSE 1 END"


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as timelines by user: seconds, and positions from 0."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") / 1000000.0
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", seconds.alias("s"), (F.row_number().over(w) - 1).alias("pos"))


def with_split(df: DataFrame) -> DataFrame:
    return df.withColumn("split", F.when(F.col("event_id") % 10 == 0, "val").when((F.col("event_id") % 10).isin(1, 2), "test").otherwise("train"))


@catalogue.add(f"""WITH {TIMED} SELECT a.event_id AS a, b.event_id AS b, round(b.s - a.s, 6) AS gap FROM t a JOIN t b ON a.user_id = b.user_id AND abs(b.s - a.s) <= 600 AND a.event_id < b.event_id AND {BIT.replace('event_id', 'a.event_id')} <> {BIT.replace('event_id', 'b.event_id')}""")
def temporal_band_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = with_split(timed(spark, sf_dir))
    a = t.select("user_id", F.col("event_id").alias("a"), F.col("s").alias("p"), F.col("split").alias("x"))
    b = t.select("user_id", F.col("event_id").alias("b"), F.col("s").alias("q"), F.col("split").alias("y"))
    return J.band_join(a, b, ["user_id"], "p", "q", 600.0).where("a < b and x <> y").select("a", "b", F.round(F.col("q") - F.col("p"), 6).alias("gap"))


@catalogue.add(f"""WITH {OCC} SELECT a.content_id AS a, b.content_id AS b, count(DISTINCT a.source) AS sources, min(abs(a.doc_id - b.doc_id)) AS min_gap FROM occ a JOIN occ b ON a.source = b.source AND a.content_id < b.content_id AND abs(a.doc_id - b.doc_id) <= 20 GROUP BY 1, 2""")
def min_gap_same_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    occ = occurrences(spark, sf_dir)
    a = occ.select("source", F.col("content_id").alias("a"), F.col("doc_id").alias("p"))
    b = occ.select("source", F.col("content_id").alias("b"), F.col("doc_id").alias("q"))
    near = J.band_join(a, b, ["source"], "p", "q", 20.0).where("a < b")
    return near.groupBy("a", "b").agg(F.countDistinct("source").alias("sources"), F.min(F.abs(F.col("p") - F.col("q"))).alias("min_gap"))


RUNS = f"""{TIMED}, m AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS new FROM t WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY pos) AS run FROM m), e AS (SELECT user_id, CAST(run AS BIGINT) AS run, event_type, min(pos) AS start, max(pos) AS "end", count(*) AS length FROM r GROUP BY 1, 2, 3)"""


@catalogue.add(f"""WITH {RUNS} SELECT * FROM e""")
def rle_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.runs(timed(spark, sf_dir), ["user_id"], ["pos"], "event_type")


@catalogue.add(f"""WITH {RUNS}, x AS (SELECT *, lag(event_type) OVER w AS p, coalesce(lag(event_type, 2) OVER w = event_type, false) AS back FROM e WINDOW w AS (PARTITION BY user_id ORDER BY run))
SELECT p AS previous, event_type, count(*) AS transitions, count(*) FILTER (WHERE back) AS returns FROM x WHERE p IS NOT NULL GROUP BY 1, 2""")
def rle_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = S.transitions(S.runs(timed(spark, sf_dir), ["user_id"], ["pos"], "event_type"), ["user_id"], "event_type")
    return got.where("previous is not null").groupBy("previous", "event_type").agg(F.count("*").alias("transitions"), F.count_if("returned").alias("returns"))


@catalogue.add("""WITH t AS (SELECT conv_id, turn, role, lag(role) OVER w AS p, lag(role, 2) OVER w AS pp FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE role = pp AND role <> p) AS returns FROM t GROUP BY 1""")
def returns_aba(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations").select("conv_id", "role", F.lag("role").over(w).alias("p"), F.lag("role", 2).over(w).alias("pp"))
    return t.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if((F.col("role") == F.col("pp")) & (F.col("role") != F.col("p"))).alias("returns"))


ISLANDS = f"""{TIMED}, g AS (SELECT *, CASE WHEN s - lag(s) OVER w > 3600 OR lag(s) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM t WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)),
i AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY s, event_id) AS BIGINT) AS island FROM g)"""


@catalogue.add(f"""WITH {ISLANDS} SELECT user_id, island, count(*) AS n, round(min(s), 6) AS start, round(max(s), 6) AS "end", round(max(value), 6) AS best FROM i GROUP BY 1, 2""")
def gap_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = S.gap_islands(timed(spark, sf_dir), ["user_id"], "s", 3600.0, "event_id")
    return got.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.round(F.min("s"), 6).alias("start"), F.round(F.max("s"), 6).alias("end"), F.round(F.max("value"), 6).alias("best"))


@catalogue.add(f"""WITH {ISLANDS}, p AS (SELECT user_id, island, count(*) AS n, min(s) AS a, max(s) AS z, max(value) AS score, arg_max(s, (value, -s)) AS peak FROM i GROUP BY 1, 2)
SELECT user_id, island, n, round(a, 3) AS start, round(z, 3) AS "end", round(peak, 3) AS peak, round(score, 6) AS score, round(coalesce((lag(peak) OVER w + peak) / 2, a), 3) AS search_from, round(coalesce((lead(peak) OVER w + peak) / 2, z), 3) AS search_to FROM p WINDOW w AS (PARTITION BY user_id ORDER BY island)""")
def localized_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = S.peaks(timed(spark, sf_dir), ["user_id"], "s", "value", 3600.0)
    return got.withColumns({c: F.round(c, 3) for c in ("start", "end", "peak", "search_from", "search_to")}).withColumn("score", F.round("score", 6))


@catalogue.add(f"""WITH {ISLANDS}, p AS (SELECT user_id, island AS segment, event_id, floor((row_number() OVER (PARTITION BY user_id, island ORDER BY s) - 1) / 4) AS page FROM i)
SELECT user_id, segment, CAST(page AS BIGINT) AS page, count(*) AS n, min(event_id) AS first FROM p GROUP BY 1, 2, 3""")
def preview_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pages(timed(spark, sf_dir), ["user_id"], "s", 3600.0, 4).groupBy("user_id", "segment", "page").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@catalogue.add("""SELECT event_id, round((rank() OVER (PARTITION BY event_type ORDER BY round(value, 12)) + (count(*) OVER (PARTITION BY event_type, round(value, 12)) - 1) / 2.0) / count(value) OVER (PARTITION BY event_type), 8) AS percentile FROM events""")
def avg_rank_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = S.percentiles(table(spark, sf_dir, "events"), "value", ["event_type"], "percentile")
    return got.select("event_id", F.round("percentile", 8).alias("percentile"))


@catalogue.add(f"""WITH {TIMED}, n AS (SELECT a.event_id, a.value, list_sort(list(b.value)) AS xs FROM t a LEFT JOIN t b ON a.user_id = b.user_id AND b.pos BETWEEN a.pos - 4 AND a.pos + 4 AND b.pos <> a.pos GROUP BY 1, 2),
m AS (SELECT *, list_median(list_filter(xs, lambda x: x IS NOT NULL)) AS med FROM n), d AS (SELECT *, list_median(list_transform(list_filter(xs, lambda x: x IS NOT NULL), lambda x: abs(x - med))) AS mad FROM m)
SELECT event_id, round(med, 6) AS median, round(mad, 6) AS mad, round(CASE WHEN mad > 0 THEN (value - med) / (mad * 1.4826) END, 5) AS z FROM d""")
def local_median_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = S.local_baseline(timed(spark, sf_dir), ["user_id"], ["pos"], "value", 4)
    return got.select("event_id", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"), F.round("z", 5).alias("z"))


@catalogue.add(f"""WITH {TIMED}, x AS (SELECT DISTINCT user_id, pos // 3 AS p FROM t WHERE event_type <> 'click'), g AS (SELECT *, lag(p) OVER (PARTITION BY user_id ORDER BY p) AS q FROM x)
SELECT user_id, CAST(q + 1 AS BIGINT) AS first, CAST(p - 1 AS BIGINT) AS last, CAST(p - q - 1 AS BIGINT) AS missing FROM g WHERE p - q > 1""")
def missing_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timed(spark, sf_dir).where("event_type <> 'click'").select("user_id", F.floor(F.col("pos") / 3).alias("p"))
    return S.missing_ranges(rows, ["user_id"], "p")


@catalogue.add(f"""WITH {TIMED}, x AS (SELECT user_id, pos, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS g FROM t WHERE event_type <> 'error'), r AS (SELECT user_id, min(pos) AS a, max(pos) AS z FROM x GROUP BY user_id, g HAVING count(*) >= 6)
SELECT user_id, min(a) AS start, arg_min(z, a) AS "end" FROM r GROUP BY 1""")
def first_long_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.first_long_run(timed(spark, sf_dir).where("event_type <> 'error'"), ["user_id"], "pos", 6)


@catalogue.add(f"""WITH {TIMED} SELECT user_id, min(pos) AS first, max(pos) AS last, count(*) AS n, count(DISTINCT event_type) AS kinds FROM t GROUP BY 1""")
def temporal_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timed(spark, sf_dir).groupBy("user_id").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("n"), F.countDistinct("event_type").alias("kinds"))


ZONES = f"{TIMED}, z AS (SELECT user_id, pos AS a, pos + 3 AS b, event_id FROM t WHERE event_type = 'error')"


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timed(spark, sf_dir).where("event_type = 'error'")
    return rows.select("user_id", F.col("pos").alias("a"), (F.col("pos") + 3).alias("b"), F.col("event_id").alias("zone"))


@catalogue.add(f"""WITH {ZONES}, h AS (SELECT t.user_id, t.pos, count(z.event_id) AS n_intervals, min(z.event_id) AS v FROM t LEFT JOIN z ON z.user_id = t.user_id AND t.pos BETWEEN z.a AND z.b GROUP BY 1, 2)
SELECT user_id, pos, n_intervals, CASE WHEN n_intervals = 1 THEN v END AS zone, CASE n_intervals WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'several' END AS status FROM h""")
def interval_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.exactly_one(timed(spark, sf_dir), zones(spark, sf_dir), ["user_id"], "pos", "a", "b", "zone", 4.0)


@catalogue.add(f"""WITH {ZONES}, c AS (SELECT user_id, pos AS a, pos + 1 AS b, event_id AS c FROM t WHERE event_type = 'purchase'), h AS (SELECT c.c, z.event_id AS e FROM c JOIN z ON c.user_id = z.user_id AND c.a - 1 <= z.b AND c.b + 1 >= z.a)
SELECT (SELECT count(*) FROM z) AS zones, (SELECT count(*) FROM c) AS candidates, count(DISTINCT e) AS zones_found, count(DISTINCT c) AS candidates_hit FROM h""")
def interval_overlap_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = timed(spark, sf_dir).where("event_type = 'purchase'").select("user_id", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"))
    real = zones(spark, sf_dir).select("user_id", F.col("a").alias("start"), F.col("b").alias("end"))
    return S.overlap_recall(found, real, ["user_id"], 1.0)


@catalogue.add(f"""WITH {ZONES}, x AS (SELECT DISTINCT user_id, unnest(generate_series(a, b)) AS p FROM z), y AS (SELECT DISTINCT user_id, unnest(generate_series(pos, pos + 2)) AS p FROM t WHERE event_type = 'purchase')
SELECT coalesce(x.user_id, y.user_id) AS user_id, count(*) FILTER (WHERE x.p IS NOT NULL AND y.p IS NOT NULL) AS shared, count(*) AS "union", round(count(*) FILTER (WHERE x.p IS NOT NULL AND y.p IS NOT NULL) / count(*), 6) AS jaccard
FROM x FULL OUTER JOIN y ON x.user_id = y.user_id AND x.p = y.p GROUP BY 1""")
def interval_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = zones(spark, sf_dir).select("user_id", F.col("a").alias("start"), F.col("b").alias("end"))
    b = timed(spark, sf_dir).where("event_type = 'purchase'").select("user_id", F.col("pos").alias("start"), (F.col("pos") + 2).alias("end"))
    return S.set_jaccard(S.position_sets(a, ["user_id"]), S.position_sets(b, ["user_id"]), ["user_id"]).withColumn("shared", F.col("shared").cast("long"))


@catalogue.add(f"""WITH {TIMED}, c AS (SELECT user_id, event_id AS centre, s FROM t WHERE event_type = 'signup') SELECT centre, t.event_id, round(t.s - c.s, 6) AS delta FROM c JOIN t ON c.user_id = t.user_id AND abs(t.s - c.s) <= 7200.000000001""")
def context_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = timed(spark, sf_dir)
    centres = t.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("centre"), F.col("s").alias("c"))
    near = J.band_join(centres, t.select("user_id", "event_id", "s"), ["user_id"], "c", "s", 7200.000000001)
    return near.select("centre", "event_id", F.round(F.col("s") - F.col("c"), 6).alias("delta"))


@catalogue.add(f"""WITH m AS (SELECT user_id, bit_or({BIT}) AS m FROM events GROUP BY 1) SELECT CAST(bit_count(m) AS INT) AS splits, count(*) AS keys FROM m GROUP BY 1""")
def sequence_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.split_counts(with_split(table(spark, sf_dir, "events")), "user_id", "split")


@catalogue.add(f"""WITH {TIMED}, p AS (SELECT abs(a.pos - b.pos) AS d, {BIT.replace('event_id', 'a.event_id')} <> {BIT.replace('event_id', 'b.event_id')} AS x FROM t a JOIN t b ON a.user_id = b.user_id AND a.event_id < b.event_id AND abs(a.pos - b.pos) <= 10)
SELECT CAST(r AS DOUBLE) AS reach, count(*) AS pairs, count(*) FILTER (WHERE x) AS crossing, round(count(*) FILTER (WHERE x) / count(*), 6) AS share FROM p, (SELECT unnest([1, 5, 10]) AS r) WHERE d <= r GROUP BY 1""")
def temporal_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.temporal_crossing(with_split(timed(spark, sf_dir)), ["user_id"], "pos", "split", "event_id", [1, 5, 10])


RATIOS = {"train": 0.7, "val": 0.1, "test": 0.2}
UNITS = "u AS (SELECT o_custkey AS g, count(*) AS n FROM orders GROUP BY 1), h AS (SELECT *, sha256('7:' || g) AS h FROM u), c AS (SELECT *, sum(n) OVER (ORDER BY h, g) AS e, sum(n) OVER () AS t FROM h)"


@catalogue.add(f"""WITH {UNITS}, a AS (SELECT e FROM c ORDER BY abs(e - 0.7 * t), e LIMIT 1), b AS (SELECT e FROM c ORDER BY abs(e - (0.7 + 0.1) * t), e LIMIT 1)
SELECT g, n, CASE WHEN c.e <= a.e THEN 'train' WHEN c.e <= b.e THEN 'val' ELSE 'test' END AS split FROM c, a, b""")
def random_group_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("g")).agg(F.count("*").alias("n"))
    return P.random_assignment(units, "g", "n", RATIOS, 7)


@catalogue.add()
def balanced_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers to splits as whole groups, by order counts in steps and priorities: the deviation of each measure."""
    wide = P.crosstab(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", ["F", "O", "P"])
    measures = ["class_F", "class_O", "class_P"]
    plan, objective = P.profile_assignment(wide, "o_custkey", measures, RATIOS, 7)
    done = P.apply_profiles(wide, "o_custkey", measures, plan, 7)
    return done.groupBy("split").agg(F.count("*").alias("groups"), *[F.sum(m).alias(m) for m in measures]).withColumn("objective", F.round(F.lit(objective), 6))


@catalogue.add("""WITH r AS (SELECT CASE WHEN l_orderkey % 10 = 0 THEN 'val' WHEN l_orderkey % 10 IN (1, 2) THEN 'test' ELSE 'train' END AS split, l_returnflag || l_linestatus AS class, l_orderkey FROM lineitem),
g AS (SELECT s.*, c FROM (SELECT unnest(['train', 'val', 'test']) AS s, unnest([0.7, 0.1, 0.2]) AS target) s, (SELECT unnest(['AF', 'AO', 'NF', 'NO', 'RF', 'RO', 'XX']) AS c)),
x AS (SELECT s AS split, c AS class, CAST(target AS DOUBLE) AS target, count(r.l_orderkey) AS images, count(DISTINCT r.l_orderkey) AS contents FROM g LEFT JOIN r ON r.split = s AND class = c GROUP BY 1, 2, 3), y AS (SELECT *, sum(images) OVER (PARTITION BY class) AS t FROM x)
SELECT split, class, images, contents, CASE WHEN t > 0 THEN round(images / t, 6) END AS share, target, CASE WHEN t > 0 THEN round((images / t - target) * 100, 6) END AS deviation_pp FROM y""")
def split_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.when(F.col("l_orderkey") % 10 == 0, "val").when((F.col("l_orderkey") % 10).isin(1, 2), "test").otherwise("train")
    rows = table(spark, sf_dir, "lineitem").select(split.alias("split"), F.concat("l_returnflag", "l_linestatus").alias("class"), "l_orderkey")
    return P.balance(rows, "split", "class", "l_orderkey", ["AF", "AO", "NF", "NO", "RF", "RO", "XX"], RATIOS)


@catalogue.add("""SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'A') AS class_A, count(*) FILTER (WHERE l_returnflag = 'N') AS class_N, count(*) FILTER (WHERE l_returnflag = 'R') AS class_R FROM lineitem GROUP BY 1""")
def class_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.crosstab(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", ["A", "N", "R"])


@catalogue.add("""WITH r AS (SELECT o_custkey, o_orderkey, count(l_orderkey) AS items, coalesce(sum(l_quantity), 0) AS quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT 'cluster:' || (o_custkey % 97) AS group_id, count(DISTINCT o_orderkey) AS contents, count(*) AS records, CAST(sum(items) AS BIGINT) AS items, sum(quantity) AS quantity FROM r GROUP BY 1""")
def group_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("items"), F.sum("l_quantity").alias("quantity"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    records = orders.join(items, "o_orderkey", "left").fillna(0, ["items", "quantity"]).select("o_orderkey", "items", "quantity")
    groups = orders.select("o_orderkey", F.concat(F.lit("cluster:"), (F.col("o_custkey") % 97).cast("string")).alias("group_id"))
    return P.group_vectors(records, groups, "o_orderkey", ["items", "quantity"])


@catalogue.add("""WITH c AS (SELECT o_custkey, o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN 'val' WHEN o_custkey % 10 IN (1, 2) THEN 'test' WHEN o_custkey = 5 AND o_orderkey % 2 = 0 THEN 'other' ELSE 'train' END AS split FROM orders),
g AS (SELECT o_custkey, count(DISTINCT split) AS n FROM c GROUP BY 1)
SELECT 'covered' AS rule, 0 AS violations UNION ALL SELECT 'one_split', 0 UNION ALL SELECT 'known_split', (SELECT count(*) FROM c WHERE split = 'other') UNION ALL SELECT 'group_whole', (SELECT count(*) FROM g WHERE n <> 1)""")
def assignment_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_custkey")
    split = F.when(k % 10 == 0, "val").when((k % 10).isin(1, 2), "test").when((k == 5) & (F.col("o_orderkey") % 2 == 0), "other").otherwise("train")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", split.alias("split"))
    return P.invariants(rows, rows, "o_orderkey", "o_custkey").withColumn("violations", F.col("violations").cast("long"))


NEXT = """n AS (SELECT a, b, p.quality <> q.quality AS no FROM (SELECT doc_id AS a, lead(doc_id) OVER (PARTITION BY lang, source, n_chars // 500 ORDER BY doc_id) AS b FROM documents) d
LEFT JOIN labels p ON p.doc_id = a LEFT JOIN labels q ON q.doc_id = b WHERE b IS NOT NULL)"""


def labelled_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document pairs with states, from all documents: equal contents; neighbours of a language, source and length class are
    confirmed, and those with unlike quality labels are rejected as well."""
    same = G.star_edges(occurrences(spark, sf_dir), "doc_id", "content_id").withColumn("state", F.lit("exact"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.floor(F.col("n_chars") / 500).alias("length"))
    near = docs.select(F.col("doc_id").alias("a"), F.lead("doc_id").over(Window.partitionBy("lang", "source", "length").orderBy("doc_id")).alias("b")).where("b is not null")
    labels = table(spark, sf_dir, "labels")
    p, q = (labels.select(F.col("doc_id").alias(c), F.col("quality").alias(f"q{c}")) for c in "ab")
    no = near.join(p, "a").join(q, "b").where("qa <> qb").select("a", "b", F.lit("rejected").alias("state"))
    return same.unionByName(near.withColumn("state", F.lit("confirmed"))).unionByName(no)


@catalogue.add(f"""WITH RECURSIVE {OCC}, {NEXT}, s AS (SELECT content_id, min(doc_id) AS m FROM occ GROUP BY 1), k AS (SELECT m AS a, doc_id AS b FROM occ JOIN s USING (content_id) WHERE doc_id <> m UNION SELECT a, b FROM n),
e AS (SELECT a, b FROM k EXCEPT SELECT a, b FROM n WHERE no), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w AS (SELECT doc_id AS n, doc_id AS r FROM occ UNION SELECT u.b, w.r FROM w JOIN u ON u.a = w.n), g AS (SELECT n, min(r) AS group_id FROM w GROUP BY 1)
SELECT n AS node, group_id, count(*) OVER (PARTITION BY group_id) AS members FROM g""")
def evidence_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = occurrences(spark, sf_dir).select("doc_id")
    return G.dependency_groups(nodes, labelled_evidence(spark, sf_dir), "doc_id", "a", "b", "state", ["exact", "confirmed"], "rejected")


@catalogue.add("""SELECT lang AS stratum, source AS grp, GROUPING(lang, source) AS grain, count(*) AS total, count(quality) AS decided, round(count(quality) / count(*), 6) AS rate
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((), (lang), (source), (lang, source))""")
def review_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return R.decision_summary(docs.withColumn("decision", F.col("quality").cast("string")), "lang", "source", "decision")


@catalogue.add("""WITH r AS (SELECT doc_id, quality, toxic FROM labels), d AS (SELECT doc_id, CASE WHEN n_chars > 500 THEN 1 - quality END AS quality, CASE WHEN lang = 'en' THEN 1 END AS toxic FROM labels JOIN documents USING (doc_id))
SELECT r.doc_id, 'quality' AS "column", CAST(r.quality AS VARCHAR) AS before, CAST(d.quality AS VARCHAR) AS after FROM r JOIN d USING (doc_id) WHERE d.quality IS NOT NULL AND d.quality IS DISTINCT FROM r.quality
UNION ALL SELECT r.doc_id, 'toxic', CAST(r.toxic AS VARCHAR), CAST(d.toxic AS VARCHAR) FROM r JOIN d USING (doc_id) WHERE d.toxic IS NOT NULL AND d.toxic IS DISTINCT FROM r.toxic""")
def review_upsert_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labels, and decisions on all of them: long texts change their quality, English ones become toxic; blanks change nothing."""
    review = table(spark, sf_dir, "labels")
    known = review.join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    new = known.select("doc_id", F.when(F.col("n_chars") > 500, 1 - F.col("quality")).alias("quality"), F.when(F.col("lang") == "en", 1).alias("toxic"))
    return R.upsert(review, new, "doc_id", ["quality", "toxic"])[1]


@catalogue.add("""WITH e AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations)
SELECT conv_id, max(CASE WHEN i = 1 THEN role END) AS role, count(*) AS events, count(DISTINCT role) > 1 AS conflict FROM e GROUP BY 1""")
def review_first_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_decisions(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], "role")


@catalogue.add("""WITH p AS (SELECT doc_id, quality FROM labels WHERE toxic = 0 UNION ALL SELECT doc_id, CASE WHEN lang = 'fr' THEN 1 - quality ELSE quality END FROM labels JOIN documents USING (doc_id))
SELECT doc_id, count(*) AS revisions, CASE WHEN count(DISTINCT quality) = 1 THEN min(quality) END AS quality, count(DISTINCT quality) > 1 AS conflict FROM p GROUP BY 1""")
def review_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reviewers: one of all labels that aren't toxic, one of all labels who sees French texts the other way."""
    labels = table(spark, sf_dir, "labels")
    second = labels.join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    second = second.select("doc_id", F.when(F.col("lang") == "fr", 1 - F.col("quality")).otherwise(F.col("quality")).alias("quality"), "toxic")
    return R.pool([labels.where("toxic = 0"), second], "doc_id", "quality")


RUNS_OF = "r AS (SELECT l_returnflag AS arm, l_suppkey % 5 AS outer_seed, l_linenumber AS inner_seed, avg(l_quantity) AS map50, avg(l_discount) AS recall FROM lineitem GROUP BY 1, 2, 3)"


def seeded_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by arm and two levels of seeds, with two metrics."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy(F.col("l_returnflag").alias("arm"), (F.col("l_suppkey") % 5).alias("outer_seed"), F.col("l_linenumber").alias("inner_seed")).agg(F.avg("l_quantity").alias("map50"), F.avg("l_discount").alias("recall"))


@catalogue.add(f"""WITH {RUNS_OF}, l AS (SELECT arm, outer_seed, unnest(['map50', 'recall']) AS metric, unnest([map50, recall]) AS v FROM r), a AS (SELECT arm, outer_seed, metric, avg(v) AS v FROM l GROUP BY 1, 2, 3),
b AS (SELECT arm, metric, count(v) AS n, avg(v) AS m, stddev_samp(v) AS s FROM a GROUP BY 1, 2)
SELECT arm, metric, n AS outer_n, round(m, 6) AS mean, round(s, 6) AS std, round(m - (SELECT m FROM b c WHERE c.arm = 'N' AND c.metric = b.metric), 6) AS effect FROM b""")
def hierarchical_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = E.hierarchical(seeded_runs(spark, sf_dir), "arm", "outer_seed", "inner_seed", ["map50", "recall"], "N")
    return got.withColumns({c: F.round(c, 6) for c in ("mean", "std", "effect")})


@catalogue.add(f"""WITH {RUNS_OF}, c AS (SELECT *, map50 - avg(map50) OVER (PARTITION BY arm) AS x, recall - avg(recall) OVER (PARTITION BY arm) AS y FROM r)
SELECT count(*) AS points, round(corr(map50, recall), 6) AS pearson, round(corr(x, y), 6) AS centered FROM c""")
def centered_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = E.centered_correlation(seeded_runs(spark, sf_dir), "arm", "map50", "recall")
    return got.withColumns({c: F.round(c, 6) for c in ("pearson", "centered")})


@catalogue.add("""WITH s AS (SELECT l_suppkey AS k, round(avg(l_quantity), 6) AS q, round(avg(l_discount), 6) AS d, round(avg(l_tax), 6) AS t FROM lineitem GROUP BY 1)
SELECT * FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.q >= a.q AND b.d <= a.d AND b.t <= a.t AND (b.q > a.q OR b.d < a.d OR b.t < a.t))""")
def pareto_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.pareto(candidates(spark, sf_dir), "k", ["q"], ["d", "t"])


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = {"q": "l_quantity", "d": "l_discount", "t": "l_tax"}
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(*[F.round(F.avg(c), 6).alias(n) for n, c in means.items()])


@catalogue.add("""WITH s AS (SELECT l_suppkey AS k, round(avg(l_quantity), 6) AS q, round(avg(l_discount), 6) AS d, round(avg(l_tax), 6) AS t FROM lineitem GROUP BY 1), r AS (SELECT *, k % 4 AS g, (rank() OVER (PARTITION BY k % 4 ORDER BY q DESC) + rank() OVER (PARTITION BY k % 4 ORDER BY d)) / 2.0 AS mean_rank FROM s),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY mean_rank, k) AS place FROM r) SELECT g, k, mean_rank, place FROM p WHERE place <= 3""")
def shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidates(spark, sf_dir).withColumn("g", F.col("k") % 4)
    return E.shortlist(rows, ["g"], "k", ["q"], ["d"], 3).select("g", "k", "mean_rank", "place")


DETECTED = """d AS (SELECT event_type AS c, value AS conf, (event_id * 37) % 1000 / 1000 AS iou, event_id AS i FROM events), u AS (SELECT event_type AS c, count(*) AS support FROM events WHERE (event_id * 37) % 1000 >= 400 GROUP BY 1),
h AS (SELECT range AS t, CAST(0.5 + 0.05 * range AS DECIMAL(3, 2)) AS least FROM range(10)),
r AS (SELECT c, t, support, sum(CASE WHEN iou >= least THEN 1 ELSE 0 END) OVER w AS tp, count(*) OVER w AS n FROM d JOIN u USING (c) CROSS JOIN h WINDOW w AS (PARTITION BY c, t ORDER BY conf DESC, i)),
p AS (SELECT c, t, n AS j, tp / support AS r, tp / n AS p FROM r UNION ALL SELECT c, t, 0, 0, 1 FROM u, h UNION ALL SELECT c, t, 1000000000, 1, 0 FROM u, h),
e AS (SELECT c, t, j, r, max(p) OVER (PARTITION BY c, t ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS e FROM p),
g AS (SELECT c, t, r, min(e) AS here, max(e) AS top FROM e GROUP BY 1, 2, 3), k AS (SELECT *, lead(r) OVER w AS r2, lead(top) OVER w AS e2 FROM g WINDOW w AS (PARTITION BY c, t ORDER BY r)),
x AS (SELECT c, t, range AS i, CASE WHEN range = 100 THEN 1.0::DOUBLE ELSE range * 0.01::DOUBLE END AS x FROM u, h, range(101)),
v AS (SELECT x.c, x.t, i, CASE WHEN r2 IS NULL OR x = r THEN here ELSE here + (e2 - here) * (x - r) / (r2 - r) END AS v FROM x ASOF JOIN k ON x.c = k.c AND x.t = k.t AND x.x >= k.r),
a AS (SELECT c, t, sum(v * CASE WHEN i IN (0, 100) THEN 0.5 ELSE 1 END) * 0.01 AS ap FROM v GROUP BY 1, 2)"""


def detections(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All events as detections by class: value as confidence, an overlap from the id. Support counts the classes' objects."""
    overlap = ((F.col("event_id") * 37) % 1000) / 1000
    found = table(spark, sf_dir, "events").select(F.col("event_type").alias("c"), F.col("value").alias("conf"), overlap.alias("iou"), F.col("event_id").alias("i"))
    return found, found.where("iou >= 0.4").groupBy("c").agg(F.count("*").alias("support"))


@catalogue.add(f"""WITH {DETECTED} SELECT c, support, round(max(CASE WHEN t = 0 THEN ap END), 6) AS map50, round(avg(ap), 6) AS map50_95 FROM a JOIN u USING (c) GROUP BY 1, 2""")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, support = detections(spark, sf_dir)
    got = E.mean_average_precision(found, "c", "conf", "iou", "i", support)
    return got.withColumns({c: F.round(c, 6) for c in ("map50", "map50_95")})


@catalogue.add(f"""WITH {DETECTED}, m AS (SELECT c, max(CASE WHEN t = 0 THEN ap END) AS map50, avg(ap) AS map50_95 FROM a GROUP BY 1)
SELECT count(*) AS classes, round(avg(map50), 6) AS map50, round(avg(map50_95), 6) AS map50_95 FROM m""")
def macro_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean over a fixed set of classes, which is undefined if one of them has no object."""
    found, support = detections(spark, sf_dir)
    got = E.mean_average_precision(found, "c", "conf", "iou", "i", support)
    means = [F.when(F.count(c) == F.count("*"), F.round(F.avg(c), 6)).alias(c) for c in ("map50", "map50_95")]
    return got.agg(F.count("*").alias("classes"), *means)


@catalogue.add()
def bootstrap_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval of each class's average precision over resampled users, whose events are detections."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", (((F.col("event_id") * 37) % 1000) >= 500).alias("hit"))
    targets = rows.where((F.col("event_id") * 37) % 1000 >= 400)
    return E.bootstrap_average_precision(rows, targets, "event_type", "value", "hit", "event_id", "user_id", 20, 0.9, 3)


@catalogue.add()
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.bootstrap(table(spark, sf_dir, "events"), "user_id", "value", ["event_type"], 200, 0.95, 3)


@catalogue.add(f"""WITH {OCC}, a AS (SELECT lang, content_id FROM occ WHERE split <> 'val'), b AS (SELECT lang, content_id FROM occ WHERE split <> 'test')
SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS only_left, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS only_right, false AS equal""")
def table_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of contents, each without another split, compared as multisets."""
    occ = occurrences(spark, sf_dir).select("lang", "content_id", "split")
    return C.equal_tables(occ.where("split <> 'val'").drop("split"), occ.where("split <> 'test'").drop("split"))


@catalogue.add("""SELECT 'positive' AS rule, count(*) FILTER (WHERE NOT coalesce(n_chars > 0, false)) AS violations FROM documents UNION ALL SELECT 'length', count(*) FILTER (WHERE NOT coalesce(length(text) = n_chars, false)) FROM documents
UNION ALL SELECT 'known_lang', count(*) FILTER (WHERE NOT coalesce(lang IN ('en', 'de', 'fr'), false)) FROM documents""")
def rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = C.violations(docs, {"positive": F.col("n_chars") > 0, "length": F.length("text") == F.col("n_chars"), "known_lang": F.col("lang").isin("en", "de", "fr")})
    return got.withColumn("violations", F.col("violations").cast("long"))


