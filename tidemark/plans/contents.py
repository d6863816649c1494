"""Queries on identities, duplicates, paths and labels, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions.stats import distribution
from tidemark.operators import contents as C
from tidemark.operators import joins as J
from tidemark.plans.base import Catalogue, table
from tidemark.storage import cut

catalogue = Catalogue()
SPLIT = "CASE WHEN doc_id % 10 = 0 THEN 'val' WHEN doc_id % 10 IN (1, 2) THEN 'test' ELSE 'train' END"
OCC = f"occ AS (SELECT doc_id, lang, source, sha256(text) AS content_id, {SPLIT} AS split, CASE WHEN doc_id % 10 = 0 THEN 2 WHEN doc_id % 10 IN (1, 2) THEN 4 ELSE 1 END AS bit FROM documents)"


def split_column() -> Column:
    return F.when(F.col("doc_id") % 10 == 0, "val").when((F.col("doc_id") % 10).isin(1, 2), "test").otherwise("train")


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as occurrences: a content is the hash of a text, a split comes from the id."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", "source", C.content_id("text").alias("content_id"), split_column().alias("split"))


@catalogue.add(f"""WITH {OCC} SELECT content_id, count(*) AS occurrences, min(doc_id) AS representative, bit_or(bit) AS mask,
bit_count(bit_or(bit)) AS n_splits, bit_count(bit_or(bit)) > 1 AS crosses FROM occ GROUP BY content_id""")
def content_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.identities(occurrences(spark, sf_dir), "content_id", "doc_id", "split")


@catalogue.add(f"""WITH {OCC} SELECT count(*) AS n_rows, count(DISTINCT content_id) AS contents, count(*) - count(DISTINCT content_id) AS surplus,
(SELECT count(*) FROM (SELECT content_id FROM occ GROUP BY 1 HAVING count(*) > 1)) AS duplicated,
(SELECT count(*) FROM (SELECT content_id FROM occ GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS crossing FROM occ""")
def manifest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = C.identities(occurrences(spark, sf_dir), "content_id", "doc_id", "split")
    n = F.sum("occurrences")
    return one.agg(
        n.alias("n_rows"), F.count("*").alias("contents"), (n - F.count("*")).alias("surplus"),
        F.count_if(F.col("occurrences") > 1).alias("duplicated"), F.count_if("crosses").alias("crossing"),
    )


@catalogue.add(f"""WITH {OCC}, l AS (SELECT occ.*, quality FROM occ LEFT JOIN labels USING (doc_id))
SELECT content_id, count(*) AS occurrences, count(quality) AS labelled, count(DISTINCT quality) AS labels, count(DISTINCT quality) > 1 AS conflict
FROM l GROUP BY content_id HAVING count(*) > 1""")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = J.checked_join(occurrences(spark, sf_dir), table(spark, sf_dir, "labels").select("doc_id", "quality"), ["doc_id"], "left")
    return C.duplicate_reports(known, "content_id", "quality")


@catalogue.add(f"""WITH {OCC}, s AS (SELECT DISTINCT content_id, split FROM occ), g AS (SELECT unnest(['train','val','test']) AS n)
SELECT a.n AS split_a, b.n AS split_b, (SELECT count(*) FROM s x JOIN s y USING (content_id) WHERE x.split = a.n AND y.split = b.n AND x.split <> y.split) AS shared FROM g a, g b""")
def cross_split_overlap_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.overlap_matrix(occurrences(spark, sf_dir), "content_id", "split")


@catalogue.add(f"""WITH {OCC} SELECT content_id, count(*) AS occurrences, CASE WHEN min(lang) = max(lang) AND count(lang) = count(*) THEN min(lang) END AS lang,
CASE WHEN min(source) = max(source) AND count(source) = count(*) THEN min(source) END AS source FROM occ GROUP BY content_id""")
def content_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occurrences(spark, sf_dir).groupBy("content_id").agg(F.count("*").alias("occurrences"), C.consensus("lang"), C.consensus("source"))


@catalogue.add(f"""WITH {OCC} SELECT doc_id, sha256(source || chr(31) || doc_id || chr(31) || content_id) AS frame_id FROM occ""")
def frame_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occurrences(spark, sf_dir).select("doc_id", C.stable_id(F.col("source"), F.col("doc_id").cast("string"), F.col("content_id")).alias("frame_id"))


@catalogue.add(f"""WITH {OCC}, r AS (SELECT sha256(doc_id || chr(31) || content_id) AS d FROM occ),
b AS (SELECT substr(d, 1, 4) AS b, count(*) AS n, sha256(string_agg(d, '' ORDER BY d)) AS h FROM r GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(b || h, '' ORDER BY b || h)) AS digest FROM b""")
def dataset_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.dataset_digest(occurrences(spark, sf_dir), ["doc_id", "content_id"])


@catalogue.add("""WITH d AS (SELECT doc_id, source FROM documents WHERE lang <> 'de')
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, source, quality, CASE WHEN d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL THEN 'matched'
WHEN d.doc_id IS NOT NULL THEN 'image_without_label' ELSE 'label_without_image' END AS status FROM d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id""")
def match_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of all languages but one as images, all labels: some labels are without an image."""
    images = table(spark, sf_dir, "documents").where("lang <> 'de'").select("doc_id", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return J.match(images, labels, ["doc_id"], ["quality"], ("matched", "image_without_label", "label_without_image"))


@catalogue.add("""WITH d AS (SELECT doc_id FROM documents WHERE lang <> 'de')
SELECT l.doc_id, quality, toxic, d2.doc_id IS NOT NULL AS in_documents FROM labels l LEFT JOIN documents d2 ON l.doc_id = d2.doc_id
WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.doc_id = l.doc_id)""")
def orphan_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    orphans = table(spark, sf_dir, "labels").join(docs.where("lang <> 'de'"), "doc_id", "left_anti")
    return orphans.join(docs.select("doc_id", F.lit(True).alias("in_documents")), "doc_id", "left").fillna(False, ["in_documents"])


@catalogue.add("""WITH d AS (SELECT source, n_chars // 100 AS length, lang IN ('en', 'de') AS l FROM documents), a AS (SELECT source, length, count(*) AS n_left FROM d WHERE l GROUP BY 1, 2),
b AS (SELECT source, length, count(*) AS n_right FROM d WHERE NOT l GROUP BY 1, 2),
j AS (SELECT coalesce(a.length, b.length) AS length, coalesce(a.source, b.source) AS source, coalesce(n_left, 0) AS n_left, coalesce(n_right, 0) AS n_right
FROM a FULL OUTER JOIN b ON a.length = b.length AND a.source = b.source)
SELECT *, CASE WHEN n_right = 0 THEN 'left_alone' WHEN n_left = 0 THEN 'right_alone' WHEN n_left = 1 AND n_right = 1 THEN 'matched' ELSE 'ambiguous' END AS status FROM j""")
def unambiguous_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of two languages and of all others, paired by source and length class where either side has just one."""
    docs = table(spark, sf_dir, "documents").select("lang", "source", F.floor(F.col("n_chars") / 100).alias("length"))
    return J.pair_unambiguous(docs.where("lang in ('en', 'de')"), docs.where("lang not in ('en', 'de')"), ["source", "length"])


@catalogue.add(f"""WITH {OCC}, h AS (SELECT DISTINCT source AS o, content_id AS i FROM occ), s AS (SELECT o, count(*) AS n FROM h GROUP BY o),
v AS (SELECT x.o AS a, y.o AS b, count(*) AS overlap FROM h x JOIN h y ON x.i = y.i AND x.o < y.o GROUP BY 1, 2),
f AS (SELECT a.o AS a, b.o AS b, a.n AS n_a, b.n AS n_b, coalesce(overlap, 0) AS overlap FROM s a JOIN s b ON a.o < b.o LEFT JOIN v ON v.a = a.o AND v.b = b.o)
SELECT *, round(overlap / (n_a + n_b - overlap), 6) AS jaccard, CASE WHEN n_a = 0 OR n_b = 0 THEN 'UNKNOWN' WHEN overlap = 0 THEN 'NO_OVERLAP'
WHEN overlap = n_a AND overlap = n_b THEN 'IDENTICAL' WHEN overlap = n_a THEN 'SUBSET' WHEN overlap = n_b THEN 'SUPERSET' ELSE 'PARTIAL' END AS relationship FROM f""")
def archive_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.set_overlap(occurrences(spark, sf_dir), "source", "content_id")


@catalogue.add(f"""WITH {OCC}, l AS (SELECT split, quality, toxic FROM occ JOIN labels USING (doc_id)), g AS (SELECT s, q FROM (SELECT unnest(['train','val','test']) AS s), (SELECT unnest([0, 1]) AS q))
SELECT s AS split, q AS quality, count(l.split) AS images, coalesce(sum(toxic), 0)::BIGINT AS toxic FROM g LEFT JOIN l ON l.split = s AND quality = q GROUP BY 1, 2""")
def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = occurrences(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").groupBy("split", "quality").agg(F.count("*").alias("images"), F.sum("toxic").alias("toxic"))
    grid = spark.createDataFrame([(s, q) for s in C.SPLITS for q in (0, 1)], "split string, quality int")
    return grid.join(known, ["split", "quality"], "left").fillna(0, ["images", "toxic"])


@catalogue.add("""WITH c AS (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY 1),
b AS (SELECT CASE WHEN n >= 3 THEN '3+' ELSE CAST(n AS VARCHAR) END AS bucket, count(*) AS n FROM c GROUP BY 1)
SELECT g.bucket, coalesce(n, 0) AS images FROM (SELECT unnest(['0','1','2','3+']) AS bucket) g LEFT JOIN b ON b.bucket = g.bucket""")
def objects_per_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    counts = table(spark, sf_dir, "orders").select("o_orderkey").join(objects, "o_orderkey", "left").fillna(0, ["n"])
    buckets = counts.groupBy(F.when(F.col("n") >= 3, "3+").otherwise(F.col("n").cast("string")).alias("bucket")).agg(F.count("*").alias("images"))
    return spark.createDataFrame([(b,) for b in ("0", "1", "2", "3+")], "bucket string").join(buckets, "bucket", "left").fillna(0, ["images"])


@catalogue.add(r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages),
s AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM p)
SELECT page_id, len(parts) AS depth, lower(regexp_extract(parts[-1], '.\.([A-Za-z0-9]+)$', 1)) AS extension,
CASE WHEN list_contains(list_transform(parts, lambda x: lower(x)), 'en') THEN 'train' WHEN list_contains(list_transform(parts, lambda x: lower(x)), 'fr') OR list_contains(list_transform(parts, lambda x: lower(x)), 'de') THEN 'val' ELSE 'unknown' END AS split,
regexp_extract(path, '([0-9]+)$', 1) AS tail, array_to_string(list_filter(['example', 'm', 'en', 'org'], lambda w: list_contains(string_split_regex(lower(path), '[/_. -]+'), w)), ',') AS concepts FROM s""")
def path_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "")
    p = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    c = F.col("path")
    return p.select(
        "page_id", X.depth(c).alias("depth"), X.extension(c).alias("extension"), X.split_of(c, {"train": ["en"], "val": ["fr", "de"]}).alias("split"),
        F.regexp_extract(c, r"([0-9]+)$", 1).alias("tail"), X.concepts(c, ["example", "m", "en", "org"]).alias("concepts"),
    )


@catalogue.add("""SELECT page_id, 'video_' || substr(sha256(url), 1, 16) AS video_id, sha256(html) AS image_sha256, octet_length(encode(html)) AS size FROM pages""")
def source_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    video = F.concat(F.lit("video_"), F.substring(F.sha2("url", 256), 1, 16))
    return table(spark, sf_dir, "pages").select("page_id", video.alias("video_id"), F.sha2("html", 256).alias("image_sha256"), F.octet_length("html").alias("size"))


LABELS = """t AS (SELECT l_orderkey AS k, string_agg(CASE WHEN l_tax = 0.08 THEN '-1' ELSE CAST(l_linenumber - 1 AS VARCHAR) END || ' ' || (l_discount + 0.45) || ' ' || (l_tax + 0.4) || ' ' || (l_quantity / 50)
|| CASE WHEN l_discount = 0.1 AND l_linestatus = 'F' THEN '' ELSE ' ' || (l_tax + 0.01) END, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS text FROM lineitem GROUP BY 1)"""


def label_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One label text an order, a line for each of its items: some are valid boxes, some break a rule."""
    cls = F.when(F.col("l_tax") == 0.08, "-1").otherwise((F.col("l_linenumber") - 1).cast("string"))
    height = F.when(~((F.col("l_discount") == 0.1) & (F.col("l_linestatus") == "F")), F.col("l_tax") + 0.01)
    line = F.concat_ws(" ", cls, F.col("l_discount") + 0.45, F.col("l_tax") + 0.4, F.col("l_quantity") / 50, height)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", line.alias("line")).alias("s"))
    return rows.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list("s")).alias("s")).select("k", F.array_join(F.transform("s", lambda x: x["line"]), "\n").alias("text"))


BOXES = f"""{LABELS}, r AS (SELECT k, unnest(string_split(text, chr(10))) AS line FROM t), f AS (SELECT k, string_split(line, ' ') AS f FROM r),
n AS (SELECT k, len(f) = 5 AND TRY_CAST(f[1] AS INT) >= 0 AS box, CAST(f[1] AS INT) AS c, CAST(f[2] AS DOUBLE) AS x, CAST(f[3] AS DOUBLE) AS y, CAST(f[4] AS DOUBLE) AS w, CASE WHEN len(f) = 5 THEN CAST(f[5] AS DOUBLE) END AS h FROM f),
e AS (SELECT *, box AND NOT (x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1 AND w > 0 AND w <= 1 AND h > 0 AND h <= 1) AS off, least(x - w / 2, y - h / 2) AS lo, greatest(x + w / 2, y + h / 2) AS hi FROM n),
i AS (SELECT *, box AND NOT (lo >= 0 AND hi <= 1) AND (lo >= -0.01 AND hi <= 1.01) AS slight, box AND NOT (lo >= -0.01 AND hi <= 1.01) AS outside FROM e)"""


@catalogue.add(f"""WITH {BOXES} SELECT k, bool_and(box) AS syntax_valid, NOT bool_or(off) AS normalized_valid, NOT bool_or(slight OR outside) AS geometry_valid, bool_and(box) AND NOT bool_or(off) AND NOT bool_or(slight OR outside) AS label_valid,
count(*) FILTER (WHERE box) AS num_objects, count(*) FILTER (WHERE NOT box) + count(*) FILTER (WHERE off) + count(*) FILTER (WHERE outside) AS n_errors, count(*) FILTER (WHERE slight) AS n_warnings, coalesce(string_agg(DISTINCT c, ',' ORDER BY c) FILTER (WHERE box), '') AS classes,
round(avg(w * h) FILTER (WHERE box), 8) AS area_mean, round(min(w * h) FILTER (WHERE box), 8) AS area_min, round(max(w * h) FILTER (WHERE box), 8) AS area_max, round(avg(w) FILTER (WHERE box), 8) AS width_mean, round(avg(h) FILTER (WHERE box), 8) AS height_mean FROM i GROUP BY k""")
def label_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = label_texts(spark, sf_dir).select("k", X.label_report(F.col("text")).alias("r")).select("k", "r.*").drop("label_empty")
    return got.withColumns({c: F.round(c, 8) for c in ("area_mean", "area_min", "area_max", "width_mean", "height_mean")})


@catalogue.add(f"""WITH {BOXES}, b AS (SELECT k, list_sort(list({{'c': c, 'x': x, 'y': y, 'w': w, 'h': h}})) AS v FROM i WHERE box GROUP BY k)
SELECT k, len(v) AS boxes, array_to_string(list_transform(v, lambda r: r.c || ' ' || printf('%.6f %.6f %.6f %.6f', r.x, r.y, r.w, r.h)), '|') AS canonical FROM b""")
def label_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical content of each label text with a box: its boxes in order, by which equal annotations are found."""
    own = label_texts(spark, sf_dir).select("k", X.sorted_boxes(F.col("text")).alias("b")).where(F.size("b") > 0)
    shown = F.transform("b", lambda r: F.format_string("%d %.6f %.6f %.6f %.6f", r["c"], r["x"], r["y"], r["w"], r["h"]))
    return own.select("k", F.size("b").alias("boxes"), F.array_join(shown, "|").alias("canonical"))


STATS = "round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q3, round(max(v), 6) AS max"


@catalogue.add(f"""WITH u AS (SELECT l_returnflag AS class, unnest(['quantity', 'price', 'discount', 'area']) AS metric, unnest([l_quantity, l_extendedprice, l_discount, l_quantity * l_discount]) AS v FROM lineitem)
SELECT class, metric, count(v) AS count, {STATS} FROM u GROUP BY 1, 2""")
def label_geometry_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("class"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), (F.col("l_quantity") * F.col("l_discount")).alias("area"))
    long = wide.unpivot(["class"], ["quantity", "price", "discount", "area"], "metric", "v")
    show = lambda c, n: F.round(c, 6).alias(n)
    quartiles = [show(F.percentile("v", F.lit(q)), n) for n, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))]
    return long.groupBy("class", "metric").agg(F.count("v").alias("count"), show(F.avg("v"), "mean"), show(F.stddev_samp("v"), "std"), show(F.min("v"), "min"), *quartiles, show(F.max("v"), "max"))


DIST = "round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max, " + ", ".join(f"round(quantile_cont(v, {q}), 6) AS {n}" for n, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("p90", 0.9), ("p95", 0.95), ("p975", 0.975), ("p99", 0.99), ("p995", 0.995), ("p999", 0.999)))


@catalogue.add(f"""SELECT event_type, count(v) AS count, {DIST} FROM (SELECT event_type, value AS v FROM events) GROUP BY 1""")
def distribution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(*distribution("value"))


@catalogue.add("""SELECT item_id, count(d.doc_id) AS documents, min(d.doc_id) AS first_doc, count(d.doc_id) > 0 AS contaminated
FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY item_id""")
def benchmark_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole benchmark items found in documents: texts share a run of eight words first, then are compared whole."""
    from tidemark.operators.containment import containing

    return containing(table(spark, sf_dir, "benchmark"), "item_id", "text", table(spark, sf_dir, "documents"), "doc_id", "text")


@catalogue.add("""WITH a AS (SELECT l_orderkey, l_returnflag, l_linestatus FROM lineitem WHERE l_linenumber <= 3), b AS (SELECT l_orderkey, l_returnflag, l_linestatus FROM lineitem WHERE l_linenumber >= 2)
SELECT l_orderkey, l_returnflag, l_linestatus, count(*) AS surplus FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY 1, 2, 3""")
def multiset_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    key = ["l_orderkey", "l_returnflag", "l_linestatus"]
    only = lines.where("l_linenumber <= 3").select(*key).exceptAll(lines.where("l_linenumber >= 2").select(*key))
    return only.groupBy(*key).agg(F.count("*").alias("surplus"))


@catalogue.add(f"""WITH {OCC}, c AS (SELECT content_id, min(doc_id) AS k, ('0x' || substr(content_id, 1, 6))::BIGINT AS h FROM occ GROUP BY 1)
SELECT a.k AS a, b.k AS b, CAST(bit_count(xor(a.h, b.h)) AS INT) AS distance FROM c a JOIN c b ON a.k < b.k AND bit_count(xor(a.h, b.h)) <= 2""")
def perceptual_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents whose 24-bit hashes differ in two bits at most, by bands that such hashes must share."""
    from tidemark.operators.hashes import expand, near_hashes

    one = occurrences(spark, sf_dir).groupBy("content_id").agg(F.min("doc_id").alias("k"))
    hashed = one.select("k", F.conv(F.substring("content_id", 1, 6), 16, 10).cast("long").alias("h"))
    hashed = cut(hashed)
    return expand(near_hashes(hashed, "k", "h", 2, 24), hashed, "k", "h")


@catalogue.add(f"""WITH {OCC}, x AS (SELECT content_id, count(*) AS n, min(doc_id) AS first FROM occ GROUP BY 1), s AS (SELECT DISTINCT content_id, source FROM occ)
SELECT source, count(*) AS contents, count(*) FILTER (WHERE n > 1) AS shared_contents, min(first) AS first FROM s JOIN x USING (content_id) GROUP BY 1""")
def source_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    occ = occurrences(spark, sf_dir)
    one = occ.groupBy("content_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    held = J.checked_join(occ.select("content_id", "source").distinct(), one, ["content_id"])
    return held.groupBy("source").agg(F.count("*").alias("contents"), F.count_if(F.col("n") > 1).alias("shared_contents"), F.min("first").alias("first"))


@catalogue.add(f"""WITH {OCC}, p AS (SELECT content_id, list_sort(list({{'doc_id': doc_id, 'split': split}})) AS points FROM occ GROUP BY 1)
SELECT content_id, len(points) AS n, array_to_string(list_transform(points, lambda x: x.doc_id || ':' || x.split), '|') AS points FROM p WHERE len(points) > 1""")
def content_timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = F.array_sort(F.collect_list(F.struct("doc_id", "split")))
    own = occurrences(spark, sf_dir).groupBy("content_id").agg(points.alias("p")).where(F.size("p") > 1)
    return own.select("content_id", F.size("p").alias("n"), F.array_join(F.transform("p", lambda x: F.concat_ws(":", x["doc_id"].cast("string"), x["split"])), "|").alias("points"))


KIND = """CASE WHEN e IN ('.jpg', '.jpeg', '.png', '.bmp', '.tif', '.tiff', '.webp') THEN 'image' WHEN e = '.txt' THEN 'label' WHEN e IN ('.mp4', '.mov', '.avi', '.mkv') THEN 'video' WHEN e IN ('.pt', '.pth', '.ckpt', '.onnx') THEN 'model'
WHEN e IN ('.zip', '.tar', '.gz', '.tgz', '.rar', '.7z') THEN 'archive' WHEN e IN ('.yaml', '.yml', '.json', '.toml', '.ini', '.cfg') THEN 'config' WHEN e IN ('.csv', '.md', '.xml', '.log') THEN 'metadata' ELSE 'other' END"""
#: Extensions given to pages, so that members of every kind are there.
ENDINGS = [".jpg", ".TXT", ".mp4", ".ckpt", ".tgz", ".yaml", ".log", ".h5", ".parquet", ""]


@catalogue.add(f"""WITH k AS (SELECT lower(({ENDINGS})[page_id % 10 + 1]) AS e FROM pages) SELECT {KIND} AS kind, e AS suffix, count(*) AS members FROM k GROUP BY 1, 2""")
def member_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.get(F.array(*[F.lit(e) for e in ENDINGS]), (F.col("page_id") % 10).cast("int"))
    members = table(spark, sf_dir, "pages").select(F.concat(F.lit("images/m"), F.col("page_id").cast("string"), ending).alias("path"))
    return members.groupBy(X.member_kind(F.col("path")).alias("kind"), X.suffix(F.col("path")).alias("suffix")).agg(F.count("*").alias("members"))
