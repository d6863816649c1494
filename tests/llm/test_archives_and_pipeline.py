import hashlib

import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

import corpus_pipeline
from pyspark.sql import functions as F
from tests.llm.test_dedup import edits
from tests.llm.test_texts import plain_mix
from tidemark.llm import minhash, warc


@pytest.mark.parametrize("few", [100_000, 0])
def test_archives_round_trip(spark, monkeypatch, few):
    monkeypatch.setattr(warc, "FEW", few)
    big = "x" * 1200
    pages = [(1, "http://a b", big), (2, None, big), (2, "u", big), (None, "u", big), (3, "u", None), (4, "u", ""), (5, "ü\n", "é" * 600), (6, "u", "P*M\x18\0\0\0\0" * 300), (7, "q", "small"), (8, "q", "small"), (2**60 + 1, "w", "y" * 999)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as bytes", "'d' as digest", "0 as first")
    path = warc.scratch(spark, "test")
    warc.write(df, path, roll=2000)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.html) for r in warc.read(spark, path, payloads=True).collect()), key=repr)
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        again = h == big and i != 2
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", 2 if again else None, "" if again else raw.decode()))
    assert got == sorted(want, key=repr)


def test_each_frame_opens_alone_with_the_leading_dictionary(spark):
    df = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i} " + "words and more " * 40) for i in range(300)], "page_id long, url string, html string")
    path = warc.scratch(spark, "test")
    warc.write(df.coalesce(1), path)
    files = spark.read.format("binaryFile").load(path).collect()
    assert files and all(r.path.endswith(".warc.zst") for r in files)
    contents = [bytes(r.content) for r in files]
    assert sum(1 for c in contents for _ in warc.frames(c)) == 300 + len(contents)  # with a warcinfo record each
    assert all(int.from_bytes(c[:4], "little") == warc.DICTIONARY_MAGIC for c in contents)
    plain = sum(len(zstandard.compress(f)) for c in contents for f in warc.frames(c))
    assert sum(map(len, contents)) < plain


def test_empty_archive(spark):
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_a_broken_archive_is_noticed():
    good = zstandard.ZstdCompressor().compress(b"x" * 100)
    try:
        list(warc.frames(good[:-3]))
    except (ValueError, zstandard.ZstdError):
        return
    raise AssertionError("a cut frame went unnoticed")


def documents(spark):
    words = {"en": "the of and to in that is was for on are with as his they this have from one had by word but not what all were".split(), "de": "der die und das nicht ein eine ist mit auf dem sich für den von zu des im".split()}
    import random

    rng = random.Random(7)
    make = lambda g, n: " ".join(rng.choice(words[g]) + str(rng.randint(0, 9)) * 0 + rng.choice("abcdefgh") for _ in range(n))
    rows = [(i, make(g, rng.randint(30, 120)), g, rng.choice("abc")) for i, g in enumerate(["en", "de"] * 40)]
    foot = "this very line is found at the end of very many documents"
    rows = [(i, t + ("\n" + foot if i % 4 == 0 else ""), g, s) for i, t, g, s in rows]
    rows += [(200, rows[3][1], "de", "a"), (201, rows[5][1] + " extra", "de", "b"), (202, None, "en", "a"), (203, "12 34", "en", "a"), (204, "", None, None)]
    full = [(i, t, g, s, len(t or "")) for i, t, g, s in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' as lines", "0 as mix"), foot


def test_stages_one_by_one(spark):
    docs, foot = documents(spark)
    known = corpus_pipeline.keep_known_languages(spark, docs, "").cache()
    assert known.columns == docs.columns and {r.doc_id for r in docs.subtract(known).collect()} == {202, 203, 204}
    fewer = corpus_pipeline.drop_repeated_lines(spark, known, "").cache()
    assert [r.doc_id for r in fewer.collect() if foot in r.text] == [76] and all(len(r.text) == r.n_chars for r in fewer.collect())
    kept = corpus_pipeline.keep_one_of_each_group(spark, fewer, "").cache()
    classes = {r.doc_id: r.class_id for r in minhash.classes(fewer).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(classes.values())) and {200, 201}.isdisjoint(classes.values())
    mixed = corpus_pipeline.mix_sources(spark, kept, "").cache()
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert mixed.columns == docs.columns and set(counts.values()) <= {1, 2}
    size = lambda rows: sum(len((r.text or "").split()) for r in rows)
    assert abs(size(mixed.collect()) - 1.5 * size(kept.collect())) < 0.02 * size(kept.collect())
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in kept.collect()}
    for r in corpus_pipeline.encode(spark, mixed, "").collect():
        assert list(r.ids) == tok.encode(texts[r.doc_id], add_special_tokens=False).ids


def test_rows_without_ids_and_repeated_rows(spark):
    docs, _ = documents(spark)
    some = docs.where("doc_id < 6")
    odd = some.unionByName(some).unionByName(some.limit(2).selectExpr("cast(null as long) as doc_id", *docs.columns[1:]))
    got = [r.doc_id for r in corpus_pipeline.keep_one_of_each_group(spark, odd, "").collect()]
    assert sorted(got, key=repr) == sorted([0, 1, 2, 3, 4, 5, None, None], key=repr)


def test_rows_of_one_id_with_unlike_texts_all_stay(spark):
    docs, _ = documents(spark)
    one = docs.where("doc_id in (8, 9)").selectExpr("8L as doc_id", *docs.columns[1:])
    again = one.unionByName(one.withColumn("source", F.lit("zz"))).repartition(3)
    got = corpus_pipeline.keep_one_of_each_group(spark, again, "").collect()
    assert len(got) == 2 and len({r.text for r in got}) == 2 and "zz" not in {r.source for r in got}


def test_run_against_plain_stages(spark, tmp_path):
    """The whole pipeline's rows from plain versions: no Spark but for the hash that seeds the sampling."""
    docs, foot = documents(spark)
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    rows = [r for r in rows if r[1] and any(map(str.isalpha, r[1]))]  # both languages of this table are told apart
    holders = [r[0] for r in rows if foot in r[1].split("\n")]
    rows = [(i, "\n".join(x for x in t.split("\n") if x != foot or i == max(holders)), g, s) for i, t, g, s in rows]
    kept = []
    for i, t, g, s in sorted(rows):
        a = t.lower().split()
        if not any(edits(a, b) <= 0.2 * max(len(a), len(b)) for b, *_ in kept):
            kept.append((a, i, t, g, s))
    keyed = spark.createDataFrame([(i, t, s) for _, i, t, _, s in kept], "i long, t string, s string")
    keyed = [tuple(r) for r in keyed.selectExpr("i", "t", "s", "xxhash64(7, cast(i as string), t)").collect()]
    copies = plain_mix(keyed)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((i, s, tok.encode(t, add_special_tokens=False).ids) for i, t, s, key in keyed for _ in range(copies[s, key]))
    assert sorted((r.doc_id, r.source, list(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want
    assert len(want) > 60


def test_run_over_empty_documents(spark, tmp_path):
    docs, _ = documents(spark)
    docs.select("doc_id", "text", "lang", "source", "n_chars").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
