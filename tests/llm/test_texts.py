import hashlib
import itertools
import math
import random
import re
import zlib

import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, language, mix, pii, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
BITS = ["the", " and", "é", "'s", "'", "ll", "  ", "\n", "\n\n", " <|endoftext|>", "<|endoftext|>", "123", "4", "...", " x", "aaaa", "日本", "🙂", "ing", "’", "\x85", "ñ"]


@pytest.fixture(scope="module")
def whole():
    tok = Tokenizer.from_file(PATH)
    return lambda t: tok.encode(t, add_special_tokens=False).ids


def test_joined_halves_equal_the_whole(whole):
    rng, encoder = random.Random(8), bpe.Encoder(PATH, chunk=40, window=8)
    for i in range(1500):
        t = "".join(rng.choice(BITS) for _ in range(rng.randint(1, 90)))
        if i % 4 == 0:
            t = "".join(rng.choice("abcdetionsé") for _ in range(rng.randint(1, 900))) + " " * rng.randint(0, 60) + "'" * rng.randint(0, 50) + "s"
        assert encoder.encode_long(t) == whole(t), t


def test_short_texts_equal_the_library(whole):
    rng, encoder = random.Random(1), bpe.Encoder(PATH)
    usual = [c for c in map(chr, range(0x2100)) if not bpe.UNUSUAL.match(c)]
    for _ in range(2000):
        t = "".join(rng.choice(usual) if rng.random() < 0.5 else rng.choice(BITS) for _ in range(20))
        assert encoder.encode_one(t) == whole(t)
        assert encoder.decode(encoder.encode_one(t)) == t
    assert encoder.encode_one("") == [] and encoder.encode_one("x" * 5000) == whole("x" * 5000)


def test_encoded_column(spark, whole):
    texts = ["hello <|endoftext|> world", "", None, "日本語 text", "long " * 20_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.c for r in df.select("doc_id", bpe.encoded(F.col("text"), PATH, keep_ids=True).alias("c")).collect()}
    for i, t in enumerate(texts):
        ids = whole(t or "")
        assert (got[i].n_tokens, list(got[i].ids)) == (len(ids), ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_long_texts_are_many_tasks_work(spark, whole):
    """Segments encoded apart and joined by key, against the library; repeated rows, clashing columns and no rows."""
    rng = random.Random(4)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(1, 700))) for _ in range(30)] + [None, "", "ab" * 900, "x" * 700, " " * 800 + "'s"]
    rows = [(i % 20, t, "old") for i, t in enumerate(texts)] + [(3, texts[3], "old")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, bpe string").selectExpr("*", "1 as i", "2 as t", "3 as ids")
    got = bpe.encode(df, PATH, keep_ids=True, chunk=40, segment=150)
    assert got.columns == df.columns[:2] + df.columns[3:] + ["bpe"] or set(got.columns) == set(df.columns)
    of = lambda xs: sorted(xs, key=repr)
    assert of((r.doc_id, r.text, list(r.bpe.ids)) for r in got.collect()) == of((i, t, whole(t or "")) for i, t, _ in rows)
    assert all(r.bpe.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest() for r in got.collect())
    assert bpe.encode(df.limit(0), PATH).count() == 0


def luhn(s):
    d = [int(c) for c in reversed(s)]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def base_spans(t):
    out = []
    for k in pii.KINDS[:4]:
        for m in re.finditer(k.plain, t):
            n = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": k.name == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(n) <= 19 and luhn(n), "phone": 10 <= len(n) <= 15}[k.name]
            if fine:
                out.append((m.start(), m.end(), k.name))
    return sorted(out, key=lambda x: (x[0], [k.name for k in pii.KINDS].index(x[2])))


def test_personal_data_against_python(spark):
    rng = random.Random(3)
    bits = ["a.b@c.de", "@", "a@b", "x@y.z@w.v", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "007.0.0.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+1", "é🙂", " ", "\n",
            "12345678901234567890", "378282246310005", "+49.30.1234567.", "%%", "--", "."]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(400)] + [None, "", "a" * 50_000, "." * 20_000 + "a.b" * 5_000 + "@" + "c." * 9_000 + "d", "1." * 30_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' as spans")
    for r in pii.detect(df).collect():
        got = [(s.start, s.end, s.kind) for s in r.spans if s.kind in ("email", "ip", "card", "phone")]
        assert got == base_spans(texts[r.doc_id] or ""), texts[r.doc_id]


def test_checksums_context_and_masks(spark):
    texts = ["my IBAN GB82 WEST 1234 5698 7654 32.", "GB83WEST12345698765432", "ssn: 123-45-6789", "part 123-45-6789", "card 4111111111111111 now", "mail a@b.cd, phone +1 555 010 9999"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.score) for s in r.spans] for r in pii.detect(df).collect()}
    assert got == {0: [("iban", 1.0)], 1: [], 2: [("ssn", 0.5)], 3: [], 4: [("card", 0.9)], 5: [("email", 1.1), ("phone", 0.9)]}
    assert [r.text for r in pii.masked(df).orderBy("doc_id").collect()][5] == "mail <EMAIL>, phone <PHONE>"


def test_account_numbers_before_and_after_other_words(spark):
    de, no, gb = "DE89370400440532013000", "NO9386011117947", "GB82 WEST 1234 5698 7654 32"
    texts = [f"{de} BIC COBADEFFXXX", "DE89 3704 0044 0532 0130 00 EUR 500", f"{de} I think", f"{no} {no} {gb}", f"AB12 {de} OK", f"é🙂 {gb} A1", f"{de[:-1]}1 BIC", f"x{de} I", f"{de}I A"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.spans if s.kind == "iban"] for r in pii.detect(df).collect()}
    assert got == {0: [de], 1: ["DE89 3704 0044 0532 0130 00"], 2: [de], 3: [no, no, gb], 4: [de], 5: [gb], 6: [], 7: [], 8: []}


def test_personal_data_plan_is_native(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    plan = pii.detect(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and pii.detect(df).count() == 0


def test_languages(spark):
    rng = random.Random(2)
    vocab = {"en": "the of and to in that is was for on are with as his they".split(), "de": "der die und das nicht ein eine ist mit auf dem sich für".split(), "eo": "la kaj de en estas por ne mi vi ke ĝi tio".split()}
    rows = [(i, " ".join(rng.choice(vocab[g]) for _ in range(rng.randint(20, 200))), g) for i, g in enumerate(list(vocab) * 60)]
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "123 !!", "de"), (1003, "the of and to in", None), (1004, "THE OF AND!! TO IN THAT", None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").selectExpr("*", "'c' as lang_pred", "1D as score")
    model = language.fit(df.where(~language.held_out()))
    assert set(model.dictionaries) == set(vocab)
    got = {r.doc_id: r.p for r in df.select("doc_id", language.classify(F.col("text"), model).alias("p")).collect()}
    assert sum(got[i].lang_pred == g for i, _, g in rows) >= 0.98 * len(rows)
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003, 1004)] == ["und", "und", "und", "en", "en"]
    assert all(0 <= p.score <= 1 for p in got.values()) and got[1000].rejected and not got[1003].rejected


def test_languages_without_anything_to_learn(spark):
    df = spark.createDataFrame([(1, "some text", None), (None, None, "en")], "doc_id long, text string, lang string")
    model = language.fit(df)
    assert [r.p.lang_pred for r in df.select(language.classify(F.col("text"), model).alias("p")).collect()] == ["und", "und"]
    one = language.fit(spark.createDataFrame([(1, "hello", "xx")], df.schema))
    assert df.select(language.classify(F.col("text"), one).alias("p")).first().p.lang_pred == "xx"


def test_a_narrow_margin_is_rejected(spark):
    same = {"a": language.plain("one two three " * 50), "b": language.plain("one two three " * 50)}
    df = spark.createDataFrame([("one two three " * 40,), ("one",)], "text string")
    got = df.select(language.classify(F.col("text"), language.Languages(same)).alias("p")).collect()
    assert [r.p.rejected for r in got] == [True, True]  # also of a short one


def test_languages_against_a_plain_version_and_held_out_accuracy(spark):
    """The query over whole texts: learned from three quarters, told by plain compression, right on the rest."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").collect()
    kept = {}
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null and lang is not null").select("doc_id", "text", "lang", F.xxhash64("text").bitwiseAND(F.lit(2**63 - 1)).alias("h")).collect():
        if zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            kept.setdefault(r.lang, {})[r.h] = r.text
    tools = []
    for g, own in sorted(kept.items(), key=lambda x: (-len(x[1]), x[0])):
        texts, n = [], 0
        for _, t in sorted(own.items()):
            n += len(t.encode())
            if n <= 1 << 19:
                texts.append(t)
        raw = zstandard.ZstdCompressionDict(language.plain(" ".join(reversed(texts))), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        tools.append((g, zstandard.ZstdCompressor(level=3, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False)))
    got, right, n = {r.doc_id: r for r in queries.op10_language(spark, "/root/testdata/sf0.01").collect()}, 0, 0
    assert len(got) == len(docs)
    for r in docs:
        own = got[r.doc_id]
        assert own.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if r.text is None or not any(map(str.isalpha, r.text)):
            assert (own.lang_pred, own.score) == ("und", 0.0)
            continue
        raw = language.plain(r.text)
        sizes = [sum(len(z.compress(raw[i : i + 8192])) for i in range(0, len(raw), 8192)) for _, z in tools]
        if sorted(sizes)[0] == sorted(sizes)[1]:
            sizes = [sum(len(z.compress((raw[i : i + 2048] + b" ") * 4)) for i in range(0, len(raw), 2048)) for _, z in tools]
        best = min(range(len(tools)), key=lambda i: (sizes[i], i))
        assert own.lang_pred == tools[best][0] and own.score == pytest.approx(1 - sizes[best] / sorted(sizes)[1])
        n, right = n + own.held_out, right + (own.held_out and own.lang_pred == r.lang)
    assert right / n >= 0.95


def test_languages_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    model = language.fit(df)
    assert model.dictionaries == {} and df.select(language.classify(F.col("text"), model).alias("p")).count() == 0


def water(sizes, weights, total):
    """Targets by a slow rise of one level."""
    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(2 * sizes[s], mid * weights[s]) for s in sizes) < total else (low, mid)
    return {s: min(2 * sizes[s], low * weights[s]) for s in sizes}


def test_targets_fill_to_the_total():
    sizes = {"b": 100, "a": 10, "c": 50, None: 0, "é": 500}
    got = mix.targets(sizes)
    want = water(sizes, {"a": 5, "b": 2, "c": 1, "é": 5, None: 2}, 1.5 * 660)
    assert all(got[s] == pytest.approx(want[s], abs=1e-6) for s in sizes) and mix.targets({"x": 0}) == {"x": 0.0}


def test_sources_share_alike_without_being_gathered(spark):
    rng = random.Random(8)
    for sizes in ({"b": 100, "a": 10, "c": 50, None: 0, "é": 500}, {f"s{i}": rng.randint(0, 1000) for i in range(40)}, {"x": 0}):
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "s string, n long")
        got = {r.s: r.target for r in mix.shared(df).collect()}
        assert got == {s: pytest.approx(t, abs=1e-6) for s, t in mix.targets(sizes).items()}


def plain_mix(docs):
    """Copies of (id, text, source, key) by sorting each source's documents: the method without bins."""
    out, by = {}, {}
    for _, t, s, key in docs:
        by.setdefault(s, []).append((key, len(re.findall(mix.WORD, t or ""))))
    goal = mix.targets({s: sum(n for _, n in own) for s, own in by.items()})
    for s, own in by.items():
        each = goal[s] / max(sum(n for _, n in own), 1)
        whole = min(int(each + 1e-9), 2)
        rest, octaves, left = max(each - whole, 0.0), {}, 0.0
        for key, n in own:
            out[s, key] = whole
            if n and rest > 1e-9:
                u = (key % (1 << 52) + 0.5) / (1 << 52)
                q = u / (1 - u) / (rest / (1 - rest) / n)
                octaves.setdefault(int(math.log2(n)), []).append((q / (1 + q), key, n))
        for _, ranked in sorted(octaves.items(), reverse=True):
            ranked.sort()
            sums = [0, *itertools.accumulate(d[2] for d in ranked)]
            base = max(i for i, x in enumerate(sums) if x <= rest * sums[-1])
            left += rest * sums[-1]
            at = min(range(max(0, base - mix.NEAR), min(len(ranked), base + mix.NEAR) + 1), key=lambda i: (abs(sums[i] - left), i))
            left -= sums[at]
            for _, key, _ in ranked[:at]:
                out[s, key] += 1
    return out


@pytest.mark.parametrize("bins, near", [(4, 3), (4096, 1024)])
def test_mix_against_plain_order_sampling(spark, monkeypatch, bins, near):
    monkeypatch.setattr(mix, "BINS", bins)
    monkeypatch.setattr(mix, "NEAR", near)
    rng = random.Random(11)
    docs = [(i, "w " * int(rng.paretovariate(0.8)), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(1200)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    keyed = [tuple(r) for r in df.selectExpr("doc_id", "text", "source", "xxhash64(7, cast(doc_id as string), text)").collect()]
    want = plain_mix(keyed)
    got = {r.doc_id: r.copies for r in mix.mix(df, texts=False).selectExpr("doc_id", "mix.copies").collect()}
    assert got == {i: want[s, key] for i, _, s, key in keyed}
    assert len(set(want.values())) > 1


def test_shorter_documents_are_likelier(spark):
    """Inclusion odds fall with size: documents of a source are sampled with unequal probability."""
    docs = [(i, "w " * (70 if i % 2 else 120), "a" if i < 800 else "z") for i in range(3000)]
    got = mix.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).selectExpr("source", "doc_id % 2 as short", "mix.copies as c")
    mean = {(r.source, r.short): r.c for r in got.groupBy("source", "short").agg(F.avg("c").alias("c")).collect()}
    assert mean["z", 1] > mean["z", 0] + 0.05


def test_mix(spark, rows):
    rng = random.Random(5)
    docs = [(i, "w " * int(rng.paretovariate(0.9)), rng.choice(["a", "b", "c", "d", None])) for i in range(1500)]
    docs += [(5000, None, "a"), (5001, "", None), (None, "x y", "b"), (5002, "k" * 9, "solo"), (5003, "a\xa0b c", "a"), (1, docs[1][1], docs[1][2])]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 as mix", "2 as size", "3 as n")
    got = mix.mix(df)
    assert set(got.columns) == set(df.columns) and got.count() == len(docs)
    table = [(r.doc_id, r.source, r.mix) for r in got.collect()]
    assert all(m.taken in (0, m.size, 2 * m.size) for _, _, m in table)
    assert next(m.size for i, _, m in table if i == 5003) == 2
    for s in {s for _, s, _ in table}:
        own = [m for _, x, m in table if x == s]
        assert own[0].source_size == sum(m.size for m in own)
        assert abs(sum(m.taken for m in own) - own[0].target) <= max(4, 0.005 * own[0].target)
    again = mix.mix(df.repartition(5))
    assert rows(again.selectExpr("doc_id", "source", "mix.taken")) == rows(got.selectExpr("doc_id", "source", "mix.taken"))
    assert mix.mix(df.limit(0)).count() == 0


def test_inclusion_odds_favour_documents(spark):
    docs = [(i, "w " * 10, "a" if i < 2000 else "z") for i in range(2100)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = mix.mix(df, inclusion=F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0)).where("source = 'a'")
    share = {r.even: r.c for r in got.groupBy((F.col("doc_id") % 2 == 0).alias("even")).agg(F.avg("mix.copies").alias("c")).collect()}
    assert share[True] > share[False]
