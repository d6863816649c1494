import io
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.sources import archives, tables
from tidemark.streaming import events as S


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("train/v1_frame_000001.jpg", b"img")
        z.writestr("train/v1_frame_000001.txt", "0 0.5 0.5 0.1 0.1")
        z.writestr("odd/../x.jpg", b"img")
    (tmp_path / "bad.zip").write_bytes(b"nothing")
    rows = archives.members(spark, str(tmp_path), ["image"]).collect()
    assert sorted((r.path or "", r.sha256 is not None) for r in rows) == [("", False), ("odd/../x.jpg", True), ("train/v1_frame_000001.jpg", True), ("train/v1_frame_000001.txt", False)]
    more = archives.described(archives.members(spark, str(tmp_path)).where("path is not null"), {"train": ["train"]})
    assert {(r.path, r.kind, r.split) for r in more.collect()} >= {("train/v1_frame_000001.txt", "label", "train"), ("odd/../x.jpg", "image", "unknown")}
    assert {r.reason for r in archives.gate(archives.members(spark, str(tmp_path))).collect()} == {"unsafe path", "unreadable member"}
    got = {r.path: bytes(r.content) for r in archives.member_contents(spark, str(tmp_path)).where("content is not null").collect()}
    assert got["train/v1_frame_000001.jpg"] == b"img"
    assert archives.files(spark, str(tmp_path)).count() == 2


def test_a_member_that_expands_too_far_is_an_error_row(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.txt", b"0" * 1_000_000)
    (tmp_path / "a.zip").write_bytes(buffer.getvalue())
    assert [r.error for r in archives.members(spark, str(tmp_path), limits=archives.Limits(ratio=10)).collect()] == ["too large"]


def test_strict_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,x,note\n1,2.5,\n2,NA,"a ""b"""\n3,,c\n')
    rows = tables.read_text_csv(spark, str(tmp_path / "t.csv"), ["id", "x", "note"])
    good, bad = tables.strict(rows, {"id": "long", "x": "double"}, {"x"})
    assert sorted((r.id, r.x, r.note) for r in good.collect()) == [(1, 2.5, ""), (3, None, "c")]
    assert [(r.id, r.note, r.fault) for r in bad.collect()] == [("2", 'a "b"', "x")]


def test_publications_are_checked_from_their_bytes(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    path = tables.publish(spark, str(tmp_path), "pairs", {"k": 5}, {"edges": df})
    assert tables.inspect(spark, path)["valid"] and [r.kind for r in tables.discover(spark, str(tmp_path)).collect()] == ["pairs"]
    with pytest.raises(Exception, match="(?i)exist"):
        tables.publish(spark, str(tmp_path), "pairs", {"k": 5}, {"edges": df})
    df.limit(1).write.mode("append").parquet(f"{path}/edges")
    assert not tables.inspect(spark, path)["valid"] and not tables.inspect(spark, str(tmp_path / "none"))["valid"]


@pytest.fixture
def stream(spark, tmp_path):
    def of(batches, schema):
        for i, b in enumerate(batches):
            spark.createDataFrame(b, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i:03d}"))
        return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    return of


def drained(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


T0 = datetime(2024, 1, 1)
at = lambda m: T0 + timedelta(minutes=m)


def test_sessions_close_behind_the_watermark(spark, stream):
    src = stream([[("u", at(0)), ("u", at(3)), ("u", at(30))], [("u", at(90))], [("u", at(200))]], "k string, ts timestamp")
    got = drained(spark, S.sessions(src, "k", "ts", "10 minutes", "5 minutes"), "sessions")
    assert sorted(r.n for r in got) == [1, 1, 2]


def test_first_occurrences(spark, stream):
    src = stream([[("c", at(0), 1), ("d", at(1), 2)], [("c", at(2), 3)]], "c string, ts timestamp, i int")
    assert sorted(r.c for r in drained(spark, S.first_occurrences(src, "c", "ts", "1 hour"), "firsts")) == ["c", "d"]


def test_windows(spark, stream):
    src = stream([[("u", at(1), 1.0), ("u", at(4), 2.0)], [("u", at(60), 5.0)]], "k string, ts timestamp, x double")
    got = drained(spark, S.windowed(src, "k", "ts", "x", "10 minutes", "10 minutes", "1 minute"), "windows")
    assert [(r.n, r.total) for r in got] == [(2, 3.0)]


def test_change_points_over_batches(spark, stream):
    rows = [("u", i, [1.0, 0.0] if i < 4 else [0.0, 1.0]) for i in range(8)]
    src = stream([rows[:3], rows[3:6], rows[6:]], "k string, i long, v array<double>")
    got = {r.i: r.change for r in drained(spark, S.centroid_changes(src, "k", "i", "v", 2), "changes")}
    assert got == {2: 0.0, 3: pytest.approx(1 - 2**-0.5), 4: 1.0, 5: pytest.approx(1 - 2**-0.5), 6: 0.0}


def test_first_decision_stays(spark, stream, tmp_path):
    src = stream([[(1, "yes")], [(1, "no"), (2, "no")]], "k int, d string")
    out = str(tmp_path / "out")
    q = src.writeStream.foreachBatch(S.append_decisions(out, "k")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.k, r.d) for r in spark.read.parquet(out).collect()) == [(1, "yes"), (2, "no")]
    assert spark.read.parquet(out).where(F.col("d") == "no").count() == 1
