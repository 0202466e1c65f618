"""The folder source with broken files, failing writers and streams; keyed state over batches and restarts."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from textora.sources.decoding import decoded
from textora.sources.folder import FolderSource
from textora.streaming import events, state


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in"
    for name, raw in {
        "a.txt": b"one\r\ntwo", "sub/b.md": "# é".encode(), "sub/u16.txt": "né".encode("utf-16"), "old.txt": b"caf\xe9", "nul.txt": b"a\0b", "empty.log": b" \n",
        "image.png": b"\x89PNG", "noname": b"x", ".hidden/x.txt": b"x", "sub/.y.txt": b"y", "Thumbs.db": b"z", "~$lock.txt": b"l",
    }.items():
        (d / name).parent.mkdir(parents=True, exist_ok=True)
        (d / name).write_bytes(raw)
    return d


def test_folder_is_read_with_reasons(spark, folder):
    spark.dataSource.register(FolderSource)
    found = spark.read.format("textora").option("bytes", "8").load(str(folder))
    assert found.rdd.getNumPartitions() > 2
    assert {r.path: (r.format, r.text, r.skipped, r.detail) for r in found.collect()} == {
        "a.txt": ("text", "one\ntwo", None, None), "sub/b.md": ("markdown", "# é", None, None), "sub/u16.txt": ("text", "né", None, None), "old.txt": ("text", "café", None, "read as cp1252"),
        "nul.txt": ("text", None, "unreadable", "holds NUL bytes"), "empty.log": ("text", None, "empty", None), "image.png": ("other", None, "unsupported", "png"), "noname": ("other", None, "unsupported", ""),
    }
    assert spark.read.format("textora").option("glob", "*.md").load(f"file://{folder}").count() == 1
    assert decoded(b"\xff\xfe\x00") == (None, "not valid UTF-16")


def test_files_are_written_whole_or_not_at_all(spark, tmp_path):
    spark.dataSource.register(FolderSource)
    out = tmp_path / "out"
    out.mkdir()
    (out / "before.txt").write_text("stays")
    rows = spark.createDataFrame([("x/a.txt", "é"), ("b.txt", None), ("../c.txt", "c")], "path string, text string").repartition(3)
    rows.write.format("textora").mode("append").save(str(out))
    there = lambda: {str(p.relative_to(out)): p.read_text() for p in out.rglob("*") if p.is_file()}
    assert there() == {"before.txt": "stays", "x/a.txt": "é", "b.txt": "", "c.txt": "c"}
    bad = rows.unionByName(spark.createDataFrame([(None, "no path")], "path string, text string"))
    with pytest.raises(Exception, match="no path"):
        bad.withColumn("text", F.lit("new")).write.format("textora").mode("append").save(str(out))
    assert there() == {"before.txt": "stays", "x/a.txt": "é", "b.txt": "", "c.txt": "c"} and not list(out.glob("_temporary*"))
    rows.where("path = 'b.txt'").write.format("textora").mode("overwrite").save(str(out))
    assert there() == {"b.txt": ""}


def test_folder_streams_what_is_new(spark, folder, tmp_path):
    spark.dataSource.register(FolderSource)
    seen = []

    def run():
        stream = spark.readStream.format("textora").option("glob", "*.txt").load(str(folder)).where("skipped is null")
        stream.writeStream.foreachBatch(lambda b, _: seen.append(sorted(r.path for r in b.collect()))).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(processingTime="0 seconds").start().processAllAvailable()
        for q in spark.streams.active:
            q.stop()

    run()
    (folder / "later.txt").write_text("later")
    run()
    assert [x for x in seen if x] == [["a.txt", "old.txt", "sub/u16.txt"], ["later.txt"]]


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(state.PROVIDER[0])
    spark.conf.set(*state.PROVIDER)
    yield
    spark.conf.set(state.PROVIDER[0], before)


def batches(spark, tmp_path, name, made, schema, rounds):
    """What a stateful query over Parquet batches gives, a list a round; the query stops between rounds."""
    source, out = tmp_path / f"{name}-in", []
    source.mkdir()
    for rows in rounds:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{source}")
        got = []
        query = made(spark.readStream.schema(schema).parquet(f"file://{source}")).writeStream.foreachBatch(lambda b, _, got=got: got.extend(map(tuple, b.collect())))
        query.option("checkpointLocation", f"file://{tmp_path}/{name}-cp").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        out.append(sorted(got))
        time.sleep(0.2)
    return out


def test_first_ever_over_restarts(spark, tmp_path, rocks):
    got = batches(spark, tmp_path, "first", state.first_ever, "key string, item long", [[("a", 3), ("a", 1), ("b", 5)], [("a", 0), ("c", 2)], [("c", 1), ("b", 9)]])
    assert got == [[("a", 1), ("b", 5)], [("c", 2)], []]


def test_stages_end_or_time_out(spark, tmp_path, rocks):
    """A stage in one batch, one over a restart, one whose end never comes, one whose start is lost."""
    at = lambda minute: datetime.datetime(2024, 1, 1, minute // 60, minute % 60)
    rounds = [[("a", "start", at(0)), ("b", "start", at(1)), ("c", "end", at(5)), ("c", "start", at(2)), ("d", "end", at(3))], [("a", "end", at(7))], [("e", "start", at(300))], [("e", "end", at(301))]]
    made = lambda d: state.stage_times(d, wait_ms=600_000, late="1 minute")
    got = batches(spark, tmp_path, "stages", made, "span string, kind string, ts timestamp", rounds)
    assert got[0] == [("c", at(2), 180.0, True)] and got[1] == [("a", at(0), 420.0, True)]
    assert sorted(x for r in got[2:] for x in r if x[0] != "d") == [("b", at(1), None, False), ("e", at(300), 60.0, True)]
    assert [x for r in got[2:] for x in r if x[0] == "d"] == [("d", None, None, False)]


def test_streams_meet_and_fall_into_sessions(spark, tmp_path, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id").orderBy("ts")
    source = tmp_path / "events"
    rows.coalesce(1).write.parquet(f"file://{source}")
    stream = spark.readStream.schema(rows.schema).parquet(f"file://{source}")
    events.sessions(stream, "user_id").writeStream.format("memory").queryName("told").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    batch = {(r.user_id, str(r.started), r.n) for r in events.sessions(rows, "user_id").collect()}
    streamed = {(r.user_id, str(r.started), r.n) for r in spark.table("told").collect()}
    assert streamed <= batch and len(streamed) > 0.9 * len(batch)
    calls = rows.select(F.col("user_id").alias("run"), "ts", "event_id")
    runs = rows.where("event_id % 5 = 0").select(F.col("user_id").alias("run"), F.col("ts").alias("started"))
    want = {(r.event_id, str(r.started)) for r in events.met(calls, runs).collect()}
    live = events.met(stream.select(F.col("user_id").alias("run"), "ts", "event_id"), stream.where("event_id % 5 = 0").select(F.col("user_id").alias("run"), F.col("ts").alias("started")))
    live.writeStream.format("memory").queryName("met").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert {(r.event_id, str(r.started)) for r in spark.table("met").collect()} == want and want
