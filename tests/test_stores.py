"""Derived stores, recording datasets, Delta tables and the catalog: increments, crashes, locks and conflicts."""

import io
import json
import threading
from pathlib import Path

import pyarrow as pa
import pytest
from marlstone import model
from marlstone.model import EngineError, Feature, IndexRow, Lineage, MediaRef, Segment
from marlstone.sources import delta, derived, recordings
from marlstone.sources.catalog import Catalog
from marlstone.streaming import refresh
from pyspark.sql import functions as F

MEDIA = MediaRef("file:///media/clip.mp4", "video")


def feature(version, model_name="m", uri=MEDIA.uri):
    return Feature(MediaRef(uri, "video"), Lineage(uri, version, "op-1", model_name, "1", {"language": "en"}), "transcript", '{"b": 1, "a": "x"}')


def test_feature_checks():
    assert feature("1").payload_json == '{"a":"x","b":1}'
    for payload in ('{"a": [{"My_Token": 1}]}', '{"sig": 1}', '{"x": {"clientSecret": ""}}'):
        with pytest.raises(EngineError, match="credential"):
            Feature(MEDIA, feature("1").lineage, "k", payload)
    assert Feature(MEDIA, feature("1").lineage, "k", '{"signatures": 1}')
    for bad in (lambda: Feature(MEDIA, feature("1").lineage, " ", "{}"), lambda: Feature(MediaRef("file:///other", "video"), feature("1").lineage, "k", "{}"), lambda: IndexRow(" ", "t", "[]", feature("1").lineage)):
        with pytest.raises(EngineError):
            bad()


def test_refresh_emits_changes_only(spark, tmp_path):
    store = derived.Store(spark, tmp_path / "s")
    first = store.frame([feature("1"), feature("1"), feature("1", uri="file:///media/other.mp4")])
    assert (store.refresh(first).emitted_rows, store.refresh(first).emitted_rows) == (3, 0)
    again = store.refresh(store.frame([feature("2"), feature("1", uri="file:///media/other.mp4")]))
    assert (again.emitted_rows, again.changed_sources) == (1, 1) and store.rows().count() == 4 and store.snapshot(again.snapshot).count() == 1
    assert {r["uri"]: r["source_version"] for r in store.manifest().collect()} == {MEDIA.uri: "2", "file:///media/other.mp4": "1"}
    other = store.frame([feature("2", "new model")])
    assert store.refresh(other).emitted_rows == 0 and store.refresh(other, full_lineage=True).emitted_rows == 1
    assert store.rows().select("media.uri", "media.storage_mode").distinct().count() == 2


def test_refresh_survives_a_crash(spark, tmp_path, monkeypatch):
    store = derived.Store(spark, tmp_path / "s")
    store.refresh(store.frame([feature("1")]))
    monkeypatch.setattr(derived, "replace_json", lambda *_: (_ for _ in ()).throw(OSError("power cut")))
    with pytest.raises(OSError, match="power"):
        store.refresh(store.frame([feature("2")]))
    monkeypatch.undo()
    assert store.rows().count() == 1 and store.refresh(store.frame([feature("2")])).emitted_rows == 1 and store.rows().count() == 2


def test_refresh_of_an_index_and_one_writer(spark, tmp_path):
    store = derived.Store(spark, tmp_path / "i", model.INDEX_ROWS)
    row = IndexRow.of(model.Embedding("a", "text", (0.5, 1.0), feature("1").lineage))
    assert store.refresh(store.frame([row])).emitted_rows == 1
    assert derived.to_embeddings(store.rows()).first()["values"] == [0.5, 1.0]
    with derived.locked(tmp_path / "i" / "writer.lock", True, "x"), pytest.raises(EngineError) as e:
        store.refresh(store.frame([row]))
    assert e.value.code == "writer_busy"


def test_refresh_stream(spark, tmp_path):
    store = derived.Store(spark, tmp_path / "s")
    store.frame([feature("1")]).write.parquet(f"{tmp_path}/in/a")
    for name, versions in (("b", ["1", "2"]), ("c", ["2"])):
        store.frame([feature(v) for v in versions]).coalesce(1).write.parquet(f"{tmp_path}/{name}")
    (tmp_path / "flat").mkdir()
    for k, name in enumerate(("in/a", "b", "c")):
        for p in (tmp_path / name).glob("*.parquet"):
            p.rename(tmp_path / "flat" / f"{k}-{p.name}")
        query = refresh.refresh_stream(spark, f"{tmp_path}/flat", store, f"{tmp_path}/check")
        query.awaitTermination(60)
        assert query.exception() is None
    assert {r["uri"]: r["source_version"] for r in store.manifest().collect()} == {MEDIA.uri: "2"} and store.rows().where("source_version = '1'").count() == 1


def test_streams_drop_late_events(spark, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    schema = "ts timestamp, k string, id bigint"

    def put(name, *rows):
        spark.createDataFrame([(*r,) for r in rows], "t string, k string, id bigint").select(F.to_timestamp("t").alias("ts"), "k", "id").coalesce(1).write.parquet(f"{tmp_path}/{name}")
        next((tmp_path / name).glob("*.parquet")).rename(folder / f"{name}.parquet")

    for name, made in (("w", lambda s: refresh.windowed(s, "10 minutes", "10 minutes", "k")), ("d", lambda s: refresh.first_of(s, ["id"], "1 hour"))):
        for p in folder.glob("*"):
            p.unlink()
        for step, rows in enumerate(([("2024-01-01 00:01:00", "a", 1), ("2024-01-01 00:02:00", "a", 1)], [("2024-01-01 02:00:00", "a", 2)], [("2024-01-01 00:03:00", "a", 3), ("2024-01-01 04:00:00", "a", 4)], [("2024-01-01 06:00:00", "b", 5)])):
            put(f"{name}{step}", *rows)
            out = made(spark.readStream.schema(schema).parquet(str(folder)))
            query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out-{name}").option("checkpointLocation", f"{tmp_path}/check-{name}").outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination(60)
    got = [(str(r["start"]), r["n"]) for r in spark.read.parquet(f"{tmp_path}/out-w").orderBy("start").collect()]
    assert got == [("2024-01-01 00:00:00", 2), ("2024-01-01 02:00:00", 1), ("2024-01-01 04:00:00", 1)]
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out-d").collect()) == [1, 2, 4, 5]


# --- recordings


class Speech:
    def __init__(self, texts=("hello world", "second"), change=None):
        self.texts, self.calls, self.change = texts, 0, change

    def transcribe(self, request):
        self.calls += 1
        rows = [Segment(request.media.uri, i * 10, i * 10 + 10, t, request.lineage, 900) for i, t in enumerate(self.texts)]
        return self.change(rows) if self.change else rows


BY = Lineage("file:///unset", "unset", "asr-1", "tiny", "1", {"beam": "5"})


def test_recordings(spark, tmp_path):
    data, audio = recordings.RecordingDataset(tmp_path / "d"), tmp_path / "a.wav"
    audio.write_bytes(b"one")
    speech = Speech()
    assert data.ingest(audio, BY, speech) == recordings.Ingested(False, 2) and data.ingest(audio, BY, speech) == recordings.Ingested(True, 2) and speech.calls == 1
    df, lease = data.frame(spark)
    assert [f.name for f in df.schema] == [x.split()[0] for x in model.TRANSCRIPTS.split(", ")] and df.count() == 2
    assert [r["text"] for r in data.search(spark, "HELLO")] == ["hello world"] and data.search(spark, "none") == []
    audio.write_bytes(b"two")
    data.ingest(audio, Lineage("x:y", "", "asr-2"), Speech(("changed",)))
    assert df.count() == 2  # the files of a held table stay
    with pytest.raises(EngineError) as e:
        data.vacuum()
    assert e.value.code == "readers_busy"
    lease.close()
    assert data.vacuum() == (0, 0)  # the manifest before still names them
    (uri,) = [r.source_uri for r in data.recordings()]
    assert data.remove(uri) and not data.remove(uri) and data.vacuum()[0] == 1 and data.recordings() == []
    assert data.frame(spark)[0].count() == 0 and data.vacuum()[0] == 0
    for bad in ("http://x/y", "file:///a?b", (data.root / "x").as_uri()):
        with pytest.raises(EngineError):
            data.remove(bad)


@pytest.mark.parametrize("change", [lambda r: r[::-1], lambda r: [Segment(r[0].media_id, 5, 5, "x", r[0].lineage)], lambda r: [Segment(r[0].media_id, 0, 5, " ", r[0].lineage)], lambda r: [Segment("x:y", 0, 5, "t", r[0].lineage)], lambda r: [Segment(r[0].media_id, 0, 5, "t", BY)], lambda r: [Segment(r[0].media_id, 0, 5, "t", r[0].lineage, 1001)]])
def test_bad_transcripts_leave_the_dataset(tmp_path, change):
    data, audio = recordings.RecordingDataset(tmp_path / "d"), tmp_path / "a.wav"
    audio.write_bytes(b"one")
    with pytest.raises(EngineError) as e:
        data.ingest(audio, BY, Speech(change=change))
    assert e.value.code == "invalid_transcript" and data.recordings() == []


def test_recordings_change_crash_and_recover(tmp_path, monkeypatch):
    data, audio = recordings.RecordingDataset(tmp_path / "d"), tmp_path / "a.wav"
    audio.write_bytes(b"one")

    def change(rows):
        audio.write_bytes(b"other")
        return rows

    with pytest.raises(EngineError) as e:
        data.ingest(audio, BY, Speech(change=change))
    assert e.value.code == "source_changed"
    data.ingest(audio, BY, Speech())
    real = recordings.os.replace
    monkeypatch.setattr(recordings.os, "replace", lambda a, b: (_ for _ in ()).throw(OSError("cut")) if str(b).endswith("manifest.json") else real(a, b))
    audio.write_bytes(b"three")
    with pytest.raises(OSError, match="cut"):
        data.ingest(audio, BY, Speech())
    monkeypatch.undo()
    assert [r.segments for r in data.recordings()] == [2] and data.vacuum()[0] >= 1
    monkeypatch.setattr(recordings, "sync_folder", lambda _: (_ for _ in ()).throw(OSError("io")) if json.loads((data.root / "manifest.json").read_text())["recordings"].get(audio.as_uri(), {}).get("segments") == 1 else None)
    with pytest.raises(recordings.RecordingError) as e:
        data.ingest(audio, BY, Speech(("one",)))
    monkeypatch.undo()
    assert e.value.code == "durability_uncertain" and e.value.published and [r.segments for r in data.recordings()] == [1]
    (data.root / "manifest.json").write_text("{")
    with pytest.raises(EngineError) as e:
        recordings.RecordingDataset(data.root)
    assert e.value.code == "invalid_manifest" and recordings.RecordingDataset.recover(data.root) == (True, 1) and recordings.RecordingDataset.recover(data.root)[0] is False
    (data.root / "manifest.json").write_text('{"format_version": 9, "recordings": {}}')
    with pytest.raises(EngineError) as e:
        recordings.RecordingDataset.recover(data.root)
    assert e.value.code == "unsupported_manifest_version"
    (data.root / "manifest.json").unlink()
    with pytest.raises(EngineError) as e:
        recordings.RecordingDataset(data.root)
    assert e.value.code == "manifest_missing"


def test_recording_folders_and_paths(tmp_path):
    data = recordings.RecordingDataset(tmp_path / "d")
    for name in ("in/a.wav", "in/sub/b.WAV", "in/c.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    got = data.ingest_folder([tmp_path / "in"], BY, Speech())
    assert [Path(p).name for p in got] == ["a.wav", "b.WAV"] and len(data.recordings()) == 2

    class Half(Speech):
        def transcribe(self, request):
            if request.media.uri.endswith("b.WAV"):
                raise EngineError("provider_failed", "no")
            return super().transcribe(request)

    with pytest.raises(recordings.IngestionError) as e:
        data.ingest_folder([tmp_path / "in"], Lineage("x:y", "", "asr-9"), Half())
    assert list(map(len, (e.value.results, e.value.failures))) == [1, 1]
    (data.root / "inside.wav").write_bytes(b"x")
    for bad in (data.root / "inside.wav", tmp_path / "in", tmp_path / "none.wav"):
        with pytest.raises(EngineError):
            data.ingest(bad, BY, Speech())
    (tmp_path / "link").symlink_to(data.root)
    with pytest.raises(EngineError) as e:
        recordings.RecordingDataset(tmp_path / "link")
    assert e.value.code == "unsafe_path"
    with data._writing(), pytest.raises(EngineError) as e:
        data.ingest(tmp_path / "in" / "a.wav", BY, Speech())
    assert e.value.code == "writer_busy"


# --- Delta


def test_delta_versions_and_schemas(spark, tmp_path):
    root = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert delta.write(df, root, delta.WriteOptions("create")) == 0 and delta.write(df, root) == 1
    assert delta.read(spark, root).count() == 4 and delta.read(spark, root, 0).count() == 2
    with pytest.raises(EngineError) as e:
        delta.write(df, root, delta.WriteOptions("create"))
    assert e.value.code == "table_exists"
    wide = spark.createDataFrame([(3, "c", 1.5)], "k int, v string, x double")
    for bad in (wide, df.select(F.col("k").cast("string").alias("k"), "v"), df.select("k")):
        with pytest.raises(EngineError, match="column"):
            delta.write(bad, root)
    assert delta.write(wide, root, delta.WriteOptions(schema="merge")) == 2
    assert sorted(map(tuple, delta.read(spark, root).collect()), key=str)[-1] == (3, "c", 1.5) and delta.read(spark, root, 1).columns == ["k", "v"]
    assert delta.write(df.select("v"), root, delta.WriteOptions("overwrite", "overwrite", metadata={"by": "test"})) == 3 and delta.read(spark, root).columns == ["v"]
    assert delta.read(spark, root, 2).count() == 5
    for bad in (7, -1):
        with pytest.raises(EngineError):
            delta.read(spark, root, bad)
    with pytest.raises(EngineError):
        delta.WriteOptions(metadata={"api_token": "x"})
    with pytest.raises(EngineError):
        delta.WriteOptions("append", "overwrite")
    with pytest.raises(EngineError):
        delta.write(df, "s3a://bucket/t")
    with pytest.raises(EngineError):
        delta.read(spark, str(tmp_path / "none"))
    delta.register(spark, "delta_t", root, 0)
    assert spark.sql("SELECT sum(k) AS s FROM delta_t").first()["s"] == 3


def test_delta_partitions_checkpoint_and_ipc(spark, tmp_path):
    root = str(tmp_path / "p")
    df = spark.createDataFrame([(i, f"g {i % 3}" if i % 4 else None, None) for i in range(40)], "k int, g string, n int")
    delta.write(df, root, delta.WriteOptions(partition_by=("g",)))
    got = delta.read(spark, root)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, df.collect()), key=str) and got.columns == ["k", "g", "n"]
    assert len(got.where("g = 'g 1'").select("k").inputFiles()) >= 1 and got.where("g is null").count() == 10
    with pytest.raises(EngineError):
        delta.write(df, root, delta.WriteOptions(partition_by=("k",)))
    many = spark.range(200).select(F.col("id"), (F.col("id") % 70).cast("int").alias("d"))
    delta.write(many, str(tmp_path / "m"), delta.WriteOptions(partition_by=("d",)))
    assert sorted(map(tuple, delta.read(spark, str(tmp_path / "m")).collect())) == [(i, i % 70) for i in range(200)]
    log = tmp_path / "p" / "_delta_log"
    actions = [json.loads(x) for x in (log / f"{0:020}.json").read_text().splitlines()]
    rows = [{"add": a.get("add"), "remove": a.get("remove"), "metaData": a.get("metaData"), "protocol": a.get("protocol")} for a in actions if "commitInfo" not in a]
    spark.createDataFrame([json.dumps(r) for r in rows], "string").select(F.from_json("value", delta._ACTIONS).alias("a")).select("a.*").coalesce(1).write.parquet(f"{tmp_path}/cp")
    next((tmp_path / "cp").glob("*.parquet")).rename(log / f"{0:020}.checkpoint.parquet")
    (log / f"{0:020}.json").unlink()
    assert delta.read(spark, root).count() == 40 and delta.write(df, root) == 1 and delta.read(spark, root).count() == 80
    out = io.BytesIO()
    table = pa.table({"k": [1, 2]})
    with pa.ipc.new_stream(out, table.schema) as w:
        w.write_table(table)
    assert delta.write_ipc(spark, out.getvalue(), str(tmp_path / "ipc")) == 0 and delta.read(spark, str(tmp_path / "ipc")).count() == 2
    (log / f"{2:020}.json").write_text(json.dumps({"protocol": {"minReaderVersion": 3, "minWriterVersion": 7}}))
    with pytest.raises(EngineError, match="reader version"):
        delta.read(spark, root)


def test_delta_conflicts(spark, tmp_path):
    root, df = str(tmp_path / "c"), spark.range(3)
    delta.write(df, root)
    now = delta.state(spark, root)
    added = delta._added(spark, root, next(p.name for p in (tmp_path / "c").glob("data-*")), ())
    assert delta._commit(df.schema, spark, root, now, added, (), delta.WriteOptions(), True) == 1
    with pytest.raises(delta.Conflict):
        delta._commit(df.schema, spark, root, now, added, (), delta.WriteOptions(), True)
    threads = [threading.Thread(target=lambda: delta.write(df, root, delta.WriteOptions(retries=9))) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert delta.state(spark, root).version == 5
    tries = []

    def once():
        tries.append(1)
        if len(tries) < 3:
            raise delta.Conflict(1)
        return 8

    assert delta.with_retry(once, 5) == 8
    with pytest.raises(ZeroDivisionError):
        delta.with_retry(lambda: 1 // 0, 5)


# --- catalog


def test_catalog(spark, tmp_path):
    c = Catalog(tmp_path / "c.json")
    assert c.execute("create media table Clips;") == "Clips" and c.execute("SHOW TABLES") == ["Clips"]
    c.register_media_table("clips2", [MEDIA], feature("1").lineage, metadata={"a": "b"})
    with pytest.raises(EngineError) as e:
        c.register_media_table("clips2", [])
    assert e.value.code == "table_exists"
    assert Catalog(tmp_path / "c.json").media_table("clips2") == [MEDIA] and c.lineage("clips2") == feature("1").lineage and c.metadata("clips2") == {"a": "b"} and c.lineage("Clips") is None
    assert c.register_in_session(spark) == ["Clips", "clips2"] and spark.sql("SELECT media.uri AS u FROM clips2").first()["u"] == MEDIA.uri
    assert c.execute(" DROP TABLE Clips ") == "Clips"
    for bad in ("DROP TABLE none", "CREATE MEDIA TABLE 1x", "CREATE TABLE x", "SHOW", "DROP TABLE a-b"):
        with pytest.raises(EngineError):
            c.execute(bad)
    with pytest.raises(EngineError):
        c.register_media_table("t", [MediaRef("file:///x", "video", metadata={"api_token": "1"})])
    with derived.locked(tmp_path / "c.json.lock", True, "x"), pytest.raises(EngineError) as e:
        c.execute("CREATE MEDIA TABLE y")
    assert e.value.code == "catalog_busy"
    (tmp_path / "c.json").write_text("[]")
    with pytest.raises(EngineError):
        c.tables()
