"""The session: registration, SQL with the engine's functions, searches, governed queries, exports, the command line and the Flight server."""

import io
import json
import threading
import time

import pyarrow as pa
import pyarrow.flight as fl
import pytest
from marlstone import cli, export, session as sessions
from marlstone.flight import Client, Server
from marlstone.governance import ByteBudget, Governor, Queries
from marlstone.model import Embedding, EngineError, Lineage, MediaRef, Segment, Unavailable
from marlstone.operators import providers, table_functions
from marlstone.session import MediaSession, is_reading
from marlstone.sources import delta
from pyspark.sql import functions as F

from tests.test_documents import docx, para, pdf, table
from tests.test_media import wav

L = Lineage("file:///a.wav", "1", "op")


@pytest.fixture(scope="module")
def media(spark):
    return MediaSession(spark, mock_dimensions=16)


def test_media_refs_and_functions(media):
    media.register_media_refs("refs", [MediaRef("file:///a.mp4", "video", size_bytes=5, metadata={"k": "v"}), MediaRef("https://h/b.wav", "audio")])
    got = media.plan("SELECT media_uri(media) AS u, media_type(media) AS t, media.uri, media.size_bytes, media_uri(NULL) AS n FROM refs ORDER BY 1").collect()
    assert [tuple(r) for r in got] == [("file:///a.mp4", "video", "file:///a.mp4", 5, None), ("https://h/b.wav", "audio", "https://h/b.wav", None, None)]
    assert len(media.spark.table("refs").schema["media"].dataType.fields) == 9
    with pytest.raises(EngineError):
        media.register_media_refs("bad-name", [])


def test_registration(spark, media, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/p")
    media.register_parquet("numbers", f"file://{tmp_path}/p")
    with pytest.raises(EngineError):
        media.register_parquet("numbers", "s3a://bucket/p")
    media.register_parquet_in_schema("lake", "ext", f"{tmp_path}/p")
    media.register_table("kept", spark.range(3), "lake")
    media.register_parquet_in_schema("lake", "ext", f"{tmp_path}/p")
    assert media.sql("SELECT (SELECT count(*) FROM numbers) + (SELECT count(*) FROM lake.ext) + (SELECT count(*) FROM lake.kept) AS n") == [{"n": "13"}]
    names = media.catalog_tables()
    assert ("spark_catalog", "lake", "ext") in names and any(t[2] == "numbers" for t in names) and not any(t[2].startswith("_") for t in names)
    (tmp_path / "c.csv").write_text("a,b\n1,x\n")
    (tmp_path / "j.json").write_text('{"a": 1}\n')
    media.register_files("c", f"{tmp_path}/c.csv", "csv", header=True)
    media.register_files("j", f"{tmp_path}/j.json", "json", "a long")
    for name, kind in (("s", pa.ipc.new_stream), ("f", pa.ipc.new_file)):
        with pa.OSFile(f"{tmp_path}/{name}.arrow", "wb") as out, kind(out, pa.schema([("a", pa.int64())])) as w:
            w.write_table(pa.table({"a": pa.array([1, 2], pa.int64())}))
    media.register_files("ipc", f"{tmp_path}/*.arrow", "arrow")
    assert media.sql("SELECT c.b, j.a, (SELECT sum(a) FROM ipc) AS s FROM c, j") == [{"b": "x", "a": "1", "s": "6"}]
    with pytest.raises(EngineError):
        media.register_files("x", "y", "xlsx")
    spark.sql("DROP SCHEMA lake CASCADE")


def test_document_functions(spark, media, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx(para("The cat") + table([para("x"), para("cat y")]), {"word/media/i.png": b"123"}))
    (tmp_path / "b.pdf").write_bytes(pdf([b"BT (Page text) Tj ET"]))
    a, b = f"file://{tmp_path}/a.docx", str(tmp_path / "b.pdf")
    assert [r["text"] for r in media.plan(f"SELECT * FROM document_sections('{a}') ORDER BY ordinal").collect()] == ["The cat", "x", "cat y"]
    assert media.sql(f"SELECT ordinal, heading, text FROM document_sections('{b}')") == [{"ordinal": "1", "heading": None, "text": "Page text\n"}]
    assert [tuple(r)[2:] for r in media.plan(f"SELECT * FROM document_tables('{a}')").collect()] == [(0, 0, 0, "x"), (0, 0, 1, "cat y")]
    assert [tuple(r)[2:] for r in media.plan(f"SELECT * FROM document_images('{a}', false)").collect()] == [(0, "word/media/i.png", "image/png", None)]
    assert bytes(media.plan(f"SELECT bytes FROM document_images('{a}', true)").first()["bytes"]) == b"123"
    assert [r["kind"] for r in media.plan(f"SELECT * FROM document_search('{a}', 'CAT', 2)").collect()] == ["section", "section"]
    assert media.document_search(a, "cat y", 9).count() == 2
    media.register_media_refs("docs", [MediaRef(a, "document"), MediaRef(f"file://{b}", "document")])
    lateral = media.plan("SELECT media.uri, count(*) AS n FROM docs, LATERAL document_sections(media.uri) s GROUP BY 1 ORDER BY 2")
    assert [r["n"] for r in lateral.collect()] == [1, 3]
    assert table_functions.documents_at(spark, f"{tmp_path}/*.docx").count() == 3 and table_functions.documents_at(spark, str(tmp_path), "images").count() == 1
    media.register_documents("cells", f"{tmp_path}/a.docx", "tables")
    assert media.sql("SELECT count(*) AS n FROM cells") == [{"n": "2"}]
    media.register_remote_document_sections("remote", MediaRef("https://h/x.docx", "document"), lambda m: ((tmp_path / "a.docx").read_bytes(), "etag-1"))
    assert media.sql("SELECT DISTINCT source_uri, source_version FROM remote") == [{"source_uri": "https://h/x.docx", "source_version": "etag-1"}]
    with pytest.raises(Exception, match="document OCR"):
        media.sql(f"SELECT * FROM document_ocr('{a}', 5)")

    class Ocr:
        def recognize(self, request):
            return [providers.OcrText(0, f"{len(request.data)} bytes", request.lineage, 900)]

    spark.udtf.register("document_ocr", table_functions.ocr_function(Ocr()))
    assert media.sql(f"SELECT image_ordinal, text FROM document_ocr('{a}', 5)") == [{"image_ordinal": "0", "text": "3 bytes"}] and media.sql(f"SELECT * FROM document_ocr('{a}', 0)") == []


def test_audio_and_video_functions(spark, media, tmp_path):
    path = wav(tmp_path / "a.wav", b"\0\1" * 32_000)
    media.register_audio_chunks("chunks", MediaRef(f"file://{path}", "audio"), 0, 5_000, 800, 9, True)
    got = media.plan("SELECT start_millis, end_millis, sample_rate_hz, channel_count, length(f32le) AS n FROM chunks WHERE start_millis >= 800 ORDER BY 1").collect()
    assert [tuple(r) for r in got] == [(800, 1600, 16_000, 1, 51_200), (1600, 2000, 16_000, 1, 25_600)] and media.audio_metadata(path) == (0, 2000) and media.media_metadata(path) == (2000, 0, 1)
    with pytest.raises(Exception, match="video decoding"):
        media.sql(f"SELECT * FROM video_frames('{path}', 0, 10, 1, 3, false)")

    class Decoder:
        def frames(self, p):
            yield from ((t, 2, 1, b"rgbrgb") for t in (0, 5, 5, 9, 20, 31, None, 40))

    spark.udtf.register("video_frames", table_functions.frames_function(Decoder()))
    media.register_video_frames("frames", MediaRef("file:///v.mp4", "video"), 1, 100, 10, 9, True)
    assert [(r["timestamp_millis"], bytes(r["rgb24"])) for r in media.spark.table("frames").collect()] == [(5, b"rgbrgb"), (20, b"rgbrgb"), (31, b"rgbrgb")]


def test_searches(media):
    media.register_transcript_segments([Segment("m", i, i + 1, f"Hello {i}", Lineage("file:///a.wav", str(i % 2), "op")) for i in range(6)])
    media.register_transcript_segments([Segment("m", 9, 9, "goodbye", L)])
    assert [r["start_millis"] for r in media.transcript_search("hELLO", 4).collect()] == [0, 1, 2, 3] and media.transcript_search("", 10).count() == 7 and media.transcript_search("x", 0).count() == 0
    assert [r["start_millis"] for r in media.plan("SELECT * FROM transcript_search('HELLO', 2) ORDER BY start_millis").collect()] == [0, 1]
    rows = [Embedding(f"e{i}", t, tuple(media.embedder.embed(t)), L) for i, t in enumerate(["red fox", "red dog", "blue whale", "fox"])]
    media.register_embedding_records(rows)
    got = media.semantic_search("red fox", 2).collect()
    assert [r["id"] for r in got][0] == "e0" and got[0]["ranking_semantics"] == "ranked" and got[0]["score"] == pytest.approx(1, abs=1e-6)
    assert [r["id"] for r in media.semantic_search("fox", 4, candidates=2).collect()][0] == "e0"
    hybrid = media.hybrid_search("whale", 4, 0, 0.0).collect()
    assert [(r["id"], r["score"]) for r in hybrid] == [("e2", 1.0), ("e0", 0.0), ("e1", 0.0), ("e3", 0.0)]
    assert [tuple(r) for r in media.plan("SELECT * FROM semantic_search('red fox', 2, 0)").collect()] == [tuple(r) for r in got]
    assert [r["id"] for r in media.plan("SELECT * FROM hybrid_search('whale', 1, 0, 0.0)").collect()] == ["e2"]
    assert {r["ranking_semantics"] for r in media.plan("SELECT * FROM semantic_search('fox', 9, 2)").collect()} == {"approximate"}
    for bad in ([Embedding("z", "t", (1.0,), L)], [Embedding("z", "t", tuple([0.0] * 16), Lineage("file:///b", "1", "op"))]):
        with pytest.raises(EngineError):
            media.register_embedding_records(bad)
    assert media.semantic_search("fox", 10).count() == 4
    for bad in (lambda: media.semantic_search(" "), lambda: media.semantic_search("x", 10_001), lambda: media.hybrid_search("x", 1, 0, 1.5), lambda: media.transcript_search("x", 2000)):
        with pytest.raises(EngineError):
            bad()
    other = Lineage("file:///b", "1", "op")
    media.register_cross_modal_records([Embedding(f"c{i}", "t", (float(i), 1.0), (L, other)[i % 2], ("image", "audio")[i % 2]) for i in range(4)])
    assert [(r["id"], r["kind"]) for r in media.search_cross_modal([1.0, 0.0], L, 5).collect()] == [("c2", "image"), ("c0", "image")]
    with pytest.raises(EngineError):
        media.register_cross_modal_records([Embedding("x", "t", (1.0, 2.0), L)])


def test_unavailable(spark):
    with pytest.raises(Unavailable):
        MediaSession(spark).semantic_search("x")
    with pytest.raises(Unavailable):
        MediaSession(spark).transcribe("file:///a.wav", "audio", L)


def test_transcribe(spark):
    class Speech:
        def transcribe(self, r):
            return [Segment(r.media.uri, 0, 5, "spoken", r.lineage)]

    s = MediaSession(spark, transcription=Speech())
    assert s.transcribe("file:///a.wav", "audio", L, max_segments=3) == 1 and s.transcript_search("SPOKEN", 5).count() == 1
    for bad in (("image", 3), ("audio", 0), ("audio", 2000)):
        with pytest.raises(EngineError):
            s.transcribe("file:///a.wav", bad[0], L, max_segments=bad[1])


def test_sql_and_explain(spark, media):
    spark.range(10).write.mode("overwrite").saveAsTable("default.ten")
    text = media.explain("SELECT id FROM ten WHERE id > 5")
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,5)]" in text and "ReadSchema: struct<id:bigint>" in text and "Parsed Logical Plan" in media.explain("EXPLAIN EXTENDED SELECT 1")
    assert media.sql("SELECT :a + 1 AS x", {"a": 2}) == [{"x": "3"}] and media.sql("SELECT array(1, 2) AS a, named_struct('b', x'01') AS s, x'ff' AS h, NULL AS n") == [{"a": "[1,2]", "s": '{"b":"AQ=="}', "h": "ff", "n": None}]
    with pytest.raises(EngineError, match="one name"):
        media.sql("SELECT 1 AS a, 2 AS a")
    media.plan("CREATE OR REPLACE TEMP VIEW v AS SELECT id * 2 AS d FROM ten")
    media.plan("CREATE TABLE made USING parquet AS SELECT * FROM v")
    media.plan("INSERT INTO made SELECT 100 AS d")
    assert media.sql("SELECT count(*) AS n, max(d) AS m FROM made") == [{"n": "11", "m": "100"}]
    for t in ("made", "ten"):
        spark.sql(f"DROP TABLE {t}")
    assert media.sql_arrow("SELECT 1 AS a").read_all().to_pylist() == [{"a": 1}]
    empty = pa.ipc.open_stream(media.sql_arrow_ipc("SELECT 1 AS a, 'x' AS b WHERE false")).read_all()
    assert empty.num_rows == 0 and empty.column_names == ["a", "b"]


def test_reading_statements(spark):
    for good in ("SELECT 1", " with a AS (SELECT 1) SELECT * FROM a;", "EXPLAIN SELECT 'drop table x'", "(SELECT 1)", "-- c\nSELECT 1", "VALUES (1)", "SHOW TABLES"):
        assert is_reading(good)
    for bad in ("DROP TABLE x", "INSERT INTO x VALUES (1)", "WITH a AS (SELECT 1) INSERT INTO x SELECT * FROM a", "EXPLAIN CREATE TABLE x AS SELECT 1", "SELECT 1; DROP TABLE x", "SET a=b", "CACHE TABLE x"):
        assert not is_reading(bad)
    with pytest.raises(EngineError):
        MediaSession(spark, read_only=True).plan("CREATE TEMP VIEW zz AS SELECT 1")


def test_exports(spark):
    df = spark.sql("SELECT 1 AS a, 'x\"y' AS b UNION ALL SELECT NULL, NULL").orderBy(F.desc_nulls_last("a"))
    out = io.StringIO()
    assert export.write_json(df, out) == 2 and [json.loads(x) for x in out.getvalue().splitlines()] == [{"a": "1", "b": 'x"y'}, {"a": None, "b": None}]
    out = io.StringIO()
    assert export.write_csv(df, out) == 2 and out.getvalue() == '"a","b"\n"1","x""y"\n"",""\n'
    out = io.StringIO()
    assert export.write_csv(df.limit(0), out) == 0 and out.getvalue() == '"a","b"\n'
    nested = spark.sql("SELECT map('k', array(named_struct('x', 1))) AS m, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS t, CAST(1.5 AS DECIMAL(5, 2)) AS d")
    assert export.reader(nested).read_all().to_pylist()[0]["m"] == [("k", [{"x": 1}])]


def test_governed_queries(spark):
    q = Queries(spark, Governor(queries=1))
    first = q.create("SELECT * FROM range(20000)")
    stream = q.run(first)
    assert next(stream).num_rows == 8192 and q.get(first).status == "running"
    other = threading.Thread(target=lambda: failed.append(q.create("SELECT 1")) or _expect(q, failed[0]))
    failed: list = []
    other.start()
    other.join()
    assert q.get(failed[0]).status == "failed" and q.get(failed[0]).error == "resource_exhausted"
    stream.close()
    assert q.get(first).status == "cancelled" and not q.cancel(first)
    done = q.create("SELECT id FROM range(9000)")
    assert sum(b.num_rows for b in q.run(done)) == 9000 and q.get(done).audit()["status"] == "succeeded" and (q.get(done).rows, q.get(done).batches) == (9000, 2)
    with pytest.raises(EngineError):
        next(q.run(done))
    never = q.create("SELECT 1")
    assert q.cancel(never) and q.get(never).status == "cancelled"
    bad = q.create("SELECT nope")
    with pytest.raises(Exception, match="nope"):
        next(q.run(bad))
    assert q.get(bad).status == "failed"
    late = q.create("SELECT count(*) FROM range(100000000000) WHERE sin(id) > 2", seconds=1.5)
    began = time.monotonic()
    with pytest.raises(EngineError) as e:
        list(q.run(late))
    assert e.value.code == "deadline_exceeded" and time.monotonic() - began < 30
    slow = q.create("SELECT count(*) FROM range(100000000000) WHERE sin(id) > 2")
    threading.Timer(1.5, lambda: q.cancel(slow)).start()
    with pytest.raises(EngineError) as e:
        list(q.run(slow))
    assert e.value.code == "cancelled"
    with pytest.raises(EngineError):
        q.get("none")


def _expect(q, query_id):
    with pytest.raises(EngineError):
        next(q.run(query_id))


def test_permits_and_budgets():
    g = Governor(1, 1, 1)
    with g.permit("cpu"), g.permit("cpu"):
        found = []
        t = threading.Thread(target=lambda: found.append(pytest.raises(EngineError, g.permit("cpu").__enter__)))
        t.start()
        t.join()
        assert found[0].value.code == "resource_exhausted"
    with g.permit("cpu"):
        pass
    b = ByteBudget(10)
    with b.take(6), pytest.raises(EngineError), b.take(5):
        pass
    with b.take(10):
        assert b.used == 10
    for bad in (lambda: Governor(0), lambda: ByteBudget(0)):
        with pytest.raises(EngineError):
            bad()


def test_collect_with_progress(media):
    told = []
    assert media.collect_with_progress("SELECT id FROM range(10000)", told.append).num_rows == 10000 and told == [8192, 10000]
    query = media.create_query("SELECT 1 AS x")
    assert media.query_status(query) == "pending" and [b.num_rows for b in media.execute_query(query)] == [1] and media.query_audit(query)["rows"] == 1 and media.cancel_query(query) is False


def test_volumes_and_resolved_tables(spark, media, tmp_path):
    ref = sessions.volume_media_ref("/Volumes/c/s/v/a/b.mp4", "video")
    assert (ref.uri, ref.catalog_ref, ref.metadata) == ("unity-volume://c/s/v/a/b.mp4", "c.s.v", {"volume_path": "/Volumes/c/s/v/a/b.mp4"})
    for bad in ("/Volumes/c/s/v", "/Volumes/c/s/v/../x", "/x/c/s/v/y", "/Volumes/c-d/s/v/y"):
        with pytest.raises(EngineError):
            sessions.volume_media_ref(bad, "video")
    spark.range(4).write.parquet(f"{tmp_path}/p")
    delta.write(spark.range(6), f"{tmp_path}/d")
    base = {"table_type": "EXTERNAL", "storage_location": f"file://{tmp_path}/p", "data_source_format": "PARQUET"}
    tables = [base | {"name": "rp"}, base | {"name": "rd", "data_source_format": "DELTA", "storage_location": f"file://{tmp_path}/d", "table_type": "MANAGED"}, base | {"name": "view", "table_type": "VIEW"}, base | {"name": "far", "storage_location": "s3://b/x"}, base | {"name": "gone", "storage_location": "file:///gone"}]
    assert sessions.attach_schema(media, tables) == (["rp", "rd"], {"view": "unsupported_table", "far": "unsupported_table", "gone": "table_missing"})
    assert media.sql("SELECT (SELECT count(*) FROM rp) + (SELECT count(*) FROM rd) AS n") == [{"n": "10"}]


def test_command_line(spark, tmp_path):
    def run(*args, given=""):
        out = io.StringIO()
        code = cli.main(["--catalog", f"{tmp_path}/c.json", *args], out, io.StringIO(given), spark)
        return code, out.getvalue()

    assert run("init")[0] == 0 and run("register", "clips", "video", "file:///a.mp4", "file:///b.mp4")[0] == 0 and run("register", "clips", "video", "file:///c.mp4")[0] == 0
    assert run("ddl", "SHOW TABLES") == (0, "clips\n") and run("ddl", "DROP TABLE nope")[0] == 1
    assert run("sql", "SELECT media.uri AS u FROM clips")[1] == '{"u": "file:///c.mp4"}\n' and run("sql", "--format", "csv", "SELECT 1 AS a WHERE false")[1] == '"a"\n'
    assert "Physical Plan" in run("explain", "SELECT 1")[1]
    lines = [json.loads(x) for x in run("audit")[1].splitlines()]
    assert [x["status"] for x in lines] == ["succeeded"] * 2 and run("audit", lines[0]["id"])[1].count("\n") == 1
    out = run("shell", given="\\ddl CREATE MEDIA TABLE t2\nSELECT nope\nSELECT 2 AS b\n\\q\nSELECT 3 AS c\n")[1]
    assert out.startswith("t2\n") and "error:" in out and '{"b": "2"}' in out and '"c"' not in out


def test_flight(media):
    server = Server(media, token="key")
    thread = threading.Thread(target=server.serve, daemon=True)
    thread.start()
    try:
        client = Client(f"grpc://127.0.0.1:{server.port}", lambda: "key")
        assert client.query("SELECT id AS a FROM range(3) ORDER BY id").to_pydict() == {"a": [0, 1, 2]}
        info = client.info("SELECT 1 AS a WHERE false")
        assert info.schema.names == ["a"] and client.fetch(info).num_rows == 0
        with pytest.raises(fl.FlightServerError, match="redeemed"):
            client.fetch(info)
        for bad in ("DROP TABLE x", "SELECT nope"):
            with pytest.raises(fl.FlightServerError):
                client.info(bad)
        handle = client.action("prepare", "SELECT 7 AS a")["handle"]
        assert client.query(f"prepared:{handle}").to_pydict() == client.query(f"prepared:{handle}").to_pydict() == {"a": [7]}
        assert client.action("close", handle)["closed"] and client.action("info")["read_only"]
        info = client.info("SELECT 1 AS a")
        assert client.action("cancel", json.loads(info.endpoints[0].ticket.ticket)["query"])["cancelled"]
        with pytest.raises(Exception, match="cancelled"):
            client.fetch(info)
        media.register_media_refs("flights", [])
        assert any(t.endswith("flights") for t in client.tables())
        with pytest.raises(fl.FlightUnauthenticatedError):
            Client(f"grpc://127.0.0.1:{server.port}", lambda: "no").query("SELECT 1")
    finally:
        server.shutdown()
    for bad in (lambda: Server(media, "0.0.0.0"), lambda: Client("grpc://example.org:1")):
        with pytest.raises(EngineError):
            bad()
