"""Audio, timelines, schedules, providers, partitions and metrics."""

import struct
import sys
import wave

import numpy as np
import pytest
from marlstone.model import ByteRange, EngineError, Lineage, MediaRef, Segment, Unavailable, check_uri
from marlstone.operators import audio, metrics, partitions, providers, schedule, timeline
from pyspark.sql import functions as F


def wav(path, samples, rate=16_000, width=2, channels=1):
    with wave.open(str(path), "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(width)
        f.setframerate(rate)
        f.writeframes(samples)
    return str(path)


def test_audio_chunks(tmp_path):
    x = (np.arange(16_000 * 3) % 1000).astype("<i2")
    path = wav(tmp_path / "a.wav", x.tobytes())
    got = audio.decode(path, 500, 2_700, 1_000, 10)
    assert [(c.start_millis, c.end_millis, len(c.samples)) for c in got] == [(500, 1500, 16_000), (1500, 2500, 16_000), (2500, 2700, 3_200)]
    assert np.array_equal(np.concatenate([c.samples for c in got]), x[8_000 : 43_200].astype(np.float32) / np.float32(32768)) and len(got[0].payload) == 64_000
    assert [c.end_millis for c in audio.decode(path, 0, 10**9, 1_000, 2)] == [1000, 2000] and audio.decode(path, 5_000, 9_000, 100, 5) == [] and audio.decode(path, 7, 7, 100, 5) == []
    assert audio.audio_metadata(path) == (0, 3000) and audio.media_metadata(path) == (3000, 0, 1)


@pytest.mark.parametrize(("rate", "channels", "width"), [(8_000, 1, 1), (44_100, 2, 2), (48_000, 2, 3), (32_000, 1, 4)])
def test_audio_resampled(tmp_path, rate, channels, width):
    t = np.arange(rate * 2) / rate
    x = np.repeat(np.sin(2 * np.pi * 200 * t)[:, None], channels, 1)
    raw = ((x * 127 + 128).astype(np.uint8) if width == 1 else (x * (2 ** (8 * width - 1) - 1)).astype("<i4")).tobytes()
    if width in (2, 3):
        raw = np.frombuffer(raw, np.uint8).reshape(-1, 4)[:, :width].tobytes()
    got = np.concatenate([c.samples for c in audio.decode(wav(tmp_path / "b.wav", raw, rate, width, channels), 0, 2_000, 700, 9)])
    assert len(got) == 32_000 and np.abs(got - np.sin(2 * np.pi * 200 * np.arange(32_000) / 16_000))[100:-100].max() < 0.02


def test_audio_bounds(tmp_path):
    for bad in ((0, 10, 0, 1), (0, 10, 5, 0), (0, 10, 5, 2000), (9, 3, 5, 1), (0, 2**63, 5, 1)):
        with pytest.raises(EngineError, match="audio"):
            audio.chunk_samples(*bad)
    with pytest.raises(EngineError) as e:
        audio.chunk_samples(0, 10**7, 10**7, 1)
    assert e.value.code == "payload_budget" and audio.chunk_samples(0, 10**7, 1000, 1) == 16_000
    (tmp_path / "x.mp3").write_bytes(b"ID3 not a wav file")
    with pytest.raises(EngineError) as e:
        audio.probe(str(tmp_path / "x.mp3"))
    assert e.value.code == "unsupported_container"
    (tmp_path / "law.wav").write_bytes(b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<IHHIIHH", 16, 7, 1, 8000, 8000, 1, 8) + b"data\x04\0\0\0abcd")
    with pytest.raises(EngineError) as e:
        audio.probe(str(tmp_path / "law.wav"))
    assert e.value.code == "unsupported_codec"


def test_assembler_gaps_and_overlaps():
    a = audio.Assembler(1, 4, 16, 9, 2)
    a.push(-20, np.ones(30, np.float32))  # ends before the window
    a.push(20, np.full(10, 2, np.float32))  # the grid begins here
    a.push(31, np.full(5, 3, np.float32))  # one late: no gap
    a.push(45, np.full(4, 4, np.float32))  # a gap of ten
    a.push(40, np.full(15, 5, np.float32))  # overlaps
    got = a.finish()
    assert [(c.start_millis, c.end_millis, len(c.samples)) for c in got] == [(1, 2, 16), (2, 3, 16), (3, 3, 3)]
    assert np.concatenate([c.samples for c in got]).tolist() == [2] * 10 + [3] * 5 + [0] * 10 + [4] * 4 + [5] * 6
    b = audio.Assembler(0, 2, 16, 1)
    b.push(0, np.ones(99, np.float32))
    assert b.finished and len(b.finish()) == 1


def test_frame_sampling_by_hand(spark):
    rng = np.random.default_rng(1)
    rows = [(k, int(t)) for k in ("a", "b", None) for t in rng.integers(0, 5000, 400)] + [("a", None)]
    df = spark.createDataFrame(rows, "uri string, millis bigint")
    want = []
    for k in ("a", "b", None):
        following = -1
        for t in sorted({t for u, t in rows if u == k and t is not None}):
            if t >= following:
                want.append((k, t))
                following = t + 70
    assert sorted(map(tuple, timeline.sample_frames(df, 70).collect()), key=str) == sorted(want, key=str)
    assert [r["millis"] for r in timeline.plan_frames(df.where("uri = 'a'"), 100, 900, 3).collect()] == sorted(t for u, t in rows if u == "a" and t is not None and 100 <= t <= 900)[:3]


def test_allowed_window():
    grid = [(s, s + 10) for s in range(0, 100, 10)]
    ops = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "=": lambda a, b: a == b}
    for name, k in (("start_millis", 0), ("end_millis", 1)):
        for op, f in ops.items():
            for v in range(0, 110, 5):
                low, high = timeline.allowed_window(0, 100, [(name, op, v)], 10)
                assert low % 10 == 0 and {g for g in grid if f(g[k], v)} <= {g for g in grid if low <= g[0] < high}


L = Lineage("file:///a.wav", "1", "op", "m", "2", {"k": "v"})
MEDIA = MediaRef("file:///a.wav", "audio")


class Fixed:
    def __init__(self, rows):
        self.rows, self.asked = rows, []

    def transcribe(self, request):
        self.asked.append(request)
        return self.rows


def test_schedule():
    work = [schedule.Work(i, c, s) for i, c, s in (("c", 9, 1), ("a", 5, 2), ("b", 6, 1), ("d", 1, 1), ("e", 1, 9))]
    got = schedule.build(work, schedule.Limits(3, 10, 4, 2))
    assert [w.id for w in got.admitted] == ["a", "d"] and got.skipped == ("b", "c", "e") and (got.cost, got.segments) == (6, 3) and [len(w) for w in got.waves()] == [2]
    for bad in ([schedule.Work(" ", 1, 1)], [schedule.Work("x", 1, 1)] * 2):
        with pytest.raises(EngineError):
            schedule.build(bad, schedule.Limits(1, 1, 1, 1))
    with pytest.raises(EngineError):
        schedule.Limits(0, 1, 1, 1)
    with pytest.raises(EngineError):
        schedule.CostModel(1, 2**63).cold(4)


def test_media_search(spark):
    from marlstone import model

    limits, rows = schedule.Limits(1, 100, 10, 1), [Segment("file:///a.wav", i, i + 1, f"Word {i}", L) for i in range(5)]
    index = spark.createDataFrame([(*r.row(), i) for i, r in enumerate(rows)], model.SEGMENTS)
    request = schedule.SearchRequest(MEDIA, L, "wORD", 3, 4, schedule.CostModel(1, 10))
    cold = Fixed(rows)
    assert schedule.explain(index, request, limits).strategy == "persisted_index" and schedule.strategy(index, L) == "indexed"
    assert [r[1] for r in schedule.matching_segments(index, request, limits, cold)] == [0, 1, 2] and not cold.asked
    none = index.limit(0)
    found = schedule.explain(none, request, limits)
    assert (found.strategy, found.cost, len(found.schedule.admitted)) == ("cold_extraction", 40, 1)
    assert [r[1] for r in schedule.matching_segments(none, request, limits, cold)] == [0, 1, 2] and cold.asked[0].max_segments == 4
    assert schedule.matching_segments(none, request, schedule.Limits(1, 39, 10, 1), cold) == []
    with pytest.raises(EngineError, match="lineage"):
        schedule.matching_segments(none, request, limits, Fixed([Segment("file:///a.wav", 0, 1, "word", Lineage("file:///a.wav", "2", "op"))]))
    with pytest.raises(Unavailable):
        schedule.matching_segments(none, request, limits, providers.NoProvider("transcription"))
    with pytest.raises(EngineError):
        schedule.SearchRequest(MediaRef("file:///b", "audio"), L, "x", 1, 1, schedule.CostModel(1, 1))
    assert len(schedule.cold_segments(cold, [MEDIA, MEDIA], "word", L, 7)) == 7


def test_providers(spark):
    e = providers.HashEmbedder(8)
    v = np.array(e.embed("The the cat"))
    assert abs(np.linalg.norm(v) - 1) < 1e-6 and v[providers.fnv1a(b"the") % 8] > v[providers.fnv1a(b"cat") % 8] and e.embed("") == [0.0] * 8
    assert providers.fnv1a(b"") == 0xCBF29CE484222325 and providers.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    got = spark.createDataFrame([("The the cat",), (None,)], "t string").select(providers.embed_column(e, F.col("t")).alias("v")).collect()
    assert np.allclose(got[0]["v"], v) and got[1]["v"] is None
    with pytest.raises(Unavailable):
        providers.NoProvider("image metadata").inspect(None)
    request = providers.ImageRequest(b"x", None, L, 1)

    class Ocr:
        def recognize(self, r):
            return [providers.OcrText(i, "t", L) for i in range(2)]

    with pytest.raises(EngineError, match="more than 1"):
        providers.run_ocr(Ocr(), request)
    for bad in ((b"x" * ((32 << 20) + 1), 1), (b"x", 0)):
        with pytest.raises(EngineError):
            providers.ImageRequest(bad[0], None, L, bad[1])


def test_programs():
    code = "import json,sys; r=json.load(sys.stdin); print(json.dumps({'vectors': [[1.0, float(len(t))] for t in r['texts']]}))"
    own = providers.ProgramEmbedder(providers.Program((sys.executable, "-c", code)), 2)
    assert own.embed_all(["ab", "c"]) == [[1.0, 2.0], [1.0, 1.0]]
    with pytest.raises(EngineError, match="right length"):
        providers.ProgramEmbedder(own.program, 3).embed("x")
    for code, kind in (("import time; time.sleep(9)", "deadline"), ("import sys; sys.exit(3)", "provider_failed"), ("print('no json')", "provider_answer")):
        with pytest.raises(EngineError) as e:
            providers.Program((sys.executable, "-c", code), seconds=0.5).ask({})
        assert e.value.code == kind
    with pytest.raises(EngineError) as e:
        providers.Program((sys.executable, "-c", "import time; time.sleep(9)")).ask({}, lambda: True)
    assert e.value.code == "cancelled"
    code = "import json,sys; json.load(sys.stdin); print(json.dumps({'segments': [{'start_millis': a, 'end_millis': a + 5, 'text': 't'} for a in (0, 50, 200)]}))"
    rows = providers.ProgramTranscription(providers.Program((sys.executable, "-c", code))).transcribe(providers.TranscriptionRequest(MEDIA, L, 10, 100))
    assert [(r.start_millis, r.lineage) for r in rows] == [(50, L)]


def test_values():
    for bad in ("no/scheme", "https://u:p@h/x", "https://h/x?Sig=1", "https://h/x?a=1&X-Amz-Signature=z"):
        with pytest.raises(EngineError):
            check_uri(bad)
    assert check_uri("https://h/x?x-amz-credential=1") and len(ByteRange(2, 5, 8)) == 3 and L.is_compatible_with(Lineage(**L.plain())) and not L.is_compatible_with(Lineage("file:///a.wav", "1", "op", "m", "2"))
    for bad in ((5, 5, 8), (2, 9, 8)):
        with pytest.raises(EngineError):
            ByteRange(*bad)
    with pytest.raises(EngineError):
        Segment("x", 2, 1, "t", L)


def test_partitions(spark):
    assert partitions.stable_partition("a", "1", 7) == providers.fnv1a(b"a\x001") % 7
    df = spark.createDataFrame([(f"u{i % 30}", str(i % 2)) for i in range(90)], "uri string, source_version string")
    got = partitions.ordered_results(partitions.tasks(df, 4)).collect()
    assert len(got) == 30 and all(r["partition"] == partitions.stable_partition(r["uri"], r["source_version"], 4) for r in got)
    assert [r["ordinal"] for r in got if r["partition"] == got[0]["partition"]] == list(range(sum(r["partition"] == got[0]["partition"] for r in got)))
    assert partitions.checked(df.distinct(), df.distinct()).count() == 30
    with pytest.raises(EngineError, match="missing"):
        partitions.checked(df, df.where("uri != 'u3'").distinct())
    assert partitions.on_driver([1, 2], lambda x: x + 1) == [2, 3]


def test_word_error_rate(spark):
    assert metrics.word_error_rate("The cat sat", "the cat") == pytest.approx(1 / 3) and metrics.word_error_rate("a b", "x a b y") == 1 and metrics.word_error_rate("It's 5", "its 5") == pytest.approx(2 / 3)
    rng = np.random.default_rng(5)

    def slow(a, b):
        d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        return d[len(a), len(b)]

    for _ in range(30):
        a, b = rng.integers(0, 4, rng.integers(0, 12)).tolist(), rng.integers(0, 4, rng.integers(0, 12)).tolist()
        assert metrics.edit_distance(a, b) == slow(a, b)
    got = metrics.corpus_error_rate(spark.createDataFrame([("x", "a b", "a"), ("x", "c", "d"), ("y", None, "q")], "k string, reference string, found string"), "k").orderBy("k").collect()
    assert [tuple(r) for r in got] == [("x", 2, 3, pytest.approx(2 / 3)), ("y", 1, 0, None)]
    assert metrics.accepted(0.25, 0.4, 0) and not metrics.accepted(0.1, 0.1, 1)
    with pytest.raises(EngineError):
        metrics.word_error_rate("...", "x")
