"""The ten operators and the pipeline: nulls, empty and long texts, ties, repeats, empty tables, clashing columns, and brute force where SQL can't say it."""

import base64
import random
import re
import zlib

import numpy as np
import pytest
from marlstone.llm import chat, embed_dedup, exact_dedup, langid, minhash, mixing, packing, quality, queries, secrets, warc
from pyspark.sql import functions as F

from tests import oracle

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    assert oracle.difference(queries.queries()[name](spark, SF), SF, queries.oracle_sql()[name]) is None


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, repeated and very long rows, beside columns with the names that operators use inside."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    long = " ".join(random.Random(1).choice(words) + str(i % 977) for i in range(60_000))
    rows = [(1, None, None, None, None), (2, "", "en", "web-1", 0), (3, " \t\n", None, "web-2", 3), (4, long, "en", "web-1", len(long)), (5, long + " tail", "de", "web-1", None), (6, "one two", "en", None, 7), (6, "one two", "en", None, 7), (None, "one  two", "fr", "x", 8), (8, "½ ² 123 ...", "es", "web-3", 11)]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("id", "cls", "run", "rank", "salt", "score", "check", "__text", "kept"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def test_odd_rows(spark, odd):
    exact = {r["doc_id"]: r for r in exact_dedup.exact_groups(odd).collect() if r["doc_id"] is not None}
    assert [exact[k]["keep_id"] for k in (1, 2, 3)] == [3, 3, 3] and exact[1]["group_size"] == 3 and exact[6]["group_size"] == 3
    assert exact_dedup.drop_exact_duplicates(odd).columns == odd.columns
    near = {r["doc_id"]: r for r in minhash.near_groups(odd).collect()}
    assert near[5]["component_id"] == 4 and near[1]["n_shingles"] == 0 and near[1]["kept"] and near[None]["component_id"] is None
    assert minhash.drop_near_duplicates(odd).columns == odd.columns
    model = langid.learn(odd, F.lit(True))
    found = {r["doc_id"]: r for r in langid.identify(odd.select("doc_id", "text"), model).collect()}
    assert found[1]["lang_pred"] == found[2]["lang_pred"] == found[8]["lang_pred"] == "und" and found[4]["lang_pred"] in model.langs
    machine = quality.learn(odd, spark.createDataFrame([(4, 1), (2, 0), (2, 1), (None, 1), (6, None)], "doc_id bigint, quality int"), F.lit(True))
    assert all(0 <= r["score"] <= 1 for r in quality.score(odd, machine, keep=["doc_id"]).collect())
    spans = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(odd, keep=["doc_id"]).collect()}
    assert spans[1] == [] and len(spans) == 8
    assert mixing.mix(odd).count() > 0 and mixing.select_documents(odd, 0.5).columns == odd.columns
    pieces = packing.pack(odd, with_ids=True).toPandas()
    assert pieces[pieces.doc_id == 1].length.tolist() == [1] and pieces.length.max() <= 2048


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    model = langid.learn(none, F.lit(True))
    machine = quality.learn(none, spark.createDataFrame([], "doc_id bigint, quality int"), F.lit(True))
    for df in (
        exact_dedup.exact_groups(none), minhash.near_groups(none), mixing.mix(none), mixing.select_documents(none, 0.5), packing.pack(none), langid.identify(none, model), quality.score(none, machine),
        secrets.find_secrets(none), chat.rotate(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")), embed_dedup.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")),
        warc.round_trip(spark, spark.createDataFrame([], "page_id bigint, url string, html string")),
    ):
        assert df.count() == 0


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = queries.op1_language_id(spark, SF).join(docs, "doc_id").where("held_out and lang is not null").toPandas()
    assert (got.lang == got.lang_pred).mean() >= 0.95 and got.score.between(0, 1).all()


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op6_quality_fm(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out and quality is not null").toPandas()
    assert (got.predicted == got.quality).mean() >= 0.95


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    m = quality.Machine(0.1, rng.normal(size=quality.SIZE).astype(np.float32), rng.normal(size=(quality.SIZE, 8)).astype(np.float32) / 9, np.zeros(28, np.float32), np.ones(28, np.float32))
    at, x, s = np.array([3, 70, 900]), np.array([0.5, 0.2, 0.8], np.float32), rng.normal(size=28).astype(np.float32)
    full = np.zeros(quality.SIZE)
    full[at], full[quality.BUCKETS :] = x, m.standard(s)
    pairs = sum(m.v[i] @ m.v[j] * full[i] * full[j] for i in np.flatnonzero(full) for j in np.flatnonzero(full) if i < j)
    assert abs(m.score(at, x, s) - 1 / (1 + np.exp(-(m.w0 + full @ m.w + pairs)))) < 1e-4


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = packing.pack(docs, with_ids=True).toPandas().sort_values(["doc_id", "piece"])
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for doc, g in got.groupby("doc_id"):
        ids = np.array([*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 0], "<u4")
        assert b"".join(g.ids) == ids.tobytes() and g.start.tolist() == list(range(0, len(ids), 2048))
        assert [zlib.crc32(x) for x in g.ids] == g.ids_crc32.tolist()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 2048
    assert got.sequence_id.nunique() <= 1.03 * -(-got.length.sum() // 2048) + 1


def _der(tag, body):
    return bytes([tag]) + (bytes([len(body)]) if len(body) < 128 else b"\x82" + len(body).to_bytes(2, "big")) + body


def test_secrets_confirmed():
    spki = _der(0x30, _der(0x30, _der(6, bytes.fromhex("2b6570"))) + _der(3, b"\0" + bytes(range(32))))
    pkcs1 = _der(0x30, b"".join(_der(2, bytes([1] * n)) for n in (1, 128, 3, 128, 64, 64, 64, 64, 64)))
    ssh = b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-ed25519", bytes(range(32))))
    token = base64.urlsafe_b64encode(b'{"alg":"HS256"}').decode().rstrip("=") + ".e30." + "s" * 10
    for raw, kind in ((spki, "der_key"), (pkcs1, "der_key"), (ssh, "ssh_key")):
        for coded in (base64.b64encode(raw).decode(), raw.hex()):
            assert kind in {k for _, _, k in secrets.scan(f"see {coded} end")}
        broken = base64.b64encode(raw[:-1]).decode()
        assert kind not in {k for _, _, k in secrets.scan(f"see {broken} end")}
    assert secrets.scan(f"x {token}")[-1][2] == "token"
    assert {k for _, _, k in secrets.scan("e" * 60 + " " + "QUJD" * 20)} == {"hex"}


def test_secrets_base(spark):
    kinds = {"assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6), "access": ("AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), "hex": ("[0-9a-f]+", lambda m: len(m[0]) >= 24)}
    for r in secrets.find_secrets(spark.read.parquet(f"{SF}/documents.parquet"), keep=["text"]).collect():
        for kind, (pattern, fits) in kinds.items():
            assert [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == kind] == [m.span() for m in re.finditer(pattern, r["text"] or "") if fits(m)]


def test_warc_odd(spark):
    body = "é" * 60
    rows = [(1, "u", None), (2, None, body), (3, "u", body), (3, "u", body), (2, "u", body), (None, "u", body), (5, "u", "short"), (6, "u", "short")]
    got = sorted(warc.round_trip(spark, spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect(), key=str)
    assert len(got) == 8 and {(r["page_id"], r["record_type"], r["refers_to"]) for r in got} == {(1, "response", None), (2, "response", None), (3, "revisit", 2), (None, "response", None), (5, "response", None), (6, "response", None)}


def test_warc_damage(tmp_path):
    raw = warc.page_record(1, "u", b"x" * 300, __import__("hashlib").sha256(b"x" * 300).hexdigest(), None)
    whole = tmp_path / "a"
    whole.write_bytes(raw * 2)
    assert [r.payload for r in warc.read_archive(f"file://{whole}")] == [b"x" * 300] * 2
    whole.write_bytes(raw[:-9])
    with pytest.raises(warc.Damaged):
        list(warc.read_archive(f"file://{whole}"))


def test_near_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(1, 9)):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own))
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if 100 * k >= 85 * (len(sets[i]) + len(sets[j]) - k):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    got = minhash.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), 3, 85, 100).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(root))


def test_vectors_brute_force(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 16))
    x = np.concatenate([c + 0.25 * rng.normal(size=(30, 16)) for c in centers]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, x[0].tolist()), (904, [1.0, None]), (905, [1.0, 0.0])]
    u = np.concatenate([x, x[:1]]).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links = (u @ u.T >= 0.9).sum(1) - 1
    got = {r["vec_id"]: r for r in embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()}
    assert [got[i]["n_links"] for i in [*range(len(x)), 903]] == links.tolist()
    assert got[903]["component_id"] == got[0]["component_id"] and all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (900, 901, 902, 904, 905))


def test_rotation_odd(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", None), (1, 2, None, "hi"), (1, None, "ann", "bye"), (None, 1, "bob", "x"), (2, 0, "system", "alone")]
    got = {(r["conv_id"], r["perspective"]): r for r in chat.rotate(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert set(got) == {(1, "ann"), (1, "unknown"), (None, "bob")}
    r = got[1, "ann"]
    assert r["text"].startswith("<|system|>\nbe kind<|end|>\n<|assistant|>\n<|end|>\n<|user name=unknown|>\nhi") and [r["text"][s["start"] : s["end"]] for s in r["mask"]] == ["<|end|>\n", "bye<|end|>\n"]


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, columns = docs.count(), docs.columns
    for _, step in pipeline.STAGES[:-1]:
        docs = pipeline.stage(step(spark, docs, SF), "test")
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert {r["doc_id"] for r in pipeline.run(spark, SF).select("doc_id").collect()} == kept
