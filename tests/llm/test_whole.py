"""The operators do the whole job on inputs that ordinary tables have few of."""

import random

import pytest
from marlstone.llm import langid, mixing
from pyspark.sql import functions as F

from tests import oracle

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _run(letters, n, seed):
    return "".join(random.Random(seed).choices(letters, k=n))


@pytest.fixture(scope="module")
def unspaced(spark):
    """A model of two languages that are only labelled with runs of 41 letters or more, and one with ordinary words."""
    rows = [(i, _run("abcdef" if i % 2 else "uvwxyz", 41 + 20 * (i % 9), i), "aa" if i % 2 else "uu", None, None) for i in range(60)]
    rows += [(i, " ".join(_run("ghijkl", 5, 7 * i + k) for k in range(40)), "gg", None, None) for i in range(60, 90)]
    return langid.learn(spark.createDataFrame(rows, DOCS), F.lit(True))


def test_language_learned_from_long_runs(unspaced):
    assert unspaced.langs == ["aa", "gg", "uu"]
    texts = [_run("abcdef", 30, 1), _run("uvwxyz", 3000, 2), " ".join(_run("ghijkl", 5, k) for k in range(30))]
    assert langid.Predictor(unspaced).predict(texts)[0] == ["aa", "uu", "gg"]


def test_long_run_read_whole(unspaced, monkeypatch):
    text = _run("abcdef", 60, 3) + _run("uvwxyz", 5000, 4)
    langs, scores = langid.Predictor(unspaced).predict([text])
    assert langs == ["uu"]
    rows = unspaced.backoff(text)
    assert abs(unspaced.mean(text) - unspaced.table[rows].mean(0, dtype="float64")).max() < 1e-6
    monkeypatch.setattr(langid, "PIECE", 7)
    assert [g for own in langid.pieces(text, 5) for g in own] == langid.grams(text, 5)
    assert langid.Predictor(unspaced).predict([text])[1] == pytest.approx(scores)


def test_every_language_is_learned(spark):
    rows = [(i, _run("abcdefghij", 12, i), f"l{i:04}", None, None) for i in range(1100)]
    assert langid.learn(spark.createDataFrame(rows, DOCS), F.lit(True)).langs == [r[2] for r in rows]


def test_leaf_without_words_comes_in_every_epoch(spark, tmp_path):
    texts = [(1, None), (2, ""), (3, " \t\n"), (None, None)]
    rows = [(i, t, "en", "web-1", None) for i, t in texts] + [(10 + i, "a b c d e", "de", "web-2", None) for i in range(20)]
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r["doc_id"], r["epoch"]) for r in mixing.mix(docs).where("lang = 'en'").collect()]
    assert sorted(got, key=str) == sorted(((i, e) for i, _ in texts for e in range(mixing.EPOCHS)), key=str)
    assert oracle.difference(mixing.mix(docs), str(tmp_path), mixing.oracle_sql()) is None
    assert mixing.select_documents(docs, 0.5).where("lang = 'en'").count() == len(texts)
